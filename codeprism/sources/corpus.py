"""Relations of a code index projected from star-schema tables, in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SYMBOLS = """SELECT p_partkey AS id,
   replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS STRING) AS name,
   lower(replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS STRING)) AS name_lower,
   'src/' || replace(p_brand, '#', '') || '/' || p_type || '.bsl' AS file_path, p_size AS line,
   CASE WHEN p_type IN ('ECONOMY', 'PROMO', 'SMALL') THEN 'procedure' WHEN p_type IN ('STANDARD', 'MEDIUM') THEN 'function' ELSE 'variable' END AS kind,
   CASE WHEN p_size % 4 = 0 THEN 1 ELSE 0 END AS is_export FROM {part}"""

#: Every line item is a call; those of every tenth part name a method outside the index, so some symbols have no caller.
CALLS = """SELECT s.file_path AS caller_file, CAST(l_orderkey AS INT) AS caller_line,
   CASE WHEN l_linenumber = 7 THEN NULL ELSE s.name END AS caller_name, CASE WHEN t.id % 10 = 3 THEN 'External_' ELSE '' END || t.name AS callee_name,
   CASE WHEN t.id % 10 = 3 THEN 'external_' ELSE '' END || t.name_lower AS callee_name_lower, l_linenumber AS callee_args_count
   FROM {lineitem} JOIN ({symbols}) s ON s.id = l_orderkey % {n} JOIN ({symbols}) t ON t.id = l_partkey"""

#: Body lines by l_orderkey modulo their number; statements of several lines, calls and literals that run over lines among them.
TEMPLATES: dict[int, tuple[str, ...]] = {
    0: ("'    Password = \"secret' || CAST(l_partkey AS STRING) || '\";'",), 1: ("'    Total = Total;'",),
    2: ("'    // TODO: check ' || CAST(l_linenumber AS STRING)",), 3: ("'    Message(\"debug\");  // noqa: BSL138'",),
    4: ("'    Addr = \"192.168.1.' || CAST(l_linenumber AS STRING) || '\";'",), 5: ("'//no space'",), 6: ("'    A = 1; B = 2;'",), 7: ("''", "'    Sum = ' || t.name || '(1);'"),
    8: ("'    Text = \"' || repeat('x', 130) || '\";'",), 9: ("chr(9) || 'Message(\"x\");   '",), 10: ("'    Return ' || CAST(l_linenumber AS STRING) || ';'",),
    11: ("'    ' || t.name || '(' || CAST(l_linenumber AS STRING) || ', P1);'",),
    12: ("'    If P1 = True Then'", "'        A = 17;'", "'    EndIf;'"), 13: ("'    While True Do'", "'        B = B + \"x\";'", "'    EndDo;'"),
    14: ("'    Try'", "'        C = Query.Execute();'", "'    Except'", "'    EndTry;'"), 15: ("'    For Each Item In Items Do'", "'        Obj = New Query;'", "'    EndDo;'"),
    16: ("'    If Not Ready Then'", "'        Return;'", "'    Else'", "'    EndIf;'"), 17: ("'#Region Private'", "'#EndRegion'"),
    18: ("'    Goto ~Label;'", "'    // BSLLS:UseOfDebugOutput-off'", "'    Message(\"off\");'", "'    // BSLLS:UseOfDebugOutput-on'"), 19: ("'    Result = ?(P1, True, False);'",),
    20: ("'    Query.Text = \"SELECT A, Message(B)'", "'    |FROM Goods AS G // rows'", "'    |WHERE A = \"\"x\"\"\";'"), 21: ("'    ' || t.name || '(Name(1, \"a,b\"),'", "'        2, , 3);'"),
    22: ("'    For Each Row In Rows Do'", "'        Query.Text = \"SELECT TOP 5 A FROM T\";'", "'    EndDo;'"), 23: ("'    Draft = 1;'", "'    Draft = Draft2;'", "'    Draft = 3;'"), 24: ("'    Var Temp, Spare;'", "'    P2 = 1;'"),
    25: ("'    If P1 Then'", "'        Done();'", "'    Else'", "'        Done();'", "'    EndIf;'"), 26: ("'    List = New Array;'", "'    Other = List;'", "'    For Each Row In Other Do'", "'        Row = 0;'", "'    EndDo;'"),
    27: ("'    Try'", "'        Name(1);'", "'    Except'", "'        Info = ErrorInfo();'", "'    EndTry;'"),
}
CASES, LONGEST = len(TEMPLATES), max(map(len, TEMPLATES.values()))
_TEXT = f"CASE l_orderkey % {CASES} * {LONGEST} + k4 " + " ".join(f"WHEN {case * LONGEST + k} THEN {text}" for case, lines in TEMPLATES.items() for k, text in enumerate(lines)) + " END"
_SIZES = ", ".join(str(len(TEMPLATES[case])) for case in range(CASES))

#: Methods with the lines of their items; variables are declared first, and their items' lines are the module's own, behind the last method.
SOURCE_LINES = f"""SELECT file_path, CAST(row_number() OVER (PARTITION BY file_path ORDER BY pid, sec, k1, k2, k3, k4) AS INT) AS line, text FROM (
  SELECT file_path, id AS pid, 0 AS sec, 0 AS k1, 0 AS k2, 0 AS k3, 0 AS k4, '// Does the work of ' || name || '.' AS text FROM ({{symbols}}) d WHERE kind <> 'variable' AND id % 3 = 0
  UNION ALL SELECT file_path, id, 1, 0, 0, 0, 0, CASE kind WHEN 'function' THEN 'Function ' ELSE 'Procedure ' END || name || CASE WHEN id % 7 = 0 THEN '(P1, P2 = 1, P3, Val P4)' ELSE '(P1, Val P2 = "a,b")' END || CASE WHEN is_export = 1 THEN ' Export' ELSE '' END FROM ({{symbols}}) h WHERE kind <> 'variable'
  UNION ALL SELECT DISTINCT file_path, -2000000000, 0, 0, 0, 0, 0, 'Var Total, Sum Export;' FROM ({{symbols}}) o
  UNION ALL SELECT file_path, id - 1000000000, 1, 0, 0, 0, 0, 'Var ' || name || CASE WHEN is_export = 1 THEN ' Export' ELSE '' END || ';' FROM ({{symbols}}) v WHERE kind = 'variable'
  UNION ALL SELECT * FROM (SELECT file_path, pid, 2, CAST(l_orderkey AS INT), l_linenumber, CAST(l_partkey * 10000000 + l_suppkey * 100 + l_quantity AS BIGINT), k4, {_TEXT} AS text
    FROM (SELECT s.file_path, CASE WHEN s.kind = 'variable' THEN s.id + 1000000000 ELSE s.id END AS pid, t.name, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, {{each}} AS k4 FROM {{lineitem}} JOIN ({{symbols}}) s ON s.id = l_orderkey % {{n}} JOIN ({{symbols}}) t ON t.id = l_partkey) t) b WHERE text IS NOT NULL
  UNION ALL SELECT file_path, id, 3, 0, 0, 0, 0, CASE kind WHEN 'function' THEN 'EndFunction' ELSE 'EndProcedure' END FROM ({{symbols}}) f WHERE kind <> 'variable') body"""

#: The same rows for Spark: an item's lines stay one row until the item has its place, so shuffle and sort see items and not lines. Items equal in all
#: keys have equal texts; ``m`` of them take turns line by line, as the order above has it.
_TEXTS = f"array_compact(CASE CAST(l_orderkey % {CASES} AS INT) " + " ".join(f"WHEN {case} THEN array({', '.join(lines)})" for case, lines in TEMPLATES.items()) + " END)"
SPARK_LINES = f"""SELECT file_path, CAST(upto - m * size(texts) + k4 * m + nth AS INT) AS line, text FROM (
  SELECT file_path, texts, sum(size(texts)) OVER w AS upto, count(*) OVER (PARTITION BY file_path ORDER BY pid, sec, k1, k2, k3 RANGE BETWEEN CURRENT ROW AND CURRENT ROW) AS m, row_number() OVER w - rank() OVER w + 1 AS nth FROM (
  SELECT file_path, id AS pid, 0 AS sec, 0 AS k1, 0 AS k2, 0 AS k3, array('// Does the work of ' || name || '.') AS texts FROM ({{symbols}}) d WHERE kind <> 'variable' AND id % 3 = 0
  UNION ALL SELECT file_path, id, 1, 0, 0, 0, array(CASE kind WHEN 'function' THEN 'Function ' ELSE 'Procedure ' END || name || CASE WHEN id % 7 = 0 THEN '(P1, P2 = 1, P3, Val P4)' ELSE '(P1, Val P2 = "a,b")' END || CASE WHEN is_export = 1 THEN ' Export' ELSE '' END) FROM ({{symbols}}) h WHERE kind <> 'variable'
  UNION ALL SELECT DISTINCT file_path, -2000000000, 0, 0, 0, 0, array('Var Total, Sum Export;') FROM ({{symbols}}) o
  UNION ALL SELECT file_path, id - 1000000000, 1, 0, 0, 0, array('Var ' || name || CASE WHEN is_export = 1 THEN ' Export' ELSE '' END || ';') FROM ({{symbols}}) v WHERE kind = 'variable'
  UNION ALL SELECT s.file_path, CASE WHEN s.kind = 'variable' THEN s.id + 1000000000 ELSE s.id END, 2, CAST(l_orderkey AS INT), l_linenumber, CAST(l_partkey * 10000000 + l_suppkey * 100 + l_quantity AS BIGINT), {_TEXTS}
    FROM {{lineitem}} JOIN ({{symbols}}) s ON s.id = l_orderkey % {{n}} JOIN ({{symbols}}) t ON t.id = l_partkey
  UNION ALL SELECT file_path, id, 3, 0, 0, 0, array(CASE kind WHEN 'function' THEN 'EndFunction' ELSE 'EndProcedure' END) FROM ({{symbols}}) f WHERE kind <> 'variable') body
  WINDOW w AS (PARTITION BY file_path ORDER BY pid, sec, k1, k2, k3)) placed LATERAL VIEW posexplode(texts) e AS k4, text"""

META_OBJECTS = "SELECT n_name AS name, lower(n_name) AS name_lower, r_name AS kind, n_nationkey AS seq FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"
META_MEMBERS = """SELECT n_name AS object_name, lower(n_name) AS object_name_lower, c_name AS name, lower(c_name) AS name_lower, c_mktsegment AS kind FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
   UNION ALL SELECT n_name, lower(n_name), s_name, lower(s_name), 'attribute' FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"""

TABLES = ("part", "lineitem", "nation", "region", "customer", "supplier")
VIEWS = {"symbols": SYMBOLS, "calls": CALLS, "source_lines": SOURCE_LINES, "meta_objects": META_OBJECTS, "meta_members": META_MEMBERS}


def oracle(query: str) -> str:
    """``query`` over the projected relations as DuckDB SQL over the plain tables."""
    names = {t: t for t in TABLES} | {"symbols": "SELECT * FROM symbols", "n": "(SELECT count(*) FROM part)", "each": f"unnest(range([{_SIZES}][l_orderkey % {CASES} + 1]))"}
    views = ", ".join(f"{v} AS ({sql.format(**names)})" for v, sql in VIEWS.items())
    rest = query.lstrip()
    if rest.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views}, {rest[14:]}"
    return f"WITH {views}, {rest[4:]}" if rest.upper().startswith("WITH") else f"WITH {views} {rest}"


def relation(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """One of ``VIEWS`` as a DataFrame; the number of parts enters as a constant, not as a cross join."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    sql = SPARK_LINES if view == "source_lines" else VIEWS[view]
    tables = {t: read(t) for t in TABLES if "{" + t + "}" in sql}
    if "{symbols}" in sql:
        tables["part"] = read("part")
        sql = sql.replace("{symbols}", SYMBOLS)
    if "{n}" in sql:
        sql = sql.replace("{n}", str(max(1, tables["part"].count())))
    return spark.sql(sql, **{k: v for k, v in tables.items() if "{" + k + "}" in sql})
