"""Completion, combined search and nested reports over the projected relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeprism.operators import completion, index, reporting, rules, syntax
from codeprism.plans.lint_queries import DEFAULT
from codeprism.plans.syntax_queries import CALLS
from codeprism.sources.corpus import oracle, relation

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda view: relation(spark, sf_dir, view))
        if sql:
            SQL[name] = oracle(sql)
        return f

    return add


def _facts(r):
    return rules.line_facts(r("source_lines"))


def _chains(r):
    """Each object behind its collection (its members by s), behind the root (by c), each collection (by the first letter of its objects), and names alone."""
    o = r("meta_objects")
    asks = [o.select(F.concat(F.lit("a:"), "name").alias("ask"), F.concat_ws(".", F.translate("kind", " ", "_"), "name").alias("chain"), F.lit("s").alias("prefix"))]
    asks.append(o.select(F.concat(F.lit("b:"), "name").alias("ask"), F.concat_ws(".", F.lit("Metadata"), F.translate("kind", " ", "_"), "name").alias("chain"), F.lit("C").alias("prefix")))
    asks.append(o.select(F.concat(F.lit("c:"), "name").alias("ask"), F.translate("kind", " ", "_").alias("chain"), F.left("name", F.lit(1)).alias("prefix")))
    asks.append(o.select(F.concat(F.lit("d:"), "name").alias("ask"), F.concat("name", F.lit(".Other")).alias("chain"), F.lit("").alias("prefix")))
    out = asks[0]
    for a in asks[1:]:
        out = out.unionByName(a)
    return out


def _objects(r):
    """Objects and members whose kinds and names are words, as chains want them."""
    o = r("meta_objects").select(F.translate("name", " ", "_").alias("name"), F.translate("name_lower", " ", "_").alias("name_lower"), F.translate("kind", " ", "_").alias("kind"))
    m = r("meta_members").select(F.translate("object_name_lower", " ", "_").alias("object_name_lower"), "name", "kind")
    return o, m


def _meta(r):
    o, m = _objects(r)
    kinds = o.select("kind").distinct()
    asks = _chains(r).withColumns({c: F.translate(c, " ", "_") for c in ("ask", "chain")})
    return asks, o, m, kinds.select(F.col("kind").alias("alias"), "kind").unionByName(kinds.select(F.concat("kind", F.lit("s")).alias("alias"), "kind"))


CHAINS = """o AS (SELECT replace(name, ' ', '_') AS name, replace(name_lower, ' ', '_') AS key, replace(kind, ' ', '_') AS kind FROM meta_objects), m AS (SELECT replace(object_name_lower, ' ', '_') AS key, name, kind FROM meta_members)"""
query("meta_chain_completions", f"""WITH {CHAINS}
  SELECT DISTINCT 'a:' || o.name AS ask, m.name AS label, m.kind FROM o JOIN m USING (key) WHERE starts_with(lower(m.name), 's')
  UNION SELECT 'b:' || o.name, m.name, m.kind FROM o JOIN m USING (key) WHERE starts_with(lower(m.name), 'c')
  UNION SELECT 'c:' || o.name, p.name, p.kind FROM o JOIN o p USING (kind) WHERE starts_with(lower(p.name), lower(left(o.name, 1)))
  UNION SELECT 'd:' || o.name, m.name, m.kind FROM o JOIN m USING (key)""")(lambda r: completion.metadata_completions(*_meta(r)))


def _asked(r):
    """What stands before the cursor: the first five letters of each method, each module's name with a dot, and each object behind a dot."""
    s = r("symbols")
    stem = F.regexp_extract("file_path", r"([^/]+)\.bsl$", 1)
    asks = [s.select(F.concat(F.lit("p:"), F.left("name_lower", F.lit(5))).alias("ask"), F.concat(F.lit("X = "), F.left("name", F.lit(5))).alias("before")), s.select(F.concat(F.lit("m:"), stem).alias("ask"), F.concat(F.lit("Y = "), stem, F.lit(".")).alias("before"))]
    asks.append(_objects(r)[0].select(F.concat(F.lit("o:"), "name").alias("ask"), F.concat("name", F.lit(".cust")).alias("before")))
    out = asks[0].unionByName(asks[1]).unionByName(asks[2])
    return out.groupBy("ask").agg(F.min("before").alias("before")).withColumn("file_path", F.lit(""))


def _candidates(r):
    asks, (o, m) = _asked(r), _objects(r)
    kinds = o.select(F.col("kind").alias("alias"), "kind").distinct()
    types = m.where("kind = 'attribute'").select(F.lit(None).cast("string").alias("type"), "name", "kind")
    return completion.completions(asks, types, r("symbols"), o, m, kinds)


query("completion_items", f"""WITH {CHAINS}, near AS (SELECT left(name_lower, 5) AS p, s.name, s.kind, row_number() OVER (PARTITION BY left(name_lower, 5) ORDER BY name_lower, file_path, line) AS nth FROM symbols s),
  found AS (SELECT 'p:' || p AS ask, 5 AS rank, name AS label, kind FROM near WHERE nth <= 30
    UNION ALL SELECT DISTINCT 'p:' || left(s.name_lower, 5), 1, m.name, m.kind FROM symbols s JOIN m ON m.kind = 'attribute' AND starts_with(lower(m.name), left(s.name_lower, 5))
    UNION ALL SELECT 'm:' || regexp_extract(file_path, '([^/]+)\\.bsl$', 1), 2, name, kind FROM symbols WHERE is_export = 1
    UNION ALL SELECT 'o:' || o.name, 4, m.name, m.kind FROM o JOIN m USING (key) WHERE starts_with(lower(m.name), 'cust'))
  SELECT ask, min((rank, kind))[1] AS rank, label, min((rank, kind))[2] AS kind FROM found GROUP BY ask, label""")(_candidates)
query("src_word_at", f"WITH {CALLS} SELECT caller_file, caller_line, caller_character, callee_name AS word, CASE WHEN callee_name = 'Execute' THEN 'Query' ELSE '' END AS left_word FROM call")(
    lambda r: syntax.call_sites(_facts(r)).select("caller_file", "caller_line", "caller_character").join(r("source_lines").select(F.col("file_path").alias("caller_file"), F.col("line").alias("caller_line"), "text"), ["caller_file", "caller_line"])
    .select("caller_file", "caller_line", "caller_character", completion.word_at(F.col("text"), F.col("caller_character")).alias("word"), completion.left_word_at(F.col("text"), F.col("caller_character")).alias("left_word"))
)
query("search_both", """SELECT * FROM (SELECT 'symbol' AS "where", file_path, line, name AS text FROM symbols WHERE contains(name_lower, 'red_') UNION ALL SELECT 'text', file_path, line, text FROM source_lines WHERE contains(lower(text), 'red_')) q ORDER BY 1, 2, 3, 4 LIMIT 500""")(
    lambda r: completion.search(r("symbols"), r("source_lines"), "Red_", 500)
)
query("lint_with_unused", f"""WITH {DEFAULT} SELECT file_path, line, code, severity FROM diag UNION ALL SELECT file_path, line, 'BSL-DEAD', 'INFORMATION' FROM symbols s WHERE kind IN ('procedure', 'function') AND is_export = 0
  AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.callee_name_lower = s.name_lower AND (c.caller_name IS NULL OR lower(c.caller_name) <> s.name_lower))""")(
    lambda r: reporting.with_unused(rules.diagnostics(r("source_lines")), index.unused_symbols(r("symbols"), r("calls")))
)
#: Logs are read back, each piece as JSON: codes of the rules as they stand, number, levels and lines of all results.
_LOG = "runs array<struct<tool:struct<driver:struct<rules:array<struct<id:string>>>>>>"
_RESULTS = "array<struct<ruleId:string,level:string,locations:array<struct<physicalLocation:struct<region:struct<startLine:int>>>>>>"


def _read_back(pieces):
    piece = lambda asked: F.when(F.expr(asked), F.col("text"))
    run = F.from_json(F.concat(piece("part = 0"), F.lit(reporting.CLOSING)), _LOG)["runs"][0]
    results = F.from_json(F.concat(F.lit("["), F.ltrim(piece(f"part > 0 AND part < {reporting.LAST}"), F.lit(",")), F.lit("]")), _RESULTS)
    told = F.transform("results", lambda x: F.concat_ws(":", x["ruleId"], x["level"], x["locations"][0]["physicalLocation"]["region"]["startLine"].cast("string")))
    read = pieces.select("file_path", "part", run.alias("run"), results.alias("results"))
    brief = read.select("file_path", "part", F.array_join(F.transform("run.tool.driver.rules", lambda x: x["id"]), ",").alias("rules"), F.size("results").alias("n"), F.array_join(told, ",").alias("told"))
    texts = F.sort_array(F.collect_list(F.when(F.col("told").isNotNull(), F.struct("part", "told"))))
    return brief.groupBy("file_path").agg(F.max("rules").alias("rules"), F.sum(F.when(F.col("told").isNotNull(), F.col("n"))).alias("n_results"), F.array_join(F.transform(texts, lambda x: x["told"]), ",").alias("results"))


query("report_sarif_documents", f"""WITH {DEFAULT}, seen AS (SELECT file_path, code, min(line) AS spot FROM diag GROUP BY ALL)
  SELECT file_path, (SELECT string_agg(code, ',' ORDER BY spot, code) FROM seen WHERE seen.file_path = d.file_path) AS rules, count(*) AS n_results, string_agg(code || ':' || CASE severity WHEN 'ERROR' THEN 'error' WHEN 'WARNING' THEN 'warning' ELSE 'note' END || ':' || line, ',' ORDER BY line, code) AS results
  FROM diag d GROUP BY file_path""")(
    lambda r: _read_back(reporting.sarif_pieces(rules.diagnostics(r("source_lines"))))
)
