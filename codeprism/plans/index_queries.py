"""Index, graph and metadata queries over the projected relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeprism.operators import graph, index
from codeprism.sources.corpus import oracle, relation

FILE = "src/Brand12/ECONOMY.bsl"
SYM = "name, file_path, line, kind, is_export"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda view: relation(spark, sf_dir, view))
        if sql:
            SQL[name] = oracle(sql)
        return f

    return add


def _sym(df):
    return df.select("name", "file_path", "line", "kind", "is_export")


query("idx_stats", "SELECT 'symbols' AS metric, count(*) AS value FROM symbols UNION ALL SELECT 'files', count(DISTINCT file_path) FROM symbols UNION ALL SELECT 'calls', count(*) FROM calls")(lambda r: index.stats(r("symbols"), r("calls")))
query("idx_file_outline", f"SELECT {SYM} FROM symbols WHERE file_path = '{FILE}'")(lambda r: _sym(index.file_outline(r("symbols"), FILE)))
NAME = "(SELECT min(name_lower) FROM symbols WHERE id = 7)"


def _seven(r) -> str:
    return r("symbols").where("id = 7").agg(F.min("name_lower")).first()[0] or ""


query("idx_find_exact", f"SELECT {SYM} FROM symbols WHERE name_lower = {NAME}")(lambda r: _sym(index.find_symbol(r("symbols"), _seven(r).upper())))
query("idx_find_file_filter", f"SELECT {SYM} FROM symbols WHERE name_lower = {NAME} AND contains(file_path, 'src/')")(lambda r: _sym(index.find_symbol(r("symbols"), _seven(r), "src/")))
query("idx_find_prefix", f"SELECT {SYM} FROM symbols WHERE len(list_filter(string_split_regex(name_lower, '[^\\p{{L}}\\p{{N}}]+'), lambda t: starts_with(t, '1'))) > 0 ORDER BY name_lower, file_path, line LIMIT 20")(lambda r: _sym(index.find_prefix(r("symbols"), "1")))
query("idx_find_ranked")(lambda r: index.ranked_prefix(r("symbols"), "1").select("name", "file_path", "line", "rank"))
query("idx_callers_count", f"SELECT count(*) AS n FROM calls WHERE callee_name_lower = {NAME}")(lambda r: index.callers_count(r("calls"), _seven(r)))
query("idx_callers_count_nonrec", f"SELECT count(*) AS n FROM calls WHERE callee_name_lower = {NAME} AND (caller_name IS NULL OR lower(caller_name) <> {NAME})")(lambda r: index.callers_count_non_recursive(r("calls"), _seven(r)))
query("idx_call_counts", "SELECT callee_name_lower, count(*) AS n, count(*) FILTER (WHERE caller_name IS NULL OR lower(caller_name) <> callee_name_lower) AS n_non_recursive FROM calls GROUP BY 1")(lambda r: index.call_counts(r("calls")))
query("idx_unused_symbols", """SELECT name, file_path, line, kind FROM symbols s WHERE kind IN ('procedure', 'function') AND is_export = 0
  AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.callee_name_lower = s.name_lower AND (c.caller_name IS NULL OR lower(c.caller_name) <> s.name_lower))""")(lambda r: index.unused_symbols(r("symbols"), r("calls")).select("name", "file_path", "line", "kind"))
CALL = "caller_file, caller_line, caller_name, callee_name, callee_args_count"
query("idx_callers", f"""SELECT {CALL}, s.line AS symbol_line FROM calls LEFT JOIN symbols s ON s.name_lower = callee_name_lower AND s.file_path = caller_file
  WHERE callee_name_lower = {NAME} ORDER BY caller_file, caller_line, caller_name NULLS FIRST, callee_args_count LIMIT 50""")(lambda r: index.find_callers(r("calls"), r("symbols"), _seven(r)).select("caller_file", "caller_line", "caller_name", "callee_name", "callee_args_count", "symbol_line"))
DEF = f"SELECT {CALL}, s.file_path AS callee_file, s.line AS callee_line FROM calls LEFT JOIN symbols s ON s.name_lower = callee_name_lower WHERE caller_file = '{FILE}'"
_defs = ("caller_file", "caller_line", "caller_name", "callee_name", "callee_args_count", "callee_file", "callee_line")
query("idx_callees_file", DEF)(lambda r: index.callees(r("calls"), r("symbols"), FILE).select(*_defs))
LEAST = f"(SELECT min(caller_line) FROM calls WHERE caller_file = '{FILE}')"
query("idx_callees_window", f"{DEF} AND caller_line BETWEEN {LEAST} - 15 AND {LEAST} + 15")(lambda r: index.callees(r("calls"), r("symbols"), FILE, line=r("calls").where(F.col("caller_file") == FILE).agg(F.min("caller_line")).first()[0] or 0).select(*_defs))
FIRST_CALLER = f"(SELECT min(caller_name) FROM calls WHERE caller_file = '{FILE}')"
query("idx_callees_by_name", f"{DEF} AND caller_name = {FIRST_CALLER}")(lambda r: index.callees(r("calls"), r("symbols"), FILE, caller=r("calls").where(F.col("caller_file") == FILE).agg(F.min("caller_name")).first()[0] or "").select(*_defs))
query("idx_module_exports", f"SELECT {SYM} FROM symbols WHERE is_export = 1 AND ends_with(file_path, '/PROMO.bsl') ORDER BY name_lower, file_path, line LIMIT 100")(lambda r: _sym(index.module_exports(r("symbols"), "PROMO")))
query("idx_upsert_merge", f"""SELECT {SYM} FROM symbols WHERE file_path <> '{FILE}' UNION ALL SELECT name, file_path, line + 1, kind, is_export FROM symbols WHERE file_path = '{FILE}' AND id % 2 = 0""")(
    lambda r: index.upsert(_sym(r("symbols")), _sym(r("symbols").where((F.col("file_path") == FILE) & (F.col("id") % 2 == 0)).withColumn("line", F.col("line") + 1)))
)
query("idx_remove_file", f"SELECT {SYM} FROM symbols WHERE file_path <> '{FILE}'")(lambda r: index.remove_files(_sym(r("symbols")), r("symbols").where(F.col("file_path") == FILE)))
query("graph_caller_closure", f"""WITH RECURSIVE e AS (SELECT DISTINCT lower(caller_name) AS caller, callee_name_lower AS callee FROM calls WHERE caller_name IS NOT NULL),
  w(root, node, depth) AS (SELECT DISTINCT name_lower, name_lower, 0 FROM symbols WHERE name_lower = {NAME} UNION SELECT root, caller, depth + 1 FROM w JOIN e ON e.callee = w.node WHERE depth < 3)
  SELECT root, node, min(depth) AS depth FROM w GROUP BY 1, 2 HAVING min(depth) > 0""")(lambda r: graph.caller_closure(r("calls"), r("symbols").where(F.col("name_lower") == _seven(r)).select(F.col("name_lower").alias("root"))))
query("graph_callees_in_range", f"SELECT {CALL}, s.name AS definition FROM calls JOIN symbols s ON s.file_path = caller_file AND caller_line BETWEEN s.line AND s.line + 20")(
    lambda r: graph.callees_in_definitions(r("symbols").withColumn("end_line", F.col("line") + 20), r("calls")).select("caller_file", "caller_line", "caller_name", "callee_name", "callee_args_count", "definition")
)
query("graph_hierarchy", """WITH e AS (SELECT DISTINCT lower(caller_name) AS caller, callee_name_lower AS callee FROM calls WHERE caller_name IS NOT NULL),
  f AS (SELECT name_lower, min((file_path, line)) AS s FROM symbols GROUP BY 1)
  SELECT caller, callee, a.s[1] AS from_file, a.s[2] AS from_line, b.s[1] AS to_file, b.s[2] AS to_line FROM e LEFT JOIN f a ON a.name_lower = caller LEFT JOIN f b ON b.name_lower = callee""")(lambda r: graph.hierarchy(r("calls"), r("symbols")))
query("graph_references", "SELECT name_lower, 'definition' AS ref_kind, file_path AS file, line FROM symbols UNION ALL SELECT callee_name_lower, 'call', caller_file, caller_line FROM calls")(lambda r: graph.references(r("calls"), r("symbols")))
query("graph_rename_preview", f"SELECT file, count(*) AS edits FROM (SELECT name_lower, file_path AS file FROM symbols UNION ALL SELECT callee_name_lower, caller_file FROM calls) WHERE name_lower = {NAME} GROUP BY 1")(lambda r: graph.rename_preview(r("calls"), r("symbols"), _seven(r)))
query("graph_recursive", f"SELECT {CALL} FROM calls WHERE lower(caller_name) = callee_name_lower")(lambda r: graph.recursive_calls(r("calls")).select("caller_file", "caller_line", "caller_name", "callee_name", "callee_args_count"))
query("meta_upsert_dedup", "SELECT name, name_lower, kind, CAST(seq AS BIGINT) AS seq FROM (SELECT name, name_lower, kind, seq + 100 AS seq FROM meta_objects)")(
    lambda r: index.latest_metadata(r("meta_objects").select("name", "name_lower", "kind", F.col("seq").cast("long").alias("seq")).unionByName(r("meta_objects").select("name", "name_lower", "kind", (F.col("seq") + 100).cast("long").alias("seq"))))
)
query("meta_members_prefix", "SELECT name, kind FROM meta_members WHERE object_name_lower = (SELECT min(name_lower) FROM meta_objects) AND starts_with(name_lower, 'c') ORDER BY name_lower, kind LIMIT 200")(
    lambda r: index.metadata_members(r("meta_objects"), r("meta_members"), r("meta_objects").agg(F.min("name_lower")).first()[0] or "", "C").select("name", "kind")
)
query("meta_collection", "SELECT name, kind FROM meta_objects WHERE kind = (SELECT min(kind) FROM meta_objects) ORDER BY name_lower LIMIT 100")(lambda r: index.metadata_collection(r("meta_objects"), r("meta_objects").agg(F.min("kind")).first()[0] or "").select("name", "kind"))
query("meta_object_report", "SELECT object_name_lower, kind, count(*) AS n, min(name) AS first_name, max(name) AS last_name FROM meta_members GROUP BY 1, 2")(lambda r: index.metadata_report(r("meta_members")))
query("meta_unknown_refs", "SELECT DISTINCT name FROM (SELECT object_name AS name FROM meta_members UNION ALL SELECT 'Missing_' || kind FROM meta_members) WHERE lower(name) NOT IN (SELECT name_lower FROM meta_objects)")(
    lambda r: index.unknown_references(r("meta_members").select(F.col("object_name").alias("name")).unionByName(r("meta_members").select(F.concat(F.lit("Missing_"), "kind").alias("name"))), r("meta_objects")).distinct()
)
