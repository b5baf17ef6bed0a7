"""Lint, extraction, report, format and stream queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeprism.functions.text import STRING
from codeprism.operators import flow, formatting, layout, reporting, rules, structure, types
from codeprism.operators.rules import ID, compiled, facts_sql
from codeprism.plans.syntax_queries import DECLARED, LITERALS
from codeprism.sources import corpus, files
from codeprism.sources.corpus import relation
from codeprism.streaming import adaptive, changes

QUERIES: dict = {}
SQL: dict[str, str] = {}
FACTS = f"facts AS MATERIALIZED ({facts_sql('source_lines')})"


def query(name: str, sql: str | None = None, tables: bool = True):
    def add(f):
        QUERIES[name] = (lambda spark, sf_dir: f(lambda view: relation(spark, sf_dir, view))) if tables else f
        if sql:
            SQL[name] = corpus.oracle(sql) if tables else sql
        return f

    return add


def duck(condition: str) -> str:
    return compiled(condition, "duckdb")


def _cases(listed) -> str:
    return "[" + ", ".join(f"CASE WHEN {duck(r[4])} THEN '{r[0]} {rules.SEVERITY[r[2]]}' END" for r in listed) + "]"


def _found(listed, source: str, line: str = "line") -> str:
    return f"SELECT file_path, {line} AS line, string_split(d, ' ')[1] AS code, string_split(d, ' ')[2] AS severity FROM (SELECT file_path, {line}, unnest(list_filter({_cases(listed)}, lambda x: x IS NOT NULL)) AS d FROM {source}) z"


def _facts(r):
    return rules.line_facts(r("source_lines"))


SCOPES = "scopes AS (SELECT *, regexp_extract(header, '(?i)" + rules.NAME_OF + "', 1) AS name FROM (SELECT file_path, scope, " + ", ".join(f"{duck(v)} AS {k}" for k, v in rules.SCOPE_FACTS.items()) + " FROM facts WHERE scope > 0 GROUP BY file_path, scope) q)"
MODULES = "modules AS (SELECT file_path, 1 AS line, " + ", ".join(f"{duck(v)} AS {k}" for k, v in rules.FILE_FACTS.items()) + " FROM facts GROUP BY file_path)"
#: Headers stand on one line in the projected modules; parameters are taken as they are written.
PARAMS = rf"""params AS (SELECT file_path, proc, proc_line, ord, trim(regexp_replace(bare, '=.*$', '')) AS name, regexp_matches(p, '^(?i)(?:{rules.VAL})\s') AS by_val,
  CASE WHEN contains(bare, '=') THEN trim(regexp_replace(bare, '^[^=]*=', '')) END AS default_value
  FROM (SELECT *, regexp_replace(p, '^(?i)(?:(?:{rules.VAL})\s+)+', '') AS bare FROM (SELECT file_path, proc, proc_line, CAST(i - 1 AS INT) AS ord, trim(ps[i]) AS p
    FROM (SELECT file_path, line AS proc_line, regexp_extract(m0, '(?i){rules.NAME_OF}', 1) AS proc, regexp_extract_all(regexp_extract(body, '\((.*)\)', 1), '{rules.PARAMETER}') AS ps FROM facts WHERE head = 1) a, unnest(range(1, len(ps) + 1)) AS u(i)) b) c)"""
PARAM_SUMS = """sums AS (SELECT file_path, proc_line AS line, count(*) AS n_params, count(default_value) AS n_optional, max(CASE WHEN default_value IS NULL THEN ord END) AS last_required,
  min(CASE WHEN default_value IS NOT NULL THEN ord END) AS first_optional, max(length(name)) AS longest, max(length(default_value)) AS longest_default FROM params GROUP BY 1, 2)"""
#: Literals that are queries, by the pattern over whole modules; their fields are cut at commas that stand outside brackets.
QUERY = rf"""{LITERALS}, worded AS (SELECT l.file_path, start_line AS line, loops, regexp_replace(l.text, '\s+', ' ', 'g') AS q FROM literal l JOIN facts f ON f.file_path = l.file_path AND f.line = start_line WHERE regexp_matches(l.text, '(?i){rules.QUERY_TEXT}')),
  asked AS (SELECT *, len(list_filter(regexp_extract_all(regexp_extract(q, '{rules.FIELDS.replace("(?iu)", "(?i)")}', 1), '{rules.PARAMETER}'), lambda x: trim(x) <> '' AND NOT regexp_matches(x, '{rules.ALIASED.replace("(?iu)", "(?i)")}'))) AS unaliased,
    regexp_replace(q, '{rules.UNION_ALL.replace("(?iu)", "(?i)")}', ' ', 'g') AS rest FROM worded)"""
ON = rules.default_rules()
DEFAULT = f"{FACTS}, {SCOPES}, {MODULES}, {PARAMS}, {PARAM_SUMS}, {QUERY}, diag AS (" + " UNION ALL ".join(
    _found([r for r in listed if r[0] in ON], source) for listed, source in ((rules.LINE_RULES, "facts"), (rules.SCOPE_RULES, "scopes"), (rules.FILE_RULES, "modules"), (rules.PARAM_RULES, "sums"), (rules.QUERY_RULES, "asked"))
) + ")"
query("lint_query_rules", f"WITH {FACTS}, {QUERY} {_found(rules.QUERY_RULES, 'asked')}")(lambda r: rules.query_diagnostics(_facts(r), r("source_lines")))

query("lint_line_rules", f"WITH {FACTS} {_found(rules.LINE_RULES, 'facts')}")(lambda r: rules.line_diagnostics(_facts(r)))
query("lint_scope_rules", f"WITH {FACTS}, {SCOPES} {_found(rules.SCOPE_RULES, 'scopes')}")(lambda r: rules.scope_diagnostics(_facts(r)))
query("lint_file_rules", f"WITH {FACTS}, {MODULES} {_found(rules.FILE_RULES, 'modules')}")(lambda r: rules.file_diagnostics(_facts(r)))
query("lint_param_rules", f"WITH {FACTS}, {PARAMS}, {PARAM_SUMS} {_found(rules.PARAM_RULES, 'sums')}")(lambda r: rules.parameter_diagnostics(rules.parameters(_facts(r))))
query("lint_procedure_as_function", rf"""WITH {FACTS} SELECT file_path, line, 'BSL117' AS code, 'ERROR' AS severity FROM facts WHERE lower(regexp_extract(c, '^{ID}\s*=\s*({ID})\s*\(', 1)) IN (SELECT name_lower FROM symbols WHERE kind = 'procedure')""")(lambda r: rules.procedures_as_functions(_facts(r), r("symbols")))
LIT = f"""lit AS (SELECT * FROM (SELECT file_path, scope, line, unnest(regexp_extract_all(text, '{STRING}')) AS literal FROM facts WHERE NOT {duck(f"m[c, {rules.starts(rules.RAISE)}]")}) q WHERE length(literal) > 2)"""
query("lint_duplicate_literals", f"""WITH {FACTS}, {LIT} SELECT file_path, min(line) AS line, 'BSL035' AS code, literal, count(*) AS n FROM lit WHERE scope > 0 GROUP BY file_path, scope, literal HAVING count(*) >= 3
  UNION ALL SELECT file_path, min(line), 'BSL132', literal, count(*) FROM lit GROUP BY file_path, literal HAVING count(*) >= 4""")(lambda r: rules.duplicate_literals(_facts(r)))
query("lint_default", f"WITH {DEFAULT} SELECT * FROM diag")(lambda r: rules.diagnostics(r("source_lines")))
NOQA = f"""SELECT file_path, line FROM facts WHERE {duck('m[note, noqa|bsl-disable]')} AND (NOT {duck(r'm[note, (?:noqa|bsl-disable)\s*:]')} OR {duck(r'm[note, BSL138]')})"""
query("lint_noqa", f"""WITH {FACTS}, found AS ({_found([r for r in rules.LINE_RULES if r[0] == 'BSL138'], 'facts')})
  SELECT found.* FROM found ANTI JOIN ({NOQA}) n ON n.file_path = found.file_path AND n.line = found.line""")(lambda r: reporting.inline_suppressed(rules.line_diagnostics(_facts(r), {"BSL138"}), r("source_lines")))
query("lint_block_suppress", f"""WITH {FACTS}, found AS ({_found([r for r in rules.LINE_RULES if r[0] == 'BSL138'], 'facts')}),
  mark AS (SELECT file_path, line, CASE WHEN note LIKE '%BSLLS:UseOfDebugOutput-off%' THEN 1 WHEN note LIKE '%BSLLS:UseOfDebugOutput-on%' THEN 0 END AS off FROM facts),
  state AS (SELECT file_path, line, last_value(off IGNORE NULLS) OVER (PARTITION BY file_path ORDER BY line) AS off FROM mark)
  SELECT found.* FROM found JOIN state USING (file_path, line) WHERE coalesce(off, 0) = 0""")(lambda r: reporting.block_suppressed(rules.line_diagnostics(_facts(r), {"BSL138"}), r("source_lines")))
SELECTED, IGNORED = ("BSL009", "bsl120", "TabIndentation", "UsingServiceTag", "BSL014"), ("TabIndentation",)
query("lint_select_ignore", f"""WITH {FACTS}, found AS ({_found(rules.LINE_RULES, 'facts')})
  SELECT * FROM found WHERE code IN ('BSL009', 'BSL120', 'BSL121', 'BSL023', 'BSL014') AND code <> 'BSL121' AND NOT (file_path LIKE '%/PROMO.bsl' AND code = 'BSL014')""")(
    lambda r: reporting.choose(rules.line_diagnostics(_facts(r), reporting.wanted(SELECTED, IGNORED)), SELECTED, IGNORED, {"%/PROMO.bsl": ["BSL014"]})
)
query("lint_priority", f"""WITH {FACTS}, found AS ({_found([r for r in rules.LINE_RULES if r[0] in ('BSL004', 'BSL059', 'BSL046', 'BSL199')], 'facts')})
  SELECT * FROM found a WHERE NOT EXISTS (SELECT 1 FROM found b WHERE b.file_path = a.file_path AND b.line = a.line AND (b.code, a.code) IN (('BSL199', 'BSL046'), ('BSL004', 'BSL059')))""")(
    lambda r: reporting.prioritized(rules.line_diagnostics(_facts(r), {"BSL004", "BSL059", "BSL046", "BSL199"}))
)
query("lint_baseline", f"""WITH {DEFAULT}, base AS (SELECT DISTINCT regexp_extract(file_path, '([^/]*)$', 1) AS f, code, line FROM diag WHERE line % 2 = 0)
  SELECT diag.* FROM diag WHERE NOT EXISTS (SELECT 1 FROM base WHERE f = regexp_extract(file_path, '([^/]*)$', 1) AND base.code = diag.code AND base.line = diag.line)""")(
    lambda r: (lambda d: reporting.without_baseline(d, d.where("line % 2 = 0").select(reporting.base_name(F.col("file_path")).alias("file"), "code", "line")).select("file_path", "line", "code", "severity"))(rules.diagnostics(r("source_lines")))
)
query("lint_group_related", f"""WITH {DEFAULT}, numbered AS (SELECT *, row_number() OVER (PARTITION BY file_path, code ORDER BY line) AS rn FROM diag)
  SELECT file_path, code, min(line) AS line, count(*) AS n, coalesce(string_agg(CASE WHEN rn BETWEEN 2 AND 51 THEN CAST(line AS VARCHAR) END, ',' ORDER BY line), '') AS related FROM numbered GROUP BY 1, 2""")(
    lambda r: reporting.grouped(rules.diagnostics(r("source_lines"))).withColumn("related", F.array_join(F.col("related").cast("array<string>"), ","))
)
query("lint_stats", f"WITH {DEFAULT} SELECT severity, code, count(*) AS n FROM diag GROUP BY GROUPING SETS ((severity), (code), ())")(lambda r: reporting.counted(rules.diagnostics(r("source_lines"))))
query("lint_summary", f"""WITH {DEFAULT} SELECT count(*) FILTER (WHERE severity = 'ERROR') AS errors, count(*) FILTER (WHERE severity = 'WARNING') AS warnings,
  count(*) FILTER (WHERE severity NOT IN ('ERROR', 'WARNING')) AS others, CAST(count(*) FILTER (WHERE severity = 'ERROR') > 0 AS INT) AS has_errors FROM diag""")(lambda r: reporting.summary(rules.diagnostics(r("source_lines"))))
query("report_sarif_rows", f"""WITH {DEFAULT} SELECT CASE severity WHEN 'ERROR' THEN 'error' WHEN 'WARNING' THEN 'warning' ELSE 'note' END AS level, code AS rule_id, file_path AS uri, line AS start_line, 1 AS start_column FROM diag""")(lambda r: reporting.sarif_rows(rules.diagnostics(r("source_lines"))))
query("report_sonar_rows", f"""WITH {DEFAULT} SELECT 'codeprism' AS engine_id, code AS rule_id, CASE severity WHEN 'ERROR' THEN 'BLOCKER' WHEN 'WARNING' THEN 'MAJOR' ELSE 'MINOR' END AS severity, file_path AS path, line AS start_line, line AS end_line FROM diag""")(lambda r: reporting.sonar_rows(rules.diagnostics(r("source_lines"))))
query("src_corpus", "SELECT file_path, line, text FROM source_lines")(lambda r: r("source_lines"))
query("src_procs", f"WITH {FACTS}, {SCOPES} SELECT file_path, name, line, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_returns AS BIGINT) AS n_returns FROM scopes")(lambda r: rules.scope_facts(_facts(r)).select("file_path", "name", "line", "n_lines", "n_returns"))
query("src_params", f"WITH {FACTS}, {PARAMS} SELECT file_path, proc, proc_line, ord, name, by_val, default_value FROM params")(lambda r: rules.parameters(_facts(r)))
CALLED = rf"(?:^|[^\p{{L}}\p{{N}}_.])({ID})\s*\("
query("src_calls", rf"""WITH {FACTS} SELECT file_path, line, callee FROM (SELECT file_path, line, unnest(regexp_extract_all(code, '{CALLED}', 1)) AS callee FROM facts WHERE head = 0) q
  WHERE lower(callee) NOT IN ('if', 'elsif', 'while', 'return', 'not', 'and', 'or', 'new', 'to', 'in')""")(
    lambda r: _facts(r).where("head = 0").select("file_path", "line", F.explode(F.regexp_extract_all("code", F.lit(CALLED), F.lit(1))).alias("callee")).where(~F.lower("callee").isin("if", "elsif", "while", "return", "not", "and", "or", "new", "to", "in"))
)
query("src_doc_comment", f"WITH {FACTS} SELECT file_path, line, t1 AS doc FROM facts WHERE head = 1 AND starts_with(t1, '//')")(lambda r: _facts(r).where("head = 1").where(F.startswith("t1", F.lit("//"))).select("file_path", "line", F.col("t1").alias("doc")))
query("search_text", "SELECT file_path, line, text FROM source_lines WHERE regexp_matches(text, '(?i)query\\.execute') ORDER BY file_path, line LIMIT 100")(lambda r: r("source_lines").where(F.col("text").rlike(r"(?iu)query\.execute")).orderBy("file_path", "line").limit(100))
query("scan_workspace", f"""WITH {FACTS} SELECT file_path, count(*) AS n_lines, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars, CAST(sum(head) AS BIGINT) AS n_methods FROM facts GROUP BY 1""")(
    lambda r: _facts(r).groupBy("file_path").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.char_length("text") + 1).alias("n_chars"), F.sum("head").alias("n_methods"))
)
query("fmt_blank_lines", "SELECT file_path, line, text FROM (SELECT *, trim(text, ' ' || chr(9)) = '' AS blank, lag(trim(text, ' ' || chr(9)) = '') OVER (PARTITION BY file_path ORDER BY line) AS before FROM source_lines) q WHERE NOT (blank AND coalesce(before, true))")(lambda r: formatting.squeezed(r("source_lines")))
_F = lambda p: f"CAST({duck(f'm[c, {p}]')} AS INT)"
query("fmt_indent_heuristic", f"""WITH {FACTS}, flag AS (SELECT file_path, line, {_F(formatting.OPENS)} AS o, {_F(formatting.CLOSES)} AS x, {_F(formatting.MIDDLE)} AS m FROM facts)
  SELECT file_path, line, CAST(greatest(sum(o) OVER w - sum(x) OVER w - o - m, 0) AS BIGINT) AS indent FROM flag WINDOW w AS (PARTITION BY file_path ORDER BY line)""")(lambda r: formatting.indents(r("source_lines")))

#: Reads and writes by the forms of the projected modules: an assignment, a for-each loop or a declaration stands first on its line, one or two on a line.
EVENTS = rf"""part AS (SELECT file_path, scope, line, k, trim(s[k]) AS s FROM (SELECT file_path, scope, line, string_split(c, ';') AS s FROM facts WHERE head = 0 AND c <> '' AND NOT regexp_matches(c, '^(?:[#&]|Var )')) q, unnest(range(1, len(s) + 1)) AS u(k) WHERE trim(s[k]) <> ''),
  act AS (SELECT *, CASE WHEN regexp_matches(s, '^For Each ') THEN 'loop' WHEN regexp_matches(s, '^{ID}\s*=') THEN 'write' END AS kind, CASE WHEN regexp_matches(s, '^For Each ') THEN regexp_extract(s, '^For Each ({ID})', 1) ELSE regexp_extract(s, '^({ID})\s*=', 1) END AS target,
    CASE WHEN regexp_matches(s, '^For Each ') THEN regexp_replace(s, '^For Each {ID}', '') ELSE regexp_replace(s, '^{ID}\s*=', '') END AS rest FROM part),
  seen AS (SELECT file_path, scope, line, k, 1 AS role, target AS name, kind, CAST(regexp_matches(rest, '^\s*ErrorInfo\(\)') AS INT) AS error FROM act WHERE kind IS NOT NULL
    UNION ALL SELECT file_path, scope, line, k, 0, n, 'read', 0 FROM (SELECT DISTINCT file_path, scope, line, k, ltrim(unnest(regexp_extract_all(rest, '(?:^|[^\p{{L}}\p{{N}}_.]){ID}')), ' (,+-*/=<>') AS n FROM act)
    UNION ALL SELECT p.file_path, scope, proc_line, 0, 1, name, 'param', 0 FROM params p JOIN facts f ON f.file_path = p.file_path AND f.line = proc_line AND head = 1
    UNION ALL SELECT d.file_path, scope, d.line, 0, 1, name, CASE is_export WHEN 1 THEN 'exported' ELSE 'decl' END, 0 FROM declared d JOIN facts f ON f.file_path = d.file_path AND f.line = d.line),
  event AS MATERIALIZED (SELECT *, lower(name) AS word FROM seen)"""
FLOW = f"{FACTS}, {PARAMS}, {DECLARED}, {EVENTS}"
_flow = lambda f: lambda r: (lambda facts: f(facts, flow.events(facts), rules.parameters(facts)))(flow.kept(_facts(r)))
_W = ", 'WARNING' AS severity, "
query("lint_unused_params", f"""WITH {FLOW}, idle AS (SELECT p.file_path, proc_line AS line, by_val, p.name FROM params p JOIN facts f ON f.file_path = p.file_path AND f.line = proc_line AND head = 1
    WHERE NOT starts_with(p.name, '_') AND (by_val OR default_value IS NULL) AND NOT EXISTS (SELECT 1 FROM event e WHERE e.file_path = p.file_path AND e.scope = f.scope AND e.word = lower(p.name) AND e.kind <> 'param'))
  SELECT file_path, line, CASE WHEN by_val THEN 'BSL021' ELSE 'BSL062' END AS code{_W}name FROM idle UNION ALL SELECT file_path, line, 'BSL122', 'WARNING', name FROM idle""")(_flow(flow.unused_parameters))
query("lint_unused_locals", f"""WITH {FLOW}, made AS (SELECT file_path, scope, word, min((line, name)) AS f FROM event WHERE kind IN ('decl', 'write') GROUP BY ALL)
  SELECT file_path, f[1] AS line, 'BSL007' AS code{_W}f[2] AS name FROM made m WHERE NOT EXISTS (SELECT 1 FROM event e WHERE e.file_path = m.file_path AND e.word = m.word AND (e.scope = m.scope AND e.kind IN ('read', 'param', 'exported')
    OR m.scope > 0 AND e.scope = 0 AND e.kind IN ('decl', 'write', 'param', 'exported') OR m.scope = 0 AND e.kind = 'read'))""")(_flow(lambda facts, found, params: flow.unused_variables(found)))
query("lint_unused_errors", f"""WITH {FLOW} SELECT file_path, line, 'BSL034' AS code{_W}name FROM event w WHERE error = 1 AND NOT EXISTS (SELECT 1 FROM event r WHERE r.file_path = w.file_path AND r.scope = w.scope AND r.word = w.word AND r.kind = 'read' AND (r.line, r.k) > (w.line, w.k))""")(
    _flow(lambda facts, found, params: flow.unused_errors(found))
)
query("lint_module_variables", f"""WITH {FLOW} SELECT file_path, line, 'BSL075' AS code, 'INFORMATION' AS severity, name FROM event w WHERE scope > 0 AND kind = 'write' AND EXISTS (SELECT 1 FROM event d WHERE d.file_path = w.file_path AND d.word = w.word AND d.scope = 0 AND d.kind IN ('decl', 'exported'))
  AND NOT EXISTS (SELECT 1 FROM event d WHERE d.file_path = w.file_path AND d.word = w.word AND d.scope = w.scope AND d.kind IN ('decl', 'param'))""")(_flow(lambda facts, found, params: flow.changed_module_variables(found)))
query("lint_rewritten_params", f"""WITH {FLOW}, use AS (SELECT *, row_number() OVER (PARTITION BY file_path, scope, word ORDER BY line, k, role) AS nth FROM event WHERE kind <> 'param')
  SELECT u.file_path, u.line, 'BSL240' AS code{_W}u.name FROM use u WHERE nth = 1 AND kind IN ('write', 'loop') AND EXISTS (SELECT 1 FROM params p JOIN facts f ON f.file_path = p.file_path AND f.line = proc_line AND head = 1 WHERE p.file_path = u.file_path AND f.scope = u.scope AND lower(p.name) = u.word AND by_val)""")(
    _flow(lambda facts, found, params: flow.rewritten_parameters(found, params))
)
query("lint_unused_iterators", f"""WITH {FLOW}, done AS (SELECT file_path, line FROM facts WHERE c = 'EndDo;'), loop AS (SELECT e.*, (SELECT min(done.line) FROM done WHERE done.file_path = e.file_path AND done.line > e.line) AS end_line FROM event e WHERE kind = 'loop')
  SELECT file_path, line, 'BSL263' AS code{_W}name FROM loop l WHERE NOT EXISTS (SELECT 1 FROM event r WHERE r.file_path = l.file_path AND r.scope = l.scope AND r.word = l.word AND r.kind = 'read' AND r.line > l.line AND r.line <= l.end_line)""")(
    _flow(lambda facts, found, params: flow.unused_iterators(facts, found))
)
query("lint_undescribed_params", rf"""WITH {DECLARED} SELECT file_path, line, 'BSL088' AS code, 'INFORMATION' AS severity, name FROM method WHERE is_export = 1 AND NOT contains(signature, '()') AND NOT regexp_matches(doc, '(?i)Parameters\s*:')""")(lambda r: flow.undescribed_parameters(_facts(r)))
query("lint_repeated_branches", f"""WITH chain AS (SELECT file_path, line, list(trim(text, ' ' || chr(9))) OVER (PARTITION BY file_path ORDER BY line ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS b FROM source_lines)
  SELECT file_path, line + 2 AS line, 'BSL197' AS code, 'WARNING' AS severity FROM chain WHERE b[1] LIKE 'If %' AND b[3] = 'Else' AND b[5] = 'EndIf;' AND b[2] = b[4] AND b[2] <> ''""")(lambda r: flow.repeated_branches(_facts(r)))
query("lint_final_newline", """SELECT doc_id AS path, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INT) AS line, 'BSL082' AS code, 'INFORMATION' AS severity FROM documents WHERE text <> '' AND NOT ends_with(text, chr(10))""", tables=False)(
    lambda spark, sf_dir: flow.missing_final_newline(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("path"), "text"))
)


def _modules(r):
    return r("source_lines").groupBy(F.col("file_path").alias("path")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))


query("fmt_full")(lambda r: formatting.format_modules(_modules(r)))
query("fix_modules")(lambda r: formatting.fix_modules(_modules(r)).select("path", "text", F.to_json("fixes").alias("fixes")))
query("src_lines", """SELECT doc_id AS path, CAST(i AS INT) AS line, l[i] AS text FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n$', ''), chr(10)) AS l FROM documents) q, unnest(range(1, len(l) + 1)) AS u(i)""", tables=False)(
    lambda spark, sf_dir: files.lines_of(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("path"), "text"))
)
query("stream_debounce", """SELECT user_id, count(*) AS n, min(ts) AS first, max(ts) AS last FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS batch
  FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events) a) b GROUP BY user_id, batch""", tables=False)(
    lambda spark, sf_dir: changes.debounced_batch(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "ts", 7200)
)

#: Events of a user are changes of one file; those of the first type report a check that took a fortieth of their value; units are of six hours.
query("stream_adaptive", """WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN value / 40 END AS took FROM events),
  k AS (SELECT user_id, ts, took, event_id, last_value(took IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, took IS NULL, event_id) AS told FROM e),
  q AS (SELECT user_id, ts, CASE WHEN told IS NULL THEN 0.6 ELSE least(3.0, greatest(0.3, told * 2)) END AS quiet FROM k WHERE took IS NULL),
  m AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= lag(quiet) OVER w * 21600000000 THEN 0 ELSE 1 END AS new FROM q WINDOW w AS (PARTITION BY user_id ORDER BY ts))
  SELECT user_id, count(*) AS n, min(ts) AS first, max(ts) AS last FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS batch FROM m) b GROUP BY user_id, batch""", tables=False)(
    lambda spark, sf_dir: (lambda e: adaptive.batches(e.select("user_id", "ts", F.when(F.col("event_type") == e.agg(F.min("event_type")).first()[0], F.col("value") / 40).alias("took")), "user_id", "ts", 21600).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")}))(spark.read.parquet(f"{sf_dir}/events.parquet"))
)


def _blocks(kind: str, opens: str, closes: str) -> str:
    return f"""SELECT file_path, '{kind}' AS kind, line, 1 AS step FROM facts WHERE {duck(f"m[c, {rules.starts(opens)}]")} UNION ALL SELECT file_path, '{kind}', line, -1 FROM facts WHERE {duck(f"m[c, {rules.starts(closes)}]")}"""


BLOCKS = f"""mark AS ({' UNION ALL '.join(_blocks(k, *v) for k, v in structure.BLOCKS.items())}),
  placed AS (SELECT *, sum(step) OVER (PARTITION BY file_path, kind ORDER BY line) + CASE WHEN step < 0 THEN 1 ELSE 0 END AS depth FROM mark),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY file_path, kind, depth, step ORDER BY line) AS nth FROM placed),
  block AS (SELECT file_path, kind, o.line AS start_line, x.line AS end_line, CAST(depth AS BIGINT) AS depth FROM (SELECT * FROM numbered WHERE step > 0) o JOIN (SELECT * FROM numbered WHERE step < 0) x USING (file_path, kind, depth, nth) WHERE x.line >= o.line AND depth > 0)"""
query("src_blocks", f"WITH {FACTS}, {BLOCKS} SELECT * FROM block")(lambda r: structure.blocks(_facts(r)))
query("src_regions", rf"WITH {FACTS}, {BLOCKS} SELECT block.file_path, regexp_extract(c, '^#\S+\s+({ID})', 1) AS name, start_line, end_line FROM block JOIN facts ON facts.file_path = block.file_path AND facts.line = start_line WHERE kind = 'region'")(lambda r: structure.regions(_facts(r)))
query("src_enclosing_blocks", f"""WITH {FACTS}, {BLOCKS} SELECT file_path, line, kind, start_line, end_line, depth, row_number() OVER (PARTITION BY file_path, line ORDER BY start_line DESC, end_line, kind) AS nesting
  FROM (SELECT file_path, line FROM facts) p JOIN block USING (file_path) WHERE line BETWEEN start_line AND end_line""")(lambda r: structure.enclosing_all(_facts(r)).select("file_path", "line", "kind", "start_line", "end_line", "depth", "nesting"))
query("src_highlight", """SELECT file_path, line, count(*) AS n FROM (SELECT file_path, line, unnest(regexp_extract_all(' ' || regexp_replace(text, '([^\\p{L}\\p{N}_])', '\\1\\1', 'g') || ' ', '(?i)[^\\p{L}\\p{N}_]message[^\\p{L}\\p{N}_]')) FROM source_lines) q GROUP BY 1, 2""")(lambda r: structure.highlights(r("source_lines"), "Message").groupBy("file_path", "line").agg(F.count(F.lit(1)).alias("n")))
query("src_semantic_tokens")(lambda r: structure.semantic_tokens(r("source_lines")))
query("src_locals")(lambda r: structure.locals_of(_facts(r)))
#: Types by recursion over the event that each assignment depends on, in the forms of the projected modules.
TYPES = rf"""given AS (SELECT file_path, scope, line, k, lower(target) AS word, trim(CASE kind WHEN 'loop' THEN regexp_extract(rest, '^ In (.*) Do$', 1) ELSE rest END) AS e, kind FROM act WHERE kind IS NOT NULL),
  formed AS (SELECT *, CASE WHEN regexp_matches(e, '^New ') THEN regexp_extract(e, '^New ({ID})', 1) WHEN regexp_matches(e, '^[0-9]+$') THEN 'Число' WHEN e = '""' THEN 'Строка' WHEN e IN ('True', 'False') THEN 'Булево' END AS known,
    CASE WHEN regexp_matches(e, '^{ID}$') AND e NOT IN ('True', 'False') THEN e ELSE regexp_extract(e, '^({ID})\.{ID}\(.*\)$', 1) END AS source, lower(regexp_extract(e, '^{ID}\.({ID})\(.*\)$', 1)) AS method FROM given),
  linked AS (SELECT *, CASE WHEN known IS NULL AND source <> '' THEN coalesce((SELECT max((b.line, b.k)) FROM formed b WHERE b.file_path = f.file_path AND b.scope = f.scope AND b.word = lower(f.source) AND (b.line, b.k) < (f.line, f.k)),
    (SELECT max((b.line, b.k)) FROM formed b WHERE b.file_path = f.file_path AND b.scope = 0 AND b.word = lower(f.source) AND (b.line, b.k) < (f.line, f.k))) END AS dep FROM formed f),
  typed AS (SELECT file_path, scope, line, k, word, coalesce(known, '') AS type FROM linked WHERE dep IS NULL AND (known IS NOT NULL OR method = '' OR kind = 'loop')
    UNION ALL SELECT file_path, scope, line, k, word, CASE lower(source) || '.' || method WHEN 'query.execute' THEN 'QueryResult' ELSE '' END FROM linked WHERE dep IS NULL AND known IS NULL AND method <> '' AND kind <> 'loop'
    UNION ALL SELECT l.file_path, l.scope, l.line, l.k, l.word, CASE WHEN l.kind = 'loop' THEN '' WHEN method = '' THEN t.type WHEN lower(CASE t.type WHEN '' THEN source ELSE t.type END) || '.' || method = 'query.execute' THEN 'QueryResult' ELSE '' END
      FROM linked l JOIN typed t ON t.file_path = l.file_path AND (t.line, t.k) = l.dep)"""
query("type_inference", f"""WITH RECURSIVE {FLOW}, {TYPES}, last AS (SELECT file_path, scope, word, max((line, k)) AS at FROM typed GROUP BY ALL)
  SELECT t.file_path, CAST(t.scope AS BIGINT) AS scope, t.word AS name, type FROM typed t JOIN last ON last.file_path = t.file_path AND last.scope = t.scope AND last.word = t.word AND last.at = (t.line, t.k) WHERE type <> ''""")(lambda r: types.inferred(_facts(r)))
query("fmt_lines")(lambda r: layout.formatted(r("source_lines")))
