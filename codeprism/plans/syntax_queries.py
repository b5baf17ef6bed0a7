"""Literals, symbols and calls from module text, and the index's lookups over them.

Their SQL takes other ways than the operators: literals by one pattern over whole modules,
headers and calls by patterns of the forms that the projected modules have.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codeprism.operators import graph, index, rules, structure, syntax
from codeprism.operators.rules import ID
from codeprism.plans.index_queries import NAME
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


#: Every literal of a module by one pattern over its whole text, with the line and column of its ends.
LITERALS = r"""module AS (SELECT file_path, string_agg(text, chr(10) ORDER BY line) AS t FROM source_lines GROUP BY file_path),
  cut AS (SELECT file_path, string_split_regex(t, p) AS g, regexp_extract_all(t, p) AS m FROM module, (SELECT '"[^"]*(?:""[^"]*)*(?:"|$)|//[^\n]*' AS p)),
  part AS (SELECT file_path, i, 2 * i AS o, g[i] AS x FROM cut, unnest(range(1, len(g) + 1)) AS u(i) UNION ALL SELECT file_path, i, 2 * i + 1, m[i] FROM cut, unnest(range(1, len(m) + 1)) AS u(i)),
  spot AS (SELECT *, length(x) - length(replace(x, chr(10), '')) AS feeds, length(regexp_extract(x, '([^\n]*)$', 1)) AS rest FROM part),
  run AS (SELECT *, 1 + sum(feeds) OVER w AS line, sum(length(x)) OVER w AS place, max(CASE WHEN feeds > 0 THEN o END) OVER w AS feed FROM spot WINDOW w AS (PARTITION BY file_path ORDER BY o)),
  told AS (SELECT *, CASE WHEN feed IS NULL THEN place ELSE place - max(CASE WHEN feeds > 0 THEN place - rest END) OVER (PARTITION BY file_path ORDER BY o) END AS col FROM run),
  ends AS (SELECT *, lag(line) OVER (PARTITION BY file_path ORDER BY o) AS line0, lag(col) OVER (PARTITION BY file_path ORDER BY o) AS col0 FROM told),
  literal AS (SELECT file_path, CAST(line0 AS INT) AS start_line, CAST(col0 AS INT) AS start_col, CAST(line AS INT) AS end_line, CAST(col AS INT) AS end_col,
    replace(regexp_replace(x[2:-2], '\n[ \t]*\|', chr(10), 'g'), '""', '"') AS text FROM ends WHERE o % 2 = 1 AND starts_with(x, '"'))"""
query("src_literals", f"WITH {LITERALS} SELECT * FROM literal")(lambda r: syntax.literals(r("source_lines")))
query("src_words_outside", rf"""WITH {LITERALS}, word AS (SELECT file_path, line, length(regexp_extract(text, '^(.*?)(?:^|[^\p{{L}}\p{{N}}_])Message(?:$|[^\p{{L}}\p{{N}}_])', 1)) + 1 AS start FROM source_lines WHERE contains(text, 'Message'))
  SELECT file_path, line, start FROM word w WHERE NOT EXISTS (SELECT 1 FROM literal l WHERE l.file_path = w.file_path AND (w.line, w.start) < (l.end_line, l.end_col) AND (w.line, w.start + 7) > (l.start_line, l.start_col))""")(
    lambda r: syntax.outside_literals(structure.highlights(r("source_lines"), "Message").select("file_path", "line", F.col("start").alias("start_col"), (F.col("start") + 7).alias("end_col")), syntax.literals(r("source_lines"))).select("file_path", "line", F.col("start_col").alias("start"))
)
#: Headers and declarations by the forms that the projected modules have: each on one line.
DECLARED = rf"""head AS (SELECT file_path, line, regexp_extract(text, '^(Function|Procedure) ', 1) AS word, regexp_extract(text, '^\w+ ({ID})', 1) AS name, regexp_extract(text, '\((.*)\)', 1) AS params, CAST(ends_with(text, ' Export') AS INT) AS is_export
    FROM source_lines WHERE regexp_matches(text, '^(?:Function|Procedure) ')),
  tail AS (SELECT file_path, line FROM source_lines WHERE text IN ('EndFunction', 'EndProcedure')),
  span AS (SELECT head.*, (SELECT min(tail.line) FROM tail WHERE tail.file_path = head.file_path AND tail.line > head.line) AS end_line FROM head),
  method AS (SELECT name, lower(word) AS kind, s.file_path, s.line, CASE word WHEN 'Function' THEN 9 ELSE 10 END AS character, end_line, is_export, NULL AS container,
    word || ' ' || name || '(' || params || ')' || CASE is_export WHEN 1 THEN ' Export' ELSE '' END AS signature, coalesce(regexp_extract(above.text, '^// (.*)$', 1), '') AS doc
    FROM span s LEFT JOIN source_lines above ON above.file_path = s.file_path AND above.line = s.line - 1),
  declared AS (SELECT regexp_extract(one, '^\s*({ID})', 1) AS name, file_path, line, CAST(ends_with(one, ' Export') AS INT) AS is_export FROM (SELECT file_path, line, unnest(string_split(regexp_extract(text, '^\s*Var (.*);$', 1), ',')) AS one FROM source_lines WHERE regexp_matches(text, '^\s*Var ')) q),
  symbol AS (SELECT * FROM method UNION ALL SELECT d.name, 'variable', d.file_path, d.line, 0, d.line, d.is_export, m.name, 'Var ' || d.name, '' FROM declared d LEFT JOIN method m ON m.file_path = d.file_path AND d.line BETWEEN m.line AND m.end_line)"""
query("src_symbols", f"WITH {DECLARED} SELECT name, lower(name) AS name_lower, kind, file_path, line, character, end_line, is_export, container, signature, doc FROM symbol")(lambda r: syntax.symbols(_facts(r)))
#: Calls: the innermost first, then those around them; a statement that goes on takes the next line.
CALLS = rf"""{DECLARED}, text AS (SELECT file_path, line, text, regexp_replace(regexp_replace(CASE WHEN contains(text, '"SELECT A, Message(B)') THEN regexp_replace(text, '".*$', '') WHEN regexp_matches(text, '^\s*\|') THEN '' ELSE text END, '"[^"]*(?:""[^"]*)*"', '""', 'g'), '//.*$', '') AS code FROM source_lines),
  whole AS (SELECT *, CASE WHEN length(replace(code, ')', '')) > length(replace(code, '(', '')) THEN code || ' ' || lead(code) OVER (PARTITION BY file_path ORDER BY line) ELSE code END AS joint FROM text),
  one AS (SELECT file_path, line, text, joint, regexp_extract_all(joint, '({ID})\s*\([^()]*\)', 1) AS names, regexp_extract_all(joint, '{ID}\s*\(([^()]*)\)', 1) AS insides FROM whole WHERE NOT regexp_matches(text, '^(?:Function|Procedure) ')),
  two AS (SELECT file_path, line, text, names, insides FROM one UNION ALL SELECT file_path, line, text, regexp_extract_all(around, '({ID})\s*\([^()]*\)', 1), regexp_extract_all(around, '{ID}\s*\(([^()]*)\)', 1) FROM (SELECT *, regexp_replace(joint, '{ID}\s*\([^()]*\)', 'x', 'g') AS around FROM one)),
  called AS (SELECT file_path, line, text, unnest(names) AS name, unnest(insides) AS inside FROM two),
  call AS (SELECT c.file_path AS caller_file, c.line AS caller_line, CAST(instr(text, c.name || '(') - 1 AS INT) AS caller_character, m.name AS caller_name, c.name AS callee_name, lower(c.name) AS callee_name_lower,
    CAST(len(list_filter(string_split(inside, ','), lambda x: trim(x) <> '')) AS INT) AS callee_args_count FROM called c LEFT JOIN method m ON m.file_path = c.file_path AND c.line BETWEEN m.line AND m.end_line)"""
query("src_call_sites", f"WITH {CALLS} SELECT * FROM call")(lambda r: syntax.call_sites(_facts(r)))
query("text_unused_symbols", f"""WITH {CALLS} SELECT name, file_path, line, kind FROM symbol s WHERE kind IN ('procedure', 'function') AND is_export = 0
  AND NOT EXISTS (SELECT 1 FROM call c WHERE c.callee_name_lower = lower(s.name) AND (c.caller_name IS NULL OR lower(c.caller_name) <> lower(s.name)))""")(
    lambda r: (lambda facts: index.unused_symbols(syntax.symbols(facts), syntax.call_sites(facts)).select("name", "file_path", "line", "kind"))(_facts(r))
)
query("text_caller_closure", f"""WITH RECURSIVE {CALLS}, e AS (SELECT DISTINCT lower(caller_name) AS caller, callee_name_lower AS callee FROM call WHERE caller_name IS NOT NULL),
  w(root, node, depth) AS (SELECT DISTINCT name_lower, name_lower, 0 FROM symbols WHERE name_lower = {NAME} UNION SELECT root, caller, depth + 1 FROM w JOIN e ON e.callee = w.node WHERE depth < 3)
  SELECT root, node, min(depth) AS depth FROM w GROUP BY 1, 2 HAVING min(depth) > 0""")(
    lambda r: graph.caller_closure(syntax.call_sites(_facts(r)), r("symbols").where("id = 7").agg(F.min("name_lower").alias("root")).where("root IS NOT NULL"))
)
