"""The operators as queries over the whole test tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeprism.llm import bpe, fingerprints, lexical_search, licenses, line_dedup, lm, packing, pii, quality, simhash, suffix_dedup, url_filter, vector_codes
from codeprism.llm.common import LOWER, UPPER, read


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_boilerplate(read(spark, sf_dir, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_versions(read(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, sf_dir, "pages"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group_documents(read(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(read(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op10_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read(spark, sf_dir, "embeddings"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OPERATORS = (
    op1_line_dedup, op2_fingerprints, op3_suffix_dedup, op4_url_filter, op5_simhash, op6_packing, op7_pii, op8_lm_score, op9_bpe, op10_host_quality, op11_vector_codes,
    op12_license_scan, op13_lexical_search,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def _terms(terms: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{t}'" for t in terms) + "]"


SQL_LINES = f"""
WITH doc AS (SELECT doc_id, source, string_split(text, chr(10)) AS all_lines FROM documents),
line AS (SELECT doc_id, source, i - 1 AS place, trim(all_lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
         FROM doc, unnest(range(1, len(all_lines) + 1)) AS u(i)),
bad AS (SELECT line, min((doc_id, place)) AS first FROM line WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce(source, chr(0))) >= {line_dedup.MIN_SITES}),
gone AS (SELECT doc_id, list(place) AS places FROM line JOIN bad USING (line) WHERE (doc_id, place) <> first GROUP BY doc_id)
SELECT doc_id, CAST(len(all_lines) AS BIGINT) AS n_lines, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(all_lines, lambda x, i: NOT coalesce(list_contains(places, i - 1), false)), chr(10))) AS kept_sha256
FROM doc LEFT JOIN gone USING (doc_id)"""

_HOST = f"translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
SQL_URLS = f"""
WITH part AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
cut AS (SELECT page_id, {_HOST} AS host, regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, ' ' || translate(u, '{UPPER}', '{LOWER}') || ' ' AS t FROM part),
rules AS (SELECT * FROM (VALUES {', '.join(str(r) for r in url_filter.RULES)}) AS v(rh, rp, verdict)),
best AS (SELECT page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(verdict, length(rh || rp)) AS ruled
         FROM cut JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
hit AS (SELECT page_id, len(list_filter({_terms(url_filter.STRICT)}, lambda x: regexp_matches(t, '[^a-z0-9]' || x || '[^a-z0-9]'))) AS strict,
         len(list_filter({_terms(url_filter.SOFT)}, lambda x: regexp_matches(t, '[^a-z0-9]' || x || '[^a-z0-9]'))) AS soft FROM cut)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN strict > 0 OR soft >= {url_filter.SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM cut JOIN hit USING (page_id) LEFT JOIN best USING (page_id)"""

_BLANK = "'[ \\t\\n\\x0b\\f\\r]+'"
SQL_QUALITY = f"""
WITH word AS (SELECT doc_id, source, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), {_BLANK}), lambda w: w <> '') AS words FROM documents),
gram AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM word, unnest(range(1, len(words) - 1)) AS u(i)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM gram),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2]) AS u(k) WHERE n > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, {_BLANK}, '', 'g')) > 0) AS l FROM word),
base AS (SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, {_BLANK}, '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM word JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  {', '.join(f'({sql}) AS fails_{r}' for r, sql in quality.SOFT.items())} FROM base),
host AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(base_failed AS BIGINT)) AS DOUBLE) AS f_base,
  {', '.join(f'CAST(sum(CAST(fails_{r} AS BIGINT)) AS DOUBLE) AS f_{r}' for r in quality.SOFT)} FROM judged GROUP BY source),
rule AS ({' UNION ALL '.join(f"SELECT source, '{r}' AS rule, n, f_{r} AS f FROM host" for r in quality.RULES)}),
sums AS (SELECT rule, CAST(count(*) AS DOUBLE) AS h, sum(n) AS d, sum(f) AS t, sum(f) / sum(n) AS m, sum(f * f / n) - sum(f) * sum(f) / sum(n) AS s, sum(n) - sum(n * n) / sum(n) AS z FROM rule GROUP BY rule),
corr AS (SELECT rule, m, CASE WHEN h < 2 OR m * (1 - m) = 0 OR z / (h - 1) <= 1 THEN 0 ELSE (s / (h - 1) - m * (1 - m)) / (m * (1 - m) * (z / (h - 1) - 1)) END AS c FROM sums),
fit AS (SELECT rule, m, CASE WHEN c > 0 THEN least({quality.MOST_WEIGHT}, greatest({quality.LEAST_WEIGHT}, 1 / c - 1)) ELSE {quality.MOST_WEIGHT} END AS w FROM corr),
rate AS (SELECT source, rule, m, n, w, (f + m * w) / (n + w) AS r FROM rule JOIN fit USING (rule)),
low AS (SELECT source, rule, m, r - {quality.Z} * sqrt(r * (1 - r) / (n + w + 1)) AS l FROM rate),
verdict AS (SELECT source, coalesce(bool_or(rule = 'base' AND l >= {quality.HOST_LIMIT}), false) AS bad, {', '.join(f"coalesce(bool_or(rule = '{r}' AND l >= {quality.STRICT} * m), false) AS strict_{r}" for r in quality.SOFT)} FROM low GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR bad {' '.join(f'OR (fails_{r} AND strict_{r})' for r in quality.SOFT)}) AS kept
FROM judged JOIN verdict ON judged.source IS NOT DISTINCT FROM verdict.source"""




def _assigned(k: int) -> str:
    """Each part's nearest entry of codebooks ``book{k}``: (vec_id, part, x, d, entry)."""
    return f"""near{k} AS (SELECT vec_id, part, any_value(x) AS x, min((d, entry)) AS best FROM (
  SELECT p.*, entry, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM piece p JOIN book{k} USING (part)) GROUP BY vec_id, part)"""


def _moved(k: int) -> str:
    """Codebooks ``book{k + 1}``: the floor of the parts' mean by component, or the entry as it was."""
    return f"""book{k + 1} AS (SELECT part, entry, list(coalesce(m, v) ORDER BY i) AS c FROM (SELECT part, entry, i, c[i] AS v FROM book{k}, unnest(range(1, len(c) + 1)) AS u(i))
  LEFT JOIN (SELECT part, best[2] AS entry, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM near{k}, unnest(range(1, len(x) + 1)) AS u(i) GROUP BY ALL) USING (part, entry, i) GROUP BY part, entry)"""


SQL_VECTORS = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({vector_codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
piece AS MATERIALIZED (SELECT vec_id, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS x FROM kept, unnest(range({vector_codes.PARTS})) AS u(part)),
book0 AS (SELECT part, entry, x AS c FROM piece JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) USING (vec_id) WHERE entry < {vector_codes.ENTRIES}),
{', '.join(f'{_assigned(k)}, {_moved(k)}' for k in range(vector_codes.ROUNDS))}, {_assigned(vector_codes.ROUNDS)},
sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{vector_codes.ROUNDS}),
code AS (SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM near{vector_codes.ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM code JOIN kept USING (vec_id), sha"""

_WORDS = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
_LICENSES = ", ".join(f"('{label}', {g}, [{', '.join(repr(w) for w in words)}], {a})" for label, g, words, a in licenses.prepared(licenses.TEMPLATES))
_PHRASES = ", ".join(f"({p.split()!r}, '{label}')" for p, label in licenses.PHRASES)
SQL_LICENSES = f"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS words FROM documents),
phrase(p, label) AS (VALUES {_PHRASES}), template(label, g, t, a) AS (VALUES {_LICENSES}),
place AS (SELECT rid, label, i - 1 AS spot FROM w, phrase, unnest(range(1, len(words) - len(p) + 2)) AS u(i) WHERE len(words) >= len(p) AND list_has_all(words, p) AND words[i : i + len(p) - 1] = p),
base AS (SELECT rid, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list(DISTINCT label) AS labels FROM place GROUP BY rid),
block AS MATERIALIZED (SELECT rid, g, list_distinct(words[k * g + 1 : (k + 2) * g]) AS b FROM w, (SELECT DISTINCT g FROM template), unnest(range(0, CAST(greatest(1, ceil(len(words) / g) - 1) AS BIGINT))) AS u(k)),
hit AS (SELECT rid, label, len(list_intersect(t, b)) / len(t) AS share FROM block JOIN template USING (g) WHERE len(list_intersect(t, b)) >= a),
met AS (SELECT rid, max(share) AS share, list(DISTINCT label) AS labels FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(met.labels, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0) END AS score
FROM w LEFT JOIN base USING (rid) LEFT JOIN met USING (rid)"""

_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL_SEARCH = f"""
WITH held AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
corpus AS (SELECT CAST(count(*) AS BIGINT) AS c, CAST(sum(len(terms)) AS BIGINT) AS l FROM held WHERE len(terms) > 0),
doc AS (SELECT doc_id, terms, 100 - 75 + (75 * len(terms) * c) // l AS m FROM held, corpus WHERE len(terms) > 0),
posting AS MATERIALIZED (SELECT doc_id, m, term, count(*) AS tf FROM (SELECT doc_id, m, unnest(terms) AS term FROM doc) GROUP BY ALL),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * c + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM posting, corpus GROUP BY term, c),
scored AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM asked JOIN weight USING (term) JOIN posting USING (term) GROUP BY ALL),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {lexical_search.TOP}"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": SQL_LINES, "op4_url_filter": SQL_URLS, "op10_host_quality": SQL_QUALITY, "op11_vector_codes": SQL_VECTORS, "op12_license_scan": SQL_LICENSES, "op13_lexical_search": SQL_SEARCH}
