"""Quality rules with host-level verdicts (DataFrame expressions only).

Rules look at one text: the base rule (too few words, or too many inside repeated
windows) and three softer ones (symbols, repeated lines, word length).  Failures of each
rule are aggregated by host (``source``).  A raw share is noise for a host with few
documents, so it is shrunk by a beta prior fitted to all hosts: its mean is the corpus
rate and its weight follows from the spread of the hosts' rates less what binomial noise
alone would make of it (the analysis-of-variance estimate of the correlation within
hosts).  The lower end of the posterior (``Z`` standard deviations below its mean) decides:

* a host is bad if it is sure to fail the base rule at ``HOST_LIMIT`` or more; all its documents go;
* a host is strict in a softer rule if it is sure to fail it ``STRICT`` times as often
  as the corpus; its documents that fail that rule go, which elsewhere are kept.

Edge cases: a null text has no words and fails; very long texts count whole; a null
source is a host of its own; repeated rows count as often as they occur; a single host
is its own corpus; an empty table gives an empty result; other columns pass through
``keep_good`` and are not read by ``judge``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeprism.llm.common import broadcast_if_small, materialize, stored, words_of

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Softer rules: symbols per 100 words, percent of repeated lines, code points per word.
MAX_SYMBOL_PERCENT, MAX_DUP_LINE_PERCENT, WORD_LENGTH = 10, 30, (3, 12)
HOST_LIMIT, STRICT, Z = 0.5, 1.5, 1.645
#: The prior's weight in documents: at least, and at most (where hosts differ by noise alone).
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1e6
#: Rejected hosts are broadcast up to this number, joined by a shuffle beyond it.
BROADCAST_HOSTS = 200_000
SYMBOLS = "#*$%&|<>"
#: Softer rules by name, over the counts of a text; the SQL twin reads them too.
SOFT = {
    "symbols": f"100 * n_symbols > {MAX_SYMBOL_PERCENT} * n_words",
    "dup_lines": f"100 * n_dup_lines > {MAX_DUP_LINE_PERCENT} * n_lines",
    "word_length": f"word_chars < {WORD_LENGTH[0]} * n_words OR word_chars > {WORD_LENGTH[1]} * n_words",
}
RULES = ("base", *SOFT)


def _repeat_words() -> Column:
    """Words inside 3-word windows that occur twice or more; needs columns words, grams.

    Equal windows meet by sorting (hash, place) pairs; their places in order give the
    covered words, 3 for each window less its overlap with the next.
    """
    return F.expr(
        """
        CASE WHEN size(array_distinct(grams)) = size(grams) THEN 0L ELSE
          aggregate(
            transform(array(sort_array(transform(grams, (h, i) -> struct(h AS h, i AS i)))), s ->
              sort_array(transform(filter(s, (x, k) -> coalesce(x.h = get(s, k - 1).h, false) OR coalesce(x.h = get(s, k + 1).h, false)), x -> x.i))),
            0L,
            (total, places) -> total + aggregate(transform(places, (p, k) -> coalesce(least(3, get(places, k + 1) - p), 3)), 0L, (a, b) -> a + b))
        END"""
    )


def text_metrics(docs: DataFrame, *keys: Column, text: str = "text") -> DataFrame:
    """``keys`` and the counts of each text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed."""
    raw = F.coalesce(F.col(text), F.lit(""))
    names = [f"k{i}" for i in range(len(keys))]
    words = docs.select(*(k.alias(n) for k, n in zip(keys, names)), raw.alias("raw"), words_of(F.col(text)).alias("words"))
    grams = words.select(
        *names,
        "raw",
        F.size("words").cast("long").alias("n_words"),
        F.expr("CASE WHEN size(words) < 3 THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) END").alias("grams"),
    )
    lines = F.filter(F.split("raw", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    counted = grams.select(
        *names,
        "n_words",
        F.char_length(F.translate("raw", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length("raw") - F.char_length(F.translate("raw", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        _repeat_words().alias("n_repeat_words"),
    ).select(
        *names,
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def failures() -> list[Column]:
    """fails_<rule> of each rule, over the counts of a text."""
    return [F.col("base_failed").alias("fails_base"), *(F.expr(sql).alias(f"fails_{name}") for name, sql in SOFT.items())]


def host_verdicts(judged: DataFrame) -> DataFrame:
    """host, n and for each rule its failures, prior weight, posterior rate and lower end; ``judged`` has host and fails_<rule>."""
    hosts = materialize(judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(f"fails_{r}").cast("long")).alias(f"f_{r}") for r in RULES)))
    n, f = F.col("n"), {r: F.col(f"f_{r}") for r in RULES}
    sums = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("all"), F.sum((n * n).cast("double")).alias("squares"),
        *(F.sum(f[r]).alias(f"f_{r}") for r in RULES), *(F.sum(f[r] * f[r] / n).alias(f"s_{r}") for r in RULES),
    ).first()
    for r in RULES:
        rate, weight = prior(sums["hosts"], sums["all"] or 0, sums["squares"] or 0.0, sums[f"f_{r}"] or 0, sums[f"s_{r}"] or 0.0)
        mean = (f[r] + F.lit(rate * weight)) / (n + F.lit(weight))
        low = F.col(f"rate_{r}") - Z * F.sqrt(F.col(f"rate_{r}") * (1 - F.col(f"rate_{r}")) / (n + F.lit(weight + 1)))
        hosts = hosts.withColumn(f"rate_{r}", mean).withColumn(f"low_{r}", low).withColumn(f"corpus_{r}", F.lit(rate))
    return hosts


def prior(hosts: int, documents: int, squares: float, failed: int, scaled: float) -> tuple[float, float]:
    """Mean and weight (alpha + beta) of a rule's beta prior.

    ``squares`` is the sum of n * n and ``scaled`` that of f * f / n over the hosts.  The
    spread between hosts is compared with the m(1-m) a host that noise alone would give.
    """
    if not documents:
        return 0.0, MOST_WEIGHT
    rate = failed / documents
    noise = rate * (1 - rate)
    if hosts < 2 or noise == 0:
        return rate, MOST_WEIGHT
    between = (scaled - failed * failed / documents) / (hosts - 1)
    size = (documents - squares / documents) / (hosts - 1)
    within = (between - noise) / (noise * (size - 1)) if size > 1 else 0.0
    return rate, min(MOST_WEIGHT, max(LEAST_WEIGHT, 1 / within - 1)) if within > 0 else MOST_WEIGHT


def flagged_hosts(judged: DataFrame, host_limit: float = HOST_LIMIT, strict: float = STRICT) -> DataFrame:
    """flagged, bad and strict (names of rules) of the hosts that are bad or strict."""
    hosts = host_verdicts(judged)
    sharp = F.array(*(F.when(F.col(f"low_{r}") >= strict * F.col(f"corpus_{r}"), F.lit(r)) for r in SOFT))
    verdict = hosts.select(F.col("host").alias("flagged"), (F.col("low_base") >= host_limit).alias("bad"), F.filter(sharp, lambda x: x.isNotNull()).alias("strict"))
    return broadcast_if_small(materialize(verdict.where(F.col("bad") | (F.size("strict") > 0))), BROADCAST_HOSTS)


def with_verdict(judged: DataFrame, host_limit: float = HOST_LIMIT, strict: float = STRICT) -> DataFrame:
    """``judged`` with column kept; it has host, base_failed and fails_<rule>."""
    met = F.array(*(F.when(F.col(f"fails_{r}"), F.lit(r)) for r in SOFT))
    refused = F.coalesce(F.col("bad") | F.arrays_overlap("strict", F.filter(met, lambda x: x.isNotNull())), F.lit(False))
    joined = judged.join(flagged_hosts(judged, host_limit, strict), F.col("host").eqNullSafe(F.col("flagged")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~refused).drop("flagged", "bad", "strict")


def judge(docs: DataFrame, host_limit: float = HOST_LIMIT, strict: float = STRICT) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    counted = text_metrics(docs, F.col("doc_id"), F.col("source")).withColumnsRenamed({"k0": "doc_id", "k1": "host"})
    judged = materialize(counted.select("*", *failures()))
    return with_verdict(judged, host_limit, strict).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, host_limit: float = HOST_LIMIT, strict: float = STRICT) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    Texts are counted once: rows that pass the base rule are stored with their verdicts,
    the others only as verdicts for their hosts.
    """
    row = F.struct(*[docs[c] for c in docs.columns])
    counted = text_metrics(docs, row, F.col("source")).withColumnsRenamed({"k0": "row", "k1": "host"})
    judged = counted.select("host", "base_failed", *failures(), "row")
    judged = stored(judged.withColumn("row", F.when(~F.col("base_failed"), F.col("row"))))
    return with_verdict(judged, host_limit, strict).where("kept").select("row.*")
