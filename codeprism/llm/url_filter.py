"""URL filter: host and path rules first, else a weighted vocabulary.

Terms come from a table (term, weight): weight ``STRICT_WEIGHT`` or more is strict, a
lower one soft, none or zero is no term.  Explicit rules (host, path prefix, verdict) win; the longest fitting one decides.
Other URLs are scanned once by an Aho-Corasick automaton over all terms.  A hit
counts only if no ASCII letter or digit touches it on either side.  One strict term,
or ``soft_limit`` different soft terms, reject the URL.

Edge cases: null URLs and those without ``://`` have empty host and path, fit no
rule and are judged by their text alone (null: allow); repeated rows are judged
alike; very long URLs are scanned whole; an empty table gives an empty result, an empty
vocabulary allows all; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeprism.llm.common import LOWER, UPPER

RULES: tuple[tuple[str, str, str], ...] = (
    ("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"), ("org", "/es/", "block"),
)
#: The default vocabulary; ``vocabulary`` takes another from a table.
STRICT = (
    "spam", "porn", "porno", "xxx", "casino", "viagra", "cialis", "malware", "phishing", "warez", "keygen", "hentai", "escort", "milf", "camgirl", "sexcam",
    "blackjack", "roulette", "sportsbook", "payday",
)
SOFT = (
    "cheap", "pills", "farm", "free", "win", "bonus", "loan", "loans", "adult", "bet", "click", "deal", "promo", "sex", "nude", "dating", "poker", "slots",
    "crack", "torrent", "replica", "discount", "jackpot", "pharmacy", "seo", "backlinks",
)
#: Terms of a table at most, since every task holds them.
MAX_TERMS = 1_000_000
SOFT_LIMIT, STRICT_WEIGHT = 2, 1.0


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null."""
    best = F.lit(None)
    for name, prefix, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(prefix))
        best = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def vocabulary(terms: DataFrame, strict_weight: float = STRICT_WEIGHT) -> tuple[list[str], list[str]]:
    """Strict and soft terms of a table with columns term and weight; letters count without case (ASCII)."""
    rows = terms.where("term <> '' AND weight > 0").groupBy(F.translate("term", UPPER, LOWER).alias("term")).agg(F.max("weight").alias("weight")).limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    return sorted(r["term"] for r in rows if r["weight"] >= strict_weight), sorted(r["term"] for r in rows if r["weight"] < strict_weight)


def automaton(strict: Sequence[str], soft: Sequence[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for terms, weight in ((soft, 1), (strict, 2)):
        for term in terms:
            found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def rejects(found, url: str | None, soft_limit: int = SOFT_LIMIT) -> bool:
    """Whether the vocabulary rejects ``url``; letters count without case (ASCII)."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url or "")
    inner = lambda i: 0 <= i < len(text) and text[i].isascii() and text[i].isalnum()
    soft = set()
    if not len(found):
        return False
    for end, (term, weight) in found.iter(text):
        if not inner(end + 1) and not inner(end - len(term)):
            if weight == 2:
                return True
            soft.add(term)
    return len(soft) >= soft_limit


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_limit: int = SOFT_LIMIT
) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages``."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(strict, soft)
        for b in batches:
            verdict = pa.array([v or ("block" if rejects(found, u, soft_limit) else "allow") for u, v in zip(b["url"].to_pylist(), b["ruled"].to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([b["page_id"], b["host"], b["path"], b["rule"], verdict], ["page_id", "host", "path", "rule", "verdict"])

    url = F.coalesce("url", F.lit(""))
    parts = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = parts.withColumn("r", rule_for(F.col("host"), F.col("path"), rules)).select("page_id", "url", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"))
    kind = dict(pages.dtypes)["page_id"]
    return ruled.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string")
