"""Personal data: four base kinds and bootstrapped contextual extraction (DataFrame expressions only).

Base spans follow one pattern per kind, leftmost and non-overlapping; a match that
fails its kind's test (octets, digit counts, Luhn) is dropped.  Places are code points:
running sums of the lengths of matches and gaps, by blocks, so that a text of n
matches costs n times a constant and not n squared.

Seeds are the base spans and, as a fifth kind, secrets: tokens of 20 characters or more
that mix letters and digits.  Candidates are blank-separated tokens with a digit or
``@``, or behind ``:`` or ``=`` (those may be letters alone), without the punctuation
around them.  A candidate's lexical patterns are its one, two and three words to the
left, its one and two words to the right (lower case, digits as 9; at most as far as the
next candidate, included) and its shape with the word to the left.

On the graph of distinct (pattern, instance) pairs a pattern's confidence for a kind is
the number of its known instances over all its instances plus ``SMOOTHING``, if they are
``MIN_SUPPORT`` or more.  An instance that is not known scores 1 - prod(1 - confidence)
over the best pattern of each side (left, right, shape; ``MAX_SIDE`` at most).  Instances of ``MIN_SCORE`` or
more become known, and so on until none is added; known sets only grow, so this ends.
Known instances are added wherever they occur outside base spans.

Edge cases: null texts have no spans; repeated rows have the same spans; a null doc_id
is a value; an empty table gives an empty result; words of any length count whole;
extra columns pass through redaction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeprism.llm.common import broadcast_if_small, materialize

KINDS = ("email", "ip", "card", "phone", "secret")
#: The kinds that base patterns find; the others come from the method.
BASE = 4
#: The base patterns, with atomic runs and look-behind so that no start inside a run is tried again.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
OCTETS = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What separates runs of digits that single blanks or hyphens join.
CARD_GAP = r"[^0-9]{2,}+|[^0-9\x20-]"
TOKEN = r"(?<!\S)(?=[^\s0-9@]*+[0-9@])\S++|(?<=[:=]\s)\S++"
SECRET = r"^(?=[^0-9]*+[0-9])(?=[^A-Za-z]*+[A-Za-z])[A-Za-z0-9_/+=-]{20,}$"
#: Punctuation that does not belong to a token at its ends.
AROUND = "\"'()[]{}<>,;:!?."
SMOOTHING, MIN_SUPPORT, MIN_SCORE = 1.0, 3, 0.9
#: What the best pattern of one side counts at most: less than ``MIN_SCORE``, so that two sides must agree.
MAX_SIDE = 0.85
#: Matches whose lengths are summed one by one; the sums of earlier blocks are at hand.
BLOCK = 128
#: Confident patterns and known instances are broadcast up to this number, joined by a shuffle beyond it.
BROADCAST_ROWS = 100_000

NO_SPANS = "cast(array() AS array<struct<start:bigint,kind:int,end:bigint>>)"


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates ``value`` once and calls it ``name`` in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _starts(matches: str, gaps: str) -> str:
    """SQL for the places where the ``matches`` start; gap i stands before match i."""
    body = f"""transform({matches}, (m, i) -> heads[i div {BLOCK}]
        + aggregate(slice(lens, (i div {BLOCK}) * {BLOCK} + 1, i % {BLOCK}), 0L, (a, x) -> a + x) + char_length({gaps}[i]))"""
    heads = "transform(sums, (s, b) -> aggregate(slice(sums, 1, b), 0L, (a, x) -> a + x))"
    sums = f"transform(sequence(0, (size(lens) - 1) div {BLOCK}), b -> aggregate(slice(lens, cast(b * {BLOCK} + 1 AS int), {BLOCK}), 0L, (a, x) -> a + x))"
    lens = f"zip_with({gaps}, {matches}, (g, m) -> cast(char_length(g) + coalesce(char_length(m), 0) AS bigint))"
    found = _let("lens", lens, _let("sums", sums, _let("heads", heads, body)))
    return f"CASE WHEN size({matches}) = 0 THEN cast(array() AS array<bigint>) ELSE {found} END"


def _spans(kind: int, matches: str, starts: str, test: str) -> str:
    """SQL for the spans (start, kind, end) of matches x.m that pass ``test``."""
    pairs = f"zip_with({matches}, {starts}, (m, s) -> struct(m AS m, s AS s))"
    return f"transform(filter({pairs}, x -> {test}), x -> struct(x.s AS start, {kind} AS kind, x.s + char_length(x.m) AS end))"


def _digits(text: str) -> str:
    return f"translate({text}, ' -+().', '')"


LUHN = """aggregate(sequence(1, char_length({d})), 0, (a, i) -> a + CASE WHEN (char_length({d}) - i) % 2 = 0 THEN cast(substr({d}, i, 1) AS int)
    ELSE cast(substr({d}, i, 1) AS int) * 2 - CASE WHEN substr({d}, i, 1) >= '5' THEN 9 ELSE 0 END END) % 10 = 0"""


def _patterns(token: str, left: str, right: str) -> str:
    """SQL for the patterns (side, pattern) of ``token`` between the texts ``left`` and ``right``, whose runs of blanks are single blanks."""
    plain = lambda t: f"trim(regexp_replace(lower({t}), '[0-9]', '9'))"
    shape = f"regexp_replace(regexp_replace({token}, '\\\\p{{L}}+', 'a'), '[0-9]', '9')"
    body = f"""concat(
        transform(sequence(1, greatest(1, least(3, size(split(l, ' '))))), k -> struct('L' AS side, concat(k, '<', substring_index(l, ' ', -k)) AS pattern)),
        transform(sequence(1, greatest(1, least(2, size(split(r, ' '))))), k -> struct('R' AS side, concat(k, '>', substring_index(r, ' ', k)) AS pattern)),
        array(struct('S' AS side, concat(substring_index(l, ' ', -1), '=', {shape}) AS pattern)))"""
    return _let("l", plain(f"substring_index(rtrim({left}), ' ', -3)"), _let("r", plain(f"substring_index(ltrim({right}), ' ', 2)"), body))


def base_spans(docs: DataFrame, *keys: Column) -> DataFrame:
    """``keys`` as k0, k1..., base (array of start, kind, end; end exclusive) and tokens (start, end, token, patterns)."""
    names = [f"k{i}" for i in range(len(keys))]
    text = docs.select(*(k.alias(n) for k, n in zip(keys, names)), F.coalesce("text", F.lit("")).alias("t"))
    empty = F.array().cast("array<string>")

    def found(when: Column, pattern: str, name: str) -> list[Column]:
        return [F.when(when, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(empty).alias(f"{name}_m"), F.when(when, F.split("t", pattern, -1)).otherwise(empty).alias(f"{name}_g")]

    has_card = F.col("t").rlike("[0-9](?:[ -]?[0-9]){11}")
    cut = text.select(
        *names,
        F.array(F.struct(
            *found(F.contains("t", F.lit("@")), EMAIL, "email"),
            *found(F.col("t").rlike(r"[0-9]\.[0-9]"), IP, "ip"),
            *found(F.col("t").rlike(r"\+[0-9]"), PHONE, "phone"),
            F.when(has_card, F.split("t", CARD_GAP, -1)).otherwise(empty).alias("card_m"),
            F.when(has_card, F.regexp_extract_all("t", F.lit(CARD_GAP), F.lit(0))).otherwise(empty).alias("card_g"),
            *found(F.col("t").rlike(r"[0-9@]|[:=]\s"), TOKEN, "token"),
        )).alias("cut"),
    )
    folded = F.transform("cut", lambda c: c.withField("token_f", F.transform(c["token_g"], lambda g: F.regexp_replace(g, r"\s+", " "))))
    cut = cut.select(*names, folded.alias("cut"))
    # Runs of digits stand before the gaps between them: as matches, each gap is the one before.
    runs = f"zip_with(c.card_m, {_starts('c.card_m', 'gaps')}, (m, s) -> struct(m AS m, s AS s, translate(m, ' -', '') AS d))"
    runs = f"filter({runs}, x -> char_length(x.d) BETWEEN 12 AND 19 AND {LUHN.format(d='x.d')})"
    cards = f"""transform({runs}, x -> struct(x.s + char_length(x.m) - char_length(trim(LEADING ' -' FROM x.m)) AS start, 2 AS kind,
        x.s + char_length(trim(TRAILING ' -' FROM x.m)) AS end))"""
    cards = _let("gaps", "concat(array(''), c.card_g)", cards)
    every = f"""concat({_spans(0, 'c.email_m', _starts('c.email_m', 'c.email_g'), 'true')}, {_spans(1, 'c.ip_m', _starts('c.ip_m', 'c.ip_g'), f"x.m RLIKE r'{OCTETS}'")}, {cards},
        {_spans(3, 'c.phone_m', _starts('c.phone_m', 'c.phone_g'), f"char_length({_digits('x.m')}) BETWEEN 9 AND 15")})"""
    around = AROUND.replace("'", "\\'")
    bare = f"trim(BOTH '{around}' FROM x.m)"
    patterns = _patterns("v.token", "concat(coalesce(get(c.token_m, v.i - 1), ''), c.token_f[v.i])", "concat(c.token_f[v.i + 1], coalesce(get(c.token_m, v.i + 1), ''))")
    places = f"zip_with(c.token_m, {_starts('c.token_m', 'c.token_g')}, (m, s) -> struct(m AS m, s AS s))"
    places = f"transform({places}, (x, i) -> struct(x.s + char_length(x.m) - char_length(trim(LEADING '{around}' FROM x.m)) AS start, {bare} AS token, i AS i))"
    tokens = f"transform(filter({places}, v -> v.token <> ''), v -> struct(v.start AS start, v.start + char_length(v.token) AS end, v.token AS token, {patterns} AS patterns))"
    made = f"transform(cut, c -> struct(array_sort({every}) AS base, {tokens} AS tokens))"
    return cut.select(*names, F.inline(F.expr(made)))


def contextual_spans(found: DataFrame, key: str = "key", smoothing: float = SMOOTHING, min_support: int = MIN_SUPPORT, min_score: float = MIN_SCORE) -> DataFrame:
    """key and the array of spans that secrets and bootstrapping add; ``found`` has key, base and tokens."""
    spots = found.select(key, "base", F.inline("tokens")).select(
        key, "start", "end", F.lower("token").alias("instance"), "patterns", F.col("token").rlike(SECRET).alias("secret"),
        F.expr("get(filter(base, s -> s.start >= start AND s.start < end), 0)").alias("own"),
        F.expr("exists(base, s -> s.start < end AND s.end > start)").alias("known"),
    )
    # A seed that runs over several tokens is an instance of its own, not its first token.
    longer = F.col("own.end") > F.col("end")
    kind = F.coalesce("own.kind", F.when(F.col("secret") & ~F.col("known"), F.lit(BASE)))
    instance = F.when(longer, F.concat("instance", F.lit("\0"), F.col("own.end") - F.col("start"))).otherwise(F.col("instance"))
    spots = materialize(spots.withColumn("seed", kind).where(F.col("seed").isNotNull() | ~F.col("known")).select(key, "start", "end", instance.alias("instance"), "patterns", "seed", "known"))
    edges = materialize(spots.select("instance", F.explode("patterns").alias("p")).select("instance", "p.side", "p.pattern").distinct())
    size = edges.groupBy("side", "pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_support)
    known = materialize(spots.where(F.col("seed").isNotNull()).groupBy("instance").agg(F.max("seed").alias("kind")))
    seeds, count = known, known.count()
    while count:
        held = edges.join(broadcast_if_small(known, BROADCAST_ROWS), "instance").groupBy("side", "pattern", "kind").agg(F.count(F.lit(1)).alias("s")).where(F.col("s") >= min_support)
        sure = materialize(held.join(size, ["side", "pattern"]).select("side", "pattern", "kind", (F.col("s") / (F.col("n") + F.lit(smoothing))).alias("c")).where(F.col("c") >= 1 - (1 - min_score) ** (1 / 3) - 1e-9))
        sides = edges.join(broadcast_if_small(sure, BROADCAST_ROWS), ["side", "pattern"]).groupBy("instance", "kind", "side").agg(F.max("c").alias("c"))
        scored = sides.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("c", F.lit(MAX_SIDE)))))).alias("score")).where(F.col("score") >= min_score)
        new = scored.groupBy("instance").agg(F.max(F.struct("score", "kind"))["kind"].alias("kind")).join(known.select("instance"), "instance", "left_anti")
        known, before = materialize(known.unionByName(new)), count
        count = known.count()
        if count == before:
            break
    learned = known.join(seeds.where(F.col("kind") < BASE).select("instance"), "instance", "left_anti")
    new = spots.where(~F.col("known")).join(broadcast_if_small(learned, BROADCAST_ROWS), "instance")
    return new.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("start", "kind", "end"))).alias("added"))


def all_spans(docs: DataFrame) -> DataFrame:
    """key (doc_id and the text's hash), base and spans (base and added, by start, then kind) of every row."""
    key = F.struct(F.col("doc_id"), F.xxhash64("text").alias("h"))
    found = materialize(base_spans(docs, key).withColumnRenamed("k0", "key"))
    added = contextual_spans(found).withColumnRenamed("key", "of")
    joined = found.select("key", "base").join(added, F.col("key").eqNullSafe(F.col("of")), "left")
    return joined.select("key", "base", F.array_sort(F.concat("base", F.coalesce("added", F.expr(NO_SPANS)))).alias("spans"))


def joined(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', array({names})[s.kind], s.start, s.end)), ',')")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans and n_added of every row."""
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = {i})")).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:BASE])]
    return all_spans(docs).select(
        F.col("key.doc_id").alias("doc_id"), *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span (overlapping ones merged) replaced by its kind, like ``<EMAIL>``; n_chars follows."""
    spans = all_spans(docs).where(F.size("spans") > 0).select("key", "spans").dropDuplicates(["key"])
    key = F.struct(F.col("doc_id"), F.xxhash64("text").alias("h"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("own"))
    names = ", ".join(f"'<{k.upper()}>'" for k in KINDS)
    # Spans are merged first and pieces joined once, so a text is not copied for each of its spans.
    last = "element_at(a, -1)"
    merged = f"""aggregate(spans, {NO_SPANS}, (a, s) -> CASE WHEN size(a) > 0 AND s.start < {last}.end
        THEN concat(slice(a, 1, size(a) - 1), array(struct({last}.start AS start, {last}.kind AS kind, greatest({last}.end, s.end) AS end)))
        ELSE concat(a, array(s)) END)"""
    pieces = f"""concat(transform(merged, (s, i) -> concat(substring(row.text, cast(coalesce(get(merged, i - 1).end, 0L) + 1 AS int), cast(s.start - coalesce(get(merged, i - 1).end, 0L) AS int)), array({names})[s.kind])),
        array(substring(row.text, cast(element_at(merged, -1).end + 1 AS int))))"""
    text = F.expr(f"CASE WHEN spans IS NULL THEN row.text ELSE array_join({_let('merged', merged, pieces)}, '') END")
    out = rows.join(spans, F.col("own").eqNullSafe(F.col("key")), "left").select("row", "spans", text.alias("text"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.char_length("text").cast("long")) if "n_chars" in docs.columns else None}
    return out.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
