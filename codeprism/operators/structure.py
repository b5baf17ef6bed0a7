"""Structure of modules: regions, foldable blocks, enclosing blocks, words and semantic tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeprism.functions.tables import stored
from codeprism.operators import rules as R

#: Block kinds as (opener, closer).
BLOCKS = {"method": (f"{R.PROC}|{R.FUNC}", f"{R.END_PROC}|{R.END_FUNC}"), "if": (R.IF, R.END_IF), "loop": (R.LOOP, R.END_LOOP), "try": (R.TRY, R.END_TRY), "region": (R.REGION, R.END_REGION)}
#: Token classes in order of precedence; the first that starts at a place wins.
CLASSES = (("string", R.STRING), ("comment", "//.*"), ("number", r"(?<![\p{L}\p{N}_.])[0-9]+(?:\.[0-9]+)?"), ("keyword", "(?iu)(?<![\\p{L}\\p{N}_.])(?:" + "|".join([R.PROC, R.FUNC, R.END_PROC, R.END_FUNC, R.IF, R.THEN, R.ELSIF, R.ELSE, R.END_IF, R.LOOP, R.DO, R.END_LOOP, R.TRY, R.EXCEPT, R.END_TRY, R.RETURN, R.RAISE, R.BREAK, R.CONTINUE, R.NOT, R.TRUE, R.FALSE, R.VAR, R.EXPORT, R.VAL]) + ")(?![\\p{L}\\p{N}_])"), ("method", rf"{R.ID}(?=\s*\()"), ("variable", R.ID))


def blocks(facts: DataFrame) -> DataFrame:
    """file_path, kind, start_line, end_line, depth of every block that closes.

    Within a kind the running depth of an opener equals that of its closer, so the
    k-th opener and the k-th closer of one depth are a pair.
    """
    return paired(facts.select("file_path", "line", F.inline(marks())))


def marks() -> Column:
    """What a line of code ``c`` opens or closes: an array of kind and step, 1 or -1."""
    cases = []
    for kind, (opens, closes) in BLOCKS.items():
        is_open, is_close = F.col("c").rlike("(?iu)" + R.starts(opens)), F.col("c").rlike("(?iu)" + R.starts(closes))
        cases.append(F.when(is_open, F.struct(F.lit(kind).alias("kind"), F.lit(1).alias("step"))).when(is_close, F.struct(F.lit(kind).alias("kind"), F.lit(-1).alias("step"))))
    return F.filter(F.array(*cases), lambda x: x.isNotNull())


def paired(marked: DataFrame) -> DataFrame:
    """``blocks`` from the marks (file_path, line, kind, step)."""
    level = F.sum("step").over(Window.partitionBy("file_path", "kind").orderBy("line")) + F.when(F.col("step") < 0, 1).otherwise(0)
    placed = marked.withColumn("depth", level)
    nth = F.row_number().over(Window.partitionBy("file_path", "kind", "depth", "step").orderBy("line"))
    placed = placed.withColumn("nth", nth)
    return (
        placed.groupBy("file_path", "kind", "depth", "nth")
        .agg(F.max(F.when(F.col("step") > 0, F.col("line"))).alias("start_line"), F.max(F.when(F.col("step") < 0, F.col("line"))).alias("end_line"))
        .where(F.col("start_line").isNotNull() & (F.col("end_line") >= F.col("start_line")) & (F.col("depth") > 0))
        .select("file_path", "kind", "start_line", "end_line", "depth")
    )


def regions(facts: DataFrame) -> DataFrame:
    """file_path, name, start_line, end_line."""
    name = F.regexp_extract("c", rf"^#\S+\s+({R.ID})", 1)
    return blocks(facts).where("kind = 'region'").join(facts.select("file_path", F.col("line").alias("start_line"), name.alias("name")), ["file_path", "start_line"]).select("file_path", "name", "start_line", "end_line")


def enclosing(found: DataFrame, positions: DataFrame, width: int = 64) -> DataFrame:
    """Blocks around each position (file_path, line), innermost first by ``nesting``.

    Blocks go to each bucket of ``width`` lines that they touch, so a line meets the blocks near it and not all of its file.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    near = found.withColumn("b", F.explode(F.sequence(bucket("start_line"), bucket("end_line"))))
    joined = positions.withColumn("b", bucket("line")).join(near, ["file_path", "b"]).where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    # A line has one bucket, so with it in the window the joined rows stay where they are.
    return joined.withColumn("nesting", F.row_number().over(Window.partitionBy("file_path", "b", "line").orderBy(F.col("start_line").desc(), F.col("end_line"), "kind"))).drop("b")


def enclosing_all(facts: DataFrame) -> DataFrame:
    """``enclosing`` blocks of every line: lines and marks are computed once and kept as a narrow table."""
    kept = stored(facts.select("file_path", "line", marks().alias("marks")))
    return enclosing(paired(kept.select("file_path", "line", F.inline("marks"))), kept.select("file_path", "line"))


def highlights(lines: DataFrame, word: str) -> DataFrame:
    """file_path, line and 0-based columns of the whole word, any case."""
    import re

    pattern = rf"(?iu)(?<![\p{{L}}\p{{N}}_]){re.escape(word)}(?![\p{{L}}\p{{N}}_])"
    gaps = lines.where(F.col("text").rlike(pattern)).select("file_path", "line", F.split("text", pattern, -1).alias("gaps"))
    at = F.transform(F.sequence(F.lit(1), F.size("gaps") - 1), lambda i: F.aggregate(F.slice("gaps", 1, i), F.lit(0), lambda a, g: a + F.char_length(g)) + (i - 1) * len(word))
    return gaps.select("file_path", "line", F.explode(at).alias("start"))


def semantic_tokens(lines: DataFrame) -> DataFrame:
    """file_path, line, start, length, type and the distance to the token before on the line.

    One pass of one pattern with a group per class; its order gives precedence.
    """
    pattern = "|".join(f"({p})" for _, p in CLASSES)
    gaps = lines.select("file_path", "line", F.split("text", pattern, -1).alias("g"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("m"))
    start = lambda i: F.aggregate(F.slice("g", 1, i + 1), F.lit(0), lambda a, g: a + F.char_length(g)) + F.aggregate(F.slice("m", 1, i), F.lit(0), lambda a, m: a + F.char_length(m))
    tokens = gaps.select("file_path", "line", F.inline(F.transform("m", lambda m, i: F.struct(start(i).alias("start"), m.alias("token"), F.get("g", i + 1).alias("after")))))
    kind = F.lit("variable")
    kind = F.when(F.col("after").rlike(r"^\s*\("), "method").otherwise(kind)
    kind = F.when(F.col("token").rlike("^" + CLASSES[3][1].replace("(?iu)", "(?iu)") + "$"), "keyword").otherwise(kind)
    kind = F.when(F.col("token").rlike("^[0-9]"), "number").when(F.startswith("token", F.lit("//")), "comment").when(F.startswith("token", F.lit('"')), "string").otherwise(kind)
    before = F.coalesce(F.lag("start").over(Window.partitionBy("file_path", "line").orderBy("start")), F.lit(0))
    return tokens.select("file_path", "line", "start", F.char_length("token").alias("length"), kind.alias("type"), (F.col("start") - before).alias("delta"))


def locals_of(facts: DataFrame) -> DataFrame:
    """file_path, scope, name, decl_line, origin of the locals of each method: parameters, declarations, loop variables, assignments."""
    inside = facts.where("scope > 0")
    parts = [
        R.parameters(facts).join(facts.where("head = 1").select("file_path", F.col("line").alias("proc_line"), "scope"), ["file_path", "proc_line"]).select("file_path", "scope", "name", F.col("proc_line").alias("decl_line"), F.lit("param").alias("origin")),
        inside.where(F.col("c").rlike("(?iu)" + R.starts(R.VAR))).select("file_path", "scope", F.explode(F.split(F.regexp_replace(F.regexp_replace("c", rf"(?iu)^(?:{R.VAR})\s+", ""), r"\s*;.*$", ""), r"\s*,\s*")).alias("name"), F.col("line").alias("decl_line"), F.lit("var").alias("origin")),
        inside.select("file_path", "scope", F.regexp_extract("c", rf"(?iu)^(?:Для|For)\s+(?:Каждого\s+|Each\s+)?({R.ID})", 1).alias("name"), F.col("line").alias("decl_line"), F.lit("loop").alias("origin")).where("name <> ''"),
        inside.select("file_path", "scope", F.regexp_extract("c", rf"^({R.ID})\s*=", 1).alias("name"), F.col("line").alias("decl_line"), F.lit("assignment").alias("origin")).where("name <> ''"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    first = F.min(F.struct("decl_line", "origin", "name")).alias("f")
    return out.groupBy("file_path", "scope", F.lower("name").alias("key")).agg(first).select("file_path", "scope", "f.name", "f.decl_line", "f.origin")
