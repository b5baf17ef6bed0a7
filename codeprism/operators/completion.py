"""Completion: words at positions, chains of metadata names, and candidates of several sources by rank.

Asks are rows, so that many positions are answered in one plan: every source is joined by
equality (a folded name, or the first letters of a prefix), never by comparing each ask
with each candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeprism.functions.text import fold

#: The name of the root of all collections, folded.
ROOTS = ("метаданные", "metadata")
WORD = r"[\p{L}\p{N}_]*"
NAME = r"[\p{L}_][\p{L}\p{N}_]*"
#: Letters of a prefix that symbols are found by, and symbols of an ask at most.
LETTERS, SYMBOLS = 3, 30


def word_at(text: Column, at: Column) -> Column:
    """The word around column ``at`` (from 0) of a line; empty beyond its end."""
    whole = F.concat(F.regexp_extract(F.left(text, at), f"({WORD})$", 1), F.regexp_extract(F.substr(text, at + 1), f"^({WORD})", 1))
    return F.when(at > F.char_length(text), F.lit("")).otherwise(whole)


def left_word_at(text: Column, at: Column) -> Column:
    """The word before the dot before the word at column ``at``; empty if there is none."""
    return F.regexp_extract(F.left(text, at), rf"({WORD})\.{WORD}$", 1)


def chain_objects(asks: DataFrame, objects: DataFrame, aliases: DataFrame) -> DataFrame:
    """ask and object: the metadata object that a dotted chain (ask, chain) speaks of.

    Root.Collection.Object and Collection.Object come first, else the first name of the chain that is an
    object.  aliases are alias and kind, objects name and name_lower.
    """
    words = asks.select("ask", F.posexplode(F.regexp_extract_all("chain", F.lit(NAME), F.lit(0))).alias("pos", "word")).withColumn("key", fold(F.col("word")))
    known = objects.groupBy("name_lower").agg(F.min("name").alias("object"))
    told = words.join(F.broadcast(aliases.select(fold(F.col("alias")).alias("key"), F.lit(1).alias("is_alias")).distinct()), "key", "left")  # collections of a platform, some forty
    told = told.join(known, told["key"] == known["name_lower"], "left")
    at = lambda p, value: F.max(F.when(F.col("pos") == p, value))
    first = F.min(F.when(F.col("object").isNotNull(), F.struct("pos", "object")))["object"]
    sums = told.groupBy("ask").agg(at(0, F.col("key").isin(*ROOTS)).alias("root"), at(0, F.col("is_alias")).alias("a0"), at(1, F.col("is_alias")).alias("a1"), at(1, F.col("object")).alias("o1"), at(2, F.col("object")).alias("o2"), first.alias("o"))
    object_ = F.when(F.col("root") & (F.col("a1") == 1) & F.col("o2").isNotNull(), F.col("o2")).when((F.col("a0") == 1) & F.col("o1").isNotNull(), F.col("o1")).otherwise(F.col("o"))
    return sums.select("ask", object_.alias("object")).where("object IS NOT NULL")


def metadata_completions(asks: DataFrame, objects: DataFrame, members: DataFrame, aliases: DataFrame) -> DataFrame:
    """ask, label and kind of what may follow the dot behind a chain (ask, chain, prefix): collections, a collection's objects, or an object's members."""
    last = F.regexp_extract("chain", f"({NAME})[^\\p{{L}}\\p{{N}}_]*$", 1)
    spoken = asks.join(chain_objects(asks, objects, aliases), "ask", "left").select("ask", fold(F.col("prefix")).alias("prefix"), fold(F.coalesce("object", last)).alias("key"))
    fits = F.startswith(fold(F.col("label")), F.col("prefix"))
    names = aliases.groupBy("kind").agg(F.min("alias").alias("label")).select("label", F.lit("collection").alias("found"), F.explode(F.array(*map(F.lit, ROOTS))).alias("key"))
    roots = spoken.join(F.broadcast(names), "key").where(fits)  # some forty collections
    folded = F.broadcast(aliases.select(fold(F.col("alias")).alias("key"), "kind").distinct())
    kinds = spoken.join(folded, "key").join(objects.select("kind", F.col("name").alias("label")), "kind").where(fits).withColumn("found", F.col("kind"))
    own = members.select(F.col("object_name_lower").alias("key"), F.col("name").alias("label"), F.col("kind").alias("found"))
    inner = spoken.where(~F.col("key").isin(*ROOTS)).join(folded, "key", "left_anti").join(own, "key").where(fits)
    pick = lambda d: d.select("ask", "label", F.col("found").alias("kind"))
    return pick(roots).unionByName(pick(kinds)).unionByName(pick(inner)).distinct()


def completions(asks: DataFrame, types: DataFrame, symbols: DataFrame, objects: DataFrame, members: DataFrame, aliases: DataFrame, variables: DataFrame | None = None) -> DataFrame:
    """ask, rank, label and kind of the candidates at each position (ask, file_path, before: the line up to the cursor).

    Behind a dot: members of the type of that name, else exports of the module of that name, else members
    of the variable's type (``variables``: ask, name, type), else metadata.  Elsewhere: globals, then up to
    ``SYMBOLS`` symbols that begin alike.  types are type (null: global), name and kind; a label is shown once.
    """
    dotted = F.contains("before", F.lit("."))
    cut = asks.select("ask", "before", dotted.alias("dotted"), F.regexp_extract("before", r"(?s)^(.*)\.[^.]*$", 1).alias("chain"), F.regexp_extract("before", f"({WORD})$", 1).alias("prefix"))
    behind = cut.where("dotted").select("ask", "chain", fold(F.col("prefix")).alias("prefix"), fold(F.regexp_extract("chain", f"({NAME})$", 1)).alias("owner"))
    fits = F.startswith(fold(F.col("label")), F.col("prefix"))
    api = types.where("type IS NOT NULL").select(fold(F.col("type")).alias("owner"), F.col("name").alias("label"), "kind")
    stem = F.regexp_extract("file_path", r"([^/\\]+)\.(?:bsl|os)$", 1)
    exports = symbols.where("is_export = 1").select(fold(stem).alias("owner"), F.col("name").alias("label"), "kind")
    ranked = [behind.join(api, "owner").where(fits).withColumn("rank", F.lit(1)), behind.join(exports, "owner").where(fits).withColumn("rank", F.lit(2))]
    if variables is not None:
        own = variables.select("ask", fold(F.col("name")).alias("owner"), fold(F.col("type")).alias("held"))
        ranked.append(behind.join(own, ["ask", "owner"]).join(api.withColumnRenamed("owner", "held"), "held").where(fits).withColumn("rank", F.lit(3)))
    pick = lambda d: d.select("ask", "rank", "label", "kind")
    found = pick(metadata_completions(behind.select("ask", "chain", "prefix"), objects, members, aliases).withColumn("rank", F.lit(4)))
    for part in ranked:
        found = found.unionByName(pick(part))
    least = F.min("rank").over(Window.partitionBy("ask"))
    found = found.withColumn("least", least).where(F.col("rank") == F.col("least"))
    plain = cut.where("NOT dotted").select("ask", fold(F.col("prefix")).alias("prefix"))
    spelled = lambda d: d.withColumn("key", F.explode(F.transform(F.sequence(F.lit(0), F.least(F.lit(LETTERS), F.char_length("folded"))), lambda n: F.left("folded", n))))
    plain = plain.withColumn("key", F.left("prefix", F.lit(LETTERS)))
    top = plain.join(spelled(types.where("type IS NULL").select(F.col("name").alias("label"), "kind", fold(F.col("name")).alias("folded"))), "key").where(F.startswith("folded", F.col("prefix")))
    near = plain.where("prefix <> ''").join(spelled(symbols.select("name_lower", F.col("name").alias("label"), "kind", "file_path", "line", F.col("name_lower").alias("folded"))), "key").where(F.startswith("folded", F.col("prefix")))
    nth = F.row_number().over(Window.partitionBy("ask").orderBy("name_lower", "file_path", "line"))
    near = near.withColumn("nth", nth).where(F.col("nth") <= SYMBOLS)
    both = pick(found).unionByName(pick(top.withColumn("rank", F.lit(1)))).unionByName(pick(near.withColumn("rank", F.lit(5))))
    return both.groupBy("ask", "label").agg(F.min(F.struct("rank", "kind")).alias("b")).select("ask", "b.rank", "label", "b.kind")


def search(symbols: DataFrame, lines: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """where (symbol or text), file_path, line and text of what is named like ``text`` or holds it: symbols first."""
    named = symbols.where(F.contains(fold(F.col("name")), fold(F.lit(text)))).select(F.lit("symbol").alias("where"), "file_path", "line", F.col("name").alias("text"))
    held = lines.where(F.contains(fold(F.col("text")), fold(F.lit(text)))).select(F.lit("text").alias("where"), "file_path", "line", "text")
    return named.unionByName(held).orderBy("where", "file_path", "line", "text").limit(limit)
