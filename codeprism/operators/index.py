"""Lookups over symbols (name, name_lower, file_path, line, kind, is_export) and calls.

Names match by folded text; every limit follows a total order, so results are stable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeprism.functions.text import fold

METHODS = ("procedure", "function")


def find_symbol(symbols: DataFrame, name: str, file_filter: str | None = None, limit: int = 20) -> DataFrame:
    hit = symbols.where(F.col("name_lower") == fold(F.lit(name)))
    if file_filter:
        hit = hit.where(F.contains("file_path", F.lit(file_filter)))
    return hit.orderBy("file_path", "line", "name").limit(limit)


def tokens_of(name: Column) -> Column:
    return F.filter(F.split(fold(name), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def find_prefix(symbols: DataFrame, prefix: str, limit: int = 20) -> DataFrame:
    """Symbols one of whose name tokens starts with ``prefix``, by name."""
    hit = symbols.where(F.exists(tokens_of(F.col("name")), lambda t: F.startswith(t, fold(F.lit(prefix)))))
    return hit.orderBy("name_lower", "file_path", "line").limit(limit)


def ranked_prefix(symbols: DataFrame, prefix: str, limit: int = 20) -> DataFrame:
    """As ``find_prefix``, best BM25 score first (k1 1.2, b 0.75)."""
    names = symbols.select("*", tokens_of(F.col("name")).alias("tokens"))
    stats = names.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("length")).first()
    hits = F.size(F.filter("tokens", lambda t: F.startswith(t, fold(F.lit(prefix)))))
    found = names.withColumn("tf", hits).where(F.col("tf") > 0)
    df = found.count()
    idf = F.log(F.lit(1 + ((stats["n"] or 0) - df + 0.5) / (df + 0.5)))
    rank = idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.size("tokens") / F.lit(stats["length"] or 1.0)))
    return found.withColumn("rank", rank).orderBy(F.col("rank").desc(), "name_lower", "file_path", "line").limit(limit).drop("tokens", "tf")


def _of(calls: DataFrame, name: str) -> DataFrame:
    return calls.where(F.col("callee_name_lower") == fold(F.lit(name)))


def _not_own(name: Column) -> Column:
    return F.col("caller_name").isNull() | (fold(F.col("caller_name")) != name)


def callers_count(calls: DataFrame, name: str) -> DataFrame:
    return _of(calls, name).agg(F.count(F.lit(1)).alias("n"))


def callers_count_non_recursive(calls: DataFrame, name: str) -> DataFrame:
    return _of(calls, name).where(_not_own(fold(F.lit(name)))).agg(F.count(F.lit(1)).alias("n"))


def call_counts(calls: DataFrame) -> DataFrame:
    """All names at once: callee_name_lower, n and n_non_recursive."""
    return calls.groupBy("callee_name_lower").agg(F.count(F.lit(1)).alias("n"), F.count_if(_not_own(F.col("callee_name_lower"))).alias("n_non_recursive"))


def unused_symbols(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Methods that are not exported and that nothing but themselves calls.

    Only names travel: callers reduce to the distinct called names before the join.
    """
    called = calls.where(_not_own(F.col("callee_name_lower"))).select(F.col("callee_name_lower").alias("name_lower")).distinct()
    return symbols.where(F.col("kind").isin(*METHODS) & (F.col("is_export") == 0)).join(called, "name_lower", "left_anti")


def find_callers(calls: DataFrame, symbols: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """Call sites of ``name`` with the line of a same-named symbol in the caller's file."""
    own = symbols.select(F.col("name_lower").alias("callee_name_lower"), F.col("file_path").alias("caller_file"), F.col("line").alias("symbol_line"))
    return _of(calls, name).join(own, ["callee_name_lower", "caller_file"], "left").orderBy("caller_file", "caller_line", "caller_name", "callee_args_count", "symbol_line").limit(limit)


def with_definitions(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls with callee_file and callee_line of each symbol of the called name (or nulls)."""
    defined = symbols.select(F.col("name_lower").alias("callee_name_lower"), F.col("file_path").alias("callee_file"), F.col("line").alias("callee_line"))
    return calls.join(defined, "callee_name_lower", "left")


def callees(calls: DataFrame, symbols: DataFrame, file: str, caller: str | None = None, line: int | None = None, around: int = 15, exact_case: bool = True) -> DataFrame:
    """What a file calls; of one caller, or within ``around`` lines of ``line``."""
    some = calls.where(F.col("caller_file") == file)
    if caller is not None:
        some = some.where(F.col("caller_name") == caller if exact_case else fold(F.col("caller_name")) == fold(F.lit(caller)))
    elif line is not None:
        some = some.where(F.col("caller_line").between(line - around, line + around))
    return with_definitions(some, symbols)


def file_outline(symbols: DataFrame, file: str) -> DataFrame:
    return symbols.where(F.col("file_path") == file).orderBy("line", "name")


def module_exports(symbols: DataFrame, module: str, limit: int = 100) -> DataFrame:
    stem = F.regexp_extract("file_path", r"([^/\\]+)\.(?:bsl|os)$", 1)
    return symbols.where((F.col("is_export") == 1) & (stem == module)).orderBy("name_lower", "file_path", "line").limit(limit)


def upsert(table: DataFrame, changed: DataFrame, key: str = "file_path", removed: DataFrame | None = None) -> DataFrame:
    """``table`` with the rows of every file in ``changed`` replaced, and those of ``removed`` gone."""
    gone = changed.select(key) if removed is None else changed.select(key).unionByName(removed.select(key))
    return table.join(gone.distinct(), key, "left_anti").unionByName(changed)


def remove_files(table: DataFrame, files: DataFrame, key: str = "file_path") -> DataFrame:
    return table.join(files.select(key).distinct(), key, "left_anti")


def stats(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    a = symbols.agg(F.count(F.lit(1)).alias("v"), F.countDistinct("file_path").alias("f")).select(F.explode(F.create_map(F.lit("symbols"), "v", F.lit("files"), "f")).alias("metric", "value"))
    return a.unionByName(calls.agg(F.count(F.lit(1)).alias("value")).select(F.lit("calls").alias("metric"), "value"))


def latest_metadata(objects: DataFrame) -> DataFrame:
    """One object per (name_lower, kind): the last by seq."""
    last = F.row_number().over(Window.partitionBy("name_lower", "kind").orderBy(F.col("seq").desc(), "name"))
    return objects.withColumn("rn", last).where(F.col("rn") == 1).drop("rn")


def metadata_members(objects: DataFrame, members: DataFrame, name: str, prefix: str = "", limit: int = 200) -> DataFrame:
    """Members of the first object of that name whose folded names start with ``prefix``."""
    one = objects.where(F.col("name_lower") == fold(F.lit(name))).orderBy("kind", "name").limit(1).select(F.col("name_lower").alias("object_name_lower"))
    return members.join(F.broadcast(one), "object_name_lower", "left_semi").where(F.startswith("name_lower", fold(F.lit(prefix)))).orderBy("name_lower", "kind").limit(limit)


def metadata_collection(objects: DataFrame, kind: str, prefix: str = "", limit: int = 100) -> DataFrame:
    return objects.where((F.col("kind") == kind) & F.startswith("name_lower", fold(F.lit(prefix)))).orderBy("name_lower").limit(limit)


def has_metadata(objects: DataFrame) -> bool:
    return bool(objects.take(1))


def metadata_report(members: DataFrame) -> DataFrame:
    """Members per object and kind: number, first and last name."""
    return members.groupBy("object_name_lower", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))


def unknown_references(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """References (name) to objects that the metadata lacks."""
    return refs.join(objects.select(F.col("name_lower").alias("ref")).distinct(), fold(F.col("name")) == F.col("ref"), "left_anti")
