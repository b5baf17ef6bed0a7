"""Platform catalogue: lookups, completion and resolution over nested JSON type descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeprism.functions.text import fold

MEMBER = "struct<name:string,name_en:string,returns:string,description:string>"
SCHEMA = f"name string, name_en string, description string, methods array<{MEMBER}>, properties array<{MEMBER}>, is_global boolean, _corrupt_record string"


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Types (and globals, ``is_global``) from JSON files; malformed ones are skipped."""
    raw = spark.read.schema(SCHEMA).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    return raw.where(F.col("_corrupt_record").isNull() & F.col("name").isNotNull()).drop("_corrupt_record")


def members(types: DataFrame) -> DataFrame:
    """type, kind (method, property), name, name_en, returns, ord of all members."""
    parts = [types.select(F.col("name").alias("type"), F.col("name_en").alias("type_en"), F.lit(kind).alias("kind"), F.posexplode(column).alias("ord", "m")).select("type", "type_en", "kind", "ord", "m.name", "m.name_en", "m.returns") for kind, column in (("method", "methods"), ("property", "properties"))]
    return parts[0].unionByName(parts[1])


def _named(name: str):
    return (fold(F.col("name")) == fold(F.lit(name))) | (fold(F.coalesce("name_en", F.lit(""))) == fold(F.lit(name)))


def find_type(types: DataFrame, name: str) -> DataFrame:
    return types.where(_named(name)).orderBy("name").limit(1)


def completions(types: DataFrame, type_name: str, prefix: str = "") -> DataFrame:
    """Members of a type whose Russian or English name starts with ``prefix``: methods, then properties."""
    of = members(types).where((fold(F.col("type")) == fold(F.lit(type_name))) | (fold(F.coalesce("type_en", F.lit(""))) == fold(F.lit(type_name))))
    starts = F.startswith(fold(F.col("name")), fold(F.lit(prefix))) | F.startswith(fold(F.coalesce("name_en", F.lit(""))), fold(F.lit(prefix)))
    return of.where(starts).orderBy("kind", "ord")


def search(types: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Names that contain ``text``: globals first, then each type followed by its methods."""
    has = F.contains(fold(F.col("name")), fold(F.lit(text))) | F.contains(fold(F.coalesce("name_en", F.lit(""))), fold(F.lit(text)))
    tops = types.select(F.when(F.col("is_global"), 0).otherwise(1).alias("rank"), F.col("name").alias("type"), F.lit(-1).alias("ord"), "name", "name_en")
    methods = members(types).where("kind = 'method'").select(F.lit(1).alias("rank"), "type", "ord", "name", "name_en")
    return tops.unionByName(methods).where(has).orderBy("rank", "type", "ord").limit(limit).select("type", "name", "name_en")


def resolve(names: DataFrame, symbols: DataFrame, types: DataFrame) -> DataFrame:
    """For each name the best source: workspace symbol, global, type, member; null kind if unknown."""
    first = lambda d, kind, rank: d.select(fold(F.col("name")).alias("key"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.col("name").alias("target"))
    pool = first(symbols, "symbol", 0).unionByName(first(types.where("is_global"), "global", 1)).unionByName(first(types.where("NOT coalesce(is_global, false)"), "type", 2)).unionByName(first(members(types), "member", 3))
    best = pool.groupBy("key").agg(F.min(F.struct("rank", "kind", "target")).alias("b")).select("key", "b.kind", "b.target")
    return names.withColumn("key", fold(F.col("name"))).join(best, "key", "left").drop("key")


def inlay_hints(calls: DataFrame, params: DataFrame) -> DataFrame:
    """Parameter names for the arguments of calls (file_path, line, callee, args array): one row per argument."""
    listed = params.groupBy(F.lower("proc").alias("key"), "file_path", "proc_line").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "name"))), lambda p: p["name"]).alias("names"))
    first = listed.groupBy("key").agg(F.min_by("names", F.struct("file_path", "proc_line")).alias("names"))
    zipped = calls.withColumn("key", F.lower("callee")).join(first, "key").select("file_path", "line", "callee", F.posexplode(F.arrays_zip("names", "args")).alias("ord", "z"))
    return zipped.where("z.args IS NOT NULL AND z.names IS NOT NULL").select("file_path", "line", "callee", "ord", F.col("z.names").alias("param"), F.col("z.args").alias("arg"))
