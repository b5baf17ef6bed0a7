"""Call-graph operators: bounded closures by joins, one level at a time, never by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeprism.functions.text import fold, rename_in


def edges(calls: DataFrame) -> DataFrame:
    """Distinct (caller, callee) by folded names."""
    return calls.where(F.col("caller_name").isNotNull()).select(fold(F.col("caller_name")).alias("caller"), F.col("callee_name_lower").alias("callee")).distinct()


def caller_closure(calls: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """root, node, depth: who reaches ``root`` (column root) within ``depth`` calls, at least depth.

    Each level joins the frontier with the edges and drops nodes already met, so the
    work is bounded by the edges within reach.
    """
    graph = edges(calls)
    seen = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct()
    frontier = seen
    for level in range(1, depth + 1):
        step = frontier.join(graph, frontier["node"] == graph["callee"]).select("root", F.col("caller").alias("node")).distinct()
        frontier = step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(level))
        seen = seen.unionByName(frontier)
    return seen.where(F.col("depth") > 0)


def caller_tree(calls: DataFrame, name: str, depth: int = 5, width: int = 20) -> dict:
    """Nested callers of ``name`` on the driver; a name is expanded where it is met first, with ``width`` callers each.

    The neighbourhood within ``depth`` is found by joins; only its first ``width`` callers per name are collected.
    """
    roots = calls.sparkSession.createDataFrame([(name.lower(),)], "root string")
    near = caller_closure(calls, roots, depth).select(F.col("node").alias("callee_name_lower")).distinct().unionByName(roots.withColumnRenamed("root", "callee_name_lower"))
    rows = calls.join(near, "callee_name_lower", "left_semi").groupBy("callee_name_lower").agg(F.slice(F.sort_array(F.collect_set(F.struct("caller_file", "caller_line", "caller_name"))), 1, width).alias("callers")).collect()
    callers, met = {r["callee_name_lower"]: r["callers"] for r in rows}, set()

    def grow(node: str, left: int) -> dict:
        key = node.lower()
        if left <= 0 or key in met:
            return {"name": node, "callers": []}
        met.add(key)
        return {"name": node, "callers": [{"file": c["caller_file"], "line": c["caller_line"], **(grow(c["caller_name"], left - 1) if c["caller_name"] else {"name": None, "callers": []})} for c in callers.get(key, ())]}

    return grow(name, depth)


def callees_in_definitions(symbols: DataFrame, calls: DataFrame, end_line: str = "end_line", width: int = 64) -> DataFrame:
    """Calls inside each definition's line range: equality on the file and a bucket of lines, then an interval.

    A definition goes to each bucket of ``width`` lines that it touches, so a call meets the definitions near it and not all of its file.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    d = symbols.where(F.col("line") <= F.col(end_line)).select(F.col("file_path").alias("caller_file"), F.col("name").alias("definition"), "line", end_line)
    near = d.withColumn("bucket", F.explode(F.sequence(bucket("line"), bucket(end_line))))
    return calls.withColumn("bucket", bucket("caller_line")).join(near, ["caller_file", "bucket"]).drop("bucket").where(F.col("caller_line").between(F.col("line"), F.col(end_line)))


def first_symbols(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("name_lower").agg(F.min(F.struct("file_path", "line", "name")).alias("s")).select("name_lower", "s.*")


def hierarchy(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """One level of the call hierarchy: each edge once, with the first symbol of either end."""
    first = first_symbols(symbols)
    a = first.select(F.col("name_lower").alias("caller"), F.col("file_path").alias("from_file"), F.col("line").alias("from_line"))
    b = first.select(F.col("name_lower").alias("callee"), F.col("file_path").alias("to_file"), F.col("line").alias("to_line"))
    return edges(calls).join(a, "caller", "left").join(b, "callee", "left")


def references(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Definitions and call sites of all names: name_lower, ref_kind, file, line."""
    d = symbols.select("name_lower", F.lit("definition").alias("ref_kind"), F.col("file_path").alias("file"), "line")
    return d.unionByName(calls.select(F.col("callee_name_lower").alias("name_lower"), F.lit("call").alias("ref_kind"), F.col("caller_file").alias("file"), F.col("caller_line").alias("line")))


def rename_preview(calls: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    return references(calls, symbols).where(F.col("name_lower") == fold(F.lit(name))).groupBy("file").agg(F.count(F.lit(1)).alias("edits"))


def rename(modules: DataFrame, old: str, new: str) -> DataFrame:
    """Modules (path, text) with the whole word replaced everywhere, if it occurs."""
    return modules.withColumn("text", rename_in(F.col("text"), old, new))


def recursive_calls(calls: DataFrame) -> DataFrame:
    return calls.where(fold(F.col("caller_name")) == F.col("callee_name_lower"))
