"""Diagnostics after the rules: choice, suppression, baseline, grouping, counts and report formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeprism.functions.tables import stored
from codeprism.functions.text import comment
from codeprism.operators.rules import ALL_RULES

#: Pairs (winner, loser): the loser goes where the winner is on the same line of the same file.
PRIORITIES = (("BSL036", "BSL153"), ("BSL199", "BSL046"), ("BSL004", "BSL059"), ("BSL256", "BSL208"))
SONAR = {"ERROR": "BLOCKER", "WARNING": "MAJOR", "INFORMATION": "MINOR", "HINT": "INFO"}
SARIF = {"ERROR": "error", "WARNING": "warning", "INFORMATION": "note", "HINT": "note"}


def codes_of(names: Sequence[str]) -> set[str]:
    """Rule codes for codes or rule names, any case."""
    wanted = {n.strip().lower() for n in names}
    return {r[0] for r in ALL_RULES if r[0].lower() in wanted or r[1].lower() in wanted}


def wanted(select: Sequence[str] = (), ignore: Sequence[str] = ()) -> set[str]:
    """Codes of the rules that ``choose`` leaves, so that others need not run."""
    return (codes_of(select) if select else {r[0] for r in ALL_RULES}) - codes_of(ignore)


def choose(found: DataFrame, select: Sequence[str] = (), ignore: Sequence[str] = (), per_file: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Diagnostics of selected, not ignored rules; ``per_file``: path pattern (SQL LIKE) to ignored rules."""
    if select:
        found = found.where(F.col("code").isin(*codes_of(select)))
    if ignore:
        found = found.where(~F.col("code").isin(*codes_of(ignore)))
    for pattern, names in (per_file or {}).items():
        found = found.where(~(F.col("file_path").like(pattern) & F.col("code").isin(*codes_of(names))))
    return found


def inline_suppressed(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Without what ``noqa`` (all), ``noqa: CODES`` or ``bsl-disable: CODES`` on the same line suppresses."""
    note = comment(F.col("text"))
    marks = lines.select("file_path", "line", note.alias("note")).where(F.col("note").rlike("(?i)noqa|bsl-disable"))
    listed = F.regexp_extract("note", r"(?i)(?:noqa|bsl-disable)\s*:\s*([A-Za-z0-9, ]+)", 1)
    marks = marks.select("file_path", "line", F.transform(F.filter(F.split(F.upper(listed), r"[,\s]+"), lambda x: x != ""), lambda x: x).alias("codes"))
    hit = (F.size("codes") == 0) | F.array_contains("codes", F.col("code"))
    return found.join(marks, ["file_path", "line"], "left").where(F.col("codes").isNull() | ~hit).drop("codes")


def block_suppressed(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Without what ``// BSLLS:Name-off`` suppresses until ``-on`` (or the end of the file); ``BSLLS-off`` is all rules.

    A mark behind code holds for its line only.  Unknown names have no effect.
    """
    note = comment(F.col("text"))
    marks = lines.select("file_path", F.col("line").alias("at"), "text", note.alias("note")).where(F.col("note").rlike("BSLLS"))
    part = marks.select("file_path", "at", F.regexp_extract("note", r"BSLLS(?::(\w+))?-(?:off|on|выкл|вкл)", 1).alias("rule"), F.col("note").rlike("-(?:off|выкл)").alias("off"), (F.btrim("text") != F.btrim("note")).alias("inline"))
    names = found.sparkSession.createDataFrame(sorted({(r[1], r[0]) for r in ALL_RULES} | {("", r[0]) for r in ALL_RULES}), "rule string, code string")
    events = part.join(F.broadcast(names), "rule")  # the rule table has a few hundred rows
    own = F.struct(*[found[c] for c in found.columns])
    asked = found.select("file_path", "code", "line", F.lit(1).alias("role"), F.lit(None).cast("boolean").alias("off"), own.alias("row"))
    marks = events.where("NOT inline").select("file_path", "code", F.col("at").alias("line"), F.lit(0).alias("role"), "off", F.lit(None).cast(asked.schema["row"].dataType).alias("row"))
    state = F.last("off", ignorenulls=True).over(Window.partitionBy("file_path", "code").orderBy("line", "role", "off"))
    known = asked.unionByName(marks).withColumn("state", state).where("role = 1")
    here = events.where("inline").groupBy("file_path", "code", F.col("at").alias("line")).agg(F.max("off").alias("here"))
    return known.join(here, ["file_path", "code", "line"], "left").where(~F.coalesce("here", "state", F.lit(False))).select("row.*")


def prioritized(found: DataFrame, pairs: Sequence[tuple[str, str]] = PRIORITIES) -> DataFrame:
    loser = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    beaten = found.select("file_path", "line", F.element_at(loser, F.col("code")).alias("code")).where(F.col("code").isNotNull()).distinct()
    return found.join(beaten, ["file_path", "line", "code"], "left_anti")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def without_baseline(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """Without diagnostics whose (base name, code, line) the baseline (file, code, line) lists."""
    known = baseline.select(F.col("file").alias("base"), "code", "line").distinct()
    return found.withColumn("base", base_name(F.col("file_path"))).join(known, ["base", "code", "line"], "left_anti").drop("base")


def grouped(found: DataFrame, related: int = 50) -> DataFrame:
    """One row per (file, code): first line, number, and up to ``related`` further lines."""
    rank = F.row_number().over(Window.partitionBy("file_path", "code").orderBy("line"))
    some = found.withColumn("rn", rank)
    return some.groupBy("file_path", "code").agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.when((F.col("rn") > 1) & (F.col("rn") <= related + 1), F.col("line")))).alias("related"))


def counted(found: DataFrame) -> DataFrame:
    """Counts in total, by severity and by code from one pass (grouping sets)."""
    view = found.select("severity", "code", "file_path")
    return found.sparkSession.sql("SELECT severity, code, count(*) AS n FROM {d} GROUP BY GROUPING SETS ((severity), (code), ())", d=view)


def summary(found: DataFrame) -> DataFrame:
    one = lambda s: F.coalesce(F.count_if(s), F.lit(0))
    return found.agg(one(F.col("severity") == "ERROR").alias("errors"), one(F.col("severity") == "WARNING").alias("warnings"), one(~F.col("severity").isin("ERROR", "WARNING")).alias("others"), (one(F.col("severity") == "ERROR") > 0).cast("int").alias("has_errors"))


def after_fix(found: DataFrame, fixed: DataFrame) -> DataFrame:
    """Without diagnostics of a (file, code) that was fixed at least once."""
    return found.join(fixed.select("file_path", "code").distinct(), ["file_path", "code"], "left_anti")


def sarif_rows(found: DataFrame) -> DataFrame:
    """Flat SARIF results: level, ruleId, uri, startLine and startColumn (from 1)."""
    level = F.element_at(F.create_map(*[F.lit(x) for kv in SARIF.items() for x in kv]), F.col("severity"))
    return found.select(level.alias("level"), F.col("code").alias("rule_id"), F.col("file_path").alias("uri"), F.col("line").alias("start_line"), F.lit(1).alias("start_column"))


def sonar_rows(found: DataFrame) -> DataFrame:
    """Flat generic issues of SonarQube: severity, ruleId, path and lines."""
    severity = F.element_at(F.create_map(*[F.lit(x) for kv in SONAR.items() for x in kv]), F.col("severity"))
    return found.select(F.lit("codeprism").alias("engine_id"), F.col("code").alias("rule_id"), severity.alias("severity"), F.col("file_path").alias("path"), F.col("line").alias("start_line"), F.col("line").alias("end_line"))


def with_unused(found: DataFrame, unused: DataFrame) -> DataFrame:
    """Diagnostics (file_path, line, code, severity) with a BSL-DEAD one for each symbol of ``unused``."""
    return found.select("file_path", "line", "code", "severity").unionByName(unused.select("file_path", "line", F.lit("BSL-DEAD").alias("code"), F.lit("INFORMATION").alias("severity")))


#: Lines whose results make one piece of a log, what closes a log, and the number of the piece that does.
SPAN, CLOSING, LAST = 1024, "]}]}", 2**31 - 1


def sarif_pieces(found: DataFrame, tool: str = "codeprism", version: str = "1.0.0") -> DataFrame:
    """file_path, part and text: SARIF 2.1.0 logs as JSON in pieces; a module's texts, one behind the other by part, are its log.

    Part 0 has all but the results, with rules in order of first appearance; the next ones have the results of
    ``SPAN`` lines each, columns counting from 1.  No row or group grows with its module.
    """
    rows = sarif_rows(stored(found))  # rules and results read it
    names = F.create_map(*(F.lit(x) for r in {r[0]: r[1] for r in ALL_RULES}.items() for x in r))
    name = F.coalesce(F.try_element_at(names, "rule_id"), F.col("rule_id"))
    region = F.struct(F.col("start_line").alias("startLine"), F.col("start_column").alias("startColumn"), F.col("start_line").alias("endLine"))
    place = F.struct(F.struct(F.struct(F.col("uri").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(name.alias("text")).alias("message"), F.array(place).alias("locations"))
    part_of = lambda line: (F.floor(F.col(line) / SPAN) + 1).cast("int").alias("part")
    rules = rows.groupBy("uri", "rule_id").agg(F.min("start_line").alias("at"), F.min("level").alias("level")).withColumn("name", name)
    rule = F.struct(F.col("rule_id").alias("id"), "name", F.struct("level").alias("defaultConfiguration"))
    listed = rules.groupBy("uri").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "rule_id", rule.alias("rule")))), lambda x: x["rule"]).alias("rules"))
    driver = F.struct(F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), F.col("rules").alias("rules")).alias("driver"))
    log = F.to_json(F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(F.struct(driver.alias("tool"), F.array().alias("results"))).alias("runs")))
    ends = F.array(F.struct(F.lit(0).alias("part"), F.left(log, F.char_length(log) - len(CLOSING)).alias("text")), F.struct(F.lit(LAST).alias("part"), F.lit(CLOSING).alias("text")))
    each = rows.groupBy("uri", part_of("start_line")).agg(F.sort_array(F.collect_list(F.struct("start_line", "rule_id", F.to_json(result).alias("result")))).alias("results"))
    first = rules.groupBy("uri").agg(F.min("at").alias("at")).select("uri", part_of("at"), F.lit("").alias("comma"))
    told = each.join(first, ["uri", "part"], "left").select("uri", "part", F.concat(F.coalesce("comma", F.lit(",")), F.array_join(F.transform("results", lambda x: x["result"]), ",")).alias("text"))
    return told.unionByName(listed.select("uri", F.inline(ends))).withColumnRenamed("uri", "file_path")


def sarif_documents(found: DataFrame, tool: str = "codeprism", version: str = "1.0.0") -> DataFrame:
    """file_path and document: a whole SARIF 2.1.0 log as JSON for each module, put together from ``sarif_pieces``.

    A row is of its module's log's size; where that is too large for one text, take the pieces.
    """
    texts = F.sort_array(F.collect_list(F.struct("part", "text")))
    return sarif_pieces(found, tool, version).groupBy("file_path").agg(F.array_join(F.transform(texts, lambda x: x["text"]), "").alias("document"))


def sonar_documents(found: DataFrame) -> DataFrame:
    """file_path and document: the generic issues of each module as JSON, nested as the importer wants them; columns from 0."""
    rows = sonar_rows(found)
    place = F.struct(F.col("rule_id").alias("message"), F.col("path").alias("filePath"), F.struct(F.col("start_line").alias("startLine"), F.greatest("start_line", "end_line").alias("endLine")).alias("textRange"))
    issue = F.struct(F.col("engine_id").alias("engineId"), F.col("rule_id").alias("ruleId"), "severity", F.lit("CODE_SMELL").alias("type"), place.alias("primaryLocation"))
    each = rows.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("start_line", "rule_id", issue.alias("issue")))), lambda x: x["issue"]).alias("issues"))
    return each.select(F.col("path").alias("file_path"), F.to_json(F.struct("issues")).alias("document"))


def localised(found: DataFrame, messages: DataFrame) -> DataFrame:
    """``found`` (code, message, ...) with message_local: the template of its code in ``messages`` (code, pattern, template) with what the pattern finds.

    A pattern's first group takes the place of ``{0}``; without a row or a match the message stays.
    """
    known = F.broadcast(messages.select("code", "pattern", "template"))  # a row for each rule
    told = found.join(known, "code", "left")
    value = F.expr("regexp_extract(message, coalesce(pattern, '^()'), 1)")
    plain = F.col("pattern").isNull() & F.col("template").isNotNull()
    local = F.when(plain, F.col("template")).when(F.expr("message RLIKE pattern"), F.replace("template", F.lit("{0}"), value)).otherwise(F.col("message"))
    return told.withColumn("message_local", local).drop("pattern", "template")


def write_changed(formatted: DataFrame, folder: str) -> None:
    """The texts of formatted modules (path, text, changed) that changed, as a table below ``folder``; others are left alone."""
    formatted.where("changed").select("path", "text").write.mode("overwrite").parquet(folder)


def json_array(found: DataFrame) -> DataFrame:
    """file_path and document: the diagnostics of each module as one JSON array, in order of line and code."""
    names = [c for c in found.columns if c != "file_path"]
    rows = F.sort_array(F.collect_list(F.struct("line", "code", F.struct("file_path", *names).alias("d"))))
    return found.groupBy("file_path").agg(rows.alias("r")).select("file_path", F.to_json(F.transform("r", lambda x: x["d"])).alias("document"))


def compact(found: DataFrame) -> DataFrame:
    return found.select(F.format_string("%s:%d: %s %s", "file_path", "line", "severity", "code").alias("value"))


def write_report(found: DataFrame, path: str, kind: str) -> None:
    """Distributed sinks: one record per diagnostic as text, json, sarif or sonar."""
    frames = {"compact": compact, "json": lambda d: d, "sarif": sarif_rows, "sonar": sonar_rows}
    out = frames[kind](found)
    (out.write.mode("overwrite").text if kind == "compact" else out.write.mode("overwrite").json)(path)
