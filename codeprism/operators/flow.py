"""Def-use chains: the ordered reads and writes of every variable, and the rules that look at them.

An event is a place where a method (or the module itself, scope 0) declares, writes or
reads a name.  Events are ordered by line, statement and role: what a statement reads
comes before what it writes.  One window over (file, scope, name) then tells for each
write whether anything reads it later or read it before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeprism.functions.tables import apart, stored
from codeprism.operators import rules as R
from codeprism.operators.structure import blocks
from codeprism.operators.syntax import DECLARES, ENDS, comments_above, methods, variables

#: Names in code, members of objects left out.
NAME = rf"(?<![\p{{L}}\p{{N}}_.])({R.ID})"
ASSIGNED = rf"^\s*({R.ID})\s*=(.*)$"
FOR_EACH = "(?iu)" + rf"^\s*(?:Для\s+Каждого|For\s+Each)\s+({R.ID})(.*)$"
FOR_TO = "(?iu)" + rf"^\s*(?:Для|For)\s+({R.ID})\s*=(.*)$"
ERROR_CALL = r"(?iu)^\s*(?:ИнформацияОбОшибке|ErrorInfo|ОписаниеОшибки|ErrorDescription)\s*\(\s*\)"
#: Parameters that handlers are given, used or not.
GIVEN = ("команда", "command", "дополнительныепараметры", "additionalparameters")


def _begins() -> Column:
    """Whether a line begins a statement; plain tests of what ends most statements come before the patterns."""
    p1 = F.col("p1")
    plain = (p1 == "") | F.endswith(p1, F.lit(";")) | F.startswith(p1, F.lit("#")) | F.startswith(p1, F.lit("&")) | p1.rlike(r"\)$")
    return plain | F.col("c").rlike("(?iu)" + R.BEGINS) | p1.rlike("(?iu)" + ENDS)


def kept(facts: DataFrame) -> DataFrame:
    """What def-use rules read of the line facts, as a stored table: they pass over the lines several times.

    code stands where a header or a declaration may, body where a header may, p1 above a method's first line.
    """
    header = F.expr(R.OF_HEADER)
    texts = {"code": header | F.col("code").rlike("(?iu)" + DECLARES), "body": header, "p1": F.col("head") == 1}
    of_text = (F.when(where, F.col(c)).alias(c) for c, where in texts.items())
    return stored(facts.where((F.col("c") != "") | header).select("file_path", "line", "scope", "head", "unclosed", "c", _begins().alias("begins"), *of_text))


def statements(facts: DataFrame) -> DataFrame:
    """file_path, scope, line, k, target, kind (write, loop, count) and rest (what is read) of every statement in code but declarations."""
    begins = F.col("begins") if "begins" in facts.columns else _begins()
    coded = facts.where((F.col("c") != "") & ~F.startswith("c", F.lit("#")) & ~F.startswith("c", F.lit("&")) & ~F.col("c").rlike("(?iu)" + R.starts(R.VAR)))
    coded = coded.select("file_path", "scope", "line", "c", begins.alias("begins"), F.expr(R.OF_HEADER).alias("of_header"))
    heads = R.headers(facts).select("file_path", F.explode(F.sequence("line", "last_line")).alias("line"))
    plain = coded.where("NOT of_header").unionByName(coded.where("of_header").join(heads, ["file_path", "line"], "left_anti"))
    said = plain.select("file_path", "scope", "line", "begins", F.posexplode(F.split("c", ";")).alias("k", "s")).where(F.btrim("s") != "")
    looped, low = F.lit(False), F.expr(R.folded("s"))
    for word in ("for", "для"):
        looped = looped | F.contains(low, F.lit(word))
    said = said.select("file_path", "scope", "line", "k", "s", looped.alias("looped"), (F.contains("s", F.lit("=")) & (F.col("begins") | (F.col("k") > 0))).alias("set"))
    part = lambda p, i: F.coalesce(F.when(F.col("looped") if p != ASSIGNED else F.col("set"), F.regexp_extract("s", p, i)), F.lit(""))
    found = said.select("file_path", "scope", "line", "k", "s", "looped", "set", part(FOR_EACH, 1).alias("each"), part(FOR_TO, 1).alias("to"), part(ASSIGNED, 1).alias("given"))
    each, to, given = (F.col(c) != "" for c in ("each", "to", "given"))
    target = F.when(each, F.col("each")).when(to, F.col("to")).when(given, F.col("given"))
    rest = F.when(each, part(FOR_EACH, 2)).when(to, part(FOR_TO, 2)).when(given, part(ASSIGNED, 2)).otherwise(F.col("s"))
    return found.select("file_path", "scope", "line", "k", target.alias("target"), F.when(each, "loop").when(to, "count").otherwise("write").alias("kind"), rest.alias("rest"))


def events(facts: DataFrame) -> DataFrame:
    """file_path, scope, word (lower case), name, line, k, role (0 read, 1 write), kind (param, decl, exported, write, loop, count, read), error (1: assigned the error information)."""
    said = statements(facts)
    write = F.when(F.col("target").isNotNull(), F.array(F.struct(F.col("target").alias("name"), F.lit(1).alias("role"), F.col("kind"), F.col("rest").rlike(ERROR_CALL).cast("int").alias("error"))))
    none = F.array().cast("array<struct<name:string,role:int,kind:string,error:int>>")
    reads = F.transform(F.array_distinct(F.regexp_extract_all("rest", F.lit(NAME), F.lit(1))), lambda n: F.struct(n.alias("name"), F.lit(0).alias("role"), F.lit("read").alias("kind"), F.lit(0).alias("error")))
    used = said.select("file_path", "scope", "line", "k", F.inline(F.concat(F.coalesce(write, none), reads)))
    params = R.scoped_parameters(facts).select("file_path", "scope", F.col("proc_line").alias("line"), F.lit(-1).alias("k"), "name", F.lit(1).alias("role"), F.lit("param").alias("kind"), F.lit(0).alias("error"))
    declared = variables(facts).select("file_path", "scope", "line", F.lit(-1).alias("k"), "name", F.lit(1).alias("role"), F.when(F.col("is_export") == 1, "exported").otherwise("decl").alias("kind"), F.lit(0).alias("error"))
    return used.unionByName(params).unionByName(declared).withColumn("word", F.lower("name"))


def _warn(frame: DataFrame, code: str | Column, severity: str) -> DataFrame:
    return frame.select("file_path", "line", (F.lit(code) if isinstance(code, str) else code).alias("code"), F.lit(severity).alias("severity"), "name")


def _has(*kinds: str) -> Column:
    return F.max(F.col("kind").isin(*kinds).cast("int"))


def unused_variables(found: DataFrame) -> DataFrame:
    """Variables that are declared or assigned and never read (BSL007): first line and name.

    The module's own may be read by any method; a method that assigns one of them has no local of that name.
    """
    made = F.min(F.when(F.col("kind").isin("decl", "write"), F.col("line"))).alias("line")
    named = found.groupBy("file_path", "scope", "word", "name").agg(_has("read").alias("reads"), _has("param", "exported").alias("kept"), made)
    first = F.min(F.when(F.col("line").isNotNull(), F.struct("line", "name"))).alias("f")
    sums = named.repartition("file_path", "word").groupBy("file_path", "scope", "word").agg(F.max("reads").alias("reads"), F.max("kept").alias("kept"), first)
    module = Window.partitionBy("file_path", "word")
    anywhere = sums.select("*", F.max(F.expr("scope = 0 AND (f IS NOT NULL OR kept = 1)")).over(module).alias("of_module"), F.max("reads").over(module).alias("read"))
    idle = anywhere.where("f IS NOT NULL AND reads = 0 AND kept = 0 AND CASE WHEN scope > 0 THEN NOT of_module ELSE read = 0 END")
    return _warn(idle.select("file_path", "f.line", "f.name"), "BSL007", "WARNING")


def chained(found: DataFrame) -> DataFrame:
    """Events with first: the place among those of its variable, parameters not counted."""
    order = Window.partitionBy("file_path", "scope", "word").orderBy("line", "k", "role")
    return found.withColumn("first", F.sum(F.when(F.col("kind") == "param", 0).otherwise(1)).over(order))


def unused_errors(found: DataFrame) -> DataFrame:
    """Error information that is kept and not read from there on (BSL034)."""
    place = F.shiftleft(F.col("line").cast("long"), 31) + F.col("k")
    last = found.where("kind = 'read'").groupBy("file_path", "scope", "word").agg(F.max(place).alias("last"))
    told = found.where("error = 1").withColumn("place", place).join(last, ["file_path", "scope", "word"], "left")
    return _warn(told.where("last IS NULL OR last <= place"), "BSL034", "WARNING")


def changed_module_variables(found: DataFrame) -> DataFrame:
    """Assignments in methods to variables that the module declares (BSL075)."""
    module = found.where("scope = 0 AND kind IN ('decl', 'exported')").select("file_path", "word").distinct()
    local = found.where("scope > 0 AND kind IN ('decl', 'param')").select("file_path", "scope", "word").distinct()
    changed = found.where("scope > 0 AND kind = 'write'").join(module, ["file_path", "word"], "left_semi").join(local, ["file_path", "scope", "word"], "left_anti")
    return _warn(changed, "BSL075", "INFORMATION")


def rewritten_parameters(found: DataFrame, params: DataFrame) -> DataFrame:
    """Parameters by value whose first use overwrites them (BSL240)."""
    by_value = params.where("by_val").select("file_path", F.lower("name").alias("word"), "proc_line")
    known = found.where("kind = 'param'").select("file_path", "scope", "word", F.col("line").alias("proc_line")).join(by_value, ["file_path", "word", "proc_line"], "left_semi").select("file_path", "scope", "word")
    return _warn(chained(found).where("first = 1 AND kind IN ('write', 'loop', 'count')").join(known, ["file_path", "scope", "word"], "left_semi"), "BSL240", "WARNING")


def unused_iterators(facts: DataFrame, found: DataFrame) -> DataFrame:
    """For-each variables that their loop's body does not read (BSL263)."""
    loops = blocks(facts).where("kind = 'loop'").select("file_path", F.col("start_line").alias("line"), "end_line")
    each = found.where("kind = 'loop'").select("file_path", "scope", "word", "name", "line").join(loops, ["file_path", "line"])
    reads = found.where("kind = 'read'").select(F.col("file_path").alias("f"), F.col("scope").alias("s"), F.col("word").alias("w"), F.col("line").alias("at"))
    inside = (F.col("file_path") == F.col("f")) & (F.col("scope") == F.col("s")) & (F.col("word") == F.col("w")) & (F.col("at") > F.col("line")) & (F.col("at") <= F.col("end_line"))
    return _warn(each.join(reads, inside, "left_anti"), "BSL263", "WARNING")


def unused_parameters(facts: DataFrame, found: DataFrame, params: DataFrame) -> DataFrame:
    """Parameters that their method never names: BSL021 by value, BSL062 else, and BSL122 for both.

    Optional ones and those that begin with an underscore may stay unused; BSL062 also spares what
    handlers are given: a command, additional parameters, all of client command and completion handlers.
    """
    used = found.where("kind <> 'param'").select("file_path", "scope", "word").distinct()
    heads = facts.where("head = 1").select("file_path", F.col("line").alias("proc_line"), "scope", "c", "p1")
    asked = params.where(~F.startswith("name", F.lit("_")) & (F.col("by_val") | F.col("default_value").isNull())).join(heads, ["file_path", "proc_line"]).withColumn("word", F.lower("name"))
    idle = asked.join(used, ["file_path", "scope", "word"], "left_anti").withColumnRenamed("proc_line", "line")
    handler = (F.col("c").rlike("(?iu)" + R.COMMAND_HANDLER) | F.col("c").rlike("(?iu)" + R.COMPLETION_HANDLER)) & F.col("p1").rlike("(?iu)" + R.AT_CLIENT)
    plain = idle.where(F.col("by_val") | ~(F.col("word").isin(*GIVEN) | handler))
    return _warn(plain, F.when(F.col("by_val"), "BSL021").otherwise("BSL062"), "WARNING").unionByName(_warn(idle, "BSL122", "WARNING"))


def undescribed_parameters(facts: DataFrame) -> DataFrame:
    """Exported methods with parameters that the comment above does not describe (BSL088)."""
    told = comments_above(facts.where(~F.startswith("t", F.lit("&"))))
    bare = methods(facts).where("is_export = 1 AND size(params) > 0").join(told, ["file_path", "line"], "left")
    return _warn(bare.where(~F.coalesce(F.col("doc"), F.lit("")).rlike(r"(?iu)(?:^|\n)\s*(?:Параметры|Parameters)\s*:")), "BSL088", "INFORMATION")


def repeated_branches(facts: DataFrame) -> DataFrame:
    """Branches of an If that have the same lines, in the same order, as an earlier one (BSL197): the line where each begins.

    Sizes and the first and last code line are compared first, which windows over the lines that part
    branches tell; that is all of a branch of one or two lines.  Only longer ones that agree in these
    with a sibling are read whole, by buckets of lines, and only if there are any.
    """
    opens, closes = (F.col("c").rlike("(?iu)" + R.starts(w)) for w in (R.IF, R.END_IF))
    code = (F.col("c") != "").cast("int")
    parts = opens | closes | (F.col("elsif") == 1) | (F.col("other") == 1)
    counted = facts.select("file_path", "line", apart(F.lower("n1")).alias("n1"), F.lower("p1").alias("p1"), "if_depth", "if_opens", parts.alias("mark"), code.alias("code"))
    counted = counted.withColumn("upto", F.sum("code").over(Window.partitionBy("file_path").orderBy("line"))).where("mark")
    numbered = counted.withColumn("if_id", F.sum("if_opens").over(Window.partitionBy("file_path", "if_depth").orderBy("line")))
    chain = Window.partitionBy("file_path", "if_depth", "if_id").orderBy("line")
    marks = numbered.select("*", *(F.lead(c).over(chain).alias(f"next_{c}") for c in ("line", "upto", "p1"))).where("next_line IS NOT NULL")
    marks = marks.withColumn("size", F.col("next_upto") - F.col("upto") - 1).where("size > 0")
    alike = Window.partitionBy("file_path", "if_depth", "if_id", "size", "n1", "next_p1")
    asked = marks.withColumns({"same": F.count(F.lit(1)).over(alike), "nth": F.row_number().over(alike.orderBy("line"))}).where("same > 1")
    asked = stored(asked.select("file_path", "if_depth", "if_id", "size", "nth", F.col("line").alias("start_line"), "next_line"))
    found, longer = asked.where("size <= 2 AND nth > 1").select("file_path", F.col("start_line").alias("line")), asked.where("size > 2")
    if not longer.isEmpty():
        found = found.unionByName(_repeated_long(facts, longer))
    return found.select("file_path", "line", F.lit("BSL197").alias("code"), F.lit("WARNING").alias("severity"))


def _repeated_long(facts: DataFrame, asked: DataFrame, width: int = 64) -> DataFrame:
    """file_path and line of the branches ``asked`` whose lines are those of an earlier one of their chain."""
    bucketed = asked.withColumn("b", F.explode(F.sequence(F.floor(F.col("start_line") / width), F.floor(F.col("next_line") / width))))
    lines = facts.select("file_path", "line", F.explode(F.filter(F.array(F.lower("c")), lambda c: c != "")).alias("c")).withColumn("b", F.floor(F.col("line") / width))
    body = bucketed.join(lines, ["file_path", "b"]).where((F.col("line") > F.col("start_line")) & (F.col("line") < F.col("next_line")))
    digest = body.groupBy("file_path", "if_depth", "if_id", "start_line").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "c"))), lambda x: x["c"]), "\n"), 256).alias("digest"))
    nth = F.row_number().over(Window.partitionBy("file_path", "if_depth", "if_id", "digest").orderBy("start_line"))
    return digest.withColumn("nth", nth).where("nth > 1").select("file_path", F.col("start_line").alias("line"))


def missing_final_newline(modules: DataFrame) -> DataFrame:
    """Modules (path, text) that have text and do not end with a line feed (BSL082), at their last line."""
    lines = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return modules.where("text <> '' AND NOT endswith(text, '\n')").select("path", lines.alias("line"), F.lit("BSL082").alias("code"), F.lit("INFORMATION").alias("severity"))


def flow_diagnostics(lines: DataFrame) -> DataFrame:
    """file_path, line, code, severity, name of all def-use rules over file_path, line, text."""
    facts = R.line_facts(lines)
    narrow = kept(facts)
    found, params = events(narrow), R.parameters(narrow)
    out = unused_variables(found)
    for more in (unused_errors(found), changed_module_variables(found), rewritten_parameters(found, params), unused_iterators(narrow, found), unused_parameters(narrow, found, params), undescribed_parameters(facts)):
        out = out.unionByName(more)
    return out
