"""Types of variables: propagation along the assignments of each method to a fixed point.

Every assignment is an event.  What it gives its variable is known at once (``New T``, a
literal, a counting loop), or follows from the variable it reads: a copy of it, a method
called on it (a map of return types), the elements of a collection that a loop runs
over.  The event it depends on is the last one before it that gave that variable a value,
in the method or else in the module, which one window finds.  Dependencies point to
earlier events only, so rounds of joins, each with what the last one settled, end.
Copies of copies are passed by doubling first; rounds are left for calls and loops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeprism.functions.tables import cut
from codeprism.operators import flow
from codeprism.operators import rules as R

#: What collections hold, lower case.
ELEMENTS = {
    "таблицазначений": "СтрокаТаблицыЗначений", "valuetable": "ValueTableRow", "деревозначений": "СтрокаДереваЗначений", "valuetree": "ValueTreeRow", "списокзначений": "ЭлементСпискаЗначений", "valuelist": "ValueListItem",
    "структура": "КлючИЗначение", "structure": "KeyAndValue", "соответствие": "КлючИЗначение", "map": "KeyAndValue",
}
#: What methods return, by type and method, lower case.
RETURNS = {
    "запрос.выполнить": "РезультатЗапроса", "query.execute": "QueryResult", "результатзапроса.выбрать": "ВыборкаИзРезультатаЗапроса", "queryresult.select": "QueryResultSelection", "результатзапроса.выгрузить": "ТаблицаЗначений", "queryresult.unload": "ValueTable",
    "таблицазначений.добавить": "СтрокаТаблицыЗначений", "valuetable.add": "ValueTableRow", "таблицазначений.найти": "СтрокаТаблицыЗначений", "valuetable.find": "ValueTableRow", "таблицазначений.скопировать": "ТаблицаЗначений", "valuetable.copy": "ValueTable",
}
#: Names of the types of literals: number, string, boolean.
LITERALS = ("Число", "Строка", "Булево")
NEW = rf"(?iu)^(?:Новый|New)\s+({R.ID})"
COPY = rf"^({R.ID})$"
CALLED = rf"^({R.ID})\s*\.\s*({R.ID})\s*\(.*\)$"
COLLECTION = rf"(?iu)^(?:Из|In)\s+(.*?)\s+(?:{R.DO})$"
#: Words that stand alone without being variables, lower case.
CONSTANTS = ("истина", "true", "ложь", "false", "неопределено", "undefined", "null")


def assignments(facts: DataFrame, numbers: tuple[str, str, str] = LITERALS) -> DataFrame:
    """id, file_path, scope, line, k, word, name, type (if known at once), form (const, copy, call, each), of (the variable read), method and dep (id of the event it depends on)."""
    said = flow.statements(facts).where(F.col("target").isNotNull())
    rest = F.btrim("rest", F.lit(" \t"))
    said = said.withColumn("e", F.when(F.col("kind") == "loop", F.btrim(F.regexp_extract(rest, COLLECTION, 1))).otherwise(rest))
    new, number = F.regexp_extract("e", NEW, 1), F.col("e").rlike(r"^[0-9]+(?:\.[0-9]+)?$")
    literal = F.when(F.col("kind") == "count", numbers[0]).when(new != "", new).when(number, numbers[0]).when(F.col("e") == '""', numbers[1]).when(F.lower("e").isin(*CONSTANTS[:4]), numbers[2])
    copied = F.when(~F.lower("e").isin(*CONSTANTS), F.nullif(F.regexp_extract("e", COPY, 1), F.lit("")))
    owner = F.nullif(F.regexp_extract("e", CALLED, 1), F.lit(""))
    of = F.when(literal.isNull(), F.coalesce(copied, owner))
    said = said.select(
        F.concat_ws(":", "scope", "line", "k").alias("id"), "file_path", "scope", "line", "k", F.lower("target").alias("word"), F.col("target").alias("name"), literal.alias("type"), of.alias("of"),
        F.when(literal.isNotNull(), "const").when(copied.isNotNull(), "copy").when(owner.isNotNull(), "call").otherwise("const").alias("form"), F.regexp_extract("e", CALLED, 2).alias("method"), (F.col("kind") == "loop").alias("each"),
    )
    reads = said.where("of IS NOT NULL").select("id", "file_path", "scope", "line", "k", F.lower("of").alias("v"), F.lit(0).alias("role"))
    writes = said.select("id", "file_path", "scope", "line", "k", F.col("word").alias("v"), F.lit(1).alias("role"))
    own = F.last(F.when(F.col("role") == 1, F.col("id")), ignorenulls=True).over(Window.partitionBy("file_path", "scope", "v").orderBy("line", "k", "role"))
    module = F.last(F.when((F.col("role") == 1) & (F.col("scope") == 0), F.col("id")), ignorenulls=True).over(Window.partitionBy("file_path", "v").orderBy("line", "k", "role"))
    linked = reads.unionByName(writes).withColumns({"own": own, "module": module}).where("role = 0").select("file_path", "id", F.coalesce("own", "module").alias("dep"))
    return said.join(linked, ["file_path", "id"], "left")


def _past_copies(found: DataFrame) -> DataFrame:
    """``found`` with dep moved past plain copies to the event that they all copy; each round doubles the way, so a chain of n copies takes log n."""
    jump = cut(found.where("dep IS NOT NULL AND form = 'copy' AND NOT each").select("file_path", "id", F.col("dep").alias("to")))
    while True:
        moved = jump.join(jump.select("file_path", F.col("id").alias("to"), F.col("to").alias("next")), ["file_path", "to"], "left")
        if not moved.where("next IS NOT NULL").limit(1).count():
            break
        jump = cut(moved.select("file_path", "id", F.coalesce("next", "to").alias("to")))
    past = found.join(jump.select("file_path", F.col("id").alias("dep"), "to"), ["file_path", "dep"], "left")
    return past.withColumn("dep", F.coalesce("to", "dep")).select(*found.columns)


def typed(found: DataFrame, returns: dict[str, str] = RETURNS, elements: dict[str, str] = ELEMENTS) -> DataFrame:
    """``found`` (assignments) with every type that can be told; others are empty."""
    table = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv)) if d else F.create_map().cast("map<string,string>")
    given, held = table(returns), table(elements)
    empty = F.lit("")

    def told(known):
        """The type of an event whose variable has type ``known``."""
        value = F.when(F.col("form") == "call", F.coalesce(F.try_element_at(given, F.concat(F.lower(F.coalesce(F.nullif(known, empty), F.col("of"))), F.lit("."), F.lower("method"))), empty)).otherwise(F.coalesce(known, empty))
        return F.when(F.col("form") == "const", F.coalesce(F.col("type"), empty)).when(F.col("each"), F.coalesce(F.try_element_at(held, F.lower(value)), empty)).otherwise(value)

    found = cut(_past_copies(cut(found)))
    settled = found.where("dep IS NULL").withColumn("type", told(F.lit(None).cast("string")))
    done, waiting = settled, found.where("dep IS NOT NULL")
    while True:
        known = cut(settled).select("file_path", F.col("id").alias("dep"), F.col("type").alias("known"))
        settled = waiting.join(known, ["file_path", "dep"]).withColumn("type", told(F.col("known"))).select(*found.columns)
        if not settled.limit(1).count():
            return done
        settled = cut(settled)
        done = done.unionByName(settled)
        waiting = waiting.join(settled.select("file_path", "id"), ["file_path", "id"], "left_anti")


def inferred(facts: DataFrame, returns: dict[str, str] = RETURNS, elements: dict[str, str] = ELEMENTS) -> DataFrame:
    """file_path, scope, name (lower case) and type of every variable whose last assignment in its method tells one."""
    last = typed(assignments(facts), returns, elements).groupBy("file_path", "scope", F.col("word").alias("name")).agg(F.max(F.struct("line", "k", "type"))["type"].alias("type"))
    return last.where("type <> ''")
