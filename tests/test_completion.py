"""Words, metadata chains, ranked candidates, and nested reports."""

import json

from pyspark.sql import functions as F

import __spark_entry__ as entry
from codeprism.operators import completion, reporting


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def tables(spark):
    aliases = frame(spark, "alias string, kind string", ("Справочники", "Catalog"), ("Catalogs", "Catalog"), ("Документы", "Document"))
    objects = frame(spark, "name string, name_lower string, kind string", ("Товары", "товары", "Catalog"), ("Склады", "склады", "Catalog"), ("Заказ", "заказ", "Document"))
    members = frame(spark, "object_name_lower string, name string, kind string", ("товары", "Цена", "attribute"), ("товары", "Состав", "tabular_section"), ("заказ", "Дата", "attribute"))
    return objects, members, aliases


def test_words(spark):
    df = frame(spark, "t string, c int", ("Объект.Метод(1)", 9), ("Объект.Метод(1)", 3), ("a b", 1), ("a b", 9), ("Ёж_1", 4))
    assert [tuple(r) for r in df.select(completion.word_at(F.col("t"), F.col("c")), completion.left_word_at(F.col("t"), F.col("c"))).collect()] == [("Метод", "Объект"), ("Объект", ""), ("a", ""), ("", ""), ("Ёж_1", "")]


def test_chains(spark):
    objects, members, aliases = tables(spark)
    asks = frame(spark, "ask int, chain string, prefix string", (1, "Справочники.Товары", ""), (2, "Метаданные.Документы.Заказ", "д"), (3, "Справочники", "С"), (4, "Метаданные", ""), (5, "Перем.Товары.Состав", "ц"), (6, "Неизвестно", ""), (7, "справочники.нет", ""))
    got = sorted((r["ask"], r["label"]) for r in completion.metadata_completions(asks, objects, members, aliases).collect())
    assert got == [(1, "Состав"), (1, "Цена"), (2, "Дата"), (3, "Склады"), (4, "Catalogs"), (4, "Документы"), (5, "Цена")]


def test_ranks(spark):
    objects, members, aliases = tables(spark)
    types = frame(spark, "type string, name string, kind string", ("Запрос", "Выполнить", "method"), ("Запрос", "Текст", "property"), (None, "Сообщить", "function"), (None, "Строка", "function"))
    symbols = frame(spark, "name string, name_lower string, kind string, file_path string, line int, is_export int", ("Общий", "общий", "procedure", "src/Модуль.bsl", 1, 1), ("Сообщить", "сообщить", "procedure", "src/a.bsl", 1, 0), *((f"Со{i:02}", f"со{i:02}", "function", "src/a.bsl", i, 0) for i in range(40)))
    asks = frame(spark, "ask int, file_path string, before string", (1, "f", "А = Запрос.в"), (2, "f", "Модуль."), (3, "f", "З.Т"), (4, "f", "Справочники.Товары.Ц"), (5, "f", "Б = со"), (6, "f", "X.Y"), (7, "f", ""))
    variables = frame(spark, "ask int, name string, type string", (3, "З", "Запрос"))
    rows = completion.completions(asks, types, symbols, objects, members, aliases, variables).collect()
    got = {k: sorted((r["rank"], r["label"]) for r in rows if r["ask"] == k) for k in range(1, 8)}
    assert got[1] == [(1, "Выполнить")] and got[2] == [(2, "Общий")] and got[3] == [(3, "Текст")] and got[4] == [(4, "Цена")] and got[6] == []
    assert got[5][0] == (1, "Сообщить") and len(got[5]) == 31 and got[7] == [(1, "Сообщить"), (1, "Строка")]


def test_documents_hold_the_rows(spark):
    found = frame(spark, "file_path string, line int, code string, severity string", ("a", 3, "BSL009", "WARNING"), ("a", 1, "BSL120", "INFORMATION"), ("a", 2, "BSL009", "WARNING"), ("b", 1, "BSL001", "ERROR"))
    logs = {r["file_path"]: json.loads(r["document"]) for r in reporting.sarif_documents(found).collect()}
    run = logs["a"]["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["BSL120", "BSL009"] and logs["b"]["version"] == "2.1.0"
    flat = [(p, r["ruleId"], r["level"], r["locations"][0]["physicalLocation"]["region"]["startLine"]) for p, d in logs.items() for r in d["runs"][0]["results"]]
    assert sorted(flat) == sorted((r["uri"], r["rule_id"], r["level"], r["start_line"]) for r in reporting.sarif_rows(found).collect())
    issues = [(i["primaryLocation"]["filePath"], i["ruleId"], i["severity"]) for r in reporting.sonar_documents(found).collect() for i in json.loads(r["document"])["issues"]]
    assert sorted(issues) == sorted((r["path"], r["rule_id"], r["severity"]) for r in reporting.sonar_rows(found).collect())
    assert reporting.sarif_documents(found.limit(0)).count() == 0


def test_logs_come_in_pieces_of_bounded_size(spark):
    lines = spark.range(1, 5001).selectExpr("'a' AS file_path", "CAST(id + 2000 AS INT) AS line", "'BSL009' AS code", "'WARNING' AS severity")
    found = lines.unionByName(frame(spark, "file_path string, line int, code string, severity string", ("b", 1, "X1", "ERROR")))
    pieces = sorted((tuple(r) for r in reporting.sarif_pieces(found).collect()))
    assert max(len(t) for _, _, t in pieces) < 300 * reporting.SPAN and len([f for f, _, _ in pieces if f == "a"]) == 8
    runs = {f: json.loads("".join(t for g, _, t in pieces if g == f))["runs"][0] for f in "ab"}
    assert [x["locations"][0]["physicalLocation"]["region"]["startLine"] for x in runs["a"]["results"]] == list(range(2001, 7001))
    assert [x["id"] for x in runs["b"]["tool"]["driver"]["rules"]] == ["X1"] and runs["b"]["results"][0]["message"]["text"] == "X1"


def test_unused_symbols_join_the_report(spark):
    found = frame(spark, "file_path string, line int, code string, severity string", ("a", 3, "BSL009", "WARNING"))
    unused = frame(spark, "file_path string, line int, name string", ("a", 7, "X"))
    assert [tuple(r) for r in reporting.with_unused(found, unused).orderBy("line").collect()] == [("a", 3, "BSL009", "WARNING"), ("a", 7, "BSL-DEAD", "INFORMATION")]


def test_only_wanted_rules_run(spark):
    assert reporting.wanted(["bsl009", "TabIndentation"], ["TabIndentation"]) == {"BSL009"} and "BSL009" not in reporting.wanted(ignore=["BSL009"])
    plan = entry.queries()["lint_select_ignore"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "BSL004" not in plan and "BSL009" in plan
