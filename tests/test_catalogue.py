import json

from codeprism.operators import catalogue, rules, structure
from codeprism.operators import types as inference


def types(spark, tmp_path):
    member = lambda n, e: {"name": n, "name_en": e, "returns": "T", "description": ""}
    docs = [{"name": "Массив", "name_en": "Array", "is_global": False, "methods": [member("Добавить", "Add"), member("Найти", "Find")], "properties": [member("Длина", "Length")]}, {"name": "Сообщить", "name_en": "Message", "is_global": True, "methods": [], "properties": []}]
    for i, d in enumerate(docs):
        (tmp_path / f"{i}.json").write_text(json.dumps(d, ensure_ascii=False))
    (tmp_path / "bad.json").write_text("{nope")
    return catalogue.read_catalogue(spark, str(tmp_path)).cache()


def test_catalogue(spark, tmp_path):
    t = types(spark, tmp_path)
    assert catalogue.find_type(t, "ARRAY").first()["name"] == "Массив"
    assert [r["name"] for r in catalogue.completions(t, "массив").collect()] == ["Добавить", "Найти", "Длина"]
    assert [r["name"] for r in catalogue.completions(t, "Array", "f").collect()] == ["Найти"]
    assert [r["name"] for r in catalogue.search(t, "о").collect()] == ["Сообщить", "Добавить"]
    names = spark.createDataFrame([("сообщить",), ("Add",), ("добавить",), ("Свой",)], "name string")
    own = spark.createDataFrame([("Свой",)], "name string")
    got = {r["name"]: r["kind"] for r in catalogue.resolve(names, own, t).collect()}
    assert got == {"сообщить": "global", "Add": None, "добавить": "member", "Свой": "symbol"}


def test_structure(spark):
    text = ["#Область Служебные", "Процедура А(Б, Знач В = 1)", "Перем Г, Д;", "Если Б Тогда", "Е = Новый Массив;", "Ж = Е;", "КонецЕсли;", "КонецПроцедуры", "#КонецОбласти"]
    lines = spark.createDataFrame([("m", i + 1, t) for i, t in enumerate(text)], "file_path string, line int, text string")
    facts = rules.line_facts(lines)
    assert {(r["kind"], r["start_line"], r["end_line"]) for r in structure.blocks(facts).collect()} == {("region", 1, 9), ("method", 2, 8), ("if", 4, 7)}
    assert structure.regions(facts).first()["name"] == "Служебные"
    around = structure.enclosing(structure.blocks(facts), spark.createDataFrame([("m", 5)], "file_path string, line int")).orderBy("nesting")
    assert [r["kind"] for r in around.collect()] == ["if", "method", "region"]
    assert {r["name"]: r["origin"] for r in structure.locals_of(facts).collect()} == {"Б": "param", "В": "param", "Г": "var", "Д": "var", "Е": "assignment", "Ж": "assignment"}
    assert {r["name"]: r["type"] for r in inference.inferred(facts).collect()} == {"е": "Массив", "ж": "Массив"}
    assert [(r["start"]) for r in structure.highlights(lines, "Е").orderBy("line", "start").collect()] == [0, 4]
    tokens = structure.semantic_tokens(lines).where("line = 5").orderBy("start").collect()
    assert [(r["start"], r["type"], r["delta"]) for r in tokens] == [(0, "variable", 0), (4, "variable", 4), (10, "variable", 6)]
    calls = spark.createDataFrame([("x", 1, "А", ["1", "2"])], "file_path string, line int, callee string, args array<string>")
    hints = catalogue.inlay_hints(calls, rules.parameters(facts)).orderBy("ord").collect()
    assert [(r["param"], r["arg"]) for r in hints] == [("Б", "1"), ("В", "2")]
