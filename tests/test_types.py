"""Types by propagation against a plain interpreter of assignments."""

import random
import re

import pytest

from codeprism.operators import rules, types


def interpreted(lines):
    """(scope, name): type after a walk over the lines of one module."""
    scope, n, module, own, out = 0, 0, {}, {}, {}
    for t in lines:
        if t.startswith("Процедура"):
            n += 1
            scope, own = n, {}
            continue
        if t.startswith("КонецПроцедуры"):
            scope = 0
            continue
        names = own if scope else module
        get = lambda v: names.get(v.lower()) if v.lower() in names else module.get(v.lower(), "")

        def value(e):
            if m := re.match(r"Новый (\w+)", e):
                return m[1]
            if re.fullmatch(r"\d+", e):
                return "Число"
            if e.startswith('"'):
                return "Строка"
            if e in ("Истина", "Ложь"):
                return "Булево"
            if m := re.fullmatch(r"(\w+)\.(\w+)\(.*\)", e):
                return types.RETURNS.get(f"{(get(m[1]) or m[1]).lower()}.{m[2].lower()}", "")
            return get(e) if re.fullmatch(r"\w+", e) and e != "Неопределено" else ""

        for s in filter(None, (x.strip() for x in t.split(";"))):
            if m := re.match(r"Для Каждого (\w+) Из (.*) Цикл", s):
                name, kind = m[1], types.ELEMENTS.get(value(m[2]).lower(), "")
            elif m := re.match(r"Для (\w+) = ", s):
                name, kind = m[1], "Число"
            elif m := re.match(r"(\w+) = (.*)$", s):
                name, kind = m[1], value(m[2])
            else:
                continue
            names[name.lower()] = kind
            out[scope, name.lower()] = kind
    return {k: v for k, v in out.items() if v}


def frame(spark, modules):
    return spark.createDataFrame([(f"f{k}", i + 1, t) for k, m in enumerate(modules) for i, t in enumerate(m)], "file_path string, line int, text string")


def test_chain(spark):
    text = ["Общая = Новый Запрос;", "Процедура А()", "Р = Общая.Выполнить();", "Т = Р.Выгрузить(); Копия = Т;", "Для Каждого С Из Копия Цикл", "Д = С;", "КонецЦикла;", "Для Сч = 1 По 3 Цикл", "КонецЦикла;", "Нет = Неизвестно();", "КонецПроцедуры"]
    got = {(r["scope"], r["name"]): r["type"] for r in types.inferred(rules.line_facts(frame(spark, [text]))).collect()}
    assert got == interpreted(text) == {(0, "общая"): "Запрос", (1, "р"): "РезультатЗапроса", (1, "т"): "ТаблицаЗначений", (1, "копия"): "ТаблицаЗначений", (1, "с"): "СтрокаТаблицыЗначений", (1, "д"): "СтрокаТаблицыЗначений", (1, "сч"): "Число"}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_modules(spark, seed):
    random.seed(seed)
    names = ["А", "Б", "В", "Г", "Д"]
    forms = ["Новый Запрос", "Новый ТаблицаЗначений", "5", '"т"', "Истина", "Неопределено", "{0}", "{0}", "{0}", "{0}.Выполнить()", "{0}.Выгрузить()", "Запрос.Выполнить()", "{0} + 1"]
    modules = []
    for _ in range(25):
        m = []
        for _ in range(random.randint(0, 3)):
            m += ["Процедура П()", *[random.choice([f"{random.choice(names)} = {random.choice(forms).format(random.choice(names))};"] * 6 + [f"Для Каждого {random.choice(names)} Из {random.choice(names)} Цикл"]) for _ in range(random.randint(0, 12))], "КонецПроцедуры", f"{random.choice(names)} = {random.choice(forms).format(random.choice(names))};"]
        modules.append(m or [""])
    found = types.inferred(rules.line_facts(frame(spark, modules))).collect()
    for k, m in enumerate(modules):
        assert {(r["scope"], r["name"]): r["type"] for r in found if r["file_path"] == f"f{k}"} == interpreted(m), m


def test_empty(spark):
    assert types.inferred(rules.line_facts(frame(spark, [["A();"]]))).collect() == []


def test_long_chains_of_copies_take_few_rounds(spark, monkeypatch):
    cuts, plain = [], types.cut
    monkeypatch.setattr(types, "cut", lambda df: cuts.append(1) or plain(df))
    text = ["В0 = Новый Запрос;", *[f"В{i + 1} = В{i};" for i in range(20)], "Р = В20.Выполнить();"]
    got = {(r["scope"], r["name"]): r["type"] for r in types.inferred(rules.line_facts(frame(spark, [text]))).collect()}
    assert got == interpreted(text) and len(got) == 22
    assert len(cuts) < 16  # two for each copy before
