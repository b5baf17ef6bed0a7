"""Def-use rules, branch bodies, query texts and contexts of methods: what fires and what does not."""

import pytest

from codeprism.operators import flow, rules


def method(*lines, head="Процедура А()", above=()):
    return [*above, head, *lines, "КонецПроцедуры"]


#: (rule, lines, fires)
CASES = [
    ("BSL007", method("Перем Б;", "В(1);"), True), ("BSL007", method("Перем Б;", "Б = 2;", "В(Б);"), False), ("BSL007", method("Перем Б;", "Б = 1;"), True), ("BSL007", method("Б = 1 + 2;"), True), ("BSL007", ["Б = 1;"], True),
    ("BSL007", ["Б = 1;", *method("В(Б);")], False), ("BSL007", method("Б = 1;", head="Процедура А(Б)"), False), ("BSL007", ["Перем Б Экспорт;"], False), ("BSL007", ["Перем Б;", *method("Б = 1;"), *method("В(Б);")], False),
    ("BSL007", method("А.Б = 1;"), False), ("BSL007", method("Б = 1; В(Б);"), False), ("BSL007", method("В(Г,", "Б = 1);"), False), ("BSL007", method("Для Каждого Б Из В Цикл", "Г();", "КонецЦикла;"), False),
    ("BSL034", method("Попытка", "Б();", "Исключение", "И = ИнформацияОбОшибке();", "КонецПопытки;"), True), ("BSL034", method("Попытка", "Б();", "Исключение", "И = ИнформацияОбОшибке();", "В(И);", "КонецПопытки;"), False),
    ("BSL034", method("В(И);", "И = ErrorInfo();"), True), ("BSL034", method("И = Б();"), False),
    ("BSL075", ["Перем Б;", *method("Б = Б + 1;")], True), ("BSL075", ["Перем Б;", *method("Б = 1;", head="Процедура А(Б)")], False), ("BSL075", method("Б = 1;"), False), ("BSL075", ["Перем Б;", *method("Перем Б;", "Б = 1;")], False),
    ("BSL240", method("Б = 1;", head="Процедура А(Знач Б) Экспорт"), True), ("BSL240", method("Б = 1;", head="Процедура А(Б) Экспорт"), False), ("BSL240", method("Б = В(Б);", head="Процедура А(Знач Б)"), False),
    ("BSL240", ["Процедура А(", "Знач Б = Неопределено) Экспорт", "В(Б);", "КонецПроцедуры"], False),
    ("BSL263", method("Для Каждого Б Из В Цикл", "Г();", "КонецЦикла;", "Д(Б);"), True), ("BSL263", method("Для Каждого Б Из В Цикл", "Г(Б);", "КонецЦикла;"), False), ("BSL263", method("For Each B In C Do", "If D Then", "E(b.F);", "EndIf;", "EndDo;"), False),
    ("BSL062", method("Б = 1;", head="Процедура А(В)"), True), ("BSL062", method("Б = В;", head="Процедура А(В)"), False), ("BSL062", method("Б = 1;", head="Процедура А(В = 1, _Г)"), False),
    ("BSL062", method("Б = 1;", head="Процедура Сохранить(Команда)", above=["&НаКлиенте"]), False), ("BSL062", method("Б = 1;", head="Процедура ОбработкаКоманды(В, Г)", above=["&НаКлиенте"]), False), ("BSL062", method("Б = 1;", head="Процедура ОбработкаКоманды(В, Г)"), True),
    ("BSL062", method("Б = В;", head="Процедура ИмяЗавершение(В, Г) Экспорт", above=["&НаКлиенте"]), False), ("BSL062", method("Б();", head="Процедура И(В, ДополнительныеПараметры)"), True), ("BSL062", method("Б(В);", head="Процедура И(В, ДополнительныеПараметры)"), False),
    ("BSL021", method("Б();", head="Процедура И(Знач В)"), True), ("BSL122", method("Б();", head="Процедура И(В)"), True), ("BSL122", method("Б(В);", head="Процедура И(В)"), False), ("BSL062", method("В = 1;", head="Процедура А(В)"), False),
    ("BSL088", method("Б(В);", head="Процедура А(В) Экспорт"), True), ("BSL088", method("Б(В);", head="Процедура А(В) Экспорт", above=["// Делает.", "// Параметры:", "//   В - вход.", "&НаКлиенте"]), False), ("BSL088", method("Б(В);", head="Процедура А(В)"), False), ("BSL088", method(head="Процедура А() Экспорт"), False),
    ("BSL197", method("Если Б Тогда", "В();", "Г();", "Иначе", "В();", "", "// слова", "Г();", "КонецЕсли;"), True), ("BSL197", method("Если Б Тогда", "В();", "Г();", "Иначе", "Г();", "В();", "КонецЕсли;"), False),
    ("BSL197", method("Если Б Тогда", "В();", "Д();", "Г();", "ИначеЕсли Е Тогда", "В();", "Ж();", "Г();", "КонецЕсли;"), False), ("BSL197", method("Если Б Тогда", "Если В Тогда", "Г();", "КонецЕсли;", "Иначе", "Если В Тогда", "Г();", "КонецЕсли;", "КонецЕсли;"), True),
    ("BSL197", method("Если Б Тогда", "В();", "КонецЕсли;", "Если Г Тогда", "В();", "КонецЕсли;"), False),
]
RULES = [
    ("BSL001", ["Процедура А()", "Б();"], True), ("BSL001", ["Процедура А()", "Б();", "КонецПроцедуры"], False), ("BSL001", ["Попытка", "Б();", "Исключение"], True), ("BSL001", ["Попытка", "Б();", "Исключение", "КонецПопытки;"], False), ("BSL001", ["КонецФункции"], True),
    ("BSL012", ['// Пароль = "секрет";'], False), ("BSL012", ['Б(); Пароль = "секрет";'], True), ("BSL041", method("О = Новый ОписаниеОповещения(1);", head="Процедура ОбработкаКоманды(Б)", above=["&НаКлиенте"]), False), ("BSL041", method("О = Новый ОписаниеОповещения(1);", head="Процедура ОбработкаКоманды(Б)"), True),
    ("BSL058", ['Т = "ВЫБРАТЬ', "|   Код,", "|ИЗ", '|   Товары";'], True), ("BSL058", ['Т = "ВЫБРАТЬ', "|   Код", "|ИЗ", "|   Товары", "|ГДЕ", '|   Код = 1";'], False), ("BSL058", ['Т = "ВЫБРАТЬ ПЕРВЫЕ 10', "| Код", '|ИЗ Товары";'], False), ("BSL058", ['Т = "Кнопка ВЫБРАТЬ ИЗ списка";'], False),
    ("BSL077", ['Т = "ВЫБРАТЬ', '| * ИЗ Б";'], True), ("BSL077", ['Т = "ВЫБРАТЬ Б ИЗ В";'], False), ("BSL106", ["Пока А Цикл", 'Т = "ВЫБРАТЬ * ИЗ Б";', "КонецЦикла;"], True), ("BSL106", ['Т = "ВЫБРАТЬ * ИЗ Б";'], False),
    ("BSL149", ['Т = "ВЫБРАТЬ', "|   Код,", "|   Имя", '|ИЗ Б";'], True), ("BSL149", ['Т = "ВЫБРАТЬ', "|   Код КАК Код,", "|   СУММА(Имя, 1) КАК Имя", '|ИЗ Б";'], False), ("BSL149", ['Т = "ВЫБРАТЬ Ссылка, Номер ИЗ Б";'], True), ("BSL149", ['Т = "SELECT * FROM B";'], False), ("BSL149", ['Т = "ВЫБРАТЬ РАЗЛИЧНЫЕ Код КАК К ИЗ Б";'], False),
    ("BSL258", ['Т = "ВЫБРАТЬ 1', "|ОБЪЕДИНИТЬ", '|ВЫБРАТЬ 2";'], True), ("BSL258", ['Т = "ВЫБРАТЬ 1', "|ОБЪЕДИНИТЬ", "|  ВСЕ", '|ВЫБРАТЬ 2";'], False), ("BSL258", ['Т = "SELECT 1 UNION ALL SELECT 2 UNION SELECT 3";'], True),
    ("BSL065", method("А();", head="Процедура Т() Экспорт", above=["// Слова.", "&НаКлиенте"]), False), ("BSL065", method("А();", head="Процедура ТЗавершение(Р, П) Экспорт", above=["&НаКлиенте"]), False), ("BSL065", method("А();", head="Процедура Т() Экспорт", above=["&НаКлиенте"]), True),
    ("BSL127", ["Функция Т(А)", "Если А Тогда", "Возврат 1;", "КонецЕсли;", "Возврат 0;", "КонецФункции"], False), ("BSL127", ["Функция Т(А)", "Возврат 1;", "Возврат 0;", "КонецФункции"], True),
    ("BSL142", [f'Процедура Т(А = "{"длинно " * 9}")', "КонецПроцедуры"], True), ("BSL142", ["Процедура Т(А = 0)", "КонецПроцедуры"], False),
    ("BSL172", method("Б();", head="Процедура ПередЗаписью(Отказ)"), True), ("BSL172", method("Если ОбменДанными.Загрузка Тогда", head="Процедура ПередЗаписью(Отказ)"), False), ("BSL172", method("Б();", head="Процедура Запись()"), False),
    ("BSL254", ["&НаСервере", "Функция Б(Ссылка)", "КонецФункции"], True), ("BSL254", ["&НаСервере", "Функция Б(Знач Ссылка, Знач В = 1) Экспорт", "КонецФункции"], False), ("BSL254", ["&НаСервере", "Функция Б(Знач Ссылка, В)", "КонецФункции"], True), ("BSL254", ["&НаКлиенте", "Функция Б(Ссылка)", "КонецФункции"], False), ("BSL254", ["&НаСервере", "Функция Б()", "КонецФункции"], False),
    ("BSL256", ["сonnection = 1;"], True), ("BSL208", ["сonnection = 1;"], False), ("BSL208", ["ИмяName = 1;"], True), ("BSL256", ["ИмяName = 1;"], False), ("BSL256", ["Имя = Name;"], False),
    *(("BSL208", [t], False) for t in ('З = Новый HTTPЗапрос("/api");', "Д = ЗначениеВJSON(С);", "Ч = Новый XMLЧтение();", "А = Новый ЧтениеZIP(П);", "О = Новый COMОбъект(1);", "ТипJSON = JSONТип;", 'НовыйSQL = "x";')),
    ("BSL138", ['А = "текст', '|Сообщить(1);";'], False), ("BSL138", ['А = "текст";', "Сообщить(1);"], True),
]


def frame(spark, cases):
    rows = [(f"src/{i:03}", n + 1, text) for i, (_, lines, _) in enumerate(cases) for n, text in enumerate(lines)]
    return spark.createDataFrame(rows, "file_path string, line int, text string")


def wrong(cases, found):
    hits = {(r["file_path"], r["code"]) for r in found.select("file_path", "code").distinct().collect()}
    return [c for i, c in enumerate(cases) if ((f"src/{i:03}", c[0]) in hits) != c[2]]


def test_flow_rules(spark):
    lines = frame(spark, CASES)
    found = flow.flow_diagnostics(lines).select("file_path", "code").unionByName(flow.repeated_branches(rules.line_facts(lines)).select("file_path", "code"))
    assert wrong(CASES, found) == []


def test_rules_of_text_and_context(spark):
    assert wrong(RULES, rules.diagnostics(frame(spark, RULES), {r[0] for r in rules.ALL_RULES})) == []


def test_form_modules_need_no_comment(spark):
    text = method("А();", head="Процедура Т() Экспорт")
    lines = spark.createDataFrame([(f, i + 1, t) for f in ("src/Forms/X/Ext/Module.bsl", "src/Module.bsl") for i, t in enumerate(text)], "file_path string, line int, text string")
    assert [r["file_path"] for r in rules.diagnostics(lines, {"BSL065"}).collect()] == ["src/Module.bsl"]


def test_final_newline(spark):
    modules = spark.createDataFrame([("a", "x\ny"), ("b", "x\n"), ("c", ""), ("d", None)], "path string, text string")
    assert [(r["path"], r["line"]) for r in flow.missing_final_newline(modules).collect()] == [("a", 2)]


@pytest.mark.parametrize("last", [200, 3000])
def test_long_branches(spark, last):
    body = [f"A{i}();" for i in range(last)]
    lines = ["If B Then", *body, "Else", *body, "EndIf;", "If B Then", *body, "Else", *body[:-2], "C();", body[-1], "EndIf;"]
    found = flow.repeated_branches(rules.line_facts(spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(lines)], "file_path string, line int, text string")))
    assert [r["line"] for r in found.collect()] == [last + 2]


def test_defuse_rules_pass_over_a_stored_table(spark):
    """The lines are computed once for all passes, and idle variables are told in one pass over the events."""
    lines = spark.createDataFrame([("a", i + 1, t) for i, t in enumerate(method("Перем Б;", "Б = 1; Для = 2;", "В(Д);"))], "file_path string, line int, text string")
    plan = flow.unused_variables(flow.events(flow.kept(rules.line_facts(lines))))._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan
    assert plan.count("posexplode(split") <= 2  # statements, and those of lines that a header may hold


def test_short_repeated_branches_need_no_lines(spark):
    text = method("Если Б Тогда", "В();", "Иначе", "в();", "КонецЕсли;", "Если Б Тогда", "В();", "Г();", "ИначеЕсли Д Тогда", "Е();", "Иначе", "В();", "Г();", "КонецЕсли;")
    facts = rules.line_facts(spark.createDataFrame([("a", i + 1, t) for i, t in enumerate(text)], "file_path string, line int, text string"))
    found = flow.repeated_branches(facts)
    assert sorted(r.line for r in found.collect()) == [4, 12]
    assert "LogicalRDD" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_calls_of_procedures_compute_the_code_once(spark):
    facts = rules.line_facts(spark.createDataFrame([("a", 1, "А = Б(1);"), ("a", 2, "В = Г(2);"), ("a", 3, "Б(3);")], "file_path string, line int, text string"))
    found = rules.procedures_as_functions(facts, spark.createDataFrame([("б", "procedure"), ("г", "function")], "name_lower string, kind string"))
    assert [tuple(r)[:3] for r in found.collect()] == [("a", 1, "BSL117")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("octet_length") + found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 2
