import pytest
from pyspark.sql import functions as F

from codeprism.functions.text import fold, rename_in, utf16_length
from codeprism.operators import formatting, graph, index, reporting, rules
from codeprism.sources import files
from codeprism.streaming import changes

#: (rule, lines, fires)
EXAMPLES = [
    ("BSL005", ['A = "10.0.0.1";'], True), ("BSL005", ['A = "http://10.0.0.1/x";'], False),
    ("BSL006", ['A = "C:\\Temp\\x";'], True), ("BSL006", ['A = "rel/x";'], False),
    ("BSL009", ["Сумма = Сумма;"], True), ("BSL009", ["A.B = A.B;"], False),
    ("BSL012", ['Пароль = "abc";'], True), ("BSL012", ['Пароль = "";'], False),
    ("BSL014", ["x" * 121], True), ("BSL014", ["x" * 120], False),
    ("BSL023", ["// TODO: later"], True), ("BSL023", ["// HACK"], False), ("BSL023", ['A = "TODO";'], False),
    ("BSL024", ["//x"], True), ("BSL024", ["// x"], False), ("BSL024", ["///x"], False), ("BSL024", ["//***"], True),
    ("BSL027", ["Перейти ~M;"], True), ("BSL029", ["A = 7;"], True), ("BSL029", ["A = 1;"], False),
    ("BSL033", ["Для Каждого А Из Б Цикл", "З.Выполнить();", "КонецЦикла;"], True), ("BSL033", ["З.Выполнить();"], False),
    ("BSL039", ["A = ?(B, ?(C, 1, 0), 0);"], True), ("BSL039", ["A = ?(B, 1, 0);"], False),
    ("BSL047", ["A = ТекущаяДата();"], True), ("BSL047", ["A = ТекущаяУниверсальнаяДата();"], False),
    ("BSL051", ["Возврат;", "A = 1;"], True), ("BSL051", ["Возврат;", "КонецЕсли;"], False),
    ("BSL055", ["A = 1;", "", "", "B = 1;"], True), ("BSL055", ["A = 1;", "", "B = 1;"], False),
    ("BSL060", ["Если НЕ НЕ А Тогда"], True), ("BSL066", ["A = Найти(B, C);"], True), ("BSL066", ["A = B.Найти(C);"], False),
    ("BSL070", ["Пока А Цикл", "КонецЦикла;"], True), ("BSL077", ['T = "ВЫБРАТЬ * ИЗ Т";'], True),
    ("BSL093", ["Если А = NULL Тогда"], True), ("BSL095", ["A = 1; B = 2;"], True), ("BSL111", ["Перемeнная = 1;"], True),
    ("BSL125", ["Прервать;"], True), ("BSL125", ["Пока А Цикл", "Прервать;", "КонецЦикла;"], False),
    ("BSL120", ["A = 1; "], True), ("BSL121", ["\tA = 1;"], True), ("BSL279", ["// ёлка"], True),
    ("BSL032", ["Функция А()", "Б = 1;", "КонецФункции"], True), ("BSL032", ["Функция А()", "Возврат 1;", "КонецФункции"], False),
    ("BSL064", ["Процедура А()", "Возврат 1;", "КонецПроцедуры"], True), ("BSL008", ["Функция А()", *["Возврат 1;"] * 4, "КонецФункции"], True),
    ("BSL031", ["Процедура А(а, б, в, г, д, е, ж, з)", "КонецПроцедуры"], True), ("BSL133", ["Процедура А(а = 1, б)", "КонецПроцедуры"], True),
    ("BSL050", ["Процедура А()", "НачатьТранзакцию();", "КонецПроцедуры"], True), ("BSL048", ["// only", ""], True),
    ("BSL018", ['ВызватьИсключение "x";'], True), ("BSL091", ["Возврат;", "Иначе"], True), ("BSL265", ["A = ?(B, Истина, Ложь);"], True),
]


def test_rule_examples(spark):
    rows = [(f"{i:03}", n + 1, text) for i, (_, lines, _) in enumerate(EXAMPLES) for n, text in enumerate(lines)]
    found = rules.diagnostics(spark.createDataFrame(rows, "file_path string, line int, text string"), {r[0] for r in rules.ALL_RULES}).select("file_path", "code").distinct().collect()
    hits = {(r[0], r[1]) for r in found}
    wrong = [e for i, e in enumerate(EXAMPLES) if ((f"{i:03}", e[0]) in hits) != e[2]]
    assert not wrong

#: (rule, lines that fire, lines that do not); statements stand in a method unless they bring their own.
PAIRS = [
    ("BSL001", ["If A Then", "B();"], ["If A Then", "B();", "EndIf;"]), ("BSL003", ["#Region Public", "Procedure A()", "EndProcedure", "#EndRegion"], ["#Region Public", "Procedure A() Export", "EndProcedure", "#EndRegion"]),
    ("BSL004", ["Try", "A();", "Except", "", "EndTry;"], ["Try", "A();", "Except", "B();", "EndTry;"]), ("BSL010", ["Procedure A()", "B();", "Return;", "EndProcedure"], ["Procedure A()", "Return;", "B();", "EndProcedure"]),
    ("BSL013", ["// A = B;", "// C = D;"], ["// some words", "// C = D;"]), ("BSL015", ["Procedure A(a = 1, b = 1, c = 1, d = 1)", "EndProcedure"], ["Procedure A(a = 1, b = 1, c = 1)", "EndProcedure"]),
    ("BSL016", ["#Region Odd", "#EndRegion"], ["#Region Public", "#EndRegion"]), ("BSL020", ["If A Then"] * 5, ["If A Then"] * 4), ("BSL022", ["Предупреждение(1);"], ["А = 1; // Предупреждение("]),
    ("BSL025", ["A();;"], ["A();"]), ("BSL026", ["#Region Public", "", "// note", "#EndRegion"], ["#Region Public", "A();", "#EndRegion"]), ("BSL028", ["Procedure A()", "B();", "EndProcedure"], ["Procedure A()", "Try", "B();", "Except", "EndTry;", "EndProcedure"]),
    ("BSL030", ["Procedure A();", "EndProcedure"], ["Procedure A()", "EndProcedure"]), ("BSL036", ["If A And B And C And D And E Then"], ["If A And B And C And D Then"]), ("BSL037", ["Function Format(A)", "EndFunction"], ["Function Reformat(A)", "EndFunction"]),
    ("BSL038", ["While A Do", 'B = B + "x";', "EndDo;"], ['B = B + "x";']), ("BSL040", ["A = ThisForm;"], ["A = ThisObject;"]), ("BSL041", ["A = New NotifyDescription(B);"], ["A = New Structure(B);"]),
    ("BSL042", ["Procedure A() Export", "// only words", "EndProcedure"], ["Procedure A() Export", "B();", "EndProcedure"]), ("BSL043", ["Procedure A()", *[f"Var v{i};" for i in range(16)], "EndProcedure"], ["Procedure A()", *[f"Var v{i};" for i in range(15)], "EndProcedure"]),
    ("BSL044", ["Function A() Export", "Return;", "EndFunction"], ["Function A() Export", "Return 1;", "EndFunction"]), ("BSL045", ['A = "x"', '+ "y";'], ['A = "x";', 'B = "y";']),
    ("BSL046", ["If A Then", "B();", "ElsIf C Then", "D();", "EndIf;"], ["If A Then", "B();", "ElsIf C Then", "D();", "Else", "E();", "EndIf;"]), ("BSL049", ["Procedure A()", "B();", 'Raise "x";', "EndProcedure"], ["Procedure A()", "If B Then", 'Raise "x";', "EndIf;", "EndProcedure"]),
    ("BSL051", ["Return;", "", "A();"], ["If A Then", "Return;", "", "EndIf;", "B();"]), ("BSL052", ["If True Then"], ["If A Then"]), ("BSL053", ["Execute(A);"], ["B.Execute();"]), ("BSL054", ["Var A Export;"], ["Var A;"]),
    ("BSL056", ["Procedure A()", "EndProcedure"], ["Procedure Abc()", "EndProcedure"]), ("BSL057", ["ВвестиЧисло(А);"], ["Ввод(А);"]), ("BSL058", ['A = "SELECT B FROM C ";'], ['A = "SELECT B FROM C WHERE D";']),
    ("BSL059", ["If A = True Then", "B();", "EndIf;"], ["If A Then", "B();", "EndIf;"]), ("BSL061", ["While A Do", "Break;", "EndDo;"], ["While A Do", "If B Then", "Break;", "EndIf;", "EndDo;"]),
    ("BSL065", ["Procedure A() Export", "EndProcedure"], ["// Words.", "Procedure A() Export", "EndProcedure"]), ("BSL067", ["Procedure A()", "B();", "Var C;", "EndProcedure"], ["Procedure A()", "Var C;", "B();", "EndProcedure"]),
    ("BSL068", ["Procedure A()", "If A Then", *["ElsIf B Then"] * 6, "EndIf;", "EndProcedure"], ["Procedure A()", "If A Then", *["ElsIf B Then"] * 5, "EndIf;", "EndProcedure"]), ("BSL069", ["While True Do", "A();", "EndDo;"], ["While True Do", "A();", "If B Then", "Break;", "EndIf;", "EndDo;"]),
    ("BSL071", ["Procedure A()", "B = 7;", "EndProcedure"], ["Procedure A()", "B = 2;", "EndProcedure"]), ("BSL072", ["While A Do", 'B = B + "x";', "EndDo;"], ["While A Do", 'B = C + "x";', "EndDo;"]),
    ("BSL073", ["If A Then", "ElsIf C Then", "EndIf;"], ["If A Then", "EndIf;"]), ("BSL074", ["// FIXME: x"], ["// fixed"]), ("BSL076", ["If Not A Then"], ["If A Then"]), ("BSL078", ["Raise;"], ['Raise "x";']), ("BSL079", ["Goto ~A;"], ["A();"]),
    ("BSL080", ["Try", "A();", "Except", "B();", "EndTry;"], ["Try", "A();", "Except", "B();", "C = ErrorDescription();", "EndTry;"]), ("BSL081", ["A.B().C().D().E().F().G();"], ["A.B().C();"]),
    ("BSL083", [f"Var v{i};" for i in range(12)], ["Var a;", "Var b;"]), ("BSL084", ["Function A()", "Return;", "EndFunction"], ["Function A()", "Return 1;", "EndFunction"]), ("BSL085", ["If False Then"], ["If B Then"]),
    ("BSL086", ["While A Do", "B = New HTTPConnection(C);", "EndDo;"], ["B = New HTTPConnection(C);"]), ("BSL087", ["While A Do", "B = New Query;", "EndDo;"], ["While A Do", "B = New Structure;", "EndDo;"]),
    ("BSL089", ["While A Do", "BeginTransaction();", "EndDo;"], ["BeginTransaction();"]), ("BSL090", ['A = "Server=x;Pwd=y";'], ['A = "Server=x";']), ("BSL092", ["If A Then", "B();", "Else", "EndIf;"], ["If A Then", "B();", "Else", "C();", "EndIf;"]),
    ("BSL094", ["A += 0;"], ["A += 1;"]), ("BSL096", ["Function A() Export", "EndFunction"], ["// Words.", "Function A() Export", "EndFunction"]), ("BSL097", ["A = CurrentDate();"], ["A = CurrentUniversalDate();"]), ("BSL098", ["Выполнить(А);"], ["Б.Выполнить();"]),
    ("BSL099", ["Procedure A(a, b, c, d, e, f, g, h)", "EndProcedure"], ["Procedure A(a, b, c, d, e, f, g)", "EndProcedure"]), ("BSL100", ['A = "/home/x";'], ['A = "x/home";']), ("BSL101", ["If A Then"] * 7, ["If A Then"] * 2),
    ("BSL102", ["A();"] * 501, ["A();"] * 500), ("BSL103", ["A = Eval(B);"], ["A = Evaluation;"]), ("BSL104", ["A();"], ["// Words.", "A();"]), ("BSL105", ["Sleep(1);"], ["A.Sleep(1);"]), ("BSL106", ["While A Do", "B = New Query;", "EndDo;"], ["B = New Query;"]),
    ("BSL107", ["If A Then", "EndIf;"], ["If A Then", "B();", "EndIf;"]), ("BSL108", ["Перем А Экспорт;"], ["Перем А;"]), ("BSL109", ["If Not A Then", "Return;", "EndIf;"], ["If A Then", "Return;", "EndIf;"]), ("BSL110", ["While A Do", 'B = "x" + C;', "EndDo;"], ["While A Do", "B = C;", "EndDo;"]),
    ("BSL112", ["Procedure A()", "BeginTransaction();", "EndProcedure"], ["Procedure A()", "BeginTransaction();", "CommitTransaction();", "EndProcedure"]), ("BSL114", ["// only words"], ["A();"]), ("BSL115", ["If Not Not A Then"], ["If Not A Then"]),
    ("BSL116", ["For A = 1 To 5 Do"], ["For Each A In B Do"]), ("BSL118", ["Function A()", "B();", "EndFunction"], ["Function A()", "Return 1;", "EndFunction"]), ("BSL119", ["x" * 121], ["x" * 120]), ("BSL123", ["// A = B;"], ["// words of prose"]),
    ("BSL124", ["Procedure Ab()", "EndProcedure"], ["Procedure Abc()", "EndProcedure"]), ("BSL126", ["Continue;"], ["While A Do", "Continue;", "EndDo;"]), ("BSL127", ["Function A()", "Return 1;", "Return 2;", "EndFunction"], ["Function A()", "Return 1;", "EndFunction"]),
    ("BSL128", ["Procedure A()", "Return;", "B();", "EndProcedure"], ["Procedure A()", "If C Then", "Return;", "EndIf;", "B();", "EndProcedure"]), ("BSL130", ["// " + "x" * 120], ["// x"]), ("BSL131", ["#Region A", "#EndRegion"], ["#Region A", "B();", "#EndRegion"]),
    ("BSL134", ["Procedure A()", *["If B Then", "EndIf;"] * 10, "EndProcedure"], ["Procedure A()", *["If B Then", "EndIf;"] * 9, "EndProcedure"]), ("BSL135", ["A(B(1));"], ["A(1);"]), ("BSL136", ["A();// x"], ["A(); // x"]), ("BSL137", ["A.FindByDescription(B);"], ["A.FindByCode(B);"]),
    ("BSL138", ["Message(A);"], ["A.Message(B);"]), ("BSL139", [f"Procedure A({'x' * 31})", "EndProcedure"], [f"Procedure A({'x' * 30})", "EndProcedure"]), ("BSL140", ["If A Then", "Else", "B();", "ElsIf C Then", "EndIf;"], ["If A Then", "ElsIf C Then", "B();", "Else", "EndIf;"]),
    ("BSL141", ["Function A()", "If B Then", "Return True;", "EndIf;", "Return False;", "EndFunction"], ["Function A()", "Return True;", "EndFunction"]), ("BSL142", [f"Procedure A(a = {'9' * 51})", "EndProcedure"], ["Procedure A(a = 9)", "EndProcedure"]),
    ("BSL143", ["If A Then", "ElsIf B Then", "ElsIf a Then", "EndIf;"], ["If A Then", "ElsIf B Then", "EndIf;", "If A Then", "EndIf;"]), ("BSL144", ["Return (A);"], ["Return (New Structure);"]), ("BSL145", ['A = "x" + B + "y";'], ['A = "x" + B;']),
    ("BSL146", ["Procedure A()", "B();", "EndProcedure", "", "C();"], ["Procedure A()", "B();", "EndProcedure"]), ("BSL147", ["OpenForm(A);"], ["A.OpenForm(B);"]), ("BSL151", ["BeginTransaction();", "A();"], ["BeginTransaction();", "", "Try"]), ("BSL153", ["if A Then"], ["If A Then"]),
    ("BSL157", ["CommitTransaction();"], ["Try", "CommitTransaction();", "Except", "EndTry;"]), ("BSL173", ["For Each A In B Do", "B.Delete(A);", "EndDo;"], ["B.Delete(A);"]), ("BSL183", ["Execute(A);"], ["A.Execute();"]), ("BSL186", ["A(1,);"], ["A(1, 2);"]),
    ("BSL190", ["A = FormDataToValue(B);"], ['A = "FormDataToValue";']), ("BSL198", ["If A Then", "ElsIf A Then", "EndIf;"], ["If A Then", "ElsIf B Then", "EndIf;"]), ("BSL199", ["If A Then", "B();", "ElsIf C Then", "D();", "EndIf;"], ["If A Then", "B();", "EndIf;"]),
    ("BSL208", ["Перемeнная = 1;"], ["Переменная = 1;"]), ("BSL216", ["A=1;"], ["A = 1;"]), ("BSL219", ["Var A Export;"], ["// Words.", "Var A Export;"]), ("BSL227", ["A(); B();"], ["A();"]), ("BSL230", ["Procedure A()", "CommitTransaction();", "EndProcedure"], ["Procedure A()", "B();", "EndProcedure"]),
    ("BSL255", ["Try", "A();", "B = Number(C);", "Except", "EndTry;"], ["Try", "A();", "Except", "B = Number(C);", "EndTry;"]), ("BSL257", ['A = "x" + + B;'], ['A = "x" + B;']), ("BSL258", ['A = "UNION SELECT";'], ['A = "UNION ALL SELECT";']),
    ("BSL063", ["A();"] * 1001, ["A();"] * 1000), ("BSL017", None, ["Procedure A() Export", "EndProcedure"]), ("BSL019", ["Procedure A()", *["While B Do", "EndDo;"] * 10, "EndProcedure"], ["Procedure A()", "EndProcedure"]),
    ("BSL011", ["Procedure A()", *["If B Then"] * 6, *["EndIf;"] * 6, "EndProcedure"], ["Procedure A()", "If B Then", "EndIf;", "EndProcedure"]), ("BSL002", ["Procedure A()", *["B();"] * 200, "EndProcedure"], ["Procedure A()", "EndProcedure", *["// words"] * 300]),
]


def test_rule_pairs(spark):
    cases = [(rule, lines, fires) for rule, *both in PAIRS for lines, fires in zip(both, (True, False)) if lines]
    rows = [(f"{i:03}", n + 1, text) for i, (_, lines, _) in enumerate(cases) for n, text in enumerate(lines)]
    frame = spark.createDataFrame(rows, "file_path string, line int, text string")
    hits = {(r[0], r[1]) for r in rules.diagnostics(frame, {r[0] for r in rules.ALL_RULES}).select("file_path", "code").distinct().collect()}
    assert [c for i, c in enumerate(cases) if ((f"{i:03}", c[0]) in hits) != c[2]] == []


def test_blocks_end_where_they_end(spark):
    text = ["Procedure A()", "While True Do", "While B Do", "Break;", "EndDo;", "EndDo;", "EndProcedure", "C();", "Procedure D()", "EndProcedure"]
    facts = rules.line_facts(spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(text)], "file_path string, line int, text string")).orderBy("line").collect()
    assert [r["scope"] for r in facts] == [1] * 7 + [0, 2, 2]
    assert [r["loop_break"] for r in facts][1:3] == [0, 1]



def test_suppression_and_choice(spark):
    texts = ["Сообщить(1);  // noqa", "Сообщить(2);  // noqa: BSL138", "Сообщить(3);  // noqa: BSL009", "// BSLLS:UseOfDebugOutput-off", "Сообщить(4);", "// BSLLS:UseOfDebugOutput-on", "Сообщить(5);", "// BSLLS:Unknown-off", "Сообщить(6);", "Сообщить(7); // BSLLS-выкл", "Сообщить(8);"]
    lines = spark.createDataFrame([("a", i + 1, t) for i, t in enumerate(texts)], "file_path string, line int, text string")
    found = rules.diagnostics(lines, {"BSL138"})
    kept = reporting.block_suppressed(reporting.inline_suppressed(found, lines), lines)
    assert sorted(r["line"] for r in kept.collect()) == [3, 7, 9, 11]
    assert reporting.codes_of(["useofdebugoutput", "bsl009", "nothing"]) == {"BSL138", "BSL009"}
    assert reporting.choose(found, ignore=["UseOfDebugOutput"]).count() == 0


def test_unused_and_callers(spark):
    symbols = spark.createDataFrame([("A", "a", "f", 1, "procedure", 0), ("B", "b", "f", 5, "function", 0), ("C", "c", "g", 1, "procedure", 1), ("D", "d", "g", 9, "procedure", 0)], "name string, name_lower string, file_path string, line int, kind string, is_export int")
    calls = spark.createDataFrame([("f", 2, "A", "B", "b", 1), ("f", 6, "B", "B", "b", 1), ("g", 10, "D", "D", "d", 0), ("g", 3, None, "A", "a", 0)], "caller_file string, caller_line int, caller_name string, callee_name string, callee_name_lower string, callee_args_count int")
    assert [r["name"] for r in index.unused_symbols(symbols, calls).collect()] == ["D"]
    assert index.callers_count_non_recursive(calls, "b").first()[0] == 1
    closure = graph.caller_closure(calls, spark.createDataFrame([("b",)], "root string"), 3)
    assert {(r["node"], r["depth"]) for r in closure.collect()} == {("a", 1)}
    tree = graph.caller_tree(calls, "B", 2)
    assert {c["name"] for c in tree["callers"]} == {"A", "B"}
    empty = symbols.limit(0)
    assert index.unused_symbols(empty, calls.limit(0)).count() == 0


def test_text_functions(spark):
    row = spark.range(1).select(fold(F.lit("STRAßE")).alias("f"), utf16_length(F.lit("a😀")).alias("u"), rename_in(F.lit("Foo(foo.FooBar)"), "foo", "Bar").alias("r")).first()
    assert (row["f"], row["u"], row["r"]) == ("strasse", 3, "Bar(Bar.FooBar)")
    with pytest.raises(ValueError):
        rename_in(F.lit(""), "a", "1x")


def test_formatting():
    text = "процедура А()\nесли Б=1 тогда\n//x\nВ = \"а=б\";\n\n\nКОНЕЦЕСЛИ;\nконецпроцедуры"
    assert formatting.format_module(text) == 'Процедура А()\n\tЕсли Б = 1 Тогда\n\t\t// x\n\t\tВ = "а=б";\n\n\tКонецЕсли;\nКонецПроцедуры\n'
    assert formatting.format_module(formatting.format_module(text)) == formatting.format_module(text)
    fixed, done = formatting.fix_module("A = A;\nReturn;\nEndProcedure\n\n\n\nB")
    assert fixed == "EndProcedure\n\nB" and done == {"BSL009": 1, "BSL010": 1, "BSL055": 2}


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.bsl").write_bytes(b"\xef\xbb\xbfA = 1;\r\nB = 2;\r\n")
    (tmp_path / "src/b.OS").write_bytes(b"\xff")
    (tmp_path / "src/c.txt").write_text("no")
    modules = files.read_modules(spark, str(tmp_path))
    assert modules.count() == 2
    assert files.read_modules(spark, str(tmp_path), ["*.OS"]).count() == 1
    lines = files.lines_of(modules.where("path like '%a.bsl'"))
    assert [(r["line"], r["text"]) for r in lines.orderBy("line").collect()] == [(1, "A = 1;"), (2, "B = 2;")]
    old = spark.createDataFrame([("x", "1"), ("y", "1")], "path string, text string")
    new = spark.createDataFrame([("y", "2"), ("z", "1")], "path string, text string")
    assert {tuple(r) for r in files.snapshot_changes(old, new).collect()} == {("x", "removed"), ("y", "changed"), ("z", "added")}
    assert files.git_changes(str(tmp_path), "HEAD~1") is None


def test_metadata_xml(spark, tmp_path):
    (tmp_path / "Catalogs").mkdir()
    (tmp_path / "Catalogs/Goods.xml").write_text('<MetaDataObject xmlns="u" xmlns:v8="w"><Catalog><Properties><Name>Goods</Name><Synonym><v8:item><v8:lang>ru</v8:lang><v8:content>Товары</v8:content></v8:item></Synonym></Properties><ChildObjects><Attribute><Properties><Name>Price</Name></Properties></Attribute></ChildObjects></Catalog></MetaDataObject>')
    objects, members = files.read_metadata(spark, str(tmp_path))
    assert [tuple(r)[:3] for r in objects.collect()] == [("Goods", "Catalog", "Товары")]
    assert [tuple(r) for r in members.collect()] == [("Goods", "attribute", "Price")]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:01"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:00:00")]
    batch = spark.createDataFrame(rows, "path string, ts string").withColumn("ts", F.to_timestamp("ts"))
    batch.write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    out = changes.debounced(stream, "path", "ts", "2 seconds").writeStream.outputMode("complete").format("memory").queryName("debounced").start()
    out.processAllAvailable()
    out.stop()
    got = sorted((r["path"], r["n"]) for r in spark.table("debounced").collect())
    twin = sorted((r["path"], r["n"]) for r in changes.debounced_batch(batch, "path", "ts", 2).collect())
    assert got == twin == [("a", 1), ("a", 2), ("b", 1)]
