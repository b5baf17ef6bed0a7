"""Layout of modules: examples, and that formatting twice changes nothing."""

import random

from codeprism.operators import layout

BEFORE = '''

процедура Тест( А ,знач Б="x ,y",
В=1 ) экспорт
//слова
если А=1 и ( Б<>"если" ) тогда Вызов( А,Б );
конецесли;
если А тогда Б(); конецесли;


Итог=А+
Б(1,"a""b" , , 2);  //хвост "x"
Текст = "ВЫБРАТЬ
  |  Поле , Другое
|ИЗ Т
без черты";
Объект
.Метод( , , х)
.Если(1);
пока Истина цикл  А = А + 1;
конеццикла;
попытка
А();
исключение
конецпопытки;
#Область Имя
&НаКлиенте
конецпроцедуры

'''
AFTER = '''Процедура Тест(А, Знач Б = "x ,y",
		В = 1) Экспорт
	// слова
	Если А = 1 и (Б <> "если") Тогда
		Вызов(А, Б);
	КонецЕсли;
	Если А Тогда Б(); КонецЕсли;

	Итог = А+
		Б(1, "a""b", , 2); // хвост "x"
	Текст = "ВЫБРАТЬ
		|  Поле , Другое
		|ИЗ Т
без черты";
	Объект
		.Метод( , , х)
		.Если(1);
	Пока Истина Цикл
		А = А + 1;
	КонецЦикла;
	Попытка
		А();
	Исключение
	КонецПопытки;
	#Область Имя
	&НаКлиенте
КонецПроцедуры'''


def frame(spark, *modules):
    return spark.createDataFrame([(f"f{k}", i + 1, t) for k, m in enumerate(modules) for i, t in enumerate(m.split("\n"))], "file_path string, line int, text string")


def text_of(laid, name="f0"):
    return "\n".join(r["text"] for r in laid.where(f"file_path = '{name}'").orderBy("line", "part").collect())


def test_example(spark):
    laid = layout.formatted(frame(spark, BEFORE))
    assert text_of(laid).split("\n") == AFTER.split("\n")
    assert text_of(layout.formatted(frame(spark, BEFORE), "    ")) == AFTER.replace("\t", "    ")


def test_twice_changes_nothing(spark):
    random.seed(3)
    pool = BEFORE.split("\n") + ["", "Procedure A(B,", "C) Export", "EndProcedure", "x=F( (1) ,2 )  ;// c", "|a , b", 'y = "un', "Иначе", "Else", ".B()"]
    modules = ["\n".join(random.choice(pool) for _ in range(random.randint(0, 40))) for _ in range(60)]
    once = layout.renumbered(layout.formatted(frame(spark, *modules)))
    again = layout.renumbered(layout.formatted(once))
    key = lambda df: sorted((r["file_path"], r["line"], r["text"]) for r in df.collect())
    a, b = key(once), key(again)
    assert [x for x, y in zip(a, b) if x != y] == [] and len(a) == len(b)


def test_literals_and_comments_are_kept(spark):
    lines = ['A = "  x  =1,2 "+"//no";   // "kept  =1"', 'B = ""; C = """";']
    assert text_of(layout.formatted(frame(spark, "\n".join(lines)))) == 'A = "  x  =1,2 "+"//no"; // "kept  =1"\nB = ""; C = """";'


def test_range(spark):
    ranges = spark.createDataFrame([("f0", 6, 7)], "file_path string, first int, last int")
    assert text_of(layout.formatted_range(frame(spark, BEFORE), ranges)) == "\tЕсли А = 1 и (Б <> \"если\") Тогда\n\t\tВызов(А, Б);\n\tКонецЕсли;"


def test_no_frame_runs_to_the_end_of_a_module(spark):
    """A frame from a line to the end of its file is summed anew for every line: seconds grow with the square of a module."""
    lines = spark.createDataFrame([("m", 1, "A = 1;"), ("m", 2, ""), ("m", 3, "B = 2;"), ("m", 4, ""), ("m", 5, " ")], "file_path string, line int, text string")
    laid = layout.formatted(lines)
    assert [(r.line, r.text) for r in laid.orderBy("line").collect()] == [(1, "A = 1;"), (2, ""), (3, "B = 2;")]
    assert "unboundedfollowing" not in laid._jdf.queryExecution().optimizedPlan().toString().replace("specifiedwindowframe(RowFrame, unboundedpreceding$(), unboundedfollowing$())", "").lower()


def test_layout_shuffles_lines_once_and_joins_nothing(spark):
    lines = spark.createDataFrame([("a", 1, "Procedure A(P1,"), ("a", 2, ""), ("a", 3, "P2)"), ("a", 4, "B = 1;")], "file_path string, line int, text string")
    laid = layout.formatted(lines)
    plan = laid._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and laid._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert [r["text"] for r in laid.orderBy("line").collect()] == ["Procedure A(P1,", "", "\t\tP2)", "\tB = 1;"]
