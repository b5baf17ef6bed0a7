"""Work that once grew more than the input asks for."""

from codeprism.operators import formatting, structure


def test_joined_blocks_are_not_shuffled_again_for_nesting(spark):
    found = spark.createDataFrame([("f", "method", 1, 200, 1), ("f", "if", 60, 70, 1), ("f", "loop", 64, 66, 1)], "file_path string, kind string, start_line int, end_line int, depth long")
    lines = spark.createDataFrame([("f", i) for i in (1, 63, 64, 65, 128, 201)], "file_path string, line int")
    out = structure.enclosing(found, lines)
    plan = out._jdf.queryExecution().executedPlan().toString()
    shuffles = [x.split("]")[0] for x in plan.split("hashpartitioning(")[1:]]
    assert len(shuffles) == 2 and not any("line#" in x for x in shuffles)
    got = {(r["line"], r["nesting"]): r["kind"] for r in out.collect()}
    assert got == {(1, 1): "method", (63, 1): "if", (63, 2): "method", (64, 1): "loop", (64, 2): "if", (64, 3): "method", (65, 1): "loop", (65, 2): "if", (65, 3): "method", (128, 1): "method"}


def test_lines_and_marks_are_computed_once(spark):
    facts = spark.createDataFrame([("f", 1, "If A Then"), ("f", 2, "B();"), ("f", 3, "EndIf;")], "file_path string, line int, c string")
    out = structure.enclosing_all(facts)
    assert "marks" in out._jdf.queryExecution().analyzed().toString() and "LogicalRDD" not in out._jdf.queryExecution().analyzed().toString()
    assert sorted((r["line"], r["kind"], r["nesting"]) for r in out.collect()) == [(1, "if", 1), (2, "if", 1), (3, "if", 1)]


def test_equal_lines_are_formatted_once():
    formatting._format_line.cache_clear()
    assert formatting.format_module("if a=1 then\n" * 3 + "endif;\n" * 3) == "If a = 1 Then\n\tIf a = 1 Then\n\t\tIf a = 1 Then\n\t\tEndIf;\n\tEndIf;\nEndIf;\n"
    assert formatting._format_line.cache_info().misses == 3  # with the empty line behind the last
