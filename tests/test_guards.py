"""Guards of rule tests, and how rules over blocks and kept lines are computed."""

from codeprism.operators import rules as R

TEXT = """Procedure A(P1, Val P2 = "a,b") Export
    Var X;
    ıf P1 = True Then
        meſſage("x");
    ElsIf P1
        Or P2 Then
        B();
    ElsIf P1
        Or X Then
        C();
    EndIf;
    While True Do
        Q = Query.Execute(); // TODO: İt
        BREAK;
    EndDo;
    Try
        Number(1);
    Except
        Info = ErrorInfo();
    EndTry;
    Query.Text = "SELECT A
    |FROM T";
    Прервать; Иначе_ = 1;
EndProcedure""".split("\n")


def modules(spark):
    return spark.createDataFrame([(f, i + 1, t) for f, ts in (("a", TEXT), ("b", TEXT[7:] + TEXT[:9])) for i, t in enumerate(ts)], "file_path string, line int, text string")


def test_guarded_rules_find_what_plain_tests_find(spark):
    facts = R.line_facts(modules(spark))
    plain = R._fused(facts, R.LINE_RULES, None, "file_path", "line")
    assert sorted(map(tuple, R.line_diagnostics(facts).collect())) == sorted(map(tuple, plain.collect()))


def test_every_match_holds_a_needed_literal():
    assert R.needed(R.starts("If|Если")) == {"If", "Если"}
    assert R.needed(r"^[#&]|^(?:Var)(?:$|\s)") == set()
    assert R.needed(r"(?:Each\s+)?In\s") == {"In"}


def test_block_windows_carry_no_text(spark):
    plan = R.line_diagnostics(R.line_facts(modules(spark)))._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("if_elsif") :].split("\n")
    thin = next(x for x in below if "Project [file_path" in x and "hits" in x)
    assert " text#" not in thin and " code#" not in thin


def test_calls_meet_definitions_by_buckets_of_lines(spark):
    from codeprism.operators.graph import callees_in_definitions

    spans = [("a", "one", 1, 21), ("a", "two", 60, 130), ("a", "none", 9, 8), ("b", "far", 1, 500), ("b", "left", -70, 2)]
    symbols = spark.createDataFrame(spans, "file_path string, name string, line int, end_line int")
    places = [(f, n) for f in "abc" for n in (-1, 0, 1, 21, 22, 60, 63, 64, 127, 128, 130, 131, 500, 501)]
    calls = spark.createDataFrame(places, "caller_file string, caller_line int")
    found = callees_in_definitions(symbols, calls)
    assert sorted(map(tuple, found.select("caller_file", "caller_line", "definition").collect())) == sorted((f, n, s[1]) for f, n in places for s in spans if s[0] == f and s[2] <= n <= s[3])
    join = next(x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in x)
    assert "bucket" in join


#: Conditions over several lines, nested and unended blocks, branches without a block, a file that begins within one.
BLOCKS = """ElsIf X
Or Y Then
If A
Or B Then
    If C Then
    ElsIf C Then
        For I = 1 To 2 Do
            Break;
        EndDo;
    EndIf;
    X = 1;
ElsIf D
Or E Then
ElsIf D Then
Else
    While True Do
        If C Then
            Break;
        EndIf;
    EndDo;
ElsIf D
    Or F Then
EndIf;
If A
ElsIf B
EndIf;
Try
    A();
    Try
    Except
        Raise;
    EndTry;
    Number(1);
Except
    B();
EndTry;
While True Do
EndDo;
If A Then
EndIf;
ElsIf A
Then""".split("\n")


def test_lines_that_tell_of_blocks_give_the_same_as_all_lines(spark):
    kinds = [BLOCKS, BLOCKS[1:], BLOCKS[12:] + BLOCKS[:20], [x for b in BLOCKS for x in (b, "")], BLOCKS[::-1]]
    lines = spark.createDataFrame([(str(f), i + 1, t) for f, ts in enumerate(kinds) for i, t in enumerate(ts)], "file_path string, line int, text string")
    facts = R.line_facts(lines)
    plain = sorted(map(tuple, R._fused(facts, R.LINE_RULES, None, "file_path", "line").collect()))
    assert sorted(map(tuple, R.line_diagnostics(facts).collect())) == plain
    assert {"BSL046", "BSL069", "BSL080", "BSL140", "BSL143", "BSL255"} <= {d[2] for d in plain}


def test_windows_over_blocks_see_only_lines_that_tell_of_them(spark):
    lines = [("a", i + 1, t) for i, t in enumerate(["X = 1;"] * 50 + BLOCKS)]
    marked = R._marked(R.line_facts(spark.createDataFrame(lines, "file_path string, line int, text string")), None)
    assert marked.where("of_block").count() < 50


def test_next_code_line_needs_no_sort_from_the_end(spark):
    plan = R.line_facts(modules(spark)).select("file_path", "line", "n1")._jdf.queryExecution().executedPlan().toString()
    assert "DESC" not in plan
    want, rows = [], {(r.file_path, r.line): r for r in R.line_facts(modules(spark)).collect()}
    for (f, n), r in rows.items():
        after = [rows[f, m].c for m in range(n + 1, len(rows) + 1) if (f, m) in rows and rows[f, m].c]
        want.append((f, n, after[0] if after else ""))
    assert sorted((f, n, r.n1) for (f, n), r in rows.items()) == sorted(want)


def test_marked_lines_are_computed_once(spark):
    """What all passes over a module's diagnostics read is a stored table; the lines themselves are not planned again."""
    plan = R.diagnostics(modules(spark))._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" not in plan and "ExistingRDD" not in plan and "parquet" in plan


def test_headers_over_lines_look_at_no_other_lines(spark):
    text = ["Procedure A(P1,", "    Val P2 = \"a,b\"", ") Export", "X = (1;", "EndProcedure", "Function B()", "Y(", "EndFunction", "Procedure C(P3", "If P3 Then", "EndIf;", "EndProcedure"]
    facts = R.line_facts(spark.createDataFrame([("a", i + 1, t) for i, t in enumerate(text)], "file_path string, line int, text string"))
    assert [r.unclosed for r in facts.orderBy("line").collect()] == [1] * 5 + [0] * 3 + [1] * 4
    assert sorted((r.proc_line, r.name, r.default_value) for r in R.parameters(facts).collect()) == [(1, "P1", None), (1, "P2", '"a,b"')]


def test_conditions_stand_outside_of_lambdas():
    hits = R._hits(R._codes(R.LINE_RULES, {"BSL009", "BSL014"}))
    assert "CASE WHEN" in hits and all("CASE" not in tail for tail in hits.split("->")[1:]) and hits.index("CASE") < hits.index("->") and "array(CASE" not in hits
