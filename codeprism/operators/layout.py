"""Layout of modules as a plan over lines: keyword case, spacing, split headers, indent by blocks and continuation.

A line is taken apart into code with emptied literals, its literals and its comment; code
is spaced and the literals are put back where they stood.  Depth comes from block words by
one window over (file, line, part); a line that does not begin a statement stands one step
deeper, and so do lines of a literal that goes on.  What a literal holds is never changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeprism.functions.text import OPEN_STRING
from codeprism.operators import rules as R
from codeprism.operators.formatting import CLOSES, KEYWORDS, MIDDLE, OPENS
from codeprism.operators.syntax import ENDS

#: A block's header with what follows it on the same line.
HEADER = "(?iu)" + rf"^((?:{R.IF}|{R.ELSIF}|{R.LOOP}){R.STOP}.*?[^\p{{L}}\p{{N}}_](?:{R.THEN}|{R.DO}))\s+(\S.*)$"
CLOSED = "(?iu)" + rf"(?:^|[^\p{{L}}\p{{N}}_.])(?:{R.END_IF}|{R.END_LOOP}|{R.END_TRY}){R.STOP}"
WORDS = rf"{R.ID}|[^\p{{L}}_]+"


def spaced(code: Column) -> Column:
    """Code with canonical keywords, a blank on either side of comparisons and assignments, one after commas and none inside brackets.

    Blanks between empty arguments stay as they are.
    """
    canon = F.create_map(*(F.lit(x) for k in KEYWORDS for x in (k.lower(), k)))
    member = lambda a, i: (i > 0) & F.get(a, i - 1).rlike(r"\.\s*$")
    words = F.regexp_extract_all(code, F.lit(WORDS), F.lit(0))
    named = F.array_join(F.transform(F.array(words), lambda a: F.array_join(F.transform(a, lambda w, i: F.when(member(a, i), w).otherwise(F.coalesce(F.try_element_at(canon, F.lower(w)), w))), "")), "")
    out = F.regexp_replace(named, r"\s*(<>|<=|>=|=|<|>)\s*", " $1 ")
    for pattern, new in ((r"(?<=[^\s,(])\s+,", ","), (r",\s*(?=[^\s,)])", ", "), (r"\(\s+(?=[^\s,)])", "("), (r"(?<=[^\s,(])\s+\)", ")")):
        out = F.regexp_replace(out, pattern, new)
    return F.btrim(F.when(code.rlike(r"^\s*[#&]"), code).otherwise(out), F.lit(" \t"))


def restored(code: Column, literals: Column) -> Column:
    """Code with its emptied literals replaced by ``literals``, in order."""
    return F.array_join(F.zip_with(F.split(code, '""', -1), literals, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")


def _past_headers(lines: DataFrame) -> DataFrame:
    """``lines`` (file_path, line, c, net, held, head, begins, ...) with after_header: whether the nearest line before that has code ends a method's header, as ``rules.headers`` has it.

    net counts a line's brackets and held tells lines that a header may hold.  Windows in the order that facts
    have tell it, so no line is shuffled or sorted again.
    """
    order = Window.partitionBy("file_path").orderBy("line")
    upto, prior = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda asked, c, frame: F.last(F.when(asked, c), ignorenulls=True).over(frame)
    known = lines.withColumns({"base": last(F.col("head") == 1, F.col("total") - F.col("net"), upto), "begun": last(F.col("head") == 1, F.col("line"), upto)})
    known = known.withColumn("closed", F.col("total") <= F.col("base"))
    known = known.withColumns({"ended": last(F.col("held") & F.col("closed") & (F.col("c") != ""), F.col("line"), prior), "broken": last(F.col("held") & (F.col("head") == 0) & F.col("begins"), F.col("line"), upto)})
    part = F.col("held") & (F.greatest(F.coalesce("ended", F.lit(-1)), F.coalesce("broken", F.lit(-1))) < F.col("begun"))
    known = known.withColumn("of_header", F.coalesce(part, F.lit(False))).drop("base", "begun", "ended", "broken", "total", "net")
    known = known.withColumn("near", last(F.col("c") != "", F.struct("line", "of_header", "closed"), prior))
    # Open brackets end a header only where the very next line is none of its lines.
    stops = (F.col("near.line") == F.col("line") - 1) & ~(F.col("of_header") & (F.col("head") == 0))
    return known.withColumn("after_header", F.coalesce(F.col("near.of_header") & (F.col("near.closed") | stops), F.lit(False)))


def formatted(lines: DataFrame, unit: str = "\t") -> DataFrame:
    """file_path, line, part and text of every line of the laid-out modules; a header's statement on the same line is part 1."""
    order = Window.partitionBy("file_path").orderBy("line")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    net = F.char_length(F.replace("code", F.lit(")"), F.lit(""))) - F.char_length(F.replace("code", F.lit("("), F.lit("")))
    settled = F.col("p1").rlike("(?iu)" + ENDS) | F.col("p1").rlike("^[#&~]") | (F.col("p1") == "")
    # Windows hold whole modules, so rows have the text and the literals only where they are needed behind them.
    narrow = R.line_facts(lines).select(
        "file_path", "line", "inside", "head", "c", "note", net.alias("net"), F.expr(R.OF_HEADER).alias("held"), F.col("c").rlike("(?iu)" + R.BEGINS).alias("begins"), settled.alias("settled"),
        F.when(F.col("inside") == 1, F.col("text")).alias("text"), F.when(F.contains("body", F.lit('"')), F.col("body")).alias("body"),
    )
    split = F.col("c").rlike(HEADER) & ~F.col("c").rlike(CLOSED) & (F.col("inside") == 0)
    is_open = lambda c: (F.col("inside") == 0) & c.rlike("(?iu)" + OPENS) & ~c.rlike(CLOSED)
    is_word = lambda c, words: (F.col("inside") == 0) & c.rlike("(?iu)" + words)
    count = lambda c: ((F.char_length(c) - F.char_length(F.replace(c, F.lit('""'), F.lit("")))) / 2).cast("int")
    # Two statements at most stand on a line, so what windows tell is told by line.
    halves = narrow.select("*", F.when(split, F.regexp_extract("c", HEADER, 1)).otherwise(F.col("c")).alias("first"), F.when(split, F.regexp_extract("c", HEADER, 2)).alias("second"))
    flags = {name + c: F.coalesce(told.cast("int"), F.lit(0)) for c in ("first", "second") for name, told in (("o_", is_open(F.col(c))), ("x_", is_word(F.col(c), CLOSES)), ("m_", is_word(F.col(c), MIDDLE)))}
    each = halves.select("*", *(c.alias(name) for name, c in flags.items())).select(
        *narrow.columns, F.col("second").isNotNull().alias("two"), (F.col("o_first") + F.col("o_second") - F.col("x_first") - F.col("x_second")).alias("step"),
        (F.col("x_first") + F.col("m_first")).alias("less"), (F.col("o_first") - F.col("x_first") - F.col("x_second") - F.col("m_second")).alias("then"), ((F.col("inside") == 0) & (F.col("c") == "") & (F.col("note") == "")).alias("blank"),
    )
    more = F.expr("lead(CASE WHEN NOT blank THEN 1 END) IGNORE NULLS OVER (PARTITION BY file_path ORDER BY line) IS NOT NULL")
    each = each.withColumns({"total": F.sum("net").over(upto), "running": F.sum("step").over(upto), "before": F.lag("blank").over(order), "more": more})
    each = _past_headers(each.where(~F.col("blank") | (F.col("more") & ~F.coalesce("before", F.lit(True)))).drop("blank", "before", "more"))
    note = F.regexp_replace("note", r"^//(?=[^\s/@&])", "// ")
    literals = F.when(F.col("body").isNotNull(), F.regexp_extract_all("body", F.lit(OPEN_STRING), F.lit(0))).otherwise(F.array().cast("array<string>"))
    each = each.select("file_path", "line", "text", "inside", (F.col("begins") | F.col("settled") | F.col("after_header")).alias("begins"), "c", "two", (F.col("running") - F.col("step")).alias("running"), "less", "then", note.alias("told"), literals.alias("literals"))
    head, tail = (F.regexp_extract("c", HEADER, i) for i in (1, 2))
    piece = lambda part, code, own, told, depth: F.struct(F.lit(part).alias("part"), code.alias("code"), own.alias("literals"), told.alias("told"), depth.alias("depth"))
    whole_line = F.array(piece(0, F.col("c"), F.col("literals"), F.col("told"), F.col("running") - F.col("less")))
    n, below = count(head), F.col("running") + F.col("then")
    both = F.array(piece(0, head, F.slice("literals", F.lit(1), n), F.lit(""), F.col("running") - F.col("less")), piece(1, tail, F.slice("literals", n + 1, F.size("literals")), F.col("told"), below))
    each = each.select("file_path", "line", "text", "inside", "begins", F.inline(F.when(F.col("two"), both).otherwise(whole_line)))
    deeper = F.when(F.col("inside") == 1, 1).when((F.col("code") == "") | F.col("code").rlike("^[#&]") | F.col("begins") | (F.col("part") == 1), 0).otherwise(1)
    code = restored(spaced(F.col("code")), F.col("literals"))
    whole = F.when(F.col("code") == "", F.col("told")).when(F.col("told") == "", code).otherwise(F.concat(code, F.lit(" "), "told"))
    goes_on = F.startswith(F.btrim("text", F.lit(" \t")), F.lit("|"))
    verbatim = (F.col("inside") == 1) & ~goes_on
    content = F.when(F.col("inside") == 1, F.when(goes_on, F.ltrim("text", F.lit(" \t"))).otherwise(F.col("text"))).otherwise(whole)
    indent = F.repeat(F.lit(unit), F.greatest(F.lit(0), F.col("depth") + deeper).cast("int"))
    return each.select("file_path", "line", "part", F.when(verbatim | (content == ""), content).otherwise(F.concat(indent, content)).alias("text"))


def formatted_range(lines: DataFrame, ranges: DataFrame, unit: str = "\t") -> DataFrame:
    """The laid-out lines of ``ranges`` (file_path, first, last), indented as in their whole modules."""
    return formatted(lines, unit).join(ranges, "file_path").where(F.col("line").between(F.col("first"), F.col("last"))).select("file_path", "line", "part", "text")


def renumbered(laid: DataFrame) -> DataFrame:
    """Laid-out lines as modules' lines again: file_path, line, text."""
    return laid.select("file_path", F.row_number().over(Window.partitionBy("file_path").orderBy("line", "part")).alias("line"), "text")
