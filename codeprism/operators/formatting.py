"""Formatting of modules: blank lines, structural indent, and safe fixes per file."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeprism.operators import rules as R

OPENS = R.starts("|".join([R.PROC, R.FUNC, R.IF, R.LOOP, R.TRY]))
CLOSES = R.starts("|".join([R.END_PROC, R.END_FUNC, R.END_IF, R.END_LOOP, R.END_TRY]))
MIDDLE = R.starts("|".join([R.ELSIF, R.ELSE, R.EXCEPT]))
#: Canonical spelling of keywords.
KEYWORDS = sorted({w for group in (R.PROC, R.FUNC, R.END_PROC, R.END_FUNC, R.IF, R.THEN, R.ELSIF, R.ELSE, R.END_IF, R.LOOP, R.DO, R.END_LOOP, R.TRY, R.EXCEPT, R.END_TRY, R.RETURN, R.RAISE, R.BREAK, R.CONTINUE, R.TRUE, R.FALSE, R.VAR, R.EXPORT, R.VAL) for w in group.split("|")})


def squeezed(lines: DataFrame) -> DataFrame:
    """Lines without a blank line after a blank one, and without blanks before the first text of a file."""
    w = Window.partitionBy("file_path").orderBy("line")
    blank = F.btrim("text", F.lit(" \t")) == ""
    marked = lines.select("file_path", "line", "text", blank.alias("blank"), F.lag(blank).over(w).alias("before"))
    return marked.where(~(F.col("blank") & F.coalesce("before", F.lit(True)))).select("file_path", "line", "text")


def indents(lines: DataFrame) -> DataFrame:
    """file_path, line and indent: the block depth by keywords alone; branch words stand at their block's level."""
    c = F.btrim(F.regexp_replace(F.regexp_replace("text", R.STRING, '""'), "//.*$", ""), F.lit(" \t"))
    flags = lines.select("file_path", "line", *[c.rlike("(?iu)" + p).cast("int").alias(n) for n, p in (("o", OPENS), ("x", CLOSES), ("m", MIDDLE))])
    w = Window.partitionBy("file_path").orderBy("line")
    depth = F.sum("o").over(w) - F.sum("x").over(w) - F.col("o") - F.col("m")
    return flags.select("file_path", "line", F.greatest(depth, F.lit(0)).alias("indent"))


def _python(pattern: str) -> str:
    return pattern.replace(r"[^\p{L}\p{N}_]", r"\W").replace(r"[\p{L}\p{N}_]", r"\w")


_CANON = {k.lower(): k for k in KEYWORDS}
_PARTS, _WORD, _SIGN, _NOTE = re.compile(r'("(?:[^"]|"")*"|//.*$)'), re.compile(r"[^\W\d]\w*"), re.compile(r"\s*(<>|<=|>=|=|<|>)\s*"), re.compile(r"^//(?=[^\s/@&])")
_LITERAL, _COMMENT = re.compile(R.STRING), re.compile(r"//.*$")
_STEPS = tuple(re.compile(_python(p), re.I) for p in (CLOSES, OPENS, MIDDLE))


@lru_cache(maxsize=1 << 16)  # modules repeat many lines
def _format_line(line: str) -> tuple[str, bool, bool, bool]:
    """A stripped line formatted but for its indent, and whether it closes, opens or divides a block."""
    parts = _PARTS.split(line)
    for i in range(0, len(parts), 2):
        part = _WORD.sub(lambda m: _CANON.get(m[0].lower(), m[0]), parts[i])
        parts[i] = _SIGN.sub(r" \1 ", part) if not part.lstrip().startswith(("#", "&")) else part
    for i in range(1, len(parts), 2):
        if parts[i].startswith("//"):
            parts[i] = _NOTE.sub("// ", parts[i])
    line = "".join(parts).strip()
    code = _COMMENT.sub("", _LITERAL.sub('""', line)).strip()
    return line, *(bool(p.search(code)) for p in _STEPS)


def format_module(text: str) -> str:
    """One module: keyword case, one blank around ``=`` and comparisons, indent by tabs, comments spaced, blank lines squeezed."""
    out, depth = [], 0
    for raw in re.split(r"\r\n|\r|\n", text.removeprefix("\ufeff")):
        line, closes, opens, middle = _format_line(raw.strip())
        depth = max(0, depth - closes)
        if line or (out and out[-1]):
            out.append("\t" * max(0, depth - middle) + line if line else "")
        depth += opens
    while out and not out[-1]:
        out.pop()
    return "\n".join(out) + "\n" if out else ""


def fix_module(text: str) -> tuple[str, dict[str, int]]:
    """Safe fixes bottom-up: self-assignments, useless returns, blank runs, double negation; counts by rule."""
    newline = "\r\n" if "\r\n" in text else "\n"
    lines, done = text.split(newline), {}
    for i in range(len(lines) - 1, -1, -1):
        code = lines[i].strip()
        same = re.fullmatch(r"([^\W\d]\w*)\s*=\s*([^\W\d]\w*)\s*;", code)
        after = lines[i + 1].strip() if i + 1 < len(lines) else ""
        if same and same[1].lower() == same[2].lower():
            rule, lines[i : i + 1] = "BSL009", []
        elif re.fullmatch(rf"(?i)(?:{R.RETURN})\s*;?", code) and re.match(rf"(?i)(?:{R.END_PROC})\b", after):
            rule, lines[i : i + 1] = "BSL010", []
        elif not code and i and not lines[i - 1].strip() and i + 1 < len(lines):
            rule, lines[i : i + 1] = "BSL055", []
        elif (plain := re.sub(rf"(?i)\b(?:{R.NOT})\s+(?:{R.NOT})\s+", "", lines[i])) != lines[i] and '"' not in lines[i]:
            rule, lines[i] = "BSL060", plain
        else:
            continue
        done[rule] = done.get(rule, 0) + 1
    return newline.join(lines), done


def format_modules(modules: DataFrame) -> DataFrame:
    """path, text (formatted), changed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            new = f["text"].fillna("").map(format_module)
            yield pd.DataFrame({"path": f["path"], "text": new, "changed": new != f["text"]})

    return modules.select("path", "text").mapInPandas(run, "path string, text string, changed boolean")


def fix_modules(modules: DataFrame) -> DataFrame:
    """path, text (fixed) and fixes by rule."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            both = [fix_module(t) for t in f["text"].fillna("")]
            yield pd.DataFrame({"path": f["path"], "text": [b[0] for b in both], "fixes": [b[1] for b in both]})

    return modules.select("path", "text").mapInPandas(run, "path string, text string, fixes map<string,long>")
