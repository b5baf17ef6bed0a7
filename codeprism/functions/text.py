"""Text functions as Column expressions: folding, masking, positions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A string literal of one line, and one that may run on; loops are over classes, so long literals need no deep stack.
STRING = '"[^"]*(?:""[^"]*)*"'
OPEN_STRING = '"[^"]*(?:""[^"]*)*(?:"|$)'


def fold(c: Column) -> Column:
    """Case-folded text; sharp s counts as ss."""
    return F.lower(F.replace(c, F.lit("ß"), F.lit("ss")))


def masked(c: Column) -> Column:
    """A line with its string literals emptied."""
    return F.regexp_replace(c, STRING, '""')


def code(c: Column) -> Column:
    """A line without literals' content and comment."""
    return F.regexp_replace(masked(c), "//.*$", "")


def comment(c: Column) -> Column:
    """The comment of a line, from its slashes on (empty: none)."""
    return F.regexp_extract(masked(c), "//.*$", 0)


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("int")


def bounded(words: str) -> str:
    """A pattern (Java and RE2) for ``words`` standing alone; letters are Unicode."""
    return rf"(?:^|[^\p{{L}}\p{{N}}_.])(?:{words})(?:$|[^\p{{L}}\p{{N}}_])"


def rename_in(c: Column, old: str, new: str) -> Column:
    """``c`` with the whole word ``old`` (any case) replaced."""
    if not re.match(r"^[^\W\d]\w*$", new):
        raise ValueError(f"not an identifier: {new!r}")
    return F.regexp_replace(c, rf"(?iu)(?<![\p{{L}}\p{{N}}_]){re.escape(old)}(?![\p{{L}}\p{{N}}_])", new)
