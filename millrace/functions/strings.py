"""String columns with the semantics of Python's str methods."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that Python counts as white space.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
#: Line ends of str.splitlines.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE))


def lit_replace(text: Column, old: str, new: str = "") -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match's group, or null without a match (regexp_extract gives '')."""
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, group))


def last_match(text: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(-1))


def first_match(text: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(1))


def first_line(text: Column) -> Column:
    return F.split(text, LINE_ENDS, 2)[0]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
