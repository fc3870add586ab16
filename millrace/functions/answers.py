"""The final answer of a free-form solution, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.strings import first_line, first_match, found, last_match, let, strip

# Patterns of answers.
MARKER = r"(?U)####\s*(-?[0-9][0-9,.]*)"
PHRASE = r"(?isU)^.*answer\s*(?:is|:|=|are)?\s*"
EQUATION_END = r"(?U)=\s*([^=\n]+?)\s*\.?\s*\z"
NUMBER = r"(?U)-?\d[\d,]*(?:\.\d+)?%?"
BOXES = (r"\boxed", r"\fbox")

#: Depth of braces that one regular expression covers; deeper ones are scanned character by character.
REGEX_DEPTH = 6


def _balanced(depth: int) -> str:
    inner = r"[^{}]*+"
    for _ in range(depth):
        inner = r"[^{}]*+(?:\{" + inner + r"\}[^{}]*+)*+"
    return inner


def _scan(rest: Column) -> Column:
    """Text before the brace that closes the one already open at the start of rest, or null: a fold over the characters."""
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(state: Column, char: Column) -> Column:
        depth = state["depth"] + F.when(char == "{", 1).when(char == "}", -1).otherwise(0)
        at = state["at"] + 1
        end = F.when(state["end"] > 0, state["end"]).when(depth == 0, at).otherwise(0)
        return F.struct(depth.alias("depth"), at.alias("at"), end.alias("end"))

    end = F.aggregate(F.split(rest, ""), start, step)["end"]
    return F.when(end > 0, F.substring(rest, F.lit(1), end - 1))


def inside_box(inside: Column) -> Column:
    """Text before the brace that closes the one just before `inside`; null if none does."""
    quick = F.regexp_extract(inside, "^(" + _balanced(REGEX_DEPTH) + r")\}", 0)
    return let(quick, lambda q: F.when(q != "", F.substring(q, F.lit(1), F.length(q) - 1)).otherwise(_scan(inside)))


def _closed(inside: Column) -> Column:
    return strip(inside_box(inside))


def _box(text: Column, marker: str) -> Column:
    rest = F.substring_index(text, marker, -1)
    content = let(rest, lambda r: F.when(F.instr(r, "{") > 0, let(F.substring(r, F.instr(r, "{") + 1, F.length(r)), _closed)))
    return F.when(F.instr(text, marker) > 0, content)


def last_boxed(text: Column) -> Column:
    r"""Content of the last \boxed{...}, else of the last \fbox{...}, with balanced braces; null if neither closes."""
    return F.coalesce(*[_box(text, marker) for marker in BOXES])


def marker_answer(text: Column) -> Column:
    """The number after the first ####, with its commas and dots."""
    return found(text, MARKER, 1)


def phrase_answer(text: Column) -> Column:
    """What follows the last "answer is": a box, else the first number, else the first line; null if nothing follows."""

    def read(tail: Column) -> Column:
        line = F.rtrim(strip(first_line(tail)), F.lit("."))
        return F.when(tail != "", F.coalesce(last_boxed(tail), first_match(tail, NUMBER), line))

    return F.when(F.regexp_like(text, F.lit("(?i)answer")), let(strip(F.regexp_replace(text, PHRASE, "")), read))


def trailing_equation(text: Column) -> Column:
    """X of a last line that ends in "= X"."""
    return strip(found(strip(text), EQUATION_END, 1))


def last_number(text: Column) -> Column:
    return last_match(text, NUMBER)


def extract_answer(text: Column) -> Column:
    """The first of: box, marker, phrase, trailing equation, last number; null if there is none."""
    return F.coalesce(last_boxed(text), marker_answer(text), phrase_answer(text), trailing_equation(text), last_number(text))


def gsm_final(answer: Column) -> Column:
    """The number after the first ####, without commas."""
    return F.replace(marker_answer(answer), F.lit(","), F.lit(""))


def gsm_steps(answer: Column) -> Column:
    """A worked solution without its markers and <<...>> calculator tags."""
    return strip(F.regexp_replace(F.regexp_replace(answer, MARKER, ""), "<<[^>]*>>", ""))
