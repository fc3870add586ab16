"""Trimming and cutting of generated text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.answers import inside_box
from millrace.functions.strings import let, strip

# Marks of a leaked chat turn.
LEAKS = ("<|im_end|>", "<|im_start|>", "\nassistant", "\nuser", "\nsystem")
BOX = "\\boxed{"


def cut_leaks(text: Column) -> Column:
    """Text before the first mark of a leaked chat turn."""
    ends = [F.when(F.instr(text, mark) > 0, F.instr(text, mark) - 1) for mark in LEAKS]
    return F.substring(text, F.lit(1), F.coalesce(F.least(*ends), F.length(text)))


def cut_after_box(text: Column) -> Column:
    """Text up to the end of the line on which the first box begins."""
    box = F.instr(text, BOX)
    end = F.instr(F.substring(text, box, F.length(text)), "\n")
    return F.when((box > 0) & (end > 0), F.substring(text, F.lit(1), box + end - 2)).otherwise(text)


def clean_solution(text: Column) -> Column:
    """A completion cut at leaked turns and after its first boxed line, without trailing Chinese, replacement and white characters."""
    return strip(F.regexp_replace(cut_after_box(cut_leaks(text)), r"(?U)[\u4e00-\u9fff\u3000-\u303f\ufffd\s\x1c-\x1f]+\z", ""))


def chunks(text: Column, size: int) -> Column:
    """Pieces of `size` characters in order; none of an empty text."""
    if size < 1:
        raise ValueError("size must be positive")
    starts = F.sequence(F.lit(1), F.length(text), F.lit(size))
    return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def truncate_at_box(text: Column, balanced: bool = False) -> Column:
    """Text up to the first closing brace after the first box, where a generator that waits for it would stop; or to the brace that closes the box."""
    box = F.instr(text, BOX)
    if balanced:
        content = let(F.substring(text, box + len(BOX), F.length(text)), inside_box)
        return F.when(box > 0, let(content, lambda c: F.when(c.isNotNull(), F.substring(text, F.lit(1), box + len(BOX) + F.length(c))).otherwise(text))).otherwise(text)
    end = F.instr(F.substring(text, box + len(BOX), F.length(text)), "}")
    return F.when((box > 0) & (end > 0), F.substring(text, F.lit(1), box + len(BOX) + end - 1)).otherwise(text)
