"""Normal forms of answers and their comparison, as native column expressions but for symbolic ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.strings import let, lit_replace, strip

# Wrappers, tokens and units that a normal form lacks, in the order in which they are removed.
WRAPPERS = r"\\(?:text|mbox|mathrm|mathbf|operatorname)(?U:\s)*\{([^{}]*)\}"
TOKENS = (r"\left", r"\right", r"\!", r"\,", r"\;", r"\:", r"\quad", r"\qquad", r"\$", "$", r"\%", "%", r"^\circ", r"\circ", r"\degree")
UNITS = (
    "km/h m/s dollars? cents? kilometers? kilometres? meters? metres? miles? hours? minutes? seconds? days? years? degrees? units? percent points? "
    "apples? liters? litres? km cm mm kg g"
).split()
THOUSANDS = r"(?U)(?<=\d),(?=\d{3}\b)"
#: Tolerances of numeric equality.
RELATIVE, ABSOLUTE = 1e-4, 1e-6

_DECIMAL = r"(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][-+]?\d+(?:_\d+)*)?"
_FLOAT = rf"(?i)^[-+]?(?:{_DECIMAL}|inf|infinity|nan)$"


def thousands(text: Column) -> Column:
    """Text without commas between a digit and three more."""
    return F.regexp_replace(text, THOUSANDS, "")


def normalise(answer: Column) -> Column:
    """An answer without delimiters, spacing, wrappers, units and thousands commas; '' for null."""
    s = strip(F.coalesce(answer, F.lit("")))
    s = strip(F.regexp_replace(s, r"^\\\(|\\\)\z|^\\\[|\\\]\z", ""))
    s = strip(F.btrim(s, F.lit("$")))
    for _ in range(3):
        s = F.regexp_replace(s, WRAPPERS, "$1")
    s = lit_replace(lit_replace(s, r"\dfrac", r"\frac"), r"\tfrac", r"\frac")
    for token in TOKENS:
        s = lit_replace(s, token)
    s = thousands(F.regexp_replace(s, r"(?iU)\b(?:" + "|".join(UNITS) + r")\b", ""))
    return F.regexp_replace(strip(F.rtrim(strip(s), F.lit("."))), r"(?U)[\s\x1c-\x1f]+", " ")


def _plain(text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit(_FLOAT)), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def _part(text: Column) -> Column:
    """A rational number: decimal, or integer over positive integer."""
    return let(strip(text), _rational)


def _rational(t: Column) -> Column:
    over = F.try_divide(F.regexp_extract(t, r"^([-+]?\d+)", 1).try_cast("double"), F.regexp_extract(t, r"(\d+)$", 1).try_cast("double"))
    return F.when(F.regexp_like(t, F.lit(r"^[-+]?\d+\s*/\s*\d+$")), over).when(F.regexp_like(t, F.lit(rf"^[-+]?{_DECIMAL}$")), _plain(t))


def to_number(text: Column) -> Column:
    """A number as double: fraction macro, percentage, integer ratio or decimal; else null."""
    return let(strip(text), _number)


def _number(t: Column) -> Column:
    macro = r"^\\frac(?U:\s)*\{([^{}]+)\}(?U:\s)*\{([^{}]+)\}$"
    ratio = r"^-?\d+\s*/\s*-?\d+$"
    divided = F.try_divide(_part(F.regexp_extract(t, macro, 1)), _part(F.regexp_extract(t, macro, 2)))
    return (
        F.when(F.regexp_like(t, F.lit(macro)), divided)
        .when(F.endswith(t, F.lit("%")), _plain(strip(F.substring(t, F.lit(1), F.length(t) - 1))))
        .when(F.regexp_like(t, F.lit(ratio)), _part(t))
        .otherwise(_plain(t))
    )


def numeric_equal(a: Column, b: Column) -> Column:
    """Whether two doubles are equal within tolerance; false for nulls and NaN."""
    near = F.abs(a - b) <= F.greatest(F.lit(ABSOLUTE), F.lit(RELATIVE) * F.greatest(F.abs(a), F.abs(b)))
    return F.coalesce(~F.isnan(a) & ~F.isnan(b) & ~F.isnan(a - b) & near, F.lit(False))


def verdict(pred: Column, gold: Column) -> Column:
    """struct(same, p, g): true or false where text or numbers decide on equivalence; else null, and the two normal forms."""

    def decide(n: Column) -> Column:
        both = F.struct(to_number(n["p"]).alias("x"), to_number(n["g"]).alias("y"))
        numbers = let(both, lambda v: F.when(v["x"].isNotNull() & v["y"].isNotNull(), numeric_equal(v["x"], v["y"])))
        same = F.when(n["p"] == n["g"], True).otherwise(numbers)
        return let(same, lambda s: F.struct(s.alias("same"), F.when(s.isNull(), n["p"]).alias("p"), F.when(s.isNull(), n["g"]).alias("g")))

    none = F.struct(F.lit(False).alias("same"), F.lit(None).cast("string").alias("p"), F.lit(None).cast("string").alias("g"))
    return F.when(pred.isNull(), none).otherwise(let(F.struct(normalise(pred).alias("p"), normalise(gold).alias("g")), decide))
