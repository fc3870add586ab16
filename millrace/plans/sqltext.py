"""Pieces of DuckDB SQL that several oracles share. They restate the semantics with other means than the Spark code."""

from __future__ import annotations

# Fixed values, stated here again so that the oracle takes nothing from what it judges: white space of Python's str.strip, tokens and
# units that a normal form lacks, in the order of their removal.
WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
TOKENS = (r"\left", r"\right", r"\!", r"\,", r"\;", r"\:", r"\quad", r"\qquad", r"\$", "$", r"\%", "%", r"^\circ", r"\circ", r"\degree")
UNITS = (
    "km/h m/s dollars? cents? kilometers? kilometres? meters? metres? miles? hours? minutes? seconds? days? years? degrees? units? percent points? "
    "apples? liters? litres? km cm mm kg g"
).split()

#: White space as a list for trim.
WS = "'" + WHITE + "'"
#: White space as a class of a regular expression.
W = r"[\s\x0b\x{85}\p{Z}]"
NUMBER = r"'-?\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?%?'"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def boxed(x: str) -> str:
    """Content of the last box, for boxes of up to three braces inside each other."""
    body = r"[^{}]*"
    for _ in range(3):
        body = r"(?:[^{}]|\{" + body + r"\})*"
    found = []
    for mark in (r"\boxed", r"\fbox"):
        rest = f"string_split({x}, '{mark}')[-1]"
        found.append(f"CASE WHEN contains({x}, '{mark}') AND regexp_matches({rest}, '^[^{{]*\\{{{body}\\}}') THEN {strip(f"regexp_extract({rest}, '^[^{{]*\\{{({body})\\}}', 1)")} END")
    return f"coalesce({', '.join(found)})"


#: A text to the end of its first box, of up to three braces inside each other.
FIRST_BOX = r"(?s)^.*?\\boxed\{(?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*\}"


def marker(x: str) -> str:
    return rf"nullif(regexp_extract({x}, '####{W}*(-?[0-9][0-9,.]*)', 1), '')"


def phrase(x: str) -> str:
    tail = strip(rf"regexp_replace({x}, '(?is)^.*answer{W}*(?:is|:|=|are)?{W}*', '')")
    line = f"rtrim({strip(rf"regexp_split_to_array({tail}, '\r\n|[\n\r\x0b\x0c]')[1]")}, '.')"
    return f"CASE WHEN regexp_matches({x}, '(?i)answer') AND {tail} <> '' THEN coalesce({boxed(tail)}, regexp_extract_all({tail}, {NUMBER})[1], {line}) END"


def equation(x: str) -> str:
    t = strip(x)
    pattern = rf"'={W}*([^=\n]+?){W}*\.?{W}*$'"
    return f"CASE WHEN regexp_matches({t}, {pattern}) THEN {strip(f'regexp_extract({t}, {pattern}, 1)')} END"


def last_number(x: str) -> str:
    return f"regexp_extract_all({x}, {NUMBER})[-1]"


def extracted(x: str) -> str:
    return f"coalesce({boxed(x)}, {marker(x)}, {phrase(x)}, {equation(x)}, {last_number(x)})"


def thousands(x: str) -> str:
    """Pieces between commas, rejoined without one where a digit stands before it and exactly three after it."""
    p = f"string_split({x}, ',')"
    glue = rf"CASE WHEN i = 1 THEN {p}[1] WHEN regexp_matches({p}[i - 1], '\d$') AND regexp_matches({p}[i], '^\d{{3}}(?:\W|$)') THEN {p}[i] ELSE ',' || {p}[i] END"
    return f"array_to_string(list_transform(range(1, len({p}) + 1), lambda i: {glue}), '')"


def normal(x: str) -> str:
    s = strip(f"coalesce({x}, '')")
    s = strip(rf"regexp_replace({s}, '^\\\(|\\\)$|^\\\[|\\\]$', '', 'g')")
    s = strip(f"trim({s}, '$')")
    for _ in range(3):
        s = rf"regexp_replace({s}, '\\(?:text|mbox|mathrm|mathbf|operatorname){W}*\{{([^{{}}]*)\}}', '\1', 'g')"
    for old, new in ((r"\dfrac", r"\frac"), (r"\tfrac", r"\frac"), *((t, "") for t in TOKENS)):
        s = f"replace({s}, '{old}', '{new}')"
    s = thousands(rf"regexp_replace({s}, '(?i)\b(?:{'|'.join(UNITS)})\b', '', 'g')")
    return rf"regexp_replace({strip(f"rtrim({strip(s)}, '.')")}, '{W}+', ' ', 'g')"


def number(x: str) -> str:
    """A number as double from a column; the plain forms that the tables hold."""
    d = r"(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][-+]?\d+)?"
    plain = f"CASE WHEN regexp_full_match({{0}}, '[-+]?{d}') THEN try_cast(replace({{0}}, '_', '') AS DOUBLE) END"
    t = strip(x)
    parts = [f"regexp_extract({t}, '^\\\\frac{W}*\\{{([^{{}}]+)\\}}{W}*\\{{([^{{}}]+)\\}}$', {i})" for i in (1, 2)]
    a, b = (plain.replace("{0}", strip(p)) for p in parts)
    over = [rf"try_cast(regexp_extract({t}, '^(-?\d+)\s*/\s*(\d+)$', {i}) AS DOUBLE)" for i in (1, 2)]
    return (
        f"CASE WHEN {parts[0]} <> '' THEN ({a}) / nullif({b}, 0) WHEN ends_with({t}, '%') THEN {plain.replace('{0}', strip(f'left({t}, -1)'))} "
        rf"WHEN regexp_full_match({t}, '-?\d+\s*/\s*-?\d+') THEN {over[0]} / nullif({over[1]}, 0) ELSE {plain.replace('{0}', t)} END"
    )


def near(a: str, b: str) -> str:
    return f"coalesce(NOT isnan({a}) AND NOT isnan({b}) AND abs({a} - {b}) <= greatest(1e-6::DOUBLE, 1e-4::DOUBLE * greatest(abs({a}), abs({b}))), false)"


def graded(rows: str, text: str, gold: str, keep: str) -> str:
    """A CTE chain from `rows` to `graded(keep, answer, ok)`; what only symbolic comparison could decide counts as wrong."""
    return f"""
    answered AS (SELECT {keep}, {gold} AS gold_, {extracted(text)} AS answer FROM {rows}),
    forms AS (SELECT *, {normal('answer')} AS p_, {normal('gold_')} AS g_ FROM answered),
    numbers AS (SELECT *, {number('p_')} AS x_, {number('g_')} AS y_ FROM forms),
    graded AS (SELECT *, CASE WHEN answer IS NULL THEN false WHEN p_ = g_ THEN true WHEN x_ IS NOT NULL AND y_ IS NOT NULL THEN {near('x_', 'y_')} ELSE false END AS ok FROM numbers)"""


def arithmetic(x: str) -> str:
    """A solution with plain operators and one chain on a line."""
    t = rf"regexp_replace(replace(replace({x}, '&=', '='), '\\', chr(10)), '\n{W}*=', ' = ', 'g')"
    for old, new in ((r"\times", "*"), (r"\cdot", "*"), (r"\div", "/"), ("×", "*"), ("÷", "/"), ("·", "*"), (r"\left", ""), (r"\right", ""), (r"\,", ""), ("^", "**"), ("$", "")):
        t = f"replace({t}, '{old}', '{new}')"
    t = thousands(rf"regexp_replace({t}, '\\[a-zA-Z]+', ' ', 'g')")
    t = rf"regexp_replace({t}, '(\d){W}*\(', '\1*(', 'g')"
    t = rf"regexp_replace({t}, '\){W}*\(', ')*(', 'g')"
    return rf"regexp_replace({t}, '\){W}*(\d)', ')*\1', 'g')"


def clean(x: str) -> str:
    """A completion cut at leaked turns and after its first boxed line."""
    cut = rf"regexp_split_to_array({x}, '<\|im_end\|>|<\|im_start\|>|\n(?:assistant|user|system)')[1]"
    line = rf"regexp_replace({cut}, '(?s)^(.*?\\boxed\{{[^\n]*)\n.*$', '\1')"
    return strip(rf"regexp_replace({line}, '[\x{{4e00}}-\x{{9fff}}\x{{3000}}-\x{{303f}}\x{{fffd}}\s\x0b\x{{85}}\p{{Z}}]+$', '')")


def source(x: str) -> str:
    return f"nullif(lower(trim({x})), '')"


RECORDS = """(SELECT DISTINCT record_id, run_id, model, eval_id, sample_idx, problem, gold, level, correct, predicted, completion FROM eval_record)"""
PROBLEMS = """(SELECT DISTINCT problem_id, problem, answer, source, level FROM grpo)"""
CHATS = """(SELECT DISTINCT sft_id, messages, source FROM sft)"""


def turn(messages: str, role: str) -> str:
    return f"list_filter({messages}, lambda m: lower(trim(coalesce(m.role, ''))) = '{role}')[-1].content"
