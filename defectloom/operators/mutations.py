"""Synthetic defects as column rules on the text of Python-like code.

A pattern finds the first place it can change and rewrites it; the draws hash id, variant and step.
Everything is built-in string functions, so mutants are made where the rows are, in the JVM. A code
that no pattern of its plan changes is left to the caller, which falls back to text replacements.
"""

from pyspark.sql import Column, functions as F

from defectloom.functions.bind import bind
from defectloom.functions.draws import draw

# Operators that swap places, and the bounds of drawn numbers.
SWAPS = (("+", "-"), ("*", "/"), ("==", "!="), ("<=", ">="), ("<", ">"))
SWAPPED = dict(SWAPS) | {b: a for a, b in SWAPS}
FAR_INDEX, SPREAD = (100, 1000), 100

PATTERNS = (
    "off_by_one",
    "missing_null_check",
    "wrong_variable",
    "wrong_operator",
    "missing_return",
    "wrong_condition",
    "array_bounds",
    "type_error",
    "logic_error",
    "missing_initialisation",
)

NAME = "[A-Za-z_][A-Za-z0-9_]*"
NUMBER = "[0-9]{1,9}"
ARITHMETIC = r"(?:\+|-|\*|/)"
COMPARISON = "(?:==|!=|<=|>=|<|>)"
# What stands before the place a pattern changes, and the place itself.
RANGE_OR_INDEX = r"(?:\brange\(|\[)"
NULL_GUARD = rf"(?:^|\n)[ \t]*if {NAME}(?:\.{NAME})* "
ASSIGNED = rf"(?:^|\n)[ \t]*{NAME} = "


def _place(code: Column, before: str, target: str, after: str, use) -> Column:
    """``code`` with ``use(target)`` instead of the first ``target`` between the two patterns.

    ``use`` gets the matched text; code without a match stays as it is.
    """
    pattern = rf"(?s)\A(.*?{before})({target}){after}"
    head = F.regexp_extract(code, pattern, 1)
    found = F.regexp_extract(code, pattern, 2)

    def spliced(parts):
        start, hit = parts["head"], parts["found"]
        rest = F.substr(code, F.length(start) + F.length(hit) + 1)
        return F.when(hit == "", code).otherwise(F.concat(start, use(hit), rest))

    return bind(F.struct(head.alias("head"), found.alias("found")), spliced)


def _swapped(op: Column) -> Column:
    out = F.when(F.lit(False), op)
    for old, new in SWAPPED.items():
        out = out.when(op == old, new)
    return out


def _between(seed: int, key, low: int, high: int) -> Column:
    return (draw(seed, *key) % (high - low + 1) + low).cast("string")


def mutated_by(pattern: str, code: Column, seed: int, key: tuple) -> Column:
    """One pattern applied once; ``key`` names the draw."""
    coin = draw(seed, *key, "coin") % 2 == 0
    if pattern == "off_by_one":

        def shifted(n):
            value = n.cast("long")
            return F.when(coin, value + 1).otherwise(F.greatest(value - 1, F.lit(0))).cast("string")

        return _place(code, RANGE_OR_INDEX, NUMBER, r"[,)\]]", shifted)
    if pattern == "missing_null_check":
        return _place(code, NULL_GUARD, "is None", ":", lambda _: F.lit("is None or True"))
    if pattern == "wrong_variable":
        return _renamed(code, seed, key)
    if pattern == "wrong_operator":
        return _place(code, " ", f"{ARITHMETIC}|{COMPARISON}", " ", _swapped)
    if pattern == "missing_return":
        number = F.concat(F.lit("return "), _between(seed, (*key, "number"), -SPREAD, SPREAD))
        return _place(
            code, r"(?:^|\n)[ \t]+", r"return\b[^\n]*", "", lambda _: F.when(coin, "pass").otherwise(number)
        )
    if pattern == "wrong_condition":
        return _place(code, r"(?:^|\n)[ \t]*(?:if|elif|while) [^\n]*? ", COMPARISON, " ", _swapped)
    if pattern == "array_bounds":
        below = _between(seed, (*key, "number"), -10, -1)
        return _place(
            code, r"[A-Za-z0-9_)\]]\[", NUMBER, r"\]",
            lambda _: F.when(coin, below).otherwise(_between(seed, (*key, "number"), *FAR_INDEX)),
        )
    if pattern == "type_error":
        return _place(
            code, f" {ARITHMETIC} ", rf"\b{NUMBER}\b", "", lambda n: F.concat(F.lit('"error_'), n, F.lit('"'))
        )
    if pattern == "logic_error":
        number = _between(seed, (*key, "number"), -SPREAD, SPREAD)
        return _place(code, ASSIGNED, NUMBER, r"(?:\n|$)", lambda _: number)
    if pattern == "missing_initialisation":
        return _place(code, r"(?:^|\n)[ \t]*", rf"{NAME} = [^\n]*", "", lambda _: F.lit("pass"))
    raise ValueError(f"unknown pattern: {pattern}")


def _renamed(code: Column, seed: int, key: tuple) -> Column:
    """All places of one assigned name get another assigned name."""
    names = F.array_distinct(
        F.regexp_extract_all(code, F.lit(rf"(?:^|\n)[ \t]*({NAME}) = "), F.lit(1))
    )

    def swapped(found):
        n = F.size(found)
        old = F.get(found, (draw(seed, *key, "old") % n).cast("int"))
        new = F.get(found, (draw(seed, *key, "new") % n).cast("int"))
        word = F.concat(F.lit(r"\b"), old, F.lit(r"\b"))
        return F.when(n < 2, code).otherwise(F.regexp_replace(code, word, new))

    return bind(names, swapped)


def mutate(code: Column, plan: Column, seed: int) -> Column:
    """The patterns numbered in ``plan`` applied in turn; null where none changes the code."""
    steps = F.transform(plan, lambda number, i: F.struct(number.alias("number"), i.alias("step")))

    def apply(text, step):
        key = (F.col("id"), F.col("variant"), step["step"] + 1)
        out = F.when(F.lit(False), text)
        for i, pattern in enumerate(PATTERNS):
            out = out.when(step["number"] == i, mutated_by(pattern, text, seed, (*key, pattern)))
        return out

    return bind(F.aggregate(steps, code, apply), lambda done: F.when(done != code, done))
