"""Mutations on lexed code: what each rule may make of a code, and what it must leave alone."""

import itertools
import re
import time

import pytest
from pyspark.sql import functions as F

from defectloom.functions.draws import chance, draw
from defectloom.operators import lexed, variants
from defectloom.plans import bindings
from defectloom.plans.queries import QUERIES

ROWS = 150


def outcomes(spark, rule, code, rows=ROWS):
    """What a rule makes of a code under the draws of many rows."""
    df = spark.createDataFrame([(str(i), code) for i in range(rows)], "id string, code string")
    made = lexed.changed_by(rule, F.col("code"), 1, (F.col("id"), F.lit(rule)))
    return {r[0] for r in df.select(made).distinct().collect()}


@pytest.mark.parametrize(
    "code",
    [
        "", " ", "\n", "x = 'a", '"""open\n== 1', "a = \"q\\\"\" + 'x\\\\'  # '", "été = 1\n\tреturn", "a\\\nb", "r'\\' + 1",
        "'''a'b''c'''\n" * 3, "x" * 5000 + " + 1", bindings.LEXED_CODE, "\ufdd0 + 1", "$ ` ?", "\r\n a \x0b",
    ],
)
def test_tokens_joined_are_the_code(spark, code):
    df = spark.createDataFrame([(code,)], "code string")
    whole = F.array_join(F.transform(lexed.tokens_of(lexed.masked(F.col("code"))), lambda t: t["whole"]), "")
    assert df.select(whole == lexed.masked(F.col("code"))).first()[0]


def test_strings_and_comments_stay(spark):
    code = '"""a + b == 1\nreturn 2\nx = 3"""\n' + "# a + b\nprint('a < b', \"x[3] \\\" - 1\")  # x[1] == 2\n"
    for rule in lexed.RULES:
        assert outcomes(spark, rule, code) == {code}, rule


def choices(text, *options):
    """All texts with each ``{}`` replaced by one of its options."""
    return {text.format(*pick) for pick in itertools.product(*options)}


@pytest.mark.parametrize(
    "rule, code, allowed",
    [
        ("wrong_operator", "a + b * -c <= d", choices("a {} b {} -c {} d", "+-", "*/", ("<=", ">="))),
        ("wrong_operator", "f(*a, **b) ** c", {"f(*a, **b) ** c"}),
        ("off_by_one", "for i in range(3, 9):\n    a[0] = b[7]", choices("for i in range({}, 9):\n    a[{}] = b[{}]", "24", "01", "68")),
        ("off_by_one", "range(3)\n[4]\na[1:2]", {"range(3)\n[4]\na[1:2]"}),
        ("wrong_condition", "if a == b(c < 1):\n    d < e", choices("if a {} b(c < 1):\n    d < e", ("==", "!="))),
        ("wrong_condition", "if a == b and c:\n    d\nwhile a < b:\n    e", {"if a == b and c:\n    d\nwhile a < b:\n    e"}),
        ("wrong_condition", "if a <= b:\n    d", {"if a <= b:\n    d"}),
        ("missing_return", "def f():\n    return a + 1  # b\n", {"def f():\n    return a + 1  # b\n", "def f():\n    pass  # b\n"}),
        ("missing_return", "return (a +\n  b)", {"return (a +\n  b)"}),
        ("type_error", "a = 1 + 2 * b", {"a = 1 + 2 * b", 'a = "error_1" + 2 * b', 'a = 1 + "error_2" * b', 'a = "error_1" + "error_2" * b'}),
        ("missing_initialisation", "a = 1\nb = (2,\n 3)\nc == 4", choices("{}\nb = (2,\n 3)\nc == 4", ("a = 1", "pass"))),
        ("missing_null_check", "if a is None:\n    b = 1\n    c\nelse:\n    d\ne", {"if a is None:\n    b = 1\n    c\nelse:\n    d\ne", "b = 1\ne"}),
        ("missing_null_check", "if a is not None:\n    b\n", {"if a is not None:\n    b\n"}),
        (
            "missing_null_check",
            "def f():\n  if a is b:\n      while c:\n          d\n\n          e\n      g\n  h",
            {"def f():\n  if a is b:\n      while c:\n          d\n\n          e\n      g\n  h", "def f():\n  while c:\n      d\n\n      e\n  h"},
        ),
        (
            "wrong_variable",
            "def f(a):\n    b = a.a\n    return g(b=b)\ndef h():\n    a = b",
            {
                "def f(a):\n    b = a.a\n    return g(b=b)\ndef h():\n    a = b",
                "def f(b):\n    b = b.a\n    return g(b=b)\ndef h():\n    a = b",
                "def f(a):\n    a = a.a\n    return g(b=a)\ndef h():\n    a = b",
            },
        ),
    ],
)
def test_rules_change_each_fitting_place(spark, rule, code, allowed):
    assert outcomes(spark, rule, code) == allowed


@pytest.mark.parametrize("rule, low, high", [("array_bounds", 100, 1000), ("logic_error", -100, 100)])
def test_drawn_numbers(spark, rule, low, high):
    made = outcomes(spark, rule, "a = 3\nb = a[3]\nc = 3")
    values = {int(v) for m in made for v in re.findall(r"(?:= |\[)(-?\d+)", m)} - {3}
    assert len(made) > 5 and all(low <= v <= high or (rule == "array_bounds" and -10 <= v <= -1) for v in values)


def test_variants_by_lexed_rules(spark):
    rows = [(str(i), "p", "s", "pr", 0, bindings.LEXED_CODE) for i in range(20)] + [("x", "p", "s", "pr", 0, "prose + more")]
    df = spark.createDataFrame(rows, "id string, pair_id string, source string, project string, is_buggy int, code string")
    made = variants.generate_variants(df, n=2, seed=5, mutator="lexed").collect()
    assert len(made) == 42 and sum(r["code"] != bindings.LEXED_CODE for r in made) > 35
    with pytest.raises(ValueError, match="unknown mutator"):
        variants.mutated_code(F.col("code"), mutator="other")


def test_part_rows_are_dealt_over_all_cores(spark, sf_dir):
    """The table is one small file, its rows made into code are the work."""
    for name in ("lexed_patterns", "single_patterns", "generate_variants"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "RoundRobinPartitioning" in plan
    assert bindings.lexed_code(spark, sf_dir).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_code_is_scanned_once_for_all_rules(spark):
    rows = spark.createDataFrame([("1", "limit = 2\nif a == 3 and b[1]:\n    return 4\n"), ("2", "\ufdd0"), ("3", None)], "id string, code string")
    key = lambda rule: (F.col("id"), F.lit(rule))
    each = lexed.changed_by_each(lexed.RULES, F.col("code"), 1, key)
    alone = F.array(*[lexed.changed_by(rule, F.col("code"), 1, key(rule)) for rule in lexed.RULES])
    for row in rows.select(F.coalesce(each, F.array_repeat(F.lit(None).cast("string"), len(lexed.RULES))).alias("each"), alone.alias("alone")).collect():
        assert row["each"] == row["alone"]
    assert each._jc.toString().count("regexp_extract_all") == 2


def test_long_lines_are_walked_once(spark):
    """Each token of a line that went looked at the whole line, so the time grew with its square."""
    code = "x = [" + "1 + a[2], " * 2500 + "0]\nreturn [" + "b < 3, " * 2500 + "0]\n"
    df = spark.createDataFrame([(str(i), code) for i in range(40)], "id string, code string").repartition(8)
    each = lexed.changed_by_each(lexed.RULES, F.col("code"), 1, lambda rule: (F.col("id"), F.lit(rule)))
    start = time.monotonic()
    made = [dict(zip(lexed.RULES, r["each"])) for r in df.select(each.alias("each")).collect()]
    assert time.monotonic() - start < 30
    second = code.index("return")
    assert {m["missing_initialisation"] for m in made} == {code, "pass\n" + code[second:]}
    assert {m["missing_return"] for m in made} == {code, code[:second] + "pass\n"}
    assert all(m["wrong_operator"].count("1 - a") in range(500, 1000) for m in made)


def test_rules_search_no_line_for_each_token(spark):
    each = lexed.changed_by_each(lexed.RULES, F.col("code"), 1, lambda rule: (F.col("id"), F.lit(rule)))
    assert "aggregate" not in each._jc.toString()


def test_edits_at_both_ends_and_side_by_side(spark):
    assert outcomes(spark, "wrong_operator", "a+b") == {"a+b", "a-b"}
    assert outcomes(spark, "type_error", "1+2") == {"1+2", '"error_1"+2'}
    assert outcomes(spark, "missing_return", "return 1") >= {"return 1", "pass"}
    assert outcomes(spark, "missing_initialisation", "a = 1\nb = 2") == choices("{}\n{}", ("a = 1", "pass"), ("b = 2", "pass"))
    assert outcomes(spark, "wrong_operator", "'\\'' + \"\\\\\"") == {"'\\'' + \"\\\\\"", "'\\'' - \"\\\\\""}


def test_null_and_empty_codes(spark):
    df = spark.createDataFrame([("1", None), (None, ""), (None, None)], "id string, code string")
    each = lexed.changed_by_each(lexed.RULES, F.col("code"), 1, lambda rule: (F.col("id"), F.lit(rule)))
    made = [r[0] for r in df.select(each).collect()]
    assert made == [[None] * 10, [""] * 10, [None] * 10]


@pytest.mark.parametrize("p", [0, 1e-9, 0.1, 0.3, 0.5, 0.999999, 1, 2])
def test_chance_is_a_draw_below_its_share(spark, p):
    key = (F.col("id"), F.lit("x"))
    share = F.lit(int(p * 2**32))
    wrong = spark.range(2000).where(~chance(p, 3, *key).eqNullSafe(draw(3, *key) < share)).count()
    assert wrong == 0
