import hashlib

import pytest
from pyspark.sql import functions as F

from defectloom.operators import augment, mutations, variants

CODE = """def f(a, table):
    total = 0
    if a is None:
        return 5
    for i in range(3):
        total = total + a * 2
    if total == 7:
        total = table[4]
    return total / 9
"""


def number(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


@pytest.fixture
def rows(spark):
    data = [
        (str(i), "src", "p", "path", "f", CODE if i % 2 else f"if not == python {i}:\n  True return - + <", i % 3 == 2, f"pair{i}")
        for i in range(40)
    ]
    df = spark.createDataFrame(
        data, "id string, source string, project string, path string, func_name string, code string, b boolean, pair_id string"
    )
    return df.withColumn("is_buggy", F.col("b").cast("int")).drop("b")


def text_model(code, row, variant, seed):
    for j in range(1, number(row, variant, "rounds", seed) % 2 + 2):
        old, new = variants.REPLACEMENTS[number(row, variant, j, "text", seed) % 10]
        code = code.replace(old, new)
    return code


def test_text_variants(rows):
    got = variants.generate_variants(rows, n=3, seed=5, mutator="text").collect()
    clean = {r["id"]: r for r in rows.collect() if r["is_buggy"] == 0}
    assert len(got) == 3 * len(clean)
    for r in got:
        parent, variant = r["id"].split("_bug_")
        assert r["code"] == text_model(clean[parent]["code"], parent, variant, 5)
        assert r["pair_id"] == f"pair{parent}_synthetic_{variant}"
        assert (r["source"], r["is_buggy"], r["project"]) == ("src_synthetic", 1, "p")


def test_variants_fall_back_to_text_where_no_pattern_applies(rows):
    got = variants.generate_variants(rows, seed=5).collect()
    clean = {r["id"]: r["code"] for r in rows.collect()}
    fallen = 0
    for r in got:
        parent, variant = r["id"].split("_bug_")
        if r["code"] == text_model(clean[parent], parent, variant, 5):
            fallen += 1
    assert 0 < fallen < len(got)
    assert all(r["code"] != CODE for r in got if int(r["id"].split("_bug_")[0]) % 2)


def plan(row, variant, seed):
    steps = number(row, variant, "steps", seed) % 3 + 1
    return [number(row, variant, j, "pattern", seed) % 10 for j in range(1, steps + 1)]


def test_variants_do_not_depend_on_layout(spark, rows):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for shuffle, order in ((1, "id"), (4, "code"), (16, "pair_id")):
            spark.conf.set("spark.sql.shuffle.partitions", shuffle)
            got = variants.generate_variants(rows.orderBy(order).repartition(shuffle), seed=1)
            results.append(sorted(map(tuple, got.collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1] == results[2]


def test_merge_keeps_all_rows(rows):
    made = variants.generate_variants(rows, mutator="text").drop("path")
    merged = variants.merge(rows, made)
    assert merged.count() == rows.count() + made.count()
    assert merged.where("origin = 'synthetic' AND path IS NULL").count() == made.count()


def applied(spark, name, code, seeds=60):
    """What a pattern makes of a code under many seeds."""
    df = spark.createDataFrame([("r", 0, code)], "id string, variant int, code string")
    key = (F.col("id"), F.col("variant"), F.lit(1), name)
    made = [mutations.mutated_by(name, F.col("code"), seed, key) for seed in range(seeds)]
    return set(df.select(F.explode(F.array(*made))).toPandas()["col"])


def numbers(low, high, text):
    return {text.format(n) for n in range(low, high + 1)}


@pytest.mark.parametrize(
    "name, code, want",
    [
        ("off_by_one", "for i in range(3):\n    x[1]", {"for i in range(4):\n    x[1]", "for i in range(2):\n    x[1]"}),
        ("off_by_one", "for i in range(n):\n    x[0]", {"for i in range(n):\n    x[1]", "for i in range(n):\n    x[0]"}),
        ("off_by_one", "y = x['a']", {"y = x['a']"}),
        ("missing_null_check", "def f():\n    if a.b is None:\n        c", {"def f():\n    if a.b is None or True:\n        c"}),
        ("missing_null_check", "if a is not None:\n    b", {"if a is not None:\n    b"}),
        ("wrong_variable", "a = 1\nb = a\nprint(a, ab, b)", {"a = 1\nb = a\nprint(a, ab, b)", "b = 1\nb = b\nprint(b, ab, b)", "a = 1\na = a\nprint(a, ab, a)"}),
        ("wrong_variable", "a = 1\nprint(a)", {"a = 1\nprint(a)"}),
        ("wrong_operator", "a + b * c", {"a - b * c"}),
        ("wrong_operator", "a <= b < c", {"a >= b < c"}),
        ("wrong_operator", "a ** b", {"a ** b"}),
        ("wrong_condition", "a < b\nwhile x and a == b:\n    c < d", {"a < b\nwhile x and a != b:\n    c < d"}),
        ("wrong_condition", "a = b < c", {"a = b < c"}),
        ("type_error", "a = b + 22", {'a = b + "error_22"'}),
        ("type_error", "a = b + c2", {"a = b + c2"}),
        ("missing_initialisation", "def f():\n    a = 1\n    b = 2", {"def f():\n    pass\n    b = 2"}),
        ("missing_initialisation", "a == 1", {"a == 1"}),
    ],
)
def test_patterns(spark, name, code, want):
    assert applied(spark, name, code) == want


@pytest.mark.parametrize(
    "name, code, allowed",
    [
        ("missing_return", "def f():\n    return 1", numbers(-100, 100, "def f():\n    return {}") | {"def f():\n    pass"}),
        ("array_bounds", "a[3]", numbers(-10, -1, "a[{}]") | numbers(100, 1000, "a[{}]")),
        ("array_bounds", "a[1:2] + [4]", {"a[1:2] + [4]"}),
        ("logic_error", "a = 3\nb = 4", numbers(-100, 100, "a = {}\nb = 4")),
        ("logic_error", "a = b", {"a = b"}),
    ],
)
def test_patterns_with_drawn_numbers(spark, name, code, allowed):
    made = applied(spark, name, code)
    assert made <= allowed and (len(made) > 3 or len(allowed) == 1)


def test_code_without_a_place_to_change_gives_null(spark):
    df = spark.createDataFrame([("r", 0, "prose"), ("s", 0, ""), ("t", 0, None)], "id string, variant int, code string")
    made = mutations.mutate(F.col("code"), F.array(F.lit(0), F.lit(9)), 5)
    assert [r[0] for r in df.select(made).collect()] == [None, None, None]


def augment_model(code, row, seed):
    p = lambda limit, *key: number(row, *key, seed) < int(limit * 2**32)
    if p(0.3, "gate") and p(0.2, "whitespace") and "\n" in code:
        code = "\n".join(
            " " * (number(row, "indent", i, seed) % 4 + 1) + line if p(0.1, "line", i) else line
            for i, line in enumerate(code.split("\n"))
        )
    if p(0.3, "gate") and p(0.15, "comment"):
        lines = code.split("\n")
        place = number(row, "place", seed) % (min(len(lines), 3) + 1)
        lines.insert(place, augment.COMMENTS[number(row, "text", seed) % 4])
        code = "\n".join(lines)
    return code


def test_augmentation(spark):
    values = [(str(i), "a\nb\n\nc" * (i % 3) + "x") for i in range(600)]
    df = spark.createDataFrame(values, "id string, code string")
    got = df.select("id", "code", augment.augment(F.col("code"), 9).alias("new")).collect()
    assert [r["new"] for r in got] == [augment_model(r["code"], r["id"], 9) for r in got]
    assert sum(r["new"] != r["code"] for r in got) > 20
