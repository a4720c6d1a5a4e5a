import re

from pyspark.sql import functions as F

from defectloom.functions import text as X


def column(spark, values, make):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(make).collect()]


def test_strip_is_python_strip(spark):
    spaces = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"
    values = [spaces + "a" + spaces + "b" + spaces, spaces, "", "x\u200b", "a\n", "\ufeffq"]
    assert column(spark, values, X.strip("t")) == [v.strip() for v in values]
    assert column(spark, values, X.is_blank("t")) == [not v.strip() for v in values]


def test_strip_passes_long_runs(spark):
    value = "a" + " " * 200_000 + "b" + "\n" * 200_000
    assert column(spark, [value], X.strip("t")) == [value.strip()]


def test_parse_kv(spark):
    block = 'a = "1"\nno line\n  b=x=y  \na=""2""\n=empty\nc=\n'
    got = column(spark, [block, "", "plain"], X.parse_kv("t"))
    assert got == [{"a": "2", "b": "x=y", "": "empty", "c": ""}, {}, {}]


def patch_model(patch, marks):
    """Lines after the last good header whose mark is wanted."""
    lines = patch.split("\n")
    start = 0
    for i, line in enumerate(lines):
        words = line.split(" ")
        if line.startswith("@@") and len(words) > 2:
            number = words[1].removeprefix("-").split(",")[0]
            if re.fullmatch(r"[+-]?[0-9]+", number):
                start = i + 1
    kept = [line[1:] for line in lines[start:] if line[:1] and line[0] in marks]
    return "\n".join(kept) or None


def test_patch_code(spark, rng):
    pieces = [
        "+a", "-b", " c", "", "+", "-", "\\ No newline", "diff --git", "--- a", "+++ b",
        "@@ -1,2 +1,2 @@", "@@ x,2 +1 @@", "@@ -7 +7 @@", "@@-3", "@@ -1", "@@", "@@@ 12 13 @@@",
        "@@ --5,1 x", "@@ -,5 x y", " @@ -1,1 +1,1 @@",
    ]
    patches = ["\n".join(rng.choices(pieces, k=rng.randint(0, 9))) for _ in range(400)]
    for marks in ("+- ", "- ", "+ "):
        got = column(spark, patches, X.patch_code("t", marks, "last"))
        assert got == [patch_model(p, marks) for p in patches]


def test_all_hunks_of_a_patch(spark):
    patch = (
        "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n@@ -9 +9,2 @@ f\n--- d\n+e\n"
        "diff --git a/y b/y\n--- a/y\n+++ b/y\n@@ -1 +1 @@\n+f\n\\ No newline"
    )
    got = [column(spark, [patch], X.patch_code("t", marks))[0] for marks in ("+- ", "- ", "+ ")]
    assert got == ["a\nb\nc\n-- d\ne\nf", "a\nb\n-- d", "a\nc\ne\nf"]
    assert column(spark, ["no header\n+a\n-b", "", None], X.patch_code("t")) == ["a\nb", None, None]


def window_model(code, n, ctx):
    lines = code.split("\n")
    marks = [i for i, l in enumerate(lines) if l.strip().startswith(("def ", "class "))]
    start = max([i for i in marks if i <= n], default=max(0, n - ctx))
    end = min([i for i in marks if i >= n], default=min(len(lines), n + ctx))
    return "\n".join(lines[start:end])


def test_function_window(spark, rng):
    pieces = ["def f():", "  class A:", "x = 1", "", "define", "def", "\u2003def g(a):", "class "]
    cases = [
        ("\n".join(rng.choices(pieces, k=rng.randint(1, 12))), rng.randint(0, 14), rng.randint(0, 4))
        for _ in range(300)
    ]
    for ctx in range(5):
        some = [c for c in cases if c[2] == ctx]
        rows = spark.createDataFrame([(i, c, n) for i, (c, n, _) in enumerate(some)], "i int, t string, n int")
        got = rows.orderBy("i").select(X.function_window(F.col("t"), F.col("n"), ctx)).collect()
        assert [r[0] for r in got] == [window_model(*c) for c in some]


def test_function_name(spark):
    values = [
        "x = 1\nclass B:\n  def run (self):", "class\u00a0Thing(object)", "def 1f(", "", "undef go(",
        "def a\n(", "async def  z(", "class é",
    ]
    assert column(spark, values, X.function_name("t")) == [
        "run", "Thing", "module", "module", "go", "a", "z", "module"
    ]


def truncate_model(code, limit):
    if len(code) <= limit:
        return code
    kept, used = [], 0
    for line in code.split("\n"):
        used += len(line) + 1
        if used > limit:
            break
        kept.append(line)
    return "\n".join(kept)


def test_truncate_lines(spark, rng):
    values = ["".join(rng.choices("ab\n\né😀", k=rng.randint(0, 40))) for _ in range(300)]
    for limit in (1, 5, 17, 40):
        got = column(spark, values, X.truncate_lines("t", limit))
        assert got == [truncate_model(v, limit) for v in values]


def test_preview_counts_characters(spark):
    values = ["é" * 100, "😀" * 101, ""]
    assert column(spark, values, X.preview("t")) == [values[0], "😀" * 100 + "...", ""]


def test_newlines(spark):
    assert column(spark, ["a\r\nb\rc\n\r\n"], X.unix_newlines("t")) == ["a\nb\nc\n\n"]


def test_bands(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 499.9, 500.0, 999.0, 1000.0, None)], "x double")
    assert [r[0] for r in rows.select(X.length_band(F.col("x"))).collect()] == [
        None, "short", "medium", "medium", "long", None
    ]
    rows = spark.createDataFrame([(x,) for x in (0.45, 0.55, 0.4, 0.6, 0.3, 0.7, 0.29, 1.0)], "x double")
    assert [r[0].split()[0] for r in rows.select(X.balance_band(F.col("x"))).collect()] == [
        "well", "well", "moderately", "moderately", "somewhat", "somewhat", "highly", "highly"
    ]


def test_safe_ratio(spark):
    row = spark.range(1).select(X.safe_ratio(F.lit(1), F.lit(4)), X.safe_ratio(F.lit(1), F.lit(0))).first()
    assert tuple(row) == (0.25, 0.0)
