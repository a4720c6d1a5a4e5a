import pytest
from pyspark.sql import functions as F

from defectloom.operators import filters, history, metrics, pairs, profile, validate
from defectloom.operators.model import score_logits


def test_pair_rows_drop_missing_sides(spark):
    rows = spark.createDataFrame(
        [("k1", "a", "x=1", "b", "x=2"), ("k2", "a", None, "b", "y"), ("k3", "a", "z", "b", "")],
        "k string, buggy_path string, buggy_code string, fixed_path string, fixed_code string",
    )
    got = pairs.pair_rows(rows, F.lit("s"), F.lit("p"), F.col("k"))
    assert sorted((r["id"], r["is_buggy"]) for r in got.collect()) == [
        ("k1_buggy", 1), ("k1_fixed", 0), ("k2_fixed", 0), ("k3_buggy", 1)
    ]


def test_request_verdicts(spark):
    values = [None, "", " \u2003\n", "x" * 10000, "x" * 10001, " " * 10001, "ok"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, code string")
    got = rows.orderBy("i").select(filters.request_verdict("code")).collect()
    assert [r[0] for r in got] == ["empty", "empty", "blank", None, "too long", "too long", None]


def test_accepted_batches(spark):
    rows = spark.range(100 + 101 + 5000 + 1).select(
        "id",
        F.when(F.col("id") < 100, "full").when(F.col("id") < 201, "over")
        .when(F.col("id") < 5201, "hot").otherwise("one").alias("b"),
    ).repartition(6)
    got = filters.accepted_batches(rows, "b").groupBy("b").count().collect()
    assert {r["b"]: r["count"] for r in got} == {"full": 100, "one": 1}
    verdicts = {r["b"]: (r["n"], r["accepted"]) for r in filters.batch_sizes(rows, "b").collect()}
    assert verdicts == {"full": (100, True), "over": (101, False), "hot": (5000, False), "one": (1, True)}


def macro(truth, guess):
    """Per-label scores over the labels that occur, then their mean."""
    labels = sorted(set(truth) | set(guess))
    scores = []
    for label in labels:
        tp = sum(t == g == label for t, g in zip(truth, guess))
        p = tp / guess.count(label) if label in guess else 0.0
        r = tp / truth.count(label) if label in truth else 0.0
        scores.append((p, r, 2 * p * r / (p + r) if p + r else 0.0))
    return [sum(s[i] for s in scores) / len(labels) for i in range(3)]


def test_metrics_per_project(spark, rng):
    rows = [("one_class", 1, 1, 0.9)] * 4 + [("never_right", 0, 1, 0.5), ("never_right", 1, 0, None)]
    rows += [(f"p{rng.randint(0, 4)}", rng.randint(0, 1), rng.randint(0, 1), rng.random()) for _ in range(200)]
    df = spark.createDataFrame(rows, "project string, is_buggy int, yhat int, score double")
    got = metrics.summary_metrics(metrics.confusion(df, ["project"]), ["project"]).collect()
    for r in got:
        mine = [x for x in rows if x[0] == r["project"]]
        truth, guess = [x[1] for x in mine], [x[2] for x in mine]
        scores = [x[3] for x in mine if x[3] is not None]
        assert r["samples"] == len(mine) and r["buggy_samples"] == sum(truth)
        assert r["clean_samples"] == len(mine) - sum(truth)
        want = [sum(t == g for t, g in zip(truth, guess)) / len(mine), *macro(truth, guess), sum(scores) / len(scores)]
        found = [r[c] for c in ("accuracy", "precision_macro", "recall_macro", "f1_macro", "avg_confidence")]
        assert found == pytest.approx(want)
    by_name = {r["project"]: r["f1_macro"] for r in got}
    assert by_name["one_class"] == 1.0 and by_name["never_right"] == 0.0


def test_absent_class_scores_zero(spark):
    df = spark.createDataFrame([(0, 0, 1.0)] * 3, "is_buggy int, yhat int, score double")
    row = metrics.class_metrics(metrics.confusion(df)).first()
    assert (row["f1_clean"], row["f1_buggy"], row["recall_buggy"]) == (1.0, 0.0, 0.0)


def test_ranking_orders_ties_by_name(spark):
    df = spark.createDataFrame([("b", 0.5, 1), ("a", 0.5, 2), ("c", 0.9, 3)], "project string, f1_macro double, samples int")
    got = metrics.project_ranking(df).orderBy("place").collect()
    assert [(r["place"], r["project"]) for r in got] == [(1, "c"), (2, "a"), (3, "b")]


def test_score_logits(spark):
    rows = spark.createDataFrame([([0.0, 0.0],), ([1000.0, 0.0],), ([-1.0, 2.0],)], "z array<double>")
    got = [r[0] for r in rows.select(score_logits(F.col("z"))).collect()]
    assert [g["label"] for g in got] == ["clean", "clean", "buggy"]
    assert got[0]["score"] == 0.5 and got[1]["score"] == 1.0
    biased = rows.select(score_logits(F.col("z"), (1.0, 2.0))["score"]).first()[0]
    assert biased == pytest.approx(2 / 3)


def stop_model(steps, patience, threshold):
    best, wait = None, 0
    for step, f1 in steps:
        if best is None or f1 > best + threshold:
            best, wait = f1, 0
        else:
            wait += 1
            if wait >= patience:
                return step, best
    return None, best


def test_early_stop(spark, rng):
    runs = {}
    for run in range(60):
        level, steps = 0.0, []
        for step in range(rng.randint(1, 80)):
            level = min(1.0, level + rng.choice([0, 0, 0.0005, 0.002, 0.01, -0.01]))
            steps.append((step * 100, round(level, 4)))
        runs[run] = steps
    rows = [(r, s, f) for r, steps in runs.items() for s, f in steps]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "run_id int, step bigint, f1 double")
    for patience in (1, 3, 8):
        got = history.early_stop(df, patience).collect()
        assert {r["run_id"]: (r["stop_step"], r["best_f1"]) for r in got} == {
            run: stop_model(steps, patience, 0.001) for run, steps in runs.items()
        }


def test_early_stop_keeps_a_short_list_of_a_long_run(spark):
    """A run of 20,000 steps that gains each step up to a plateau is folded from its start."""
    df = spark.range(20000).select(
        F.lit(1).alias("run_id"), F.col("id").alias("step"),
        F.least(F.col("id") * 0.01, F.lit(0.9)).alias("f1"),
    )
    row = history.early_stop(df, 3, 0.001).first()
    assert (row["stop_step"], row["best_f1"]) == (93, 0.9)
    with pytest.raises(ValueError):
        history.early_stop(df, 3, 0.0)


def test_early_stop_of_a_rising_run_takes_few_jobs(spark):
    """A million steps that gain each time but at their end, beside short runs."""
    n = 1_000_000
    long = spark.range(n).selectExpr("1 AS run_id", "id AS step", f"least(id, {n - 50}) * 1.0D AS f1")
    short = spark.range(300).selectExpr("2 + id AS run_id", "0L AS step", "0.5D AS f1")
    df = long.union(short.selectExpr("int(run_id)", "step", "f1"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("early stop", "")
    try:
        got = {r["run_id"]: (r["stop_step"], r["best_f1"]) for r in history.early_stop(df, 3, 0.5, 256).collect()}
    finally:
        jobs = len(tracker.getJobIdsForGroup("early stop"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got.pop(1) == (n - 50 + 3, n - 50.0) and set(got.values()) == {(None, 0.5)} and len(got) == 300
    assert 0 < jobs < 40


def test_turned_away_batches_keep_their_rows(spark):
    sizes = {"a": 1, "b": 100, "c": 101, "d": 5000, None: 102}
    rows = spark.createDataFrame([(b, i) for b, n in sizes.items() for i in range(n)], "b string, id int")
    got = {r["b"]: (r["n"], r["reason"]) for r in filters.batch_verdicts(rows, "b").groupBy("b", "reason").agg(F.count("*").alias("n")).collect()}
    assert got == {b: (n, None if n <= 100 else "batch too large") for b, n in sizes.items()}


@pytest.mark.parametrize("block", [4096, 7])
def test_early_stop_with_scores_that_are_none(spark, block):
    nan, inf = float("nan"), float("inf")
    slow = [0.01 * min(k, 29) for k in range(100)]
    runs = {
        1: slow,
        2: slow[:40] + [nan] + slow[41:],
        3: [nan, nan, 0.5, 0.6],
        4: [nan, nan, nan, 0.5],
        5: [0.1, inf, 0.5, 0.6, 0.7],
        6: [0.1, -inf, 0.5, None, None, None, 0.9],
        None: [0.5, 0.4, 0.4, 0.4],
        7: [None],
        8: [float(k) for k in range(50)] + [0.0] * 9,
    }
    rows = [(run, step, f1) for run, own in runs.items() for step, f1 in enumerate(own)] + [(1, None, 99.0)]
    df = spark.createDataFrame(rows, "run_id int, step int, f1 double").repartition(5)
    got = {r["run_id"]: (r["stop_step"], r["best_f1"]) for r in history.early_stop(df, 3, 0.001, block).collect()}

    def model(own):
        best, wait = None, 0
        for step, f1 in enumerate(own):
            if f1 is not None and f1 == f1 and (best is None or f1 > best + 0.001):
                best, wait = f1, 0
            else:
                wait += 1
                if wait >= 3:
                    return step, best
        return None, best

    assert got == {run: model(own) for run, own in runs.items()}
    assert got[1] == got[2] == (32, 0.29)


def test_best_step_passes_over_scores_that_are_none(spark):
    rows = [(1, 1, 0.5), (1, 2, float("nan")), (1, 3, 0.9), (1, 4, None), (2, 1, float("nan")), (None, 3, 0.1)]
    df = spark.createDataFrame(rows, "run_id int, step int, f1 double")
    got = {tuple(r) for r in history.best_step(df).collect()}
    assert got == {(1, 3, 0.9), (2, None, None), (None, 3, 0.1)}


def test_best_step_takes_the_earliest(spark):
    df = spark.createDataFrame([(1, 10, 0.5), (1, 5, 0.5), (1, 20, 0.1), (2, 1, 0.0)], "run_id int, step int, f1 double")
    assert sorted(map(tuple, history.best_step(df).collect())) == [(1, 5, 0.5), (2, 1, 0.0)]


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "is_buggy int")
    got = {r["label"]: r["weight"] for r in metrics.class_weights(df).collect()}
    assert got == {0: pytest.approx(4 / 6), 1: 2.0}


def test_length_profile_median(spark):
    rows = [("s", "x" * n, n % 2) for n in (1, 2, 4, 9)] + [("t", "abc", 1)]
    df = spark.createDataFrame(rows, "split string, code string, is_buggy int")
    got = {r["split"]: r for r in profile.length_profile(df).collect()}
    s = got["s"]
    assert (s["avg_length"], s["median_length"], s["min_length"], s["max_length"]) == (4.0, 3.0, 1, 9)
    assert s["buggy_ratio"] == 0.5 and got["t"]["median_length"] == 3.0


def test_validation(spark):
    rows = [("1", "en", 0), ("2", "xx", 1), ("3", None, 2), ("4", "en", None)]
    df = spark.createDataFrame(rows, "id string, source string, is_buggy int")
    found = validate.domain_violations(df, ["en"]).collect()
    assert sorted((r["id"], r["column"], r["value"]) for r in found if r["value"]) == [
        ("2", "source", "xx"), ("3", "is_buggy", "2")
    ]
    assert {(r["id"], r["column"]) for r in found if r["value"] is None} == {
        ("3", "source"), ("4", "is_buggy")
    }
    report = {r["column"]: r for r in validate.schema_report(df).collect()}
    assert report["is_buggy"]["ok"] and report["is_buggy"]["nulls"] == 1
    assert not report["code"]["ok"] and report["code"]["actual"] is None and report["code"]["nulls"] == 4
    preds = spark.createDataFrame(
        [(0.0, "buggy"), (1.0, "clean"), (1.1, "buggy"), (0.5, "odd"), (None, "buggy")], "score double, label string"
    )
    assert validate.prediction_violations(preds).count() == 3
