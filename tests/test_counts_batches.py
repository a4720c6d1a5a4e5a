"""The classifier in closed form against plain Python, and the batch limit in a stream."""

import hashlib
import random
from collections import Counter
from dataclasses import replace
from datetime import datetime, timedelta
from math import exp, log

import pytest
from pyspark.sql import functions as F

from defectloom.operators import counts_model
from defectloom.operators.tokens import TOKEN
from defectloom.plans import training
from defectloom.streaming.batches import TOO_LARGE, start_batches

import regex

N = 64


def brute_buckets(code):
    tokens = regex.findall(TOKEN, code or "", flags=regex.ASCII)
    return {int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % N for t in tokens}


def brute_weights(rows):
    texts = Counter(label for _, label in rows)
    seen = {label: Counter(b for code, own in rows if own == label for b in brute_buckets(code)) for label in (0, 1)}
    share = {label: lambda b, c=label: (seen[c][b] + 1) / (texts[c] + 2) for label in (0, 1)}
    return [
        round(counts_model.UNIT * (log(share[1](b)) - log(share[0](b)))) if seen[0][b] + seen[1][b] else 0 for b in range(N)
    ]


def labelled():
    rng = random.Random(1)
    names = [f"v{k}" for k in range(40)]
    rows = []
    for _ in range(120):
        label = int(rng.random() < 0.3)
        own = [rng.choice(names[10 * label : 10 * label + 30]) for _ in range(12)]
        rows.append((" + ".join(own), label))
    return rows + [("", 0), (None, 1), ("v1 " * 50_000, 1), ("v2", None), *[("x == y", 0)] * 3]


def test_counts_are_those_of_plain_python(spark):
    rows = labelled()
    table = spark.createDataFrame(rows, "code string, is_buggy int").repartition(5)
    fitted = counts_model.fit(table, N)
    want = brute_weights(rows)
    assert [r.weight for r in fitted.orderBy("bucket").collect()] == want
    got = counts_model.predict(fitted, table.select("code", F.lit("mine").alias("weight")).distinct()).collect()
    for r in got:
        margin = sum(want[b] for b in brute_buckets(r.code)) / counts_model.UNIT
        assert r.yhat == (margin > 0) and r.weight == "mine"
        assert r.score == pytest.approx(1 / (1 + exp(-abs(margin))))
        assert r.label == ("buggy" if margin > 0 else "clean")
    assert {(r.yhat, r.score) for r in got if not r.code} == {(0, 0.5)}


def test_nothing_to_fit_on(spark):
    none = spark.createDataFrame([], "code string, is_buggy int")
    fitted = counts_model.fit(none, N)
    assert fitted.count() == N and fitted.where("weight <> 0").count() == 0
    assert counts_model.predict(fitted, none).count() == 0


def test_fitting_shuffles_counts_only(spark):
    table = spark.createDataFrame(labelled(), "code string, is_buggy int")
    plan = counts_model.fit(table, N)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_counted_classifier_runs_the_whole_job(spark, tmp_path):
    rows = [
        (f"r{i}", "s", f"p{i % 9}", "x", "g", "return bad / 0" if i % 2 else "return good + 1", i % 2, f"r{i}",
         ("train", "test", "eval")[i % 9 // 3])
        for i in range(90)
    ]
    df = spark.createDataFrame(
        rows,
        "id string, source string, project string, path string, func_name string, code string, is_buggy int, pair_id string, split string",
    )
    settings = replace(training.TrainSettings(), n_features=1 << 10, classifier="counts")
    report = training.run(df, settings, str(tmp_path / "run")).collect()
    assert {r["section"] for r in report} == {"test", "project", "held_out"}
    plain = training.evaluate(training.train(df, settings), df).collect()
    assert all(r["accuracy"] == 1.0 for r in plain)
    again = spark.read.parquet(str(tmp_path / "run" / "model"))
    assert training.score_table(again, df).count() == 60


START = datetime(2024, 1, 1)
SCHEMA = "id bigint, name string, code string, at timestamp"


def test_batches_over_several_files(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def arrive(rows, minutes):
        rows = [(i, name, code, START + timedelta(minutes=minutes)) for i, name, code in rows]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        requests = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        start_batches(requests, "name", "at", out, state, lateness="10 minutes", max_batch=3).awaitTermination()
        found = spark.read.schema("id bigint, batch string, code string, reason string, status string").parquet(out)
        return Counter((r.id, r.batch, r.status, r.reason) for r in found.collect())

    big = 1 << 60
    arrive([(1, "small", "x"), (2, "large", "x"), (3, "large", None), (big + 1, None, "y")], 0)
    # Nothing is decided before the watermark has passed.
    assert not run()
    arrive([(4, "small", " "), (5, "large", "x"), (6, "large", "x")], 1)
    large = {(k, "large", "rejected", TOO_LARGE) for k in (2, 3, 5, 6)}
    assert set(run()) == large
    arrive([(7, "large", "x"), (8, "small", "x")], 2)
    large.add((7, "large", "rejected", TOO_LARGE))
    assert set(run()) == large
    arrive([(None, None, None), (9, "later", "x")], 60)
    done = run()
    want = large | {
        (1, "small", "accepted", None), (4, "small", "rejected", "blank"), (8, "small", "accepted", None),
        (big + 1, None, "accepted", None),
    }
    assert set(done) == want and max(done.values()) == 1
    arrive([(None, None, None)], 120)
    assert set(run()) == want | {(9, "later", "accepted", None)}


def test_a_batch_that_holds_most_rows_leaves_a_small_state(spark, tmp_path):
    rows = [(k, "hot" if k % 3 else f"b{k % 700}", "x", START) for k in range(6000)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(source)
    last = [(None, None, None, START + timedelta(days=1))]
    spark.createDataFrame(last, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    requests = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(source)
    query = start_batches(requests, "name", "at", str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    got = {r.status: r.n for r in found.groupBy("status").agg(F.count("id").alias("n")).collect()}
    assert got == {"accepted": 2000, "rejected": 4000}
    assert found.select("id").distinct().count() == 6000
    assert all(p["stateOperators"][0]["memoryUsedBytes"] < 5_000_000 for p in query.recentProgress if p["stateOperators"])
