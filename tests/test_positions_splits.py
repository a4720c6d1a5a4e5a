import pytest
from pyspark.sql import functions as F

from defectloom.operators import splits
from defectloom.operators.positions import with_position
from defectloom.operators.variants import shuffle_rows


def keyed(spark, n, parts):
    return spark.range(n).repartition(parts).select(
        F.concat(F.lit("k"), F.md5(F.col("id").cast("string"))).alias("id"), F.col("id").alias("n")
    )


@pytest.mark.parametrize("n, parts, buckets", [(0, 1, 16), (1, 1, 16), (5000, 7, 16), (5000, 3, 40)])
def test_global_positions(spark, n, parts, buckets):
    got = with_position(keyed(spark, n, parts), ["id"], buckets=buckets).collect()
    by_id = sorted(got, key=lambda r: r["id"])
    assert [r["pos"] for r in by_id] == list(range(n))


def test_positions_within_a_hot_group(spark):
    """One group holds most rows; it spans many buckets and stays exactly numbered."""
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("run"),
        (F.col("id") * 7919 % 6007).alias("step"),
    )
    placed = with_position(rows, ["step"], ["run"], buckets=32)
    by_run = {}
    for r in placed.collect():
        by_run.setdefault(r["run"], []).append((r["step"], r["pos"]))
    assert len(by_run["hot"]) == 4000
    for steps in by_run.values():
        assert [p for _, p in sorted(steps)] == list(range(len(steps)))


def test_buckets_are_even(spark):
    plan = with_position(keyed(spark, 20000, 4), ["id"], buckets=16)
    assert plan.select(F.max("pos")).first()[0] == 19999


def test_shuffle_does_not_depend_on_layout(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for shuffle, parts in ((1, 5), (4, 1), (16, 9)):
            spark.conf.set("spark.sql.shuffle.partitions", shuffle)
            rows = shuffle_rows(keyed(spark, 700, parts), seed=3).collect()
            results.append({r["id"]: r["pos"] for r in rows})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1] == results[2]
    assert sorted(results[0].values()) == list(range(700))
    assert results[0] != {i: p for p, i in enumerate(sorted(results[0]))}


def projects(spark, n):
    return spark.range(n * 3).select(
        F.col("id").cast("string").alias("id"),
        F.format_string("p%04d", F.col("id") % n).alias("project"),
        F.lit("main").alias("source"),
    )


@pytest.mark.parametrize("n", [0, 1, 2, 6, 17, 20, 90, 170, 180])
def test_sorted_split_truncates_in_double(spark, n):
    got = {r["project"]: r["split"] for r in splits.sorted_split(projects(spark, n)).collect()}
    train, val = int(0.7 * n), int(0.15 * n)
    names = [f"p{i:04d}" for i in range(n)]
    want = {p: "train" if i < train else "val" if i < train + val else "test" for i, p in enumerate(names)}
    assert got == want


def test_other_sources_are_held_out(spark):
    extra = projects(spark, 3).withColumn("source", F.lit("other"))
    rows = projects(spark, 20).unionByName(extra)
    got = splits.sorted_split(rows, main_source="main").groupBy("source", "split").count().collect()
    assert {(r["source"], r["split"]): r["count"] for r in got} == {
        ("main", "train"): 42, ("main", "val"): 9, ("main", "test"): 9, ("other", "eval"): 9
    }


def test_seeded_split(spark):
    rows = projects(spark, 40)
    one = splits.seeded_split(rows, seed=1).select("project", "split").distinct()
    assert {r["split"]: r["count"] for r in one.groupBy("split").count().collect()} == {
        "train": 28, "val": 4, "test": 8
    }
    again = splits.seeded_split(rows.repartition(11), seed=1).select("project", "split").distinct()
    other = splits.seeded_split(rows, seed=2).select("project", "split").distinct()
    assert sorted(one.collect()) == sorted(again.collect()) != sorted(other.collect())
    assert splits.leaking_projects(splits.seeded_split(rows)).count() == 0


def test_ratios_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        splits.seeded_split(projects(spark, 3), 0.5, 0.1, 0.1)


def test_leak_is_found(spark):
    rows = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "val")], "project string, split string")
    assert [r["project"] for r in splits.leaking_projects(rows).collect()] == ["a"]


def test_shuffled_rows_move_once(spark):
    """The numbering looks at keys; the wide column is in one exchange only."""
    rows = keyed(spark, 500, 4).selectExpr("string(id) AS id", "repeat(string(id), 20) AS code")
    plan = shuffle_rows(rows, seed=3)._jdf.queryExecution().optimizedPlan().toString()
    wide = [line for line in plan.split("\n") if "Window" in line and "code" in line]
    assert len(wide) <= 1
    explained = shuffle_rows(rows, seed=3)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    moved = [part for part in explained.split("\n\n") if ") Exchange" in part.split("\n")[0] and "code#" in part]
    assert len(moved) == 1


def test_rows_per_bucket_keeps_positions(spark):
    got = with_position(keyed(spark, 5000, 3).withColumn("w", F.col("n") % 4), ["id"], weight="w", rows_per_bucket=50).collect()
    want, at = [], 0
    for r in sorted(got, key=lambda r: r["id"]):
        want.append(at)
        at += r["w"]
    assert [r["pos"] for r in sorted(got, key=lambda r: r["id"])] == want
