import json
import os

import pytest
from pyspark.sql import functions as F

from defectloom.plans.dataset import DataSettings, prepare
from defectloom.schema import SAMPLE
from defectloom.sources import bug_tree, code_dirs, layout, reports, samples
from defectloom.sources import test_cases as cases
from defectloom.sources import verify_log
from defectloom.workspace import work_dir


def put(root, path, content):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(content if isinstance(content, bytes) else content.encode())


@pytest.fixture
def code_root(tmp_path):
    root = tmp_path / "code"
    bad, good = code_dirs.DEFECT_DIR, code_dirs.FIX_DIR
    put(root, f"{bad}/one.py", "def one(x):\r\n    return x\r\n")
    put(root, f"{good}/one.py", "def one(x):\n    return x + 1\n")
    put(root, f"{bad}/same.py", "\n x = 1 \n")
    put(root, f"{good}/same.py", "x = 1")
    put(root, f"{bad}/lonely.py", "x")
    put(root, f"{good}/nobody.py", "x")
    put(root, f"{bad}/empty.py", "")
    put(root, f"{good}/empty.py", "y")
    put(root, f"{bad}/latin.py", b"x = '\xe9'\n")
    put(root, f"{good}/latin.py", "x = 'e'\n")
    put(root, f"{bad}/notes.txt", "no code")
    put(root, f"{bad}/sub/deep.py", "x = 1")
    put(root, f"{good}/deep.py", "x = 2")
    put(root, f"{bad}/long.py", "a = 1\n" * 1000)
    put(root, f"{good}/long.py", "b = 1\n" * 1000)
    return str(root)


def test_code_dirs(spark, code_root):
    rows = code_dirs.code_dir_samples(spark, code_root, "programs").orderBy("id").collect()
    assert [r["id"] for r in rows] == [
        "programs_long_buggy", "programs_long_fixed", "programs_one_buggy", "programs_one_fixed"
    ]
    one = rows[2].asDict()
    assert one == {
        "id": "programs_one_buggy", "source": "programs", "project": "programs",
        "path": f"{code_dirs.DEFECT_DIR}/one.py", "func_name": "one",
        "code": "def one(x):\n    return x\n", "is_buggy": 1, "pair_id": "programs_one",
    }
    assert len(rows[0]["code"]) > 4000 and set(rows[0]["code"].split("\n")) == {"a = 1", ""}
    cut = code_dirs.code_dir_samples(spark, code_root, "programs", 4000).orderBy("id").first()
    assert cut["code"] == "\n".join(["a = 1"] * 666)


def test_layout_is_checked(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match=code_dirs.FIX_DIR):
        os.makedirs(tmp_path / code_dirs.DEFECT_DIR)
        code_dirs.code_dir_samples(spark, str(tmp_path), "x")
    with pytest.raises(FileNotFoundError):
        bug_tree.scan_bug_tree(spark, str(tmp_path))
    assert layout.path_exists(spark, str(tmp_path))


PATCH = "--- a\n+++ b\n@@ -1,2 +1,2 @@\n x\n-y\n@@ -5,2 +5,2 @@\n keep\n-old\n+new\n"


@pytest.fixture
def bug_root(tmp_path):
    root = tmp_path / "tree"
    put(root, "projects/p1/bugs/1/bug.info", 'test_file="t/a.py"\nline_number="3"\n')
    put(root, "projects/p1/bugs/1/bug_patch.txt", PATCH)
    put(root, "projects/p1/bugs/2/bug.info", "status=OK\r\n")
    put(root, "projects/p1/bugs/2/bug_patch.txt", "@@ -1,1 +1,2 @@\r\n+only new\r\n")
    put(root, "projects/p1/bugs/3/bug_patch.txt", PATCH)
    put(root, "projects/p1/bugs/old/bug.info", "a=b")
    put(root, "projects/p1/bugs/old/bug_patch.txt", PATCH)
    put(root, "projects/p2/bugs/1/bug.info", "a=b")
    put(root, "projects/p2/bugs/1/bug_patch.txt", b"@@ -1,1 +1,1 @@\n+\xff\n")
    put(root, "projects/p2/bugs/7/bug.info", "a=b")
    put(root, "projects/p2/bugs/7/bug_buggy.py", "x")
    put(root, "projects/p2/bugs/7/bug_patch.txt", PATCH)
    return str(root)


def test_bug_tree(spark, bug_root):
    tree = bug_tree.scan_bug_tree(spark, bug_root)
    found = {(r["project"], r["bug"]): r["patch"] is not None for r in tree.collect()}
    assert found == {("p1", "1"): True, ("p1", "2"): True, ("p2", "1"): False, ("p2", "7"): True}
    whole = {r["id"]: r["code"] for r in bug_tree.bug_tree_samples(tree, "tree").collect()}
    assert whole["p1_1_buggy"] == "x\ny\nkeep\nold"
    rows = {r["id"]: r for r in bug_tree.bug_tree_samples(tree, "tree", hunks="last").collect()}
    assert sorted(rows) == [
        "p1_1_buggy", "p1_1_fixed", "p1_2_fixed", "p2_7_buggy", "p2_7_fixed"
    ]
    assert rows["p1_1_buggy"]["code"] == "keep\nold"
    assert rows["p1_1_fixed"]["code"] == "keep\nnew"
    assert rows["p1_1_fixed"]["path"] == "t/a.py"
    assert rows["p1_2_fixed"]["path"] == "unknown"
    assert rows["p1_2_fixed"]["func_name"] == "module"


def test_bug_tree_same_sides(spark, bug_root):
    tree = bug_tree.scan_bug_tree(spark, bug_root)
    rows = {r["id"]: r["code"] for r in bug_tree.bug_tree_samples(tree, "t", "same", 9, "last").collect()}
    assert rows["p1_1_buggy"] == rows["p1_1_fixed"] == "keep\nold"
    with pytest.raises(ValueError):
        bug_tree.bug_tree_samples(tree, "t", "both")


def test_prepare_writes_splits_and_statistics(spark, bug_root, code_root, tmp_path):
    out = str(tmp_path / "out")
    table = prepare(spark, DataSettings(bug_root, code_root, out))
    assert table.groupBy("split").count().count() >= 2
    stats = {r["split"]: r for r in reports.load_stats(spark, f"{out}/stats").collect()}
    assert stats["eval"]["samples"] == 4 and stats["eval"]["projects"] is None
    assert sum(r["samples"] for r in stats.values()) == table.count() == 9
    # Two projects: none for train and val, which stay in the statistics.
    assert sorted(stats) == ["eval", "test", "train", "val"]
    assert (stats["val"]["samples"], stats["val"]["avg_length"]) == (0, None)
    assert set(samples.load_split(spark, f"{out}/splits", "eval").columns) == set(SAMPLE.names)


def test_missing_table_is_empty_and_typed(spark, tmp_path):
    empty = samples.load_samples(spark, str(tmp_path / "none"))
    assert empty.schema == SAMPLE and empty.count() == 0


def test_test_cases(spark):
    lines = ["[5, 1]", '[[1, "a"], [2]]', '["x\\"y", null]', "[{\"a\": [1]}, 2.5]", "[[], true]"]
    got = cases.normalise_test_cases(spark.createDataFrame([(l,) for l in lines], "value string")).collect()
    for line, row in zip(lines, got):
        given, wanted = json.loads(line)
        assert json.loads(row["input"]) == (given if isinstance(given, list) else [given])
        assert json.loads(row["expected"]) == wanted


def test_scan_test_cases(spark, tmp_path):
    put(tmp_path, "gcd.json", "[[1, 2], 1]\n\n[5, 5]\n")
    put(tmp_path, "detect_cycle.json", "[1, 2]\n")
    put(tmp_path, "notes.txt", "x")
    got = cases.normalise_test_cases(cases.scan_test_cases(spark, str(tmp_path)))
    assert sorted(map(tuple, got.collect())) == [("gcd", "[1,2]", "1"), ("gcd", "[5]", "5")]


def test_scan_verify_logs(spark, tmp_path):
    put(tmp_path, "projects/p1/p1-pass.txt", "bugs/3 (FAIL)\nPASS: bugs/4\n\n")
    put(tmp_path, "projects/p1/other-pass.txt", "bugs/9\n")
    put(tmp_path, "projects/p2/p2-pass.txt", "bugs/5\nbugs/5\n")
    got = verify_log.verified_ids(verify_log.scan_verify_logs(spark, str(tmp_path)))
    assert sorted(map(tuple, got.collect())) == [("p1", "3"), ("p2", "5")]


def test_verified_ids(spark):
    lines = [
        ("p", "bugs/12 (FAIL)"), ("p", "a/b/12(again)"), ("p", "PASS: bugs/3"), ("p", ""), ("p", "  "),
        ("p", "7 is broken"), ("q", "bugs/12 x"), ("p", "(nothing)"), ("p", " PASS: x"),
    ]
    got = verify_log.verified_ids(spark.createDataFrame(lines, "project string, line string"))
    assert sorted(map(tuple, got.collect())) == [("p", "12"), ("p", "7"), ("q", "12")]


def test_stats_report_of_an_empty_held_out_set(spark):
    stats = spark.createDataFrame(
        [("train", 3, 1, 2, 2, 12.5, 1 / 3)],
        "split string, samples bigint, buggy bigint, clean bigint, projects bigint, avg_length double, r double",
    )
    lines = [r["value"] for r in reports.stats_report(stats).orderBy("line_no").collect()]
    assert "train           3          1        2        0.333    2          12        " in lines
    assert "Overall buggy ratio: 33.3%" in lines and "Evaluation set: 0 samples" in lines


def test_model_card_is_json(spark, tmp_path):
    metrics = spark.createDataFrame([(0.5, 3)], "accuracy double, samples int")
    card = reports.model_card(metrics, {"model_name": "m"}, {"epochs": 3}, "2024-01-01")
    reports.save_text(card, str(tmp_path / "card"))
    found = json.loads(spark.read.text(str(tmp_path / "card")).first()[0])
    assert found == {
        "created_at": "2024-01-01", "model_name": "m", "training_config": {"epochs": 3},
        "metrics": {"accuracy": 0.5, "samples": 3},
    }


def test_work_dir_follows_the_session(spark):
    assert work_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
