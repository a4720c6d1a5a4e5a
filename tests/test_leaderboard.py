from datetime import datetime

import pytest

from defectloom.operators import leaderboard as L
from defectloom.sources.reports import leaderboard_page

AS_OF = datetime(2024, 1, 31)
OLD, NEW = datetime(2024, 1, 1), datetime(2024, 1, 30)
REQ, RUN, INFO = "requirements.txt", "run_test.sh", "bug.info"


@pytest.fixture
def commits(spark):
    rows = [
        # Quiet during the week: no week owner, though another file has fresh commits.
        ("p", "1", REQ, "ann", OLD), ("p", "1", RUN, "bob", NEW),
        # Tie on commits goes to the first name; the week has its own winner.
        ("p", "2", RUN, "bob", OLD), ("p", "2", RUN, "ann", OLD), ("p", "2", RUN, "cat", NEW),
        ("p", "2", INFO, "dan", NEW),
        # Same number in another project is another bug.
        ("q", "1", INFO, "dan", NEW), ("q", "1", INFO, "dan", NEW), ("q", "1", INFO, "ann", OLD),
    ]
    return spark.createDataFrame(rows, "project string, bug string, file string, author string, ts timestamp_ntz")


def test_owners(commits):
    got = {(r["project"], r["bug"]): tuple(r)[2:] for r in L.owners(L.top_authors(commits, AS_OF)).collect()}
    assert got == {
        ("p", "1"): ("ann", None, "bob", "bob"),
        ("p", "2"): ("ann", "cat", "ann", "cat"),
        ("q", "1"): ("dan", "dan", "dan", "dan"),
    }


def test_counts_and_podium(spark, commits):
    verified = spark.createDataFrame([("p", "1"), ("q", "1"), ("q", "99")], "project string, bug string")
    board = L.mark_verified(L.owners(L.top_authors(commits, AS_OF)), verified)
    counts = L.contributor_counts(board)
    # bob owns a verified bug only by the second order of files, and no bug by the first.
    assert sorted(map(tuple, counts.collect())) == [("ann", 2, 0), ("dan", 1, 1)]
    week = L.contributor_counts(board, week=True)
    assert sorted(map(tuple, week.collect())) == [("cat", 1, 0), ("dan", 1, 1)]
    assert [r["name"] for r in L.podium(week).collect()] == ["dan", "cat"]
    assert tuple(L.totals(board).first()) == (3, 2)
    page = leaderboard_page("Bugs", L.podium(counts), L.podium(week), L.totals(board))
    lines = [r["value"] for r in page.orderBy("line_no").collect()]
    assert lines[0] == "# Bugs" and lines[4:6] == ["ann | 2 | 0", "dan | 1 | 1"]
    assert lines[-2:] == ["#### Total data : 3", "#### Total verified bugs data : 2"]
