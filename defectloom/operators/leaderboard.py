"""Who contributed bugs, from a table of commits.

``commits`` holds one row per commit: ``project, bug, file, author, ts``. A file exists when
it has a commit. All steps are grouped aggregates with map-side partial results.
"""

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

# The files asked for an owner, in order, for all bugs and for verified bugs.
BUG_FILES = ("requirements.txt", "run_test.sh", "bug.info")
VERIFIED_FILES = ("run_test.sh", "requirements.txt", "bug.info")
WINDOW_DAYS = 7
PODIUM = 3


def top_authors(commits: DataFrame, as_of: datetime) -> DataFrame:
    """Author with the most commits per file, over all time and in the last week.

    Ties go to the first name. ``week_author`` is null without a commit in the window.
    """
    until = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    since = until - F.expr(f"INTERVAL {WINDOW_DAYS} DAYS")
    per_author = commits.groupBy("project", "bug", "file", "author").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ts") >= since).alias("n_week")
    )
    return (
        per_author.groupBy("project", "bug", "file")
        .agg(
            F.min(F.struct(-F.col("n"), "author")).alias("all_time"),
            F.min(F.when(F.col("n_week") > 0, F.struct(-F.col("n_week"), "author"))).alias("week"),
        )
        .select(
            "project",
            "bug",
            "file",
            F.col("all_time.author").alias("author"),
            F.col("week.author").alias("week_author"),
        )
    )


def owners(tops: DataFrame) -> DataFrame:
    """Owner per bug: the top author of the first of its files that exists.

    The files are asked in two orders, for all bugs (``owner``) and for verified ones
    (``checked_owner``). A later file counts only when the earlier ones are missing, not when
    they were quiet during the week.
    """

    def first_of(files):
        rank = F.array_position(F.array(*[F.lit(f) for f in files]), F.col("file"))
        return F.min(F.struct(rank.alias("rank"), "author", "week_author"))

    return (
        tops.where(F.col("file").isin(*BUG_FILES))
        .groupBy("project", "bug")
        .agg(first_of(BUG_FILES).alias("a"), first_of(VERIFIED_FILES).alias("c"))
        .select(
            "project",
            "bug",
            F.col("a.author").alias("owner"),
            F.col("a.week_author").alias("week_owner"),
            F.col("c.author").alias("checked_owner"),
            F.col("c.week_author").alias("checked_week_owner"),
        )
    )


def mark_verified(bug_owners: DataFrame, verified: DataFrame) -> DataFrame:
    """Owners with a flag for the bugs in ``verified``, distinct ``project, bug``."""
    flagged = verified.select("project", "bug", F.lit(True).alias("verified"))
    return bug_owners.join(flagged, ["project", "bug"], "left").withColumn(
        "verified", F.coalesce("verified", F.lit(False))
    )


def contributor_counts(board: DataFrame, week: bool = False) -> DataFrame:
    """Bugs and verified bugs per name, 0 without a verified one; all time or last week."""
    owner, checked = ("week_owner", "checked_week_owner") if week else ("owner", "checked_owner")
    credits = F.array(
        F.struct(F.col(owner).alias("name"), F.lit(1).alias("bug"), F.lit(0).alias("ok")),
        F.struct(
            F.when(F.col("verified"), F.col(checked)).alias("name"),
            F.lit(0).alias("bug"),
            F.lit(1).alias("ok"),
        ),
    )
    return (
        board.select(F.inline(credits))
        .where("name IS NOT NULL")
        .groupBy("name")
        .agg(F.sum("bug").alias("bugs"), F.sum("ok").alias("verified"))
        .where("bugs > 0")
    )


def podium(counts: DataFrame) -> DataFrame:
    """The three names with the most bugs; ties go to the last name."""
    return counts.orderBy(F.desc("bugs"), F.desc("name")).limit(PODIUM)


def totals(board: DataFrame) -> DataFrame:
    return board.agg(
        F.count(F.lit(1)).alias("bugs"), F.count_if(F.col("verified")).alias("verified")
    )
