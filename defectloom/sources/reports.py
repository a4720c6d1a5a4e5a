"""Small reports: statistics as JSON and as text, the leaderboard page, the model card.

Everything here starts from an aggregate with a handful of rows (one per split, three per
podium), so gathering it into one row is bounded.
"""

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from defectloom.functions.text import balance_band, length_band, safe_ratio
from defectloom.schema import SPLITS

STATS = (
    "map<string,struct<samples:bigint,buggy:bigint,clean:bigint,projects:bigint,"
    "avg_length:double>>"
)
# Column layout and rules of the text report.
COLUMNS = ("Split", "Samples", "Buggy", "Clean", "Ratio", "Projects", "Avg Len")
LAYOUT = "%-15s %-10s %-8s %-8s %-8s %-10s %-10s"
WIDTH = 80


def stats_json(stats: DataFrame) -> DataFrame:
    """One line of JSON: split -> statistics. The held-out set has no project count."""
    projects = F.when(F.col("split") != "eval", F.col("projects"))
    entry = F.struct(
        "split", F.struct("samples", "buggy", "clean", projects.alias("projects"), "avg_length")
    )
    return stats.agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("value")
    )


def save_text(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def load_stats(spark: SparkSession, path: str) -> DataFrame:
    """Statistics per split from the JSON written above."""
    parsed = spark.read.text(path).select(F.explode(F.from_json("value", STATS)))
    return parsed.select(F.col("key").alias("split"), "value.*")


def _split_place():
    return F.array_position(F.array(*[F.lit(s) for s in SPLITS]), F.col("split"))


def _rule(mark: str):
    return F.lit(mark * WIDTH)


def stats_report(stats: DataFrame) -> DataFrame:
    """The statistics table and its summary as numbered lines of text."""
    is_eval = F.col("split") == "eval"
    ratio = F.format_string("%.3f", safe_ratio(F.col("buggy"), F.col("samples")))
    # Half to even, as C's printf does.
    length = F.bround("avg_length", 0).cast("long")
    line = F.format_string(
        LAYOUT,
        "split",
        F.col("samples").cast("string"),
        F.col("buggy").cast("string"),
        F.col("clean").cast("string"),
        ratio,
        F.when(is_eval, "1").otherwise(F.col("projects").cast("string")),
        F.coalesce(length.cast("string"), F.lit("-")),
    )

    def total(name, chosen):
        return F.coalesce(F.sum(F.when(chosen, F.col(name))), F.lit(0))

    gathered = stats.agg(
        F.sort_array(
            F.collect_list(F.struct(_split_place().alias("o"), line.alias("line")))
        ).alias("rows"),
        *[total(name, ~is_eval).alias(name) for name in ("samples", "buggy", "clean")],
        *[total(name, is_eval).alias(f"eval_{name}") for name in ("samples", "buggy", "clean")],
    )
    percent = safe_ratio(F.col("buggy") * 100, F.col("samples"))
    head = [_rule("="), F.lit("DATASET STATISTICS"), _rule("="), F.lit(LAYOUT % COLUMNS), _rule("-")]
    foot = [
        _rule("-"),
        _rule("="),
        F.lit("SUMMARY"),
        _rule("="),
        F.format_string("Total training samples (train + val + test): %,d", "samples"),
        F.format_string("Total buggy samples: %d", "buggy"),
        F.format_string("Total clean samples: %d", "clean"),
        F.format_string("Overall buggy ratio: %.1f%%", percent),
        F.format_string("Evaluation set: %d samples", "eval_samples"),
        F.format_string("  Buggy: %d, Clean: %d", "eval_buggy", "eval_clean"),
    ]
    lines = F.concat(F.array(*head), F.col("rows.line"), F.array(*foot))
    return gathered.select(F.posexplode(lines).alias("line_no", "value"))


def detail_report(wide: DataFrame) -> DataFrame:
    """The wide statistics of every split as numbered lines of text."""
    ratio = F.col("buggy_ratio")

    def whole(name):
        return F.bround(name, 0).cast("long")

    block = F.array(
        F.lit(""),
        F.concat(F.upper("split"), F.lit(" SPLIT:")),
        F.format_string("  Total samples: %,d", "samples"),
        F.format_string("  Buggy samples: %,d (%.1f%%)", "buggy", ratio * 100),
        F.format_string("  Clean samples: %,d (%.1f%%)", "clean", (1 - ratio) * 100),
        F.format_string("  Projects: %d", "projects"),
        F.lit("  Code length statistics:"),
        F.format_string("    Average: %d characters", whole("avg_length")),
        F.format_string("    Median: %d characters", whole("median_length")),
        F.format_string("    Min: %d characters", "min_length"),
        F.format_string("    Max: %d characters", "max_length"),
    )
    rows = F.sort_array(F.collect_list(F.struct(_split_place().alias("o"), block.alias("lines"))))
    head = F.array(_rule("="), F.lit("DETAILED STATISTICS"), _rule("="))
    gathered = wide.agg(rows.alias("rows"))
    return gathered.select(
        F.posexplode(F.concat(head, F.flatten("rows.lines"))).alias("line_no", "value")
    )


# What the report says about a band.
LENGTH_LINES = {
    "short": "    Short code (< 500 chars): Likely function-level snippets",
    "medium": "    Medium code (500-1000 chars): Function or small module",
    "long": "    Long code (> 1000 chars): Module or file-level code",
}
BALANCE_LINES = {
    "well balanced": "  Status: Well balanced",
    "moderately balanced": "  Status: Moderately balanced",
    "somewhat imbalanced": "  Status: Somewhat imbalanced",
    "highly imbalanced": "  Status: Highly imbalanced (consider class weights)",
}


def band_report(wide: DataFrame) -> DataFrame:
    """The length and balance sections, split by split, as numbered lines of text."""

    def worded(band, lines: dict):
        said = F.when(F.lit(False), "")
        for name, line in lines.items():
            said = said.when(band == name, line)
        return said

    def whole(name):
        return F.bround(name, 0).cast("long")

    band = worded(length_band(F.col("avg_length")), LENGTH_LINES)
    lengths = F.array(
        F.lit(""),
        F.concat(F.upper("split"), F.lit(":")),
        F.format_string("  Average length: %d characters", whole("avg_length")),
        F.format_string("  Median length: %d characters", whole("median_length")),
        F.format_string("  Range: %d - %d characters", "min_length", "max_length"),
        F.when(band.isNotNull(), "  Length distribution:"),
        band,
    )
    balance = F.array(
        F.lit(""),
        F.concat(F.upper("split"), F.lit(":")),
        F.format_string("  Buggy ratio: %.1f%%", F.col("buggy_ratio") * 100),
        worded(balance_band(F.col("buggy_ratio")), BALANCE_LINES),
    )
    ordered = F.sort_array(
        F.collect_list(F.struct(_split_place().alias("o"), lengths.alias("l"), balance.alias("b")))
    )
    gathered = wide.agg(ordered.alias("rows"))
    lines = F.concat(
        F.array(_rule("="), F.lit("CODE LENGTH ANALYSIS"), _rule("=")),
        F.flatten("rows.l"),
        F.array(F.lit(""), _rule("="), F.lit("CLASS BALANCE ANALYSIS"), _rule("=")),
        F.flatten("rows.b"),
    )
    said = F.filter(lines, lambda line: line.isNotNull())
    return gathered.select(F.posexplode(said).alias("line_no", "value"))


def evaluation_document(report: DataFrame) -> DataFrame:
    """The evaluation report as one JSON document: test, held-out rows and each test project.

    One entry per project is gathered, as the document itself holds one.
    """
    figures = F.struct(*[c for c in report.columns if c not in ("section", "name")])
    kept = report.select("section", "name", figures.alias("figures"))

    def alone(section):
        return F.max(F.when(F.col("section") == section, F.col("figures"))).alias(section)

    project = F.when(F.col("section") == "project", F.struct("name", "figures"))
    projects = F.map_from_entries(F.sort_array(F.collect_list(project))).alias("projects")
    whole = kept.agg(alone("test"), alone("held_out"), projects)
    return whole.select(F.to_json(F.struct("test", "held_out", "projects")).alias("value"))


def leaderboard_page(
    title: str, all_time: DataFrame, week: DataFrame, totals: DataFrame
) -> DataFrame:
    """The leaderboard as numbered lines of markdown, from two podiums and the totals."""
    row = F.concat_ws(" | ", "name", F.col("bugs").cast("string"), F.col("verified").cast("string"))

    def table(podium: DataFrame, name: str) -> DataFrame:
        best_first = F.struct((-F.col("bugs")).alias("o"), F.col("name").alias("who"), row.alias("line"))
        by_bugs = F.array_sort(
            F.collect_list(best_first),
            lambda a, b: F.when(a["o"] != b["o"], F.when(a["o"] < b["o"], -1).otherwise(1))
            .when(a["who"] > b["who"], -1)
            .when(a["who"] < b["who"], 1)
            .otherwise(0),
        )
        return podium.agg(by_bugs["line"].alias(name))

    names = [F.lit("Name | Bugs Data | Verified Bugs Data"), F.lit("--- | --- | --- ")]
    page = totals.select(
        F.concat(
            F.array(F.lit(f"# {title}"), F.lit("##  Top 3 Contributors (of all time)"), *names),
            table(all_time, "lines").scalar(),
            F.array(F.lit("##  Top 3 Contributors (last week)"), *names),
            table(week, "lines").scalar(),
            F.array(
                F.format_string("#### Total data : %d", "bugs"),
                F.format_string("#### Total verified bugs data : %d", "verified"),
            ),
        ).alias("lines")
    )
    return page.select(F.posexplode("lines").alias("line_no", "value"))


def model_card(metrics: DataFrame, model: dict, settings: dict, created_at: str) -> DataFrame:
    """One line of JSON about a model; ``metrics`` is a one-row table."""
    about = {**model, "training_config": settings, "created_at": created_at}
    text = json.dumps(about, sort_keys=True)
    return metrics.select(
        F.concat(
            F.lit(text[:-1] + ', "metrics": '), F.to_json(F.struct("*")), F.lit("}")
        ).alias("value")
    )
