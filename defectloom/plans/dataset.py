"""From raw folders to a split, measured table."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from defectloom.operators.profile import split_statistics, with_all_splits
from defectloom.operators.splits import sorted_split
from defectloom.sources.bug_tree import bug_tree_samples, scan_bug_tree
from defectloom.sources.code_dirs import code_dir_samples
from defectloom.sources.reports import save_text, stats_json
from defectloom.sources.samples import save_splits


@dataclass(frozen=True)
class DataSettings:
    bug_root: str
    code_root: str
    out: str
    main_source: str = "bug_tree"
    eval_source: str = "code_dirs"
    sides: str = "split"
    train_ratio: float = 0.7
    val_ratio: float = 0.15


def extract(spark: SparkSession, settings: DataSettings) -> DataFrame:
    """Labelled rows of both sources."""
    tree = scan_bug_tree(spark, settings.bug_root)
    return bug_tree_samples(tree, settings.main_source, settings.sides).unionByName(
        code_dir_samples(spark, settings.code_root, settings.eval_source)
    )


def prepare(spark: SparkSession, settings: DataSettings) -> DataFrame:
    """Extract, split, write the splits and their statistics; returns the written table."""
    rows = sorted_split(
        extract(spark, settings), settings.train_ratio, settings.val_ratio, settings.main_source
    )
    table = f"{settings.out}/splits"
    save_splits(rows, table)
    written = spark.read.parquet(table)
    stats = with_all_splits(split_statistics(written))
    save_text(stats_json(stats), f"{settings.out}/stats")
    return written
