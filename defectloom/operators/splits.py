"""Train / val / test by project, so that no project is in two splits.

Projects are put in an order and cut into three ranges. Two project keys describe the whole
split; they are computed once, over the distinct projects, and every row is compared with
them. So the split moves no rows, and filters on it reach the scan.
"""

from pyspark.sql import Column, DataFrame, functions as F

from defectloom.functions.draws import shuffle_key
from defectloom.operators.positions import with_position
from defectloom.workspace import work_dir


TOLERANCE = 1e-6


def ratios_fit(train, val, test) -> Column:
    """Whether three ratio columns sum to one."""
    return F.abs(train + val + test - 1.0) <= TOLERANCE


def check_ratios(train: float, val: float, test: float) -> None:
    if abs(train + val + test - 1.0) > TOLERANCE:
        raise ValueError(f"ratios must sum to 1.0, got {train + val + test}")


def _last_keys(keys: DataFrame, train: float, val: float) -> Column:
    """Last train key and last val key, as a subquery."""
    total = keys.agg(F.count(F.lit(1))).scalar()
    train_end = (F.lit(train) * total).cast("int")
    val_end = train_end + (F.lit(val) * total).cast("int")
    key = F.struct(*keys.columns)
    ends = with_position(keys, keys.columns).agg(
        F.struct(
            F.max(F.when(F.col("pos") < train_end, key)).alias("train"),
            F.max(F.when(F.col("pos") < val_end, key)).alias("val"),
        )
    )
    return ends.scalar()


def _range_split(members: DataFrame, order: list[Column], train: float, val: float) -> Column:
    # The projects are found once and written: numbering reads them several times.
    found = members.select(*order).distinct()
    path = f"{work_dir(found.sparkSession)}/projects"
    found.write.parquet(path)
    last = _last_keys(found.sparkSession.read.schema(found.schema).parquet(path), train, val)
    key = F.struct(*order)
    return F.when(key <= last["train"], "train").when(key <= last["val"], "val").otherwise("test")


def sorted_split(
    df: DataFrame,
    train: float = 0.7,
    val: float = 0.15,
    main_source: str | None = None,
    members: DataFrame | None = None,
) -> DataFrame:
    """Projects in name order: the first 70 % train, the next 15 % val, the rest test.

    With ``main_source`` only its rows are split; rows of other sources are held out as
    ``eval``. ``members`` is the table whose projects are counted, when that is not ``df``.
    """
    members = df if members is None else members
    if main_source is None:
        split = _range_split(members, [F.col("project")], train, val)
    else:
        is_main = F.col("source") == main_source
        split = _range_split(members.where(is_main), [F.col("project")], train, val)
        split = F.when(is_main, split).otherwise("eval")
    return df.withColumn("split", split)


def seeded_split(
    df: DataFrame, train: float = 0.7, val: float = 0.1, test: float = 0.2, seed: int = 42
) -> DataFrame:
    """Projects in a seeded random order, with the ratios as given."""
    check_ratios(train, val, test)
    order = [shuffle_key(seed, F.col("project")).alias("draw"), F.col("project")]
    return df.withColumn("split", _range_split(df, order, train, val))


def leaking_projects(df: DataFrame) -> DataFrame:
    """Projects found in more than one split; empty when the split is sound."""
    return (
        df.groupBy("project")
        .agg(F.countDistinct("split").alias("n_splits"))
        .where("n_splits > 1")
    )
