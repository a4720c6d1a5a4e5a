"""Synthetic defects: variants of clean rows, and their merge into the training table."""

from pyspark.sql import Column, DataFrame, functions as F

from defectloom.functions.draws import pick, shuffle_key
from defectloom.operators import lexed
from defectloom.operators.filters import clean_only
from defectloom.operators.mutations import PATTERNS, mutate
from defectloom.operators.positions import with_position

# The text replacements, in the order the draw numbers them.
REPLACEMENTS = (
    ("+", "-"),
    ("-", "+"),
    ("==", "!="),
    ("!=", "=="),
    ("<", ">"),
    (">", "<"),
    ("True", "False"),
    ("False", "True"),
    ("return", "# return"),
    ("if ", "# if "),
)


def fan_out(clean: DataFrame, n: int = 3) -> DataFrame:
    """Each row ``n`` times, numbered from 0 in ``variant``."""
    return clean.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def mutation_plan(seed: int = 42) -> Column:
    """One to three pattern numbers, drawn with replacement, per ``id`` and ``variant``."""
    key = (F.col("id"), F.col("variant"))
    steps = F.sequence(F.lit(1), pick(3, seed, *key, "steps") + 1)
    return F.transform(steps, lambda j: pick(len(PATTERNS), seed, *key, j, "pattern"))


def text_mutation(code, seed: int = 42) -> Column:
    """One or two replacements over the whole text, drawn per ``id`` and ``variant``."""
    key = (F.col("id"), F.col("variant"))
    rounds = F.sequence(F.lit(1), pick(2, seed, *key, "rounds") + 1)
    draws = F.transform(rounds, lambda j: pick(len(REPLACEMENTS), seed, *key, j, "text"))

    def swap(text, number):
        cases = F.when(F.lit(False), text)
        for i, (old, new) in enumerate(REPLACEMENTS):
            cases = cases.when(number == i, F.replace(text, F.lit(old), F.lit(new)))
        return cases

    return F.aggregate(draws, code, swap)


def variant_rows(samples: DataFrame, n: int = 3) -> DataFrame:
    """Buggy variants of the clean rows, still with the code of the clean row."""
    return fan_out(clean_only(samples), n)


def label_variants(variants: DataFrame) -> DataFrame:
    """New ids, pair ids, source and label for mutated rows."""
    return variants.withColumns(
        {
            "id": F.concat("id", F.lit("_bug_"), "variant"),
            "pair_id": F.concat("pair_id", F.lit("_synthetic_"), "variant"),
            "source": F.concat("source", F.lit("_synthetic")),
            "is_buggy": F.lit(1),
        }
    ).drop("variant")


def mutated_code(code: Column, seed: int = 42, mutator: str = "patterns") -> Column:
    """``patterns`` follows the row's plan and falls back to text where nothing of it applies;
    ``lexed`` does so with the rules that draw every place outside strings and comments; ``text``
    takes the fallback for every row."""
    if mutator not in ("patterns", "lexed", "text"):
        raise ValueError(f"unknown mutator: {mutator}")
    fallback = text_mutation(code, seed)
    if mutator == "text":
        return fallback
    follow = lexed.mutate if mutator == "lexed" else mutate
    return F.coalesce(follow(code, mutation_plan(seed), seed), fallback)


def generate_variants(
    samples: DataFrame, n: int = 3, seed: int = 42, mutator: str = "patterns"
) -> DataFrame:
    """Synthetic defects of all clean rows."""
    rows = variant_rows(samples, n)
    return label_variants(rows.withColumn("code", mutated_code(F.col("code"), seed, mutator)))


def merge(train: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Both tables, columns matched by name, with the ``origin`` of each row."""
    return train.withColumn("origin", F.lit("train")).unionByName(
        synthetic.withColumn("origin", F.lit("synthetic")), allowMissingColumns=True
    )


def shuffle_rows(df: DataFrame, seed: int = 42, into: str = "pos") -> DataFrame:
    """A seeded random order of all rows, as a position column; ``id`` is unique."""
    keyed = df.withColumn("_draw", shuffle_key(seed, F.col("id")))
    return with_position(keyed, ["_draw", "id"], into=into).drop("_draw")
