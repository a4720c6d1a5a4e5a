import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, kinds=400):
    return " ".join(rng.choice("abcdefgh") + str(rng.randrange(kinds)) for _ in range(n))


def corpus(seed=5):
    """Rows with nulls, empty, blank and long texts, copies, near copies and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for k in range(60):
        text = "\n".join(words(rng, rng.randrange(1, 40)) for _ in range(rng.randrange(1, 8)))
        rows.append((k, text, "en", f"s{k % 4}", len(text)))
    base = words(rng, 120)
    for k in range(60, 75):
        rows.append((k, base, "en", "s0", len(base)))
    for k in range(75, 85):
        parts = base.split(" ")
        parts[k - 75] = "other"
        rows.append((k, " ".join(parts), "fr", "s1", None))
    rows += [
        (85, None, "en", "s1", None),
        (86, "", "en", None, 0),
        (87, " \t\n\n \r\f\v ", None, "s2", 9),
        (88, "One TWO three", "en", "s2", 13),
        (89, "x" * 50_000, "en", "s3", 50_000),
        (90, words(rng, 30_000, 5_000), "en", "s3", None),
        (None, "no id here " * 5, "en", "s3", None),
        (None, "no id here " * 5, "en", "s3", None),
        (91, "Grüße, Ελλάδα ΣΑΣ; 東京 🙂 l'été́ don't 12,5", "el", "s2", None),
        (92, "same row", "en", "s2", 8),
        (92, "same row", "en", "s2", 8),
        (93, "a\x0bb\x1cc\x85d\xa0e f", "en", "s2", None),
    ]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
