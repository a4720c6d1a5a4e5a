"""A corpus from raw documents to token ids, in five stages.

Each stage is a function of (spark, docs, sf_dir). What it returns is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of documents; ``n_chars``
follows the text where a stage changes it. Every stage works on all rows it gets:

* quality: rejected documents go, lines common to a host's documents are cut from the others.
* near_copies: of each group within three bits of SimHash one document stays.
* personal_data: base spans give way to their kind, words that reveal them are replaced.
* mixture: each document comes as often as the sources' targets ask for.
* tokens: ids of the text, and digests of ids and decoded text.

Stages state what they do with nulls, empty texts, repeated rows and empty tables in the docstrings
of their operators.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from defectloom.llm.bpe import decode, encode
from defectloom.llm.mixing import mix
from defectloom.llm.pii import sanitise
from defectloom.llm.quality import keep_good
from defectloom.llm.simhash import drop_near_copies
from defectloom.llm.tables import table, tokenizer_path
from defectloom.workspace import work_dir


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(keep_good(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(sanitise(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = encode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path()).drop("text")
    digits = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decode(encoded, tokenizer_path()).select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("tokens", tokens),
]

# Newton steps, shared merges and Hamming components have no SQL; tests hold the stages against
# plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = work_dir(spark)
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{name}")
    return docs
