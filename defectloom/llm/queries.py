"""Registered queries of the subpackage: (spark, sf_dir) -> DataFrame."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from defectloom.llm.bpe import decode, encode
from defectloom.llm.chunks import exact_copies
from defectloom.llm.licenses import scan_licences
from defectloom.llm.mixing import mixture
from defectloom.llm.phrases import collocations
from defectloom.llm.pii import KINDS, personal_data
from defectloom.llm.quality import COUNTS, quality
from defectloom.llm.sharding import byte_shards
from defectloom.llm.simhash import simhash_components
from defectloom.llm.tables import table, tokenizer_path
from defectloom.llm.token_files import read_tokens, write_tokens
from defectloom.llm.turns import repair_damaged
from defectloom.llm.urls import judge_pages
from defectloom.llm.vectors import near_vectors
from defectloom.workspace import work_dir


def op1_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents and of the text they decode to."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode(documents, tokenizer_path()).select("doc_id", "ids")
    digits = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decode(encoded, tokenizer_path()).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ids in compressed files, read back with their place in the stream."""
    path = f"{work_dir(spark)}/tokens"
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return read_tokens(spark, path).select(
        F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"),
        F.col("crc32").alias("ids_crc32"),
    )


def op3_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, with the words that would reveal it."""
    found = personal_data(table(spark, sf_dir, "documents"))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS
    ]
    return found.select(
        "doc_id", *counts, F.sha2("base_text", 256).alias("base_sha256"), F.col("spans_text").alias("spans")
    )


def op4_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on all pages. The label of the document with a page's id is the page's outcome: bad
    if of low quality."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return judge_pages(table(spark, sf_dir, "pages"), outcomes)


def op5_licence_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences found in all documents."""
    found = scan_licences(table(spark, sf_dir, "documents"))
    names = F.array_join("licences", ",")
    return found.select("doc_id", F.size("licences").cast("long").alias("n_licences"), names.alias("licences"), "score")


def op6_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 contiguous shards of near-equal bytes."""
    placed = byte_shards(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op8_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of all documents, the source as host."""
    judged = quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "n_left")


def op9_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    found = simhash_components(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op10_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix by source weights takes from all documents."""
    mixed = mixture(table(spark, sf_dir, "documents"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken)


def op11_misra_gries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of all documents by language."""
    return collocations(table(spark, sf_dir, "documents")).withColumnRenamed("grp", "lang")


def op12_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents."""
    found = exact_copies(table(spark, sf_dir, "documents"))
    return found.withColumnsRenamed({"key": "doc_id", "keep": "keep_id"})


def op13_branch_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-cost repair of all conversations after damage."""
    return repair_damaged(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_trie_bpe": op1_trie_bpe,
    "op2_token_files": op2_token_files,
    "op3_disclosure": op3_disclosure,
    "op4_host_reputation": op4_host_reputation,
    "op5_licence_dice": op5_licence_dice,
    "op6_byte_shards": op6_byte_shards,
    "op7_multi_index": op7_multi_index,
    "op8_line_frequency": op8_line_frequency,
    "op9_simhash_bk": op9_simhash_bk,
    "op10_entropy_mix": op10_entropy_mix,
    "op11_misra_gries": op11_misra_gries,
    "op12_chunk_recipes": op12_chunk_recipes,
    "op13_branch_bound": op13_branch_bound,
}
