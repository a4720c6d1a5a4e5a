"""The given tables seen as the data model: samples, pairs, patches, commits and so on.

Each binding covers its whole table, but for ``defects`` and ``fixes``: of a conversation, user
turns stand for defects and assistant turns for fixes, and system turns are neither.
"""

import posixpath
import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from defectloom.functions.text import function_name, lines_of
from defectloom.operators.model import score_logits
from defectloom.sources.bug_tree import INFO, PATCH
from defectloom.sources.code_dirs import DEFECT_DIR, FIX_DIR

AS_OF = datetime(2024, 1, 31)
MAIN_SOURCE = "en"
SOURCES = ["en", "fr", "de"]
TASKS_PER_CORE = 4


# The types of the given tables, so that a scan starts without reading footers.
SCHEMAS = {
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
    "props string",
    "labels": "doc_id bigint, quality int, toxic int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over all cores. A table of short rows is one small file, whose rows would
    be made into code and changed in one task; its size in bytes says nothing about that work."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(max(TASKS_PER_CORE * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def code_like(text) -> Column:
    """Prose with some words turned into block starts, so the code rules find something."""
    starts = F.replace(F.replace(text, F.lit("The "), F.lit("def ")), F.lit("De "), F.lit("class "))
    return F.replace(starts, F.lit(","), F.lit("("))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: language as source, document source as project."""
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    return documents.join(labels, "doc_id").select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("lang").alias("source"),
        F.col("source").alias("project"),
        F.concat_ws("/", "source", "doc_id").alias("path"),
        function_name(code_like("text")).alias("func_name"),
        F.col("text").alias("code"),
        (1 - F.col("quality")).cast("int").alias("is_buggy"),
        F.expr("doc_id div 2").cast("string").alias("pair_id"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as unlabelled code."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("project"),
        "lang",
        "n_chars",
        F.col("text").alias("code"),
    )


def _turns(spark: SparkSession, sf_dir: str, role: str, shift: int) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where(F.col("role") == role)
    return turns.select(
        F.concat_ws("_", "conv_id", (F.col("turn") + shift).cast("string")).alias("stem"),
        F.concat_ws("/", F.lit(role), "conv_id", "turn").alias("path"),
        F.col("text").alias("code"),
    )


def defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir, "user", 0)


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir, "assistant", -1)


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sums over both halves of an embedding as class logits."""

    def half(first: str, n: str) -> Column:
        part = F.expr(f"slice(embedding, {first}, {n})")
        return F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x.cast("double"))

    n = "size(embedding) div 2"
    both = F.array(half("1", n), half(f"{n} + 1", f"size(embedding) - {n}"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), both.alias("logits"), (F.col("label") % 2).alias("is_buggy")
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic flag as predicted class, with a confidence where there is an embedding."""
    scores = logits(spark, sf_dir).select(
        F.col("id").alias("doc_id"), score_logits(F.col("logits"))["score"].alias("score")
    )
    return table(spark, sf_dir, "labels").join(scores, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"), F.col("toxic").alias("yhat"), "score"
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("step"),
        (F.col("value") / 1000).alias("f1"),
    )


def _bug(event_id: str = "event_id") -> tuple[Column, Column]:
    bug = F.expr(f"{event_id} div 5")
    return F.concat(F.lit("p"), (bug % 7).cast("string")), bug.cast("string")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commits: each event type stands for one file, three of them files of a bug that
    tell its owner and two that don't."""
    project, bug = _bug()
    file = (
        F.when(F.col("event_type") == "view", "requirements.txt")
        .when(F.col("event_type") == "click", "run_test.sh")
        .when(F.col("event_type") == "error", "bug.info")
        .when(F.col("event_type") == "signup", "README.md")
        .otherwise("setup.cfg")
    )
    return table(spark, sf_dir, "events").select(
        project.alias("project"),
        bug.alias("bug"),
        file.alias("file"),
        F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("author"),
        "ts",
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a verification log."""
    project, bug = _bug()
    kind = F.col("event_type")
    line = (
        F.when(kind == "view", "")
        .when(kind == "click", F.concat(F.lit("PASS: bugs/"), bug))
        .when(kind == "error", F.concat(F.lit("bugs/"), bug, F.lit(" (FAIL)")))
        .when(kind == "signup", F.concat(F.lit("  projects/x/bugs/"), bug, F.lit("(again) ")))
        .otherwise(F.concat(F.lit("PASS:"), bug))
    )
    return table(spark, sf_dir, "events").select(project.alias("project"), line.alias("line"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines as a diff of two hunks; every third line is added, every third removed."""
    lines = lines_of(F.col("text"))
    middle = F.expr("size(split(text, '\\n')) div 2")

    def diff_line(line, i):
        mark = F.element_at(F.array(F.lit(" "), F.lit("-"), F.lit("+")), (i % 3 + 1).cast("int"))
        header = F.format_string("@@ -%d,3 +%d,3 @@ block\n", i, i)
        return F.concat(F.when((i == 0) | (i == middle), header).otherwise(""), mark, line)

    body = F.array_join(F.transform(lines, diff_line), "\n")
    head = F.lit("diff --git a/x b/x\nindex 1..2\n--- a/x\n+++ b/x\n")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.concat(head, body).alias("patch")
    )


def kv_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part rows as metadata blocks; ``size`` comes twice and one line has no ``=``."""
    text = F.format_string(
        'name="%s"\n brand = "%s" \nsize=%d\nno separator\ntype="a=%s"\nsize="%d"',
        "p_name",
        "p_brand",
        "p_size",
        "p_type",
        F.col("p_size") + 1,
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text"))


def test_case_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part rows as test cases, with single values, lists and texts as input."""
    size, key = F.col("p_size"), F.col("p_partkey")
    line = (
        F.when(size % 3 == 0, F.format_string("[%d, %d]", size, key))
        .when(size % 3 == 1, F.format_string('[[%d, "%s"], [%d]]', size, "p_name", key))
        .otherwise(F.format_string('["%s", true]', "p_name"))
    )
    return table(spark, sf_dir, "part").select(key.alias("id"), line.alias("value"))


def ratio_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as split settings, some of whose ratios sum to one."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("id"),
        ((key % 3 + 6) / 10).alias("train"),
        ((nation % 3 + 1) / 10).alias("val"),
        F.lit(0.2).alias("test"),
    )


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part rows as runs of test programs."""
    # A few program names, some of them with graph inputs.
    names = ["bitcount", "detect_cycle", "gcd", "kth", "shortest_paths", "sieve", "topological_ordering"]
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("p_size") % len(names) + 1)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), name.alias("program")
    )


def python_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part rows as small Python functions, in the shape of the sample table."""
    price = F.floor("p_retailprice").cast("int")
    code = F.format_string(
        "def price_%d(table, qty):\n"
        "    limit = %d\n"
        "    total = 0\n"
        "    if qty is None:\n"
        "        return %d\n"
        "    for i in range(%d):\n"
        "        total = total + qty * 2\n"
        "    if total == limit:\n"
        "        total = table[%d]\n"
        "    if total < %d:\n"
        "        return -1\n"
        "    return total / limit\n",
        "p_partkey",
        "p_size",
        "p_size",
        "p_size",
        F.col("p_size") % 7,
        price,
    )
    key = F.col("p_partkey").cast("string")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    return spread(parts).select(
        key.alias("id"),
        F.col("p_type").alias("source"),
        F.col("p_brand").alias("project"),
        F.concat(F.lit("part/"), key).alias("path"),
        F.concat(F.lit("price_"), key).alias("func_name"),
        code.alias("code"),
        F.lit(0).alias("is_buggy"),
        key.alias("pair_id"),
    )


def write_files(files: DataFrame, root: str) -> None:
    """Write ``path, content`` rows as files below ``root``, from the tasks.

    A path without a scheme is taken from the file system Spark itself would use for it.
    """
    spark = files.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    # Arrow knows the object store by one name only.
    where = re.sub("^s3[an]://", "s3://", system.makeQualified(path).toString())

    def write(rows):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(where)
        made = set()
        for row in rows:
            target = f"{base}/{row['path']}"
            folder = posixpath.dirname(target)
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            with store.open_output_stream(target) as out:
                out.write(row["content"].encode())

    files.foreachPartition(write)


def write_code_dirs(spark: SparkSession, sf_dir: str, root: str) -> None:
    """One program per supplier: a defect file for all, a fix for those with a balance."""
    key, balance = F.col("s_suppkey"), F.floor("s_acctbal").cast("int")
    name = F.format_string("prog_%d.py", key)
    defect = F.format_string("def prog_%d(x):\r\n    return x - %d\r\n", key, balance)
    fix = F.format_string("def prog_%d(x):\n    return x + %d\n", key, balance)
    files = F.array(
        F.struct(F.concat(F.lit(f"{DEFECT_DIR}/"), name).alias("path"), defect.alias("content")),
        F.when(
            balance > 0,
            F.struct(F.concat(F.lit(f"{FIX_DIR}/"), name).alias("path"), fix.alias("content")),
        ),
    )
    rows = table(spark, sf_dir, "supplier").select(
        F.explode(F.filter(files, lambda f: f.isNotNull())).alias("f")
    )
    write_files(rows.select("f.path", "f.content"), root)


def write_bug_tree(spark: SparkSession, sf_dir: str, root: str) -> None:
    """One bug per supplier, in the project of its nation; some have no patch."""
    key, balance = F.col("s_suppkey"), F.floor("s_acctbal").cast("int")
    folder = F.format_string("projects/nation%d/bugs/%d/", "s_nationkey", key)
    info = F.format_string('test_file="tests/t%d.py"\nstatus = "OK"\n', key)
    patch = F.format_string(
        "--- a/f.py\n+++ b/f.py\n@@ -1,2 +1,2 @@\n a = 1\n-b = 2\n+b = 3\n"
        "@@ -9,3 +9,3 @@\n def f%d(x):\n-    return x - %d\n+    return x + %d\n",
        key,
        balance,
        balance,
    )
    files = F.array(
        F.struct(F.concat(folder, F.lit(INFO)).alias("path"), info.alias("content")),
        F.when(
            balance > 0,
            F.struct(F.concat(folder, F.lit(PATCH)).alias("path"), patch.alias("content")),
        ),
    )
    rows = table(spark, sf_dir, "supplier").select(
        F.explode(F.filter(files, lambda f: f.isNotNull())).alias("f")
    )
    write_files(rows.select("f.path", "f.content"), root)


LEXED_CODE = r'''def price_{k}(table, qty):
    """total + limit == {n}
    limit = 0"""
    limit = {n}  # limit = 2 + 3
    note = "if a == {n} + 1: \"{t}\"" + 'x\\'
    if table is None:
        # nothing
        if qty is limit:
            limit = {n} + 1
            note = ""
        else:
            qty = 4
        return {n}
    elif qty is not limit:
        total = qty * {n}

    def inner(total, step=2):
        total = total - step * 2 + table[{m}]
        if total == limit:
            return -total
        return 7

    for i in range({n}):
        total = inner(i + 1,
                      step=3) + qty.qty
    if total < {n} and qty != 2:
        return table[{m}][0]
    if total <= {n} - {m}:
        qty = 5
    if len(table[1:2]) == 3 ** 2:  # total < 1
        return (total
                / limit)
    return total / limit
'''


def lexed_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part rows as functions with strings, comments, nested blocks and open brackets."""
    values = {"{k}": "p_partkey", "{n}": "p_size", "{m}": F.col("p_size") % 7, "{t}": "p_type"}
    code = F.lit(LEXED_CODE)
    for name, value in values.items():
        code = F.replace(code, F.lit(name), (F.col(value) if isinstance(value, str) else value).cast("string"))
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size"))
    return parts.select(F.col("p_partkey").cast("string").alias("id"), code.alias("code"))
