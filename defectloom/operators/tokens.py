"""Code tokens, a vocabulary, id windows that hold every token, and padded batches.

Counts are summed on the map side. Encoding looks tokens up inside the row, in a hash table of the
most frequent ones, whose size is fixed and which every task has once. Only a text's distinct rare
tokens become rows, to be joined with the rest of the vocabulary and put back in their places.
Decoding does the same with a list of the frequent tokens by id, and spreads what it joins over
several keys per id. So neither makes a row per token, and frequent tokens are no hot keys. A text
is encoded into windows of bounded length; none of its tokens is left out.
"""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from defectloom.functions.bind import bind
from defectloom.operators.positions import with_position
from defectloom.workspace import work_dir

# Token pattern, marker ids and limits.
TOKEN = r"[A-Za-z_]\w*|\d+|[^\w\t-\r ]"
PAD, UNK, BOS, EOS = 0, 1, 2, 3
FIRST_ID = 4
MAX_LENGTH = 512
SAMPLE_TEXTS = 5
# Tokens of the head, how long such a token may be, and the buckets of its hash table.
HEAD, HEAD_CHARS, BUCKETS = 65_536, 64, 65_536
# Keys that a rare id is spread over, and distinct rare tokens that a text may have (as a power of two).
SALTS, MAX_RARE_BITS = 16, 26
# Encoded texts that one task puts in order.
TEXTS_PER_BUCKET = 4_096


def tokenise(code) -> Column:
    return F.regexp_extract_all(code, F.lit(TOKEN), F.lit(0))


def token_counts(df: DataFrame, code: str = "code") -> DataFrame:
    return (
        df.select(F.explode(tokenise(code)).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def vocabulary(df: DataFrame, code: str = "code", vocab_size: int | None = None) -> DataFrame:
    """All tokens with their ids, by falling count and then by token.

    With ``vocab_size`` only that many tokens have an id, and the others are encoded as unknown.
    """
    counts = token_counts(df, code).withColumn("_rare", -F.col("n"))
    # Counted once, numbered from the written table.
    path = f"{work_dir(df.sparkSession)}/token_counts"
    counts.write.parquet(path)
    written = df.sparkSession.read.schema(counts.schema).parquet(path)
    placed = with_position(written, ["_rare", "token"], into="_place")
    if vocab_size is not None:
        placed = placed.where(F.col("_place") < vocab_size)
    return placed.select("token", "n", (F.col("_place") + FIRST_ID).cast("int").alias("token_id"))


def vocab_total(df: DataFrame, code: str = "code") -> DataFrame:
    return token_counts(df, code).agg(F.count(F.lit(1)).alias("vocab_size"))


def token_stats(df: DataFrame, code: str = "code", max_length: int = MAX_LENGTH) -> DataFrame:
    """Tokens per text with both markers, over all rows."""
    n = F.col("n")
    # Taken apart once per text, then summed.
    return df.select((F.size(tokenise(code)) + 2).alias("n")).agg(
        F.count(F.lit(1)).alias("texts"),
        F.sum(n).alias("tokens"),
        F.avg(n).alias("avg_tokens"),
        F.count_if(n > max_length).alias("over_limit"),
        (F.avg(n) > 0.8 * max_length).alias("near_limit"),
    )


def sample_token_report(
    df: DataFrame, code: str = "code", max_length: int = MAX_LENGTH
) -> DataFrame:
    """Token numbers of the first five texts."""
    n = F.size(tokenise(code)) + 2
    return (
        df.orderBy("id")
        .limit(SAMPLE_TEXTS)
        .select("id", n.alias("tokens"), (n > max_length).alias("over_limit"))
    )


def _frequent() -> Column:
    return (F.col("token_id") < FIRST_ID + HEAD) & (F.length("token") <= HEAD_CHARS)


def _filled(entries: DataFrame, places: int, value: str) -> Column:
    """One list with ``value`` at each row's ``at``, null elsewhere, as a subquery's only value."""
    every = entries.sparkSession.range(places).withColumnRenamed("id", "at").join(entries, "at", "left")
    listed = F.sort_array(F.collect_list(F.struct("at", value)))
    return every.agg(F.transform(listed, lambda e: e[value])).scalar()


def _bucket(token) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _hash_table(vocab: DataFrame) -> Column:
    """The head of the vocabulary as a list of buckets, each a short list of tokens with ids."""
    head = vocab.where(_frequent()).select(_bucket("token").cast("long").alias("at"), F.struct("token", "token_id").alias("e"))
    return _filled(head.groupBy("at").agg(F.collect_list("e").alias("entries")), BUCKETS, "entries")


def _same(names: list[str], prefix: str) -> Column:
    return reduce(and_, [F.col(n).eqNullSafe(F.col(f"{prefix}{n}")) for n in names])


def encode_texts(df: DataFrame, vocab: DataFrame, code: str = "code") -> DataFrame:
    """All ids of each text in order, without markers, as ``ids``; unknown tokens are ``UNK``.

    The columns other than ``code`` stay and must identify a row. ``vocab`` is read several times
    and should be a written table.
    """
    keep = [name for name in df.columns if name != code]

    def looked_up(tokens):
        ids = F.transform(
            tokens,
            lambda t: F.get(F.filter(F.get(F.col("_head"), _bucket(t)), lambda e: e["token"] == t), F.lit(0))["token_id"],
        )
        return bind(ids, lambda found: F.struct(found.alias("ids"), rare_ones(tokens, found).alias("rare")))

    def rare_ones(tokens, found):
        marked = F.transform(
            found, lambda n, i: F.when(n.isNull(), F.struct(i.alias("at"), F.get(tokens, i).alias("token")))
        )
        return F.filter(marked, lambda e: e.isNotNull())

    coded = df.withColumn("_head", _hash_table(vocab)).select(
        *keep, bind(tokenise(F.coalesce(F.col(code), F.lit(""))), looked_up).alias("_c")
    )
    tail = vocab.where(~_frequent()).select("token", "token_id")
    if not tail.take(1):
        return coded.select(*keep, F.transform("_c.ids", lambda n: F.coalesce(n, F.lit(UNK))).alias("ids"))
    path = f"{work_dir(df.sparkSession)}/coded"
    coded = coded.select(*keep, F.col("_c.ids").alias("ids"), F.col("_c.rare").alias("rare"))
    coded.write.parquet(path)
    coded = df.sparkSession.read.schema(coded.schema).parquet(path)
    some = F.size("rare") > 0
    pairs = coded.where(some).select(*keep, F.explode(F.array_distinct("rare.token")).alias("token"))
    found = pairs.join(tail, "token").groupBy(*[F.col(n).alias(f"_of_{n}") for n in keep])
    found = found.agg(F.sort_array(F.collect_list(F.struct("token", "token_id"))).alias("_found"))
    joined = coded.where(some).join(found, _same(keep, "_of_"), "left")
    patched = joined.select(*keep, _patched().cast("array<int>").alias("ids"))
    return coded.where(~some).select(*keep, "ids").unionByName(patched)


def _patched() -> Column:
    """``ids`` with the ids of the ``rare`` tokens, which stand in order in ``_found``, in their places."""
    steps = F.array(*[F.lit(1 << k) for k in range(MAX_RARE_BITS, -1, -1)])
    found = F.coalesce("_found", F.expr("CAST(array() AS array<struct<token: string, token_id: int>>)"))

    def id_of(entry):
        def closer(below, step):
            fits = F.get(found, below + step - 1)["token"] <= entry["token"]
            return F.when(F.coalesce(fits, F.lit(False)), below + step).otherwise(below)

        def if_same(place):
            hit = F.get(found, place - 1)
            return F.when(hit["token"] == entry["token"], hit["token_id"])

        return F.coalesce(bind(F.aggregate(steps, F.lit(0), closer), if_same), F.lit(UNK))

    def placed(at, n):
        return F.shiftleft(at.cast("long"), 32) + n

    # Place and id in one number, so that both lists sort as plain numbers.
    known = F.filter(F.transform("ids", lambda n, i: placed(i, n)), lambda e: e.isNotNull())
    rare = F.transform("rare", lambda e: placed(e["at"], id_of(e)))
    return F.transform(F.sort_array(F.concat(known, rare)), lambda e: e.bitwiseAND(0xFFFFFFFF).cast("int"))


def n_windows(ids, max_length: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.size(ids) / (max_length - 2)).cast("int"))


def windows(texts: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """Windows of a text's ``ids``, numbered by ``window``, each with begin and end marker and mask."""
    keep = [name for name in texts.columns if name != "ids"]
    room = max_length - 2
    cut = F.transform(
        F.sequence(F.lit(0), n_windows("ids", max_length) - 1), lambda w: F.slice("ids", w * room + 1, F.lit(room))
    )
    own = texts.select(*keep, F.posexplode(cut).alias("window", "_ids"))
    return own.select(
        *keep,
        "window",
        F.concat(F.array(F.lit(BOS)), "_ids", F.array(F.lit(EOS))).alias("input_ids"),
        F.array_repeat(F.lit(1), F.size("_ids") + 2).alias("attention_mask"),
    )


def encode(
    df: DataFrame, vocab: DataFrame, code: str = "code", max_length: int = MAX_LENGTH
) -> DataFrame:
    """Windows of a text's ids, numbered by ``window``, each with begin and end marker and mask.

    A window holds ``max_length`` ids at most; a text without tokens has one window. The columns
    other than ``code`` stay and must identify a row.
    """
    return windows(encode_texts(df, vocab, code), max_length)


def decode(df: DataFrame, vocab: DataFrame, ids: str = "input_ids") -> DataFrame:
    """Text of each row's windows in order, markers and unknown tokens left out, joined by blanks.

    ``df`` has a ``window`` column; those other than it, ``ids`` and the mask identify a text. It is
    read twice and should be a written table, as should ``vocab``.
    """
    keep = [name for name in df.columns if name not in (ids, "window", "attention_mask")]
    own = df.select(*keep, "window", F.col(ids).alias("_ids"))
    head = vocab.where(_frequent()).select((F.col("token_id") - FIRST_ID).cast("long").alias("at"), "token")
    head = _filled(head, HEAD, "token")
    tail = vocab.where(~_frequent()).select("token_id", "token")
    if tail.take(1):
        # Ids move once, next to the rare tokens found for them; only then do they become words.
        missing = F.lit(None).cast("array<struct<token_id: int, token: string>>").alias("_found")
        rows = own.select("*", missing).unionByName(_rare_words(own, [*keep, "window"], head, tail), allowMissingColumns=True)
        rows = rows.repartition(*keep) if keep else rows
        listed = F.filter(F.collect_list(F.struct("_ids")), lambda e: e["_ids"].isNotNull())
        own = rows.groupBy(*keep, "window").agg(listed.alias("_lists"), F.flatten(F.collect_list("_found")).alias("_found"))
    else:
        none = F.expr("CAST(array() AS array<struct<token_id: int, token: string>>)")
        own = own.select(*keep, "window", F.array(F.struct("_ids")).alias("_lists"), none.alias("_found"))

    def piece(e):
        words = F.transform(e["_ids"], word)
        return F.struct("window", F.nullif(F.array_join(words, " "), F.lit("")).alias("piece"))

    def word(n):
        rare = F.get(F.filter("_found", lambda e: e["token_id"] == n), F.lit(0))["token"]
        return F.when(n >= FIRST_ID, F.coalesce(F.get(F.col("_head"), n - FIRST_ID), rare))

    pieces = own.withColumn("_head", head).select(*keep, F.transform("_lists", piece).alias("pieces"))
    joined = pieces.groupBy(*keep).agg(F.sort_array(F.flatten(F.collect_list("pieces"))).alias("pieces"))
    return joined.select(*keep, F.array_join("pieces.piece", " ").alias("text"))


def _rare_words(own: DataFrame, key: list[str], head: Column, tail: DataFrame) -> DataFrame:
    """The tokens of those ids of a window that only ``tail`` has, as ``_found``. Ids among the first
    ``HEAD``, whose tokens are too long for the head, may be frequent: their windows are spread over
    ``SALTS`` keys, and the tail has a row for each. The other ids are rare and have one key. The tail
    grows with the input, and its files are small for its rows, so it is never broadcast."""
    missing = F.filter("_ids", lambda n: (n >= FIRST_ID) & F.get(F.col("_head"), n - FIRST_ID).isNull())
    often = F.col("token_id") < FIRST_ID + HEAD
    salt = F.when(often, F.pmod(F.xxhash64(*key), F.lit(SALTS))).otherwise(0).alias("_salt")
    pairs = own.withColumn("_head", head).select(*key, F.explode(F.array_distinct(missing)).alias("token_id"))
    salts = F.sequence(F.lit(0).cast("long"), F.when(often, SALTS - 1).otherwise(0).cast("long"))
    salted = tail.withColumn("_salt", F.explode(salts)).hint("merge")
    named = pairs.select("*", salt).join(salted, ["token_id", "_salt"])
    # A window's ids: a bounded list.
    return named.groupBy(*key).agg(F.collect_list(F.struct("token_id", "token")).alias("_found"))


def batches(df: DataFrame, batch_size: int, order: list[str] = ("id",)) -> DataFrame:
    """Consecutive batches in key order: ``batch`` and the row's ``slot`` in it."""
    placed = with_position(df, list(order))
    return placed.withColumns(
        {
            "batch": F.floor(F.col("pos") / batch_size),
            "slot": (F.col("pos") % batch_size).cast("int"),
        }
    ).drop("pos")


def window_batches(
    texts: DataFrame, batch_size: int, max_length: int = MAX_LENGTH, order: list[str] = ("id",)
) -> DataFrame:
    """Windows of encoded texts in consecutive batches: ``batch`` and ``slot`` of each window.

    Only the numbers of windows are added up over the texts in ``order``; a window's place is
    its text's first one and its number. ``texts`` should be a written table.
    """
    counted = texts.withColumn("_n", n_windows("ids", max_length))
    placed = with_position(
        counted, list(order), into="_start", weight="_n", rows_per_bucket=TEXTS_PER_BUCKET
    ).drop("_n")
    place = F.col("_start") + F.col("window")
    return windows(placed, max_length).withColumns(
        {"batch": F.floor(place / batch_size), "slot": (place % batch_size).cast("int")}
    ).drop("_start")


def pad_batches(df: DataFrame) -> DataFrame:
    """Ids and masks filled up to the longest sequence of the batch."""
    longest = F.max(F.size("input_ids")).over(W.partitionBy("batch"))
    gap = F.col("_longest") - F.size("input_ids")
    return df.withColumn("_longest", longest).withColumns(
        {
            "input_ids": F.concat("input_ids", F.array_repeat(F.lit(PAD), gap)),
            "attention_mask": F.concat("attention_mask", F.array_repeat(F.lit(0), gap)),
        }
    ).drop("_longest")
