import json
import re

import pytest
from pyspark.sql import functions as F

from defectloom.operators import model, tokens
from defectloom.plans import training
from defectloom.plans.queries import QUERIES
from defectloom.streaming.scoring import start_scoring

TEXTS = ["x = x + 1\n\treturn x_1", "é😀 a1 22b", "", "   ", "def f(a):\n    return a[0]", "a " * 700]
PATTERN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\t-\r A-Za-z0-9_]")


@pytest.fixture
def corpus(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, code string").repartition(3)


def test_tokenise(corpus):
    got = {r["id"]: r["t"] for r in corpus.select("id", tokens.tokenise("code").alias("t")).collect()}
    assert got == {i: PATTERN.findall(t) for i, t in enumerate(TEXTS)}


def encode_model(text, ids, limit=512):
    """All windows of a text."""
    found = [ids.get(t, tokens.UNK) for t in PATTERN.findall(text)]
    room = limit - 2
    return [[tokens.BOS, *found[k : k + room], tokens.EOS] for k in range(0, max(1, len(found)), room)]


@pytest.mark.parametrize("size, limit, head", [(None, 512, 65_536), (3, 512, 65_536), (None, 6, 65_536), (None, 6, 2), (3, 6, 2)])
def test_encode_and_decode(corpus, size, limit, head, monkeypatch):
    monkeypatch.setattr(tokens, "HEAD", head)
    vocab = tokens.vocabulary(corpus, vocab_size=size)
    ids = {r["token"]: r["token_id"] for r in vocab.collect()}
    assert sorted(ids.values()) == list(range(tokens.FIRST_ID, tokens.FIRST_ID + len(ids)))
    assert size is None or len(ids) == size
    encoded = tokens.encode(corpus, vocab, max_length=limit)
    got = {(r["id"], r["window"]): r for r in encoded.collect()}
    words = {i: t for t, i in ids.items()}
    texts = {r["id"]: r["text"] for r in tokens.decode(encoded, vocab).collect()}
    assert len(got) == sum(len(encode_model(t, ids, limit)) for t in TEXTS)
    for i, text in enumerate(TEXTS):
        want = encode_model(text, ids, limit)
        for k, window in enumerate(want):
            assert got[i, k]["input_ids"] == window and got[i, k]["attention_mask"] == [1] * len(window)
        assert texts[i] == " ".join(words[t] for window in want for t in window if t in words)
        if size is None:
            assert texts[i] == " ".join(PATTERN.findall(text))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_row_per_token(spark, corpus, monkeypatch):
    """Only distinct rare tokens are exploded, and no exchange of decoding is dealt by the id alone."""
    monkeypatch.setattr(tokens, "HEAD", 2)
    vocab = tokens.vocabulary(corpus)
    encoded = tokens.encode(corpus, vocab)
    exploded = re.findall(r"explode\(([^\n]*)", plan_of(encoded))
    assert exploded and all(e.startswith(("array_distinct(", "transform(sequence")) for e in exploded)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = plan_of(tokens.decode(encoded, vocab))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(token_id#" in plan and not re.search(r"hashpartitioning\(token_id#\w+, \d", plan)


@pytest.mark.parametrize("head", [65_536, 1])
def test_an_id_that_half_the_corpus_holds(spark, head, monkeypatch):
    monkeypatch.setattr(tokens, "HEAD", head)
    rows = spark.range(3000).selectExpr("id", "concat('common w', id % 7, ' common ', repeat('long', 30)) AS code")
    vocab = tokens.vocabulary(rows)
    encoded = tokens.encode(rows, vocab)
    texts = tokens.decode(encoded, vocab).groupBy("text").count().collect()
    assert {r["text"]: r["count"] for r in texts} == {
        f"common w{k} common {'long' * 30}": len(range(k, 3000, 7)) for k in range(7)
    }


def test_ids_that_no_vocabulary_has_are_left_out(spark):
    vocab = spark.createDataFrame([("a", 4), ("b", 70_000)], "token string, token_id int")
    rows = spark.createDataFrame([(1, 0, [2, 4, 99, 70_000, 3]), (1, 1, [2, 4, 3]), (2, 0, [2, 3])], "id int, window int, input_ids array<int>")
    assert sorted(map(tuple, tokens.decode(rows, vocab).collect())) == [(1, "a b a"), (2, "")]


def test_decoding_moves_windows_once_and_never_encodes_again(spark, sf_dir):
    """Windows meet their rare tokens by one shuffle on the text, and the query reads them written."""
    vocab = spark.createDataFrame([("a", 4), ("b", 70_000)], "token string, token_id int")
    rows = spark.createDataFrame([(1, 0, [2, 4, 70_000, 3])], "id int, window int, input_ids array<int>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = plan_of(tokens.decode(rows, vocab))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"SortMergeJoin \[(?!at#)", plan)) == 1
    assert "regexp_extract_all" not in plan_of(QUERIES["decode"](spark, sf_dir))


def test_the_vocabulary_is_never_broadcast(spark, tmp_path):
    """Its files are far smaller than its rows in memory, more so with a row per salt."""
    words = spark.range(200_000).selectExpr("concat('w', id) AS token", "int(id + 4) AS token_id")
    words.write.parquet(str(tmp_path / "vocab"))
    rows = spark.createDataFrame([(1, 0, [2, 4, 150_004, 3])], "id int, window int, input_ids array<int>")
    decoded = tokens.decode(rows, spark.read.parquet(str(tmp_path / "vocab")))
    assert not re.search(r"BroadcastHashJoin \[token_id", plan_of(decoded))
    assert decoded.first()["text"] == "w0 w150000"


def test_equal_and_missing_keys_keep_all_windows(spark):
    vocab = spark.createDataFrame([("a", 4), ("b", 70_000), ("c", 70_001)], "token string, token_id int")
    rows = spark.createDataFrame(
        [(None, 0, [2, 4, 70_000, 3]), (None, 0, [2, 70_001, 3]), (1, 0, [2, 70_001, 3]), (1, 0, [2, 70_001, 3]), (2, 0, None)],
        "id int, window int, input_ids array<int>",
    )
    got = sorted(map(tuple, tokens.decode(rows, vocab).collect()), key=str)
    assert got == [(1, "c c"), (2, ""), (None, "a b c")]


@pytest.mark.parametrize("size", [2, 3])
def test_window_batches_are_those_of_all_windows(corpus, size):
    vocab = tokens.vocabulary(corpus)
    texts = tokens.encode_texts(corpus, vocab)
    got = tokens.window_batches(texts, size, 12).select("id", "window", "batch", "slot").collect()
    order = sorted((r["id"], r["window"]) for r in tokens.windows(texts, 12).collect())
    assert sorted(map(tuple, got)) == [(*name, k // size, k % size) for k, name in enumerate(order)]


def test_pad_batches(corpus):
    vocab = tokens.vocabulary(corpus)
    encoded = tokens.encode(corpus, vocab)
    rows = {(r["id"], r["window"]): r for r in tokens.pad_batches(tokens.window_batches(tokens.encode_texts(corpus, vocab), 2)).collect()}
    plain = {(r["id"], r["window"]): r["input_ids"] for r in encoded.collect()}
    order = sorted(plain)
    for place, name in enumerate(order):
        r = rows[name]
        assert (r["batch"], r["slot"]) == (place // 2, place % 2)
        longest = max(len(plain[n]) for n in order[place // 2 * 2 : place // 2 * 2 + 2])
        gap = longest - len(plain[name])
        assert r["input_ids"] == plain[name] + [tokens.PAD] * gap
        assert r["attention_mask"] == [1] * len(plain[name]) + [0] * gap


def test_token_stats(corpus):
    sizes = [len(PATTERN.findall(t)) + 2 for t in TEXTS]
    row = tokens.token_stats(corpus).first()
    assert (row["texts"], row["tokens"], row["over_limit"]) == (6, sum(sizes), 1)
    assert row["avg_tokens"] == pytest.approx(sum(sizes) / 6) and not row["near_limit"]
    first = tokens.sample_token_report(corpus).collect()
    assert [r["tokens"] for r in first] == sizes[:5]
    assert tokens.vocab_total(corpus).first()[0] == len({t for x in TEXTS for t in PATTERN.findall(x)})


@pytest.fixture(scope="module")
def fitted(spark):
    rows = [(f"def f{i}():\n    return bad / 0" if i % 2 else f"def f{i}(x):\n    return good", i % 2) for i in range(60)]
    train = spark.createDataFrame(rows, "code string, is_buggy int")
    return model.fit(train, n_features=1 << 10, iterations=10)


def test_predict_save_load(spark, fitted, tmp_path):
    asked = spark.createDataFrame(
        [("m", "def f(x):\n    return x[10]", "buggy"), ("n", "return bad / 0", "buggy"), ("n", "return good", "clean")],
        "name string, code string, expected string",
    )
    got = model.predict(fitted, asked)
    assert got.columns == ["name", "code", "expected", "yhat", "score", "label"]
    named = got.where("name = 'n'").collect()
    assert [r["label"] for r in named] == [r["expected"] for r in named]
    assert all(0.5 <= r["score"] <= 1 for r in got.collect())
    model.save(fitted, str(tmp_path / "m"))
    again = model.predict(model.load(str(tmp_path / "m")), asked)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))
    assert model.predict(fitted, asked.limit(0)).count() == 0
    assert model.describe(fitted)["features"] == 1 << 10


def test_stream_scores_each_row_once(spark, fitted, tmp_path):
    schema = "id bigint, code string"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        requests = spark.readStream.schema(schema).parquet(source)
        start_scoring(requests, fitted, out, state).awaitTermination()
        return {r["id"]: r for r in spark.read.parquet(out).collect()}

    arrive((1, "return bad / 0"), (2, " \n"), (3, None))
    first = run()
    assert {i: (r["status"], r["reason"]) for i, r in first.items()} == {
        1: ("accepted", None), 2: ("rejected", "blank"), 3: ("rejected", "empty")
    }
    assert first[1]["label"] == "buggy" and first[2]["score"] is None
    arrive((4, "return good"), (5, "x" * 10001))
    second = run()
    assert set(second) == {1, 2, 3, 4, 5} and spark.read.parquet(out).count() == 5
    assert second[4]["label"] == "clean" and second[5]["reason"] == "too long"


def test_training_job(spark, tmp_path):
    bad, good = "def g(x):\n    return bad / 0", "def g(x):\n    return good + 1"
    rows = [
        (f"r{i}", "s", f"p{i % 9}", "x", "g", bad if i % 2 else good, i % 2, f"r{i}", ("train", "test", "eval")[i % 9 // 3])
        for i in range(90)
    ]
    df = spark.createDataFrame(
        rows,
        "id string, source string, project string, path string, func_name string, code string, is_buggy int, pair_id string, split string",
    )
    settings = training.TrainSettings(n_features=1 << 10, iterations=10)
    merged = training.enlarged_train(df, settings, str(tmp_path / "train"))
    assert merged.count() == 30 + 15 * 3
    assert sorted(r["pos"] for r in merged.select("pos").collect()) == list(range(75))
    report = training.run(df, settings, str(tmp_path / "run")).collect()
    assert {r["section"] for r in report} == {"test", "project", "held_out"}
    assert all(r["samples"] > 0 and 0 <= r["f1_macro"] <= 1 for r in report)
    card = json.loads(spark.read.text(str(tmp_path / "run" / "model_card")).first()[0])
    assert card["training_config"]["seed"] == 42 and card["metrics"]["samples"] == 30
    again = model.load(str(tmp_path / "run" / "model"))
    assert training.score_table(again, df).count() == 60
    plain = training.evaluate(training.train(df, settings), df).collect()
    assert all(r["accuracy"] == 1.0 for r in plain)


def test_texts_stand_in_small_buckets(corpus, monkeypatch):
    """Whole encoded texts move into their bucket, so the buckets of narrow rows are too large for them."""
    asked, number = [], tokens.with_position

    def spy(*args, **options):
        asked.append(options["rows_per_bucket"])
        return number(*args, **options)

    monkeypatch.setattr(tokens, "with_position", spy)
    tokens.window_batches(corpus.select("id", F.array(F.lit(4)).alias("ids")), 2)
    assert asked == [tokens.TEXTS_PER_BUCKET] and asked[0] <= 10_000
