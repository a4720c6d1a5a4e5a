"""Shards, mixtures, page verdicts, vectors and the pipeline against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from defectloom.llm import mixing, sharding, urls, vectors
from defectloom.llm.prefix import running_sums
from defectloom.llm.store import packed, row_marks
from tests.llm.conftest import SCHEMA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(300)]), rng.randrange(9), rng.randrange(100)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "k long, h long, v long").repartition(7)
    got = running_sums(df, ["k", "h", "v"], {"before": "v", "pos": F.lit(1)}).collect()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    total, want = 0, []
    for k, row in enumerate(rows):
        want.append((*row, total, k))
        total += row[2]
    assert sorted(tuple(r) for r in got if r.k is not None) == sorted(w for w in want if w[0] is not None)
    assert Counter(tuple(r) for r in got) == Counter(want)


def test_byte_shards(docs, rows):
    got = sharding.byte_shards(docs, shards=5).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert set(by) <= set(range(5))
    order = []
    for shard in sorted(by):
        own = sorted(by[shard], key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        assert sum(r.size for r in own) <= total / 5 + largest
        order += [(r.doc_id is not None, r.doc_id or 0) for r in own]
    assert order == sorted(order)


def test_even_shards_where_documents_are_small(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), (F.col("id") % 9).cast("int")).alias("text"))
    sizes = [r[1] for r in sharding.byte_shards(docs).groupBy("shard").sum("size").collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 2 * 24


def test_written_shards(spark, docs, tmp_path):
    known = docs.where("doc_id < 85").withColumn("slot", F.lit("mine"))
    sharding.write_shards(known, f"file://{tmp_path}/shards", shards=4)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert back.count() == 85 and back.where("shard is null").count() == 0


def fill(sizes, weights, most):
    """Targets by raising full sources one after the other."""
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = sum(weights[s] for s in sizes if s not in full)
        share = {s: most * sizes[s] if s in full else rest * weights[s] / open_ for s in sizes}
        more = {s for s in sizes if s not in full and share[s] > most * sizes[s]}
        if not more:
            return share
        full |= more


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{k:02}": rng.choice([0, 1, 5, 40, 3000]) + rng.randrange(9) for k in range(11)} | {None: 77}
    rows = [(s, n, 1) for s, n in sizes.items()]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long, n long")).collect()}
    names = sorted(s for s in sizes if s is not None) + [None]
    want = fill(sizes, {s: k % 3 + 1 for k, s in enumerate(names)}, 3)
    assert got == pytest.approx(want)


def test_mixture_comes_near_its_targets(docs, rows):
    got = mixing.mixture(docs).collect()
    size = {}
    for r in rows:
        size.setdefault(r[3], []).append(len(WORD.findall(r[1] or "")))
    assert Counter(r["size"] for r in got) == Counter(n for own in size.values() for n in own)
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.copies <= 3
        by[r.source_size, r.target].append(r)
    for (source_size, target), own in by.items():
        assert source_size == sum(r["size"] for r in own)
        assert abs(sum(r["size"] * r.copies for r in own) - target) <= max(r["size"] for r in own) + 1
    again = Counter(tuple(r) for r in mixing.mixture(docs.repartition(3)).collect())
    assert again == Counter(tuple(r) for r in got)


def test_multipliers_solve_the_dual(spark):
    rng = random.Random(1)
    sizes = [(s, n, rng.randrange(1, 9)) for s in "abc" for n in rng.sample(range(1, 400), 30)]
    df = spark.createDataFrame(sizes, "source string, size long, n long")
    totals = {s: sum(n * k for t, n, k in sizes if t == s) for s in "abc"}
    wanted = {"a": 0.2 * totals["a"], "b": 2.5 * totals["b"], "c": 1.0 * totals["c"]}
    docs = {s: sum(k for t, _, k in sizes if t == s) for s in "abc"}
    targets = spark.createDataFrame(
        [(s, docs[s], totals[s], wanted[s]) for s in "abc"], "source string, docs long, source_size long, target double"
    )
    for r in mixing.multipliers(df, targets).collect():
        mean = totals[r.source] / docs[r.source]
        words = sum(k * n * min(3, math.exp(r.lam * n / mean)) for t, n, k in sizes if t == r.source)
        assert words == pytest.approx(wanted[r.source], rel=1e-5)


def test_mixed_rows(docs, rows):
    more = docs.withColumn("_h", F.lit("mine")).withColumn("size", F.lit(1)).withColumn("copies", F.lit(9))
    mixed = mixing.mix(more)
    assert mixed.columns == more.columns
    got = Counter(r.doc_id for r in mixed.collect())
    want = Counter()
    for r in mixing.mixture(docs).collect():
        want[r.doc_id] += r.copies
    assert got == +want


def test_rows_that_differ_in_which_column_is_null_stay_apart(spark):
    rows = [(1, "some words here", "web", None, 5), (1, "some words here", None, "web", 5)]
    lists = [(2, [None, "a"]), (2, ["a", None]), (2, ["a"]), (2, None)]
    for df in (spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(lists, "k long, v array<string>")):
        marks = [tuple(r) for r in packed(df).select(*row_marks(df)).collect()]
        assert len(set(marks)) == len(marks)
    docs = spark.createDataFrame(rows, SCHEMA)
    want = Counter()
    for r in mixing._copies(mixing._narrow(docs, "doc_id", "source", "text"), mixing.WEIGHTS, mixing.MOST).collect():
        want[r.source] += r.copies
    assert Counter(r.source for r in mixing.mix(docs).collect()) == +want and len(+want) == 2


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
         ("block", "net", "/fr/")]


def brute_page(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, behind = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    return host, behind[: min([behind.index(c) for c in "?#" if c in behind], default=len(behind))]


def brute_rule(host, path):
    fit = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fit, key=lambda r: len(r[1] + r[2]), default=None)
    return (best[1] + best[2], best[0]) if best else (None, None)


def brute_bounds(pages, outcomes):
    """Posterior bounds of all hosts, level by level."""
    host_of = defaultdict(list)
    for page, host in pages:
        host_of[page].append(host)
    n, bad = Counter(), Counter()
    for page, b in outcomes:
        for host in host_of.get(page, []) if b is not None else []:
            n[host] += 1
            bad[host] += b
    hosts = {h for _, h in pages}

    def names(host):
        parts = host.split(".")
        two = ".".join(parts[-2:])
        return (two, ".".join(parts[-3:])) if two in urls.SUFFIXES else (parts[-1], two)

    prior = (sum(bad.values()) + 1) / (sum(n.values()) + 2)

    def level(members, prior_of):
        above = below = 0
        sums = {g: (sum(n[h] for h in own), sum(bad[h] for h in own)) for g, own in members.items()}
        for g, (m, b) in sums.items():
            p = prior_of(g)
            above += (b - m * p) ** 2 - m * p * (1 - p)
            below += m * (m - 1) * p * (1 - p)
        spread = above / below if below else 0.001
        s = 1 / min(0.5, max(0.001, spread)) - 1
        return s, {g: (s * prior_of(g) + b) / (s + m) for g, (m, b) in sums.items()}

    suffixes, domains = defaultdict(set), defaultdict(set)
    for h in hosts:
        suffixes[names(h)[0]].add(h)
        domains[names(h)[1]].add(h)
    _, suffix = level(suffixes, lambda g: prior)
    _, domain = level(domains, lambda g: suffix[names(next(iter(domains[g])))[0]])
    s, mean = level({h: {h} for h in hosts}, lambda g: domain[names(g)[1]])
    limit = min(urls.MOST, urls.RATIO * prior)
    return {h: above(limit, mean[h] * (s + n[h]), (1 - mean[h]) * (s + n[h])) > urls.SURE for h in hosts}


def above(x, a, b):
    """The upper tail of a beta distribution, integrated over logits."""
    at = np.linspace(-400, 400, 800_001)
    logs = -a * np.logaddexp(0, -at) - b * np.logaddexp(0, at)
    density = np.exp(logs - logs.max())
    return float(density[at > math.log(x / (1 - x))].sum() / density.sum())


def test_beta_tail_is_that_of_a_binomial(spark):
    cases = [(x, a, b) for x in (0.02, 0.15, 0.3, 0.5, 0.9) for a in (1, 2, 7, 60) for b in (1, 3, 40, 500)]
    table = spark.createDataFrame([(x, float(a), float(b)) for x, a, b in cases], "x double, a double, b double")
    got = [r[0] for r in table.select(urls.beta_above(*(F.col(c) for c in "xab"))).collect()]
    for (x, a, b), p in zip(cases, got):
        n = a + b - 1
        want = math.fsum(math.comb(n, k) * x**k * (1 - x) ** (n - k) for k in range(a))
        assert p == pytest.approx(want, abs=2e-4)


def test_a_planted_bad_host_is_blocked(spark):
    rng = random.Random(2)
    rows, outcomes = [], []
    for k in range(3000):
        host = "bad.example.org" if k % 50 == 0 else f"h{k % 40}.site{k % 8}.de"
        rows.append((k, f"https://{host}/x{k}"))
        outcomes.append((k, int(rng.random() < (0.6 if host.startswith("bad") else 0.1))))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = urls.judge_pages(pages, spark.createDataFrame(outcomes, "page_id long, bad int")).collect()
    assert {r.host for r in got if r.verdict == "block"} == {"bad.example.org"}
    assert sum(r.verdict == "block" for r in got) == 60


def test_pages(spark):
    rng = random.Random(9)
    hosts = ["a.example.com", "www.example.com", "EXAMPLE.com", "x.net", "y.x.net", "bad.org", "w.bad.org", "one.co.uk", "two.co.uk",
             "localhost", "notexample.com", "É.de"]
    paths = ["", "/", "/en/", "/en/a?b#c", "/es/x", "/fr/", "?q=/", "#/", "/en", "/es?x"]
    rows = [(k, f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(paths)}") for k in range(500)]
    rows += [(500, None), (501, "no scheme"), (502, "://"), (503, "a://b://c/d"), (None, "http://x.net/"), (None, None), (4, "http://bad.org")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("mine")).withColumn("n", F.lit(1))
    host_of = [(k, brute_page(u)[0]) for k, u in rows]
    outcomes = [(k, int("bad" in (host_of[k][1]) or rng.random() < 0.2)) for k in rng.sample(range(500), 300)]
    outcomes += [(3, None), (9999, 1), (None, 1), (outcomes[0][0], 1)]
    table = spark.createDataFrame(outcomes, "page_id long, bad int")
    got = urls.judge_pages(pages, table).collect()
    bounds = brute_bounds(host_of, [o for o in outcomes if o[0] is not None])
    want = []
    for k, u in rows:
        host, path = brute_page(u)
        rule, verdict = brute_rule(host, path)
        want.append((k, host, path, rule, verdict or ("block" if bounds[host] else "allow")))
    assert Counter(tuple(r) for r in got) == Counter(want)
    assert {w[4] for w in want if w[3] is None} == {"allow", "block"}
    assert {r.host: r.blocked for r in urls.reputation(urls.with_host(pages.select("page_id", "url")), table).collect()} == bounds


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    outcomes = spark.createDataFrame([], "page_id long, bad int")
    assert urls.judge_pages(pages, outcomes).count() == 0
    some = spark.createDataFrame([(1, "http://a.de/")], "page_id long, url string")
    assert urls.judge_pages(some, outcomes).first().verdict == "allow"


def clustered(seed=3, n=500, length=16):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, length))
    near = base[:150] + 0.06 * rng.standard_normal((150, length))
    chain = [base[0]]
    for _ in range(12):
        chain.append(chain[-1] + 0.2 * rng.standard_normal(length))
    one = base[1] + 0.02 * rng.standard_normal((80, length))
    rows = np.concatenate([base, near, np.array(chain), one, base[:5], np.repeat(base[3:4], 40, 0), 3 * base[6:9]])
    return [(k, [float(x) for x in np.float32(v)]) for k, v in enumerate(rows)]


def brute_vectors(rows):
    good = [(k, v) for k, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = defaultdict(set)
    for length in {len(v) for _, v in good}:
        own = [(k, v) for k, v in good if len(v) == length]
        m = vectors.unit(np.array([v for _, v in own]))
        for i, j in zip(*np.nonzero(m @ m.T >= 0.95)):
            if i != j:
                links[own[i][0]].add(own[j][0])
    return links


@pytest.mark.parametrize("tile", [512, 16])
def test_vectors_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    monkeypatch.setattr(vectors, "PER_CELL", 8)
    rows = clustered()
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 16), (n + 3, [float("nan")] + [1.0] * 15), (n + 4, [None] + [1.0] * 15),
             (n + 5, [float("inf")] * 16), (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0]), (n + 8, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vector", F.lit(1)).repartition(4)
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    assert len(got) == len(rows)
    links = brute_vectors(rows)
    every, found = sum(map(len, links.values())), sum(r.n_links for r in got.values())
    # A link is found from either side, so nearly all are; none is made up.
    assert found >= 0.995 * every
    assert all(r.n_links <= len(links[k]) for k, r in got.items())
    exact = {r.vec_id: r for r in vectors.near_vectors(df, recall=1.0).collect()}
    assert {k: r.n_links for k, r in exact.items()} == {k: len(links[k]) for k in got}
    root = {}
    for k, _ in rows:
        stack, seen = [k], {k}
        if k not in root:
            while stack:
                for j in links[stack.pop()] - seen:
                    seen.add(j)
                    stack.append(j)
            root |= {j: min(seen) for j in seen}
    assert {k: r.component_id for k, r in exact.items()} == root
    assert all(r.kept == (k == r.component_id) for k, r in exact.items())


def test_more_lengths_than_have_an_index(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LENGTHS", 2)
    monkeypatch.setattr(vectors, "TILE", 16)
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(rng.standard_normal((90, 12)))]
    for length in range(1, 41):
        base = rng.standard_normal(length)
        rows += [(len(rows) + k, [float(x) for x in base + 0.2 * rng.standard_normal(length)]) for k in range(4 + 40 * (length == 7))]
    rows.append((len(rows), rows[-1][1]))
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=1.0).collect()}
    links = brute_vectors(rows)
    assert {k: r.n_links for k, r in got.items()} == {k: len(links[k]) for k, _ in rows}
    assert all(r.component_id <= min({k, *links[k]}) for k, r in got.items())


@pytest.mark.parametrize("rank", [4, 6, 8])
def test_recall_in_data_of_low_rank(rank):
    rng = np.random.default_rng(rank)
    data = vectors.unit(rng.standard_normal((6000, rank)) @ np.linalg.qr(rng.standard_normal((64, rank)))[0].T)
    index = vectors.MultiIndex(data[:4000], 128, 0.95, vectors.RECALL)
    who, cells = index.visits(data[:600])
    visited = np.zeros((600, 128 * 128), bool)
    visited[who, cells] = True
    homes = index.cells(data)
    i, j = np.nonzero(data[:600] @ data.T >= 0.95)
    either = visited[i, homes[j]]
    for k in np.nonzero(~either)[0]:
        back, there = index.visits(data[j[k] : j[k] + 1])
        either[k] = homes[i[k]] in there
    assert either.mean() >= 0.99


def test_repeated_rows_and_unknown_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.01]), (None, [0.0, 1.0])]
    got = Counter(tuple(r) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == Counter([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, False)])


def test_no_vectors(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pipeline(spark, docs, rows, tmp_path):
    import corpus_pipeline

    folder = f"{tmp_path}"
    docs.write.parquet(f"file://{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, f"file://{folder}").collect()
    assert {r.doc_id for r in out} <= {r[0] for r in rows} and len(out) > 40
    stages = dict(corpus_pipeline.STAGES)
    now = spark.read.schema(SCHEMA).parquet(f"file://{folder}/documents.parquet")
    for name, stage in list(stages.items())[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == docs.columns, name
    assert now.where(F.length("text") != F.col("n_chars")).count() == 0
    assert Counter(r.doc_id for r in now.collect()) == Counter(r.doc_id for r in out)


def test_pipeline_without_documents(spark, no_docs, tmp_path):
    import corpus_pipeline

    no_docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
