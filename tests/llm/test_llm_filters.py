"""Quality, near copies, personal data and licences against plain Python."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict
from math import log

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from defectloom.llm import licenses, pii, quality, simhash
from defectloom.llm.components import components, forest
from tests.llm.conftest import SCHEMA, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {k: k + 32 for k in range(65, 91)}


def brute_repeats(own):
    counts = Counter(tuple(own[i : i + 8]) for i in range(len(own) - 7))
    covered = set()
    for i in range(len(own) - 7):
        if counts[tuple(own[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    return len(covered)


def test_repeated_words_by_doubling():
    rng = random.Random(3)
    for _ in range(300):
        own = [rng.choice(b"abc").to_bytes(1, "big") for _ in range(rng.randrange(60))]
        assert quality.repeated_words(own) == brute_repeats(own)


def brute_quality(rows, max_share, min_docs, min_left):
    lines_of, docs_of, having = {}, defaultdict(set), defaultdict(set)
    for _, text, _, source, _ in rows:
        text = text or ""
        docs_of[source].add(text)
        lines_of[text] = [
            (" ".join(WORD.findall(line.translate(ASCII_LOWER))), line) for line in text.split("\n") if WORD.search(line)
        ]
        for norm, _line in lines_of[text]:
            having[source, norm].add(text)
    out = []
    for doc_id, text, _, source, _ in rows:
        text = text or ""
        own = WORD.findall(text)
        repeats = brute_repeats(own)
        raw = [line for _, line in lines_of[text]]
        gone = [
            n for n, _ in lines_of[text]
            if len(having[source, n]) >= min_docs and len(having[source, n]) > max_share * len(docs_of[source])
        ]
        left = len(own) - sum(len(n.split(" ")) for n in gone)
        failed = len(own) < 20 or 100 * repeats > 30 * len(own)
        out.append(
            (doc_id, len(own), sum(map(len, own)), sum(text.count(c) for c in "#*$%&|<>"), len(raw) - len(set(raw)),
             repeats, failed, left, not failed and left >= min_left * len(own))
        )
    return out


def with_common_lines(rows):
    """Lines that many documents of one host share, in other cases and blanks."""
    out = []
    for k, row in enumerate(rows):
        row = list(row)
        if row[1] and row[3] == "s0" and k % 3:
            row[1] += "\nAll rights  RESERVED by us\nall rights reserved\tby us"
        if row[3] == "s1" and row[1]:
            shared = [f"n{i} share this page with all {i} of your friends" for i in range(12)]
            row[1] = "\n".join([*shared, row[1]])
        out.append(tuple(row))
    return out


def test_quality_counts_lines_over_documents(spark, rows):
    rows = with_common_lines(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = quality.quality(docs, max_share=0.2, min_docs=4)
    names = ["doc_id", *quality.COUNTS, "base_failed", "n_left", "kept"]
    want = brute_quality(rows, 0.2, 4, quality.MIN_LEFT)
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == Counter(want)
    assert any(w[1] != w[7] for w in want) and any(not w[6] and not w[8] for w in want)


def test_good_documents_lose_their_common_lines(spark, rows):
    rows = with_common_lines(rows)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("own", F.lit("mine")).withColumn("removed", F.lit(1))
    kept = quality.keep_good(docs, max_share=0.2, min_docs=4)
    assert kept.columns == docs.columns
    want = Counter(w[0] for w in brute_quality(rows, 0.2, 4, quality.MIN_LEFT) if w[8])
    got = kept.collect()
    assert Counter(r.doc_id for r in got) == want
    assert all("all rights" not in r.text.lower() for r in got)
    originals = {r[0]: r[1] for r in rows}
    assert any(r.text == originals[r.doc_id] for r in got) and any(r.text != originals[r.doc_id] for r in got)


def test_copies_alone_make_no_line_common(spark):
    rng = random.Random(4)
    text = "\n".join(words(rng, 12) for _ in range(5))
    docs = spark.createDataFrame([(k, text, "en", "s", 0) for k in range(50)], SCHEMA)
    assert quality.keep_good(docs).count() == 50


def test_a_line_is_common_at_the_same_number_of_documents_in_any_host(spark):
    rng = random.Random(9)
    rows = []
    for host, size in (("small", 60), ("large", 400)):
        for k in range(size):
            shared = ["shared by twenty five of the documents"] * (k < 25) + ["shared by only nineteen"] * (k < 19)
            rows.append((len(rows), "\n".join([words(rng, 40, 10_000), *shared]), "en", host, 0))
    got = {r.doc_id: r.text for r in quality.keep_good(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    assert not any("twenty five" in t for t in got.values())
    assert sum("nineteen" in t for t in got.values()) == 38


def brute_simhash(text):
    own = WORD.findall((text or "").translate(ASCII_LOWER))
    shingles = [" ".join(own[k : k + 3]) for k in range(max(1, len(own) - 2))] if own else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_bits(rows):
    for row in rows:
        if len(row[1] or "") < 10_000:
            assert simhash.simhash(row[1]) % (1 << 64) == brute_simhash(row[1])


def test_bk_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    near = base[:80] ^ (np.uint64(1) << rng.integers(0, 64, 80).astype(np.uint64))
    prints = np.unique(np.concatenate([base, near, near[:20] ^ np.uint64(5)]))
    tree = simhash.BkTree.load(simhash.BkTree.build(prints).dump())
    got = set(zip(*(a.tolist() for a in tree.within(prints, 3))))
    want = {(a, b) for a in prints.tolist() for b in prints.tolist() if (a ^ b).bit_count() <= 3}
    assert got == want
    # Children keep the distance to their parent, each distance once.
    apart = np.bitwise_count(tree.prints[1:] ^ tree.prints[tree.parent[1:]])
    assert (apart == tree.distance[1:]).all()
    assert len(set(zip(tree.parent[1:].tolist(), apart.tolist()))) == len(prints) - 1


def group(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_components(ids, prints):
    kinds = sorted(set(prints))
    near = [(a, b) for a, b in itertools.combinations(kinds, 2) if (a ^ b).bit_count() <= 3]
    root = group(kinds, near)
    smallest = {}
    for doc_id, fp in zip(ids, prints):
        if doc_id is not None:
            smallest[root[fp]] = min(doc_id, smallest.get(root[fp], doc_id))
    return [smallest.get(root[fp]) for fp in prints]


@pytest.mark.parametrize("sizes", [(512, 2048), (4, 8)])
def test_simhash_components(docs, rows, monkeypatch, sizes):
    monkeypatch.setattr(simhash, "SHARD_SIZE", sizes[0])
    monkeypatch.setattr(simhash, "TREE_SIZE", sizes[1])
    got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.simhash_components(docs).collect())
    prints = [simhash.simhash(r[1]) % (1 << 64) for r in rows]
    ids = [r[0] for r in rows]
    assert got == Counter(zip(ids, prints, brute_components(ids, prints)))


def near_pairs(rng, n):
    """Random fingerprints, and for each another one at most three bits apart."""
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (n, 3)).astype(np.uint64)
    return np.unique(np.concatenate([base, np.bitwise_xor.reduce(flips, axis=1) ^ base]))


@pytest.mark.parametrize("rows, shards", [(1 << 25, 10), (1 << 33, 20), (1 << 40, 35)])
def test_shards_for_any_number_of_prints(spark, monkeypatch, rows, shards):
    # The shards that a table of so many rows would get: from two, three or four blocks.
    prints = near_pairs(np.random.default_rng(4), 1000)
    own = prints.view(np.int64).tolist()
    table = spark.createDataFrame([(p,) for p in own], "fp long").repartition(3)
    whole = simhash.in_shards
    assert whole(table, rows).count() == shards * len(own)
    monkeypatch.setattr(simhash, "in_shards", lambda t, n, max_bits: whole(t, rows, max_bits))
    got = group(own, ((r.node, r.root) for r in simhash.near_prints(table).collect()))
    apart = np.bitwise_count(prints[:, None] ^ prints[None, :])
    assert got == group(own, ((own[a], own[b]) for a, b in zip(*np.nonzero(apart <= 3))))


def test_work_per_print_does_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_SIZE", 1)
    for n, shards in ((1 << 14, 4), (1 << 19, 10)):
        prints = spark.range(n).select(F.xxhash64("id").alias("fp"))
        sizes = simhash.in_shards(prints, n).groupBy("shard").count()
        looked = sizes.agg(F.sum(F.col("count") * F.col("count"))).first()[0] / n
        assert looked < 2 * shards


def test_a_crowded_shard_is_many_keys(spark, monkeypatch):
    # All prints share 50 leading bits: their trees and queries meet in groups, and no link is lost.
    monkeypatch.setattr(simhash, "TREE_SIZE", 32)
    monkeypatch.setattr(simhash, "TREES_AT_ONCE", 2)
    prints = np.unique(np.random.default_rng(6).integers(0, 1 << 14, 700)).astype(np.uint64)
    table = spark.createDataFrame([(int(p),) for p in prints], "fp long")
    own = prints.tolist()
    apart = np.bitwise_count(prints[:, None] ^ prints[None, :])
    want = group(own, ((own[a], own[b]) for a, b in zip(*np.nonzero(apart <= 3))))
    assert group(own, ((r.node, r.root) for r in simhash.near_prints(table).collect())) == want


def test_one_document_of_each_group_stays(docs, rows):
    prints = [simhash.simhash(r[1]) % (1 << 64) for r in rows]
    ids = [r[0] for r in rows]
    groups = set(brute_components(ids, prints))
    more = docs.withColumn("_h", F.lit("mine")).withColumn("fp", F.lit(1)).withColumn("root", F.lit(2))
    kept = simhash.drop_near_copies(more)
    assert kept.columns == more.columns
    got = [r.doc_id for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == groups


def test_chains_and_stars_become_components(spark):
    links = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 5000), (7, 7)]
    links += [(1050, 2000), (2000, 2001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    want = group({n for p in links for n in p}, links)
    assert got == {n: r for n, r in want.items() if n != r}


def test_forest_of_a_clique_is_a_tree():
    a, b = zip(*itertools.combinations(range(40), 2))
    node, root = forest(np.array(a), np.array(b))
    assert len(node) == 39 and set(root.tolist()) == {0}


def luhn(digits):
    return sum(int(x) if k % 2 == 0 else int(x) * 2 - 9 * (int(x) > 4) for k, x in enumerate(reversed(digits))) % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


def odd_personal_texts():
    rng = random.Random(8)
    bits = ["a@b.c", "x.y+z@d-e.f.g", "@", ".", "..", "-", "+", "1", "12", "255", "256", "007", "1.2.3.4", "4111 1111 1111 1111",
            "5500-0000-0000-0004", "+1 (555) 123-4567", "+", "é", "🙂", " ", "\x01", "\x02", "4", "(", ")", "_", "%", "\n", "z9"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(1500)]
    texts += ["1" * 20_000, "a" * 20_000 + "@b.c", "1 " * 10_000, "a." * 10_000 + "@" + "b." * 10_000 + "c", "+1" + "-" * 9_000]
    texts += [None, "", "a@b.c " * 400, "4111111111111111", "a@b@c.d+e@f.g"]
    return texts


def test_base_spans(spark):
    texts = odd_personal_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.base_text for r in pii.personal_data(docs).select("doc_id", "base_text").collect()}
    for k, text in enumerate(texts):
        assert got[k] == brute_spans(text), text


def disclosure_docs():
    rng = random.Random(6)
    rows = []
    for k in range(80):
        text = words(rng, 20)
        if k < 6:
            text = f"the Zorblat person known as quimby wrote from jo@corp.example and left the {text}"
        elif k < 50:
            text = f"the person wrote {text}"
        rows.append((k, text))
    return rows + [(80, None), (81, "other@mail.example"), (None, "the mail of Zorblat quimby")]


def test_words_that_reveal_an_entity(spark):
    rows = disclosure_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii._find(docs, "doc_id", "text")
    got = {(r.entity, r.word): r.share for r in pii.revealing_words(docs, found, generalise_at=-9).collect()}
    n = len(rows)
    with_word = Counter(w for _, t in rows for w in {x.lower() for x in re.findall(r"[^\W\d_]{3,}", t or "")})
    for word, times in (("the", 6), ("zorblat", 6), ("quimby", 6), ("person", 6), ("left", 6)):
        want = log((times * n / 6 + pii.DOUBT) / (with_word[word] + pii.DOUBT)) / log(n / 6)
        assert got["jo@corp.example", word] == pytest.approx(want)
    assert {e for e, _ in got} == {"jo@corp.example"}


def brute_terms(rows):
    """Spans of revealing words per row, and each text without its personal data."""
    letters = re.compile(r"[^\W\d_]{3,}")
    entity_of = {"email": str.lower, "ip": str}
    near, n_word, n_entity, n_both = [], Counter(), Counter(), Counter()
    for _, text in rows:
        text, own = text or "", []
        spans = [p.split(":") for p in brute_spans(text).split(",") if p]
        spans = [(kind, int(a), int(b)) for kind, a, b in spans]
        for kind, a, b in spans:
            entity = entity_of.get(kind, lambda v: re.sub("[^0-9]", "", v))(text[a:b])
            first = max(0, a - pii.NEAR)
            for at, end in ((first, a), (b, min(len(text), b + pii.NEAR))):
                for m in letters.finditer(text[at:end]):
                    x, y = at + m.start(), at + m.end()
                    cut = (at == first and 0 < x == at < a) or (at == b and y == end == b + pii.NEAR)
                    if not cut and not any(s < y and x < e for _, s, e in spans):
                        own.append((entity, m[0].lower(), x, y))
        near.append((spans, own))
        n_word.update({w.lower() for w in letters.findall(text)})
        n_entity.update({e for e, *_ in own} | {entity_of.get(k, lambda v: re.sub("[^0-9]", "", v))(text[a:b]) for k, a, b in spans})
        n_both.update({(e, w) for e, w, *_ in own})
    n, out = len(rows), []
    for (_, text), (spans, own) in zip(rows, near):
        share = defaultdict(lambda: -9.0)
        for e, w, x, y in own:
            known = log(n / n_entity[e])
            if known > 0:
                lift = (n_both[e, w] * n / n_entity[e] + pii.DOUBT) / (n_word[w] + pii.DOUBT)
                share[x, y] = max(share[x, y], log(lift) / known)
        terms = {p: s for p, s in share.items() if s >= pii.GENERALISE_AT}
        edits = [(a, b, f"[{kind.upper()}]") for kind, a, b in spans]
        for (x, y), s in terms.items():
            edits.append((x, y, "" if s >= pii.REMOVE_AT else "[NAME]" if text[x] != text[x].lower() else "[WORD]"))
        clean, at = "", 0
        for x, y, instead in sorted(edits):
            if x >= at:
                clean += text[at:x] + instead
            at = max(at, y)
        every = sorted([(a, pii.KINDS.index(k), k, b) for k, a, b in spans] + [(x, 4, "term", y) for x, y in terms])
        out.append((",".join(f"{k}:{a}:{b}" for a, _, k, b in every), clean + text[at:] if text else text))
    return out


def far_and_rare_docs():
    rng = random.Random(12)
    rows = [(k, words(rng, 60)) for k in range(400)]
    rows += [(400, f"mail Anselma Zwick at zwick@home.example or {words(rng, 30)}"), (401, f"{words(rng, 30)} from 10.1.2.3 by Berthold")]
    rows += [(k, f"the office of Anselma answers {words(rng, 3)} zwick@home.example") for k in (402, 403)]
    return rows + [(404, f"Anselma {words(rng, 40)}"), (405, f"Zwick {'x' * 90} zwick@home.example")]


@pytest.mark.parametrize("rows", [disclosure_docs(), far_and_rare_docs()], ids=["repeated", "rare"])
def test_terms_are_those_of_plain_python(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(3))
    want = brute_terms(rows)
    got = {r.doc_id: r.spans_text for r in pii.personal_data(docs).collect()}
    assert got == {k: spans for (k, _), (spans, _) in zip(rows, want)}
    clean = pii.sanitise(docs)
    assert clean.columns == ["doc_id", "text", "spans"]
    assert {r.doc_id: r.text for r in clean.collect()} == {k: text for (k, _), (_, text) in zip(rows, want)}
    assert any("term" in spans for spans, _ in want)


def test_names_seen_in_one_document_are_found(spark):
    docs = spark.createDataFrame(far_and_rare_docs(), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert not any(name in got[k] for k, name in ((400, "Anselma"), (401, "Berthold"), (402, "Anselma")))
    assert got[404].startswith("Anselma")


def test_texts_without_personal_data_stay(spark):
    docs = spark.createDataFrame(disclosure_docs(), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    originals = dict(disclosure_docs())
    assert got[0].startswith("the [NAME] person") and "jo@corp" not in got[0] and "quimby" not in got[0]
    assert got[81] == "[EMAIL]" and got[80] is None
    assert all(got[k] == originals[k] for k in [None, *range(6, 80)])


def test_overlapping_spans_are_replaced_once(spark):
    docs = spark.createDataFrame([(1, "call +1 4111 1111 1111 1111 x"), (2, "1.2.3.4 a@b.c")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert got[2] == "[IP] [EMAIL]"
    assert "1111" not in got[1] or brute_spans("call +1 4111 1111 1111 1111 x") == ""


def brute_templates():
    for name in sorted(licenses.NOTICES):
        for template in licenses.NOTICES[name]:
            words = re.findall(r"[^\W_]+", template.lower())
            yield name, len(words), set(zip(words, words[1:]))


def brute_windows(text):
    """The windows kept: (score, name)."""
    words = re.findall(r"[^\W_]+", text.lower())
    pairs, found = list(zip(words, words[1:])), []
    for rank, (name, length, own) in enumerate(brute_templates()):
        hit = [p in own for p in pairs] + [False]
        starts = [i for i, h in enumerate(hit) if h and not hit[i - 1]]
        ends = [i for i, h in enumerate(hit) if h and not hit[i + 1]]
        for s in starts:
            for e in (e for e in ends if e >= s and (e - s < 3 * length + 1 or all(hit[s : e + 1]))):
                mine = set(pairs[s : e + 1])
                score = 2 * len(mine & own) / (len(mine) + len(own))
                if score >= 0.8:
                    found.append((score, -rank, s, e, name))
    kept = []
    for w in sorted(found, reverse=True):
        if all(w[3] < k[2] or k[3] < w[2] for k in kept):
            kept.append(w)
    return [(w[0], w[4]) for w in kept]


def brute_licences(text):
    found, best = set(), None
    text = text or ""
    for p in {*text.split("\n"), *re.split(r"\n[ \t\r]*\n", text), text}:
        own = re.findall(r"[^\W_]+", p.lower())
        mine, scores = set(zip(own, own[1:])), []
        for name, _, theirs in brute_templates():
            scores.append((-2 * len(mine & theirs) / (len(mine) + len(theirs)), name))
        if scores and -min(scores)[0] >= 0.8:
            found.add(min(scores)[1])
            best = max(best or 0, -min(scores)[0])
    for score, name in brute_windows(text):
        found.add(name)
        best = max(best or 0, score)
    return sorted(found), best


def test_licences(spark, rows):
    mit = licenses.NOTICES["MIT"][2]
    texts = [r[1] for r in rows if len(r[1] or "") < 10_000] + [
        "some words\nReleased under the MIT License.\nmore",
        "licensed under cc by nc 4 0\n\nThis work is licensed under the GNU General Public License, version 3.",
        mit, mit[:700].replace(". ", ".\n"), mit + "\n\nother text here", mit.upper(), " ".join(mit.split(" ")[10:]),
        "Copyright me\n\n" + licenses.NOTICES["Apache-2.0"][2].replace(". ", ".\n") + "\n\n" + "x y " * 100,
        "Licensed under the Apache License, Version 2.0.\n" * 3, "under the MIT", "License",
        "a b " * 20 + mit.replace("\n", " ") + " c d " + licenses.NOTICES["GPL-2.0"][0] + " e f " + mit[200:],
        "ours, licensed under the GNU Lesser General Public License, version 3 or licensed under CC BY-NC 4.0 too",
    ]
    # Extra columns may have the names of working columns.
    docs = spark.createDataFrame([(k, t, "mine", "mine") for k, t in enumerate(texts)], "doc_id long, text string, found string, windows string")
    for r in licenses.scan_licences(docs).collect():
        names, best = brute_licences(texts[r.doc_id])
        assert (r.licences, r.score) == (names, pytest.approx(best) if best else None), texts[r.doc_id]


def test_licences_in_lines_and_over_paragraphs(spark):
    rng = random.Random(12)
    mit, gpl = licenses.NOTICES["MIT"][2], licenses.NOTICES["GPL-3.0"][2]
    more = "\n\n" + words(rng, 120)
    texts = {
        "Foo is copyright 2020 Jane Doe and licensed under the MIT License.": ["MIT"],
        "all of it licensed under the Apache License, Version 2.0, see the LICENSE file in the root": ["Apache-2.0"],
        mit.replace(": The", ":\n\nThe").replace('. THE', '.\n\nTHE') + more: ["MIT"],
        gpl.replace(". This", ".\n\nThis").replace(". You", ".\n\nYou") + more: ["GPL-3.0"],
        "both " + mit + " and also x y " + gpl + " end" + more: ["GPL-3.0", "MIT"],
        "code of ours, licensed under the GNU Lesser General Public License, version 3, as ever": ["LGPL-3.0"],
        "the text of this, licensed under CC BY-NC 4.0, and more of it": ["CC-BY-NC-4.0"],
        mit.replace(" or ", " and/or else ") + more: ["MIT"],
        "permission is hereby granted to use the software under the terms of the people": [],
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licences(docs).collect()}
    for k, (text, names) in enumerate(texts.items()):
        assert got[k].licences == names, text
        assert (got[k].score is not None) == bool(names)
    assert got[0].score == got[2].score == got[3].score == 1


def test_empty_tables(no_docs):
    assert quality.quality(no_docs).count() == 0
    assert quality.keep_good(no_docs).count() == 0
    assert simhash.simhash_components(no_docs).count() == 0
    assert simhash.drop_near_copies(no_docs).count() == 0
    assert pii.personal_data(no_docs).count() == 0
    assert pii.sanitise(no_docs).count() == 0
    assert licenses.scan_licences(no_docs).count() == 0


def test_personal_data_has_no_python_and_joins_no_row_with_all(docs):
    plan = pii.personal_data(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert hashlib.sha256(b"").hexdigest()
