"""Phrase mining, exact dedup and conversation repair against plain Python."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from defectloom.llm.chunks import MAX_CHUNK, chunk_list, exact_copies, normalised
from defectloom.llm.phrases import collocations, frequent_runs
from defectloom.llm.summaries import Summary, tally
from defectloom.llm.turns import best_repair, block_table, joined, plain_turns, repair, repair_damaged, search, whole
from defectloom.llm.wordstream import slices

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = "[\x20\x09-\x0d]"


def brute_runs(rows):
    """Occurrences of runs and words per group."""
    counts, words = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(SMALL)):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            own.update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    return counts, words


def brute_collocations(rows, threshold, top):
    out = []
    counts, words = brute_runs(rows)
    for lang, own in counts.items():
        f = {p: a for p, a in own.items() if a >= threshold}
        inside = {
            p[i : i + k] for p, a in f.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if f[p[i : i + k]] == a
        }
        found = []
        for p, a in f.items():
            if len(p) > 1 and p not in inside:
                cuts = [(1000 * a * words[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


def mined(rng):
    rows = [(" ".join(rng.choice("abcde") for _ in range(rng.randrange(60))), rng.choice(["en", "fr", None])) for _ in range(60)]
    rows += [("one\ttwo  Three four. FIVE six", "en")] * 30 + [("und", None), (None, "en"), ("", ""), (" \t.,;\n", "x")]
    rows += [("Ünï été ß 東京 🙂 " * 40, "de"), ("x" * 5000 + " y " * 50, "en"), ("word" * 100 + " z " + "word" * 100, "en")]
    return rows


@pytest.mark.parametrize("capacity", [1 << 16, 32])
def test_collocations_are_those_of_plain_python(spark, rng, capacity):
    rows = mined(rng)
    df = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, grp int").repartition(4)
    for top in (2000, 3):
        got = sorted(map(tuple, collocations(df, threshold=10, top=top, capacity=capacity).collect()))
        assert got == brute_collocations(rows, 10, top)


def test_a_repeated_row_counts_each_time(spark):
    df = spark.range(100_000).selectExpr("'the same. text here' AS text", "'en' AS lang")
    runs, totals = frequent_runs(df)
    assert {(r.phrase, r.f) for r in runs.collect()} == {
        (p, 100_000) for p in ("the", "same", "the same", "text", "here", "text here")
    }
    assert totals.first().n == 400_000


def test_no_documents_no_phrases(spark, no_docs):
    assert collocations(no_docs).collect() == []


def test_counts_of_large_products_are_exact(spark):
    df = spark.createDataFrame([("a b " * 3000, "en")], "text string, lang string")
    row = collocations(df, threshold=100, top=1).first()
    f = brute_runs([("a b " * 3000, "en")])[0]["en"]
    assert row.score == 1000 * row.a * 6000 // (row.l * row.r) and row.a == f[tuple(row.phrase.split())]


def test_a_summary_misses_nothing_frequent(rng):
    stream = np.array([rng.choice([rng.randrange(12), rng.randrange(5000)]) for _ in range(20_000)], np.uint64)
    true = Counter(stream.tolist())
    threshold, capacity = 200, 20_000 // 200 + 1
    whole_, parts = Summary(capacity), [Summary(capacity) for _ in range(7)]
    for k, block in enumerate(np.array_split(stream, 70)):
        parts[k % 7].add(*tally(block))
    for part in parts:
        whole_.add(part.hashes, part.counts, part.lost)
    assert whole_.lost < threshold and len(whole_.hashes) <= capacity
    assert {h for h, n in true.items() if n >= threshold} <= set(whole_.possible(threshold).tolist())
    for h, n in zip(whole_.hashes.tolist(), whole_.counts.tolist()):
        assert n <= true[h] <= n + whole_.lost


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_slices_lose_and_repeat_no_run(rng, size):
    texts = [" ".join(rng.choice(["aa", "b", "c.", "ddd"]) for _ in range(rng.randrange(200))) for _ in range(30)]
    texts += [None, "", "q" * 300, " lead", "trail "]
    got = Counter()
    for part in slices(texts, [5] * len(texts), size):
        whole_ = np.ones(len(part.starts), bool)
        for n in range(1, 6):
            whole_ = whole_ if n == 1 else part.unbroken(whole_, n)
            got.update(tuple(part.text(int(k), n).split()) for k in np.flatnonzero(whole_[: part.own]))
    assert got == brute_runs([(t, "g") for t in texts])[0]["g"]


def brute_copies(rows):
    groups, out = {}, []
    for key, text in rows:
        groups.setdefault(re.sub(f"{BLANKS}+", " ", text or ""), []).append(key)
    for text, keys in groups.items():
        keep = min((k for k in keys if k is not None), default=None)
        first = keys.index(keep)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(k, keep, len(keys), i == first, sha) for i, k in enumerate(keys)]
    return sorted(out, key=repr)


def test_normalised_is_the_pattern(rng):
    for _ in range(3000):
        text = "".join(rng.choice(" \t\n\r\x0b\x0c\x1c\x85\xa0ab") for _ in range(rng.randrange(8)))
        assert normalised(text) == re.sub(f"{BLANKS}+", " ", text).encode()


def test_chunks_follow_the_content(rng):
    text = " ".join(f"w{rng.randrange(10_000)}" for _ in range(60_000)).encode()
    whole_ = chunk_list(text)
    assert b"".join(whole_) == text and max(map(len, whole_)) <= MAX_CHUNK
    moved = chunk_list(b"something before it " * 40 + text)
    assert len(set(whole_) & set(moved)) > 0.8 * len(whole_)
    same = chunk_list(b"x" * 300_000)
    assert b"".join(same) == b"x" * 300_000 and max(map(len, same)) <= MAX_CHUNK


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_copies_are_those_of_plain_python(spark, rng, digest_bytes):
    """With digests of one byte nearly all chunks collide; the bytes decide."""
    base = ["".join(rng.choice("ab ") for _ in range(rng.choice([5, 3000, 9000]))) for _ in range(50)]
    rows = [(rng.choice([None, *range(50)]), rng.choice([None, "", " ", *base])) for _ in range(400)]
    rows += [(7, "a \n b" * 40_000), (3, "a\tb" * 40_000), (3, "a\tb" * 40_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, recipe int").repartition(4)
    got = sorted(map(tuple, exact_copies(df, digest_bytes=digest_bytes).collect()), key=repr)
    assert got == brute_copies(rows)


def test_copies_of_no_documents_and_of_one_row(spark, no_docs):
    assert exact_copies(no_docs).collect() == []
    df = spark.range(100_000).selectExpr("id AS doc_id", "'the  same' AS text")
    rows = exact_copies(df).selectExpr("sum(int(kept)) AS kept", "max(keep) AS keep", "min(group_size) AS n").first()
    assert tuple(rows) == (1, 0, 100_000)


def cheapest(marked):
    """(cost, audit) by search in order of cost and audit over whole patterns of roles."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "")], set()
    while True:
        cost, audit, i, roles = heapq.heappop(heap)
        if (i, roles) in done:
            continue
        done.add((i, roles))
        if i == len(marked) and roles in ("", "xa"):
            return cost, audit
        after = {c: c if c == "s" else "x" + c for c in follow[roles[-1:]]}
        for c in set(after) - {"s"}:
            heapq.heappush(heap, (cost + 3, audit + "I", i, after[c]))
        if i < len(marked):
            initial, kind = marked[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles))
            if kind in (0, 3):
                for c in set(after) - {"s"}:
                    heapq.heappush(heap, (cost + 3 + kind, audit + "R", i + 1, after[c]))
                if initial in after:
                    heapq.heappush(heap, (cost + kind, audit + "K", i + 1, after[initial]))


def brute_repair(rows):
    convs, out = {}, []
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for conv, own in convs.items():
        own.sort(key=lambda e: (e[0] is not None, e[0] or 0, e[1], hashlib.sha256(e[2].encode()).hexdigest()))
        seen, marked = set(), []
        for _, role, text in own:
            chars = re.findall("[^\x20\x09-\x0d]", text)
            marked.append((role[:1], 1 if not chars else 2 if (role, text) in seen else 0 if chars[-1] in ".!?" else 3))
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        kinds = [k for _, k in marked]
        cost, audit = cheapest(marked)
        lines, roles, left = [], "", iter(own)
        for edit in audit:
            role, text = (None, "") if edit == "I" else next(left)[1:]
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if roles[-1:] == "u" else "user"
            roles += role[0]
            lines.append(f"{role}:{text}")
        assert re.fullmatch("(s?(ua)+)?", roles)
        out.append((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds.count(1), kinds.count(2), kinds.count(3),
            sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def random_turns(rng, n):
    return [(rng.choice(["s", "u", "a", "a", "u", "x", ""]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]


def test_search_finds_the_cheapest_edits(rng):
    for _ in range(1500):
        turns = random_turns(rng, rng.randrange(12))
        assert search(turns) == cheapest(turns)
    for roles in ("u" * 64, "a" * 64, "s" * 64, "uuaa" * 16):
        turns = [(c, 3) for c in roles]
        assert search(turns) == cheapest(turns)


def test_blocks_joined_are_the_whole_conversation(rng):
    for _ in range(40):
        turns = random_turns(rng, rng.randrange(2, 200))
        cut = rng.randrange(1, len(turns))
        assert whole(joined(block_table(turns[:cut]), block_table(turns[cut:]))) == cheapest(turns) == best_repair(turns)


def conversations(rng):
    rows = []
    for conv, n in ((None, 300), (1, 700), (2, 4500), (3, 9), (4, 8), (5, 1)):
        for k in range(n):
            role = rng.choice([None, "", "user", "assistant", "system", "user", "assistant", "tool"])
            text = rng.choice([None, "", " \t", "a", "b.", "Hi! ", "é?\n", f"t{k}.", f"t{k}", "x" * 50])
            rows.append((conv, rng.choice([None, *range(k // 2 + 1)]), role, text))
    return rows


@pytest.mark.parametrize("large", [4096, 100])
def test_repairs_are_those_of_plain_python(spark, rng, large):
    rows = conversations(rng)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = sorted(map(tuple, repair_damaged(df, large).collect()), key=repr)
    assert got == brute_repair(rows)


def test_repair_of_nothing_and_of_one_turn_repeated(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, pos int")
    assert repair_damaged(none).collect() == []
    df = spark.range(20_000).selectExpr("1L AS conv_id", "2L AS turn", "'user' AS role", "'Hi.' AS text", "id AS pos")
    row = repair(plain_turns(df)).first()
    assert (row.gaps, row.duplicate, row.illegal, row.cost) == (0, 19_999, 19_999, 4 * 19_999 + 3)
    assert row.audit == "K" + "D" * 19_999 + "I" and row.repaired_sha256 == hashlib.sha256(b"user:Hi.\nassistant:").hexdigest()
