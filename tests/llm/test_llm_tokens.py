"""Encoding against the library, decoding, and the compressed files."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from defectloom.llm import bpe, token_files
from defectloom.llm.encoder import ChunkTable
from defectloom.llm.pretoken import Memo, Splitter, read_spec

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.TrieEncoder(read_spec(PATH))


def ids(data):
    return np.frombuffer(data, np.uint32).tolist()


def odd_texts():
    rng = random.Random(1)
    letters = "abcABC'streved12 .,;:-_<|>éÉßÑñΣςİıſǅＡ中文한글̈\t\r\n\x0b\x1c\x85\xa0 😀aaaaatthhee"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(600)]
    texts += ["", None, "a" * 3000, "ab" * 2000, "<|endoftext|>x <|startoftext|> <|ENDOFTEXT|>"]
    texts += [" ".join("x" + chr(k) + "y" for k in range(0x21, 0x0600))]
    return texts


def test_trie_gives_the_library_s_ids(encoder, library):
    texts = odd_texts()
    for text, got in zip(texts, encoder.encode(texts)):
        assert ids(got) == library.encode(text or "", add_special_tokens=False).ids


def test_memoed_library_gives_the_library_s_ids(library):
    texts = odd_texts()
    for text, got in zip(texts, token_files.LibraryEncoder(read_spec(PATH)).encode(texts)):
        assert ids(got) == library.encode(text or "", add_special_tokens=False).ids


def test_every_token_comes_from_its_own_letters(encoder):
    assert all(encoder.merges.sound(token) for token in list(encoder.merges.halves)[::7])


def test_plain_characters_are_split_as_by_the_library(library):
    splitter = Splitter(read_spec(PATH))
    for k in range(0x21, 0x250):
        chunk = f"q{chr(k)}Q"
        if splitter.words(chunk) is not None:
            assert splitter.words(chunk) == splitter.parts(chunk)


def test_memo_is_bounded_and_right():
    memo = Memo(10)
    for k in range(100):
        keys = {k, k + 1, 0}
        assert memo.of(keys, lambda new: {n: n * 2 for n in new}) == {n: n * 2 for n in keys}
        assert len(memo.young) + len(memo.old) <= 16


def test_whole_table(docs, rows, library):
    out = bpe.decode(bpe.encode(docs, PATH), PATH).select("doc_id", "text", "ids", "decoded").collect()
    assert len(out) == len(rows)
    for row in out:
        want = library.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == want
        assert row.decoded == library.decode(want, skip_special_tokens=False)


def test_output_replaces_a_column_of_the_same_name(docs, library):
    named = docs.select("doc_id", "text", F.lit(1).alias("ids"), F.lit(2).alias("decoded"))
    out = bpe.decode(bpe.encode(named, PATH), PATH)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert out.where("doc_id = 88").first().ids == library.encode("One TWO three", add_special_tokens=False).ids


def test_empty_table(no_docs):
    assert bpe.decode(bpe.encode(no_docs, PATH), PATH).count() == 0


def test_files_give_back_all_ids_in_order(docs, rows, library, spark, tmp_path):
    path = f"file://{tmp_path}/tokens"
    token_files.write_tokens(docs, path, PATH)
    got = token_files.read_tokens(spark, path).collect()
    assert len(got) == len(rows)
    texts = sorted((r[0] is not None, r[0] or 0, r[1]) for r in rows if r[1] is not None)
    want = {(k if known else None, tuple(library.encode(t, add_special_tokens=False).ids + [1])) for known, k, t in texts}
    assert want <= {(r.key, tuple(ids(r.ids))) for r in got}
    place = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == place
        assert r.n_ids == len(ids(r.ids)) and r.crc32 == zlib.crc32(bytes(r.ids))
        place += r.n_ids
    keys = [r.key for r in sorted(got, key=lambda r: r.start)]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))


def test_single_documents_are_read_alone(docs, spark, library, tmp_path):
    path = f"file://{tmp_path}/tokens"
    token_files.write_tokens(docs, path, PATH)
    got = {r.key: ids(r.ids) for r in token_files.read_documents(spark, path, [3, 88, 4711]).collect()}
    assert set(got) == {3, 88}
    assert got[88] == library.encode("One TWO three", add_special_tokens=False).ids + [1]


def test_packs_hold_several_documents_and_close_at_their_size(monkeypatch):
    monkeypatch.setattr(token_files, "PACK_BYTES", 100)
    writer, packs = token_files.PackWriter(b"0" * 32, 2), []
    for k in range(10):
        packs += list(writer.add(k // 7, k, 3, b"x" * 40))
    packs.append(writer.pack())
    assert [p["n_docs"] for p in packs] == [2, 2, 2, 1, 2, 1]
    assert [p["ids_before"] for p in packs] == [0, 6, 12, 18, 0, 6]
    assert [(p["range"], p["part"]) for p in packs] == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1)]


def test_files_without_documents(no_docs, spark, tmp_path):
    path = f"file://{tmp_path}/tokens"
    token_files.write_tokens(no_docs, path, PATH)
    assert token_files.read_tokens(spark, path).count() == 0


def test_a_foreign_dictionary_is_refused():
    writer = token_files.PackWriter(hashlib.sha256(b"a").digest(), 2)
    list(writer.add(0, 1, 1, b""))
    with pytest.raises(ValueError, match="dictionary"):
        token_files.Pack(writer.pack()["payload"], hashlib.sha256(b"b").digest(), None)


def test_trie_sees_each_distinct_chunk_once(encoder, monkeypatch):
    """Chunks are found on the bytes of all texts; words between punctuation are no new chunks."""
    seen = []
    monkeypatch.setattr(encoder.splitter, "words", lambda chunk, own=encoder.splitter.words: seen.append(chunk) or own(chunk))
    encoder.encode(["qwortz, (qwortz) qwortz. 7qwortz!", "qwortz; Qwortz?"] * 3)
    assert len(seen) == len(set(seen)) and not any("qwortz," in chunk or "(q" in chunk for chunk in seen)


def test_many_distinct_chunks_are_not_encoded_again(monkeypatch):
    """More chunks than a batch or two: when they come again, nearly all are still known."""
    encoder, seen = token_files.LibraryEncoder(read_spec(PATH)), []
    monkeypatch.setattr(encoder, "_chunks", lambda new: seen.append(len(new)) or {chunk: chunk for chunk in new})
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join(f"{a}{b}{c}{d}" for b in letters for c in letters for d in letters) for a in letters[:20]]
    first = encoder.encode(texts)
    assert seen == [20 * 26**3]
    assert encoder.encode(texts) == first == [text.replace(" ", "").encode() for text in texts]
    assert seen[1] < 0.2 * seen[0]


def test_few_places_and_few_ids_change_no_result(library):
    """Chunks that push each other out, and a table that is emptied again and again."""
    encoder, texts = token_files.LibraryEncoder(read_spec(PATH)), odd_texts()
    encoder.by_chunk = ChunkTable(7, 500)
    for k in range(0, len(texts), 10):
        want = [library.encode(text or "", add_special_tokens=False).ids for text in texts[k : k + 10]]
        for _ in range(2):
            assert [ids(got) for got in encoder.encode(texts[k : k + 10])] == want
            # Beyond the limit lie the ids of these texts alone.
            assert encoder.by_chunk.used <= 500 + sum(map(len, want))
