"""The registered queries over the smallest given tables: columns, types, rows and contents."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from defectloom.llm.oracle import ORACLE
from defectloom.llm.queries import QUERIES
from tests.llm.test_llm_filters import brute_spans
from tools import check_oracle

TYPES = {
    "op1_trie_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op2_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op3_disclosure": {
        "doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint",
        "base_sha256": "string", "spans": "string",
    },
    "op4_host_reputation": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op5_licence_dice": {"doc_id": "bigint", "n_licences": "bigint", "licences": "string", "score": "double"},
    "op6_byte_shards": {
        "doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint",
        "grown_shard": "int",
    },
    "op7_multi_index": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op8_line_frequency": {
        "doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
        "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean", "n_left": "bigint",
    },
    "op9_simhash_bk": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op10_entropy_mix": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op11_misra_gries": {
        "lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint",
        "score": "bigint",
    },
    "op12_chunk_recipes": {
        "doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string",
    },
    "op13_branch_bound": {
        "conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint",
        "illegal": "bigint", "cost": "bigint", "audit": "string", "repaired_sha256": "string",
    },
}
ROWS = {
    "op4_host_reputation": "count(*) FROM pages",
    "op7_multi_index": "count(*) FROM embeddings",
    "op11_misra_gries": f"count(*) FROM ({ORACLE['op11_misra_gries']})",
    "op13_branch_bound": "count(DISTINCT conv_id) FROM conversations",
}


@pytest.fixture(scope="module")
def duck():
    check_oracle.SF_DIR = "/root/testdata/sf0.001"
    return check_oracle.duck()


@pytest.fixture(scope="module")
def results(spark):
    """Each query's rows, made when first asked for."""
    made = {}

    def of(name):
        if name not in made:
            df = QUERIES[name](spark, "/root/testdata/sf0.001")
            made[name] = dict(df.dtypes), df.collect()
        return made[name]

    return of


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


def test_every_operator_has_its_query():
    assert set(QUERIES) == set(TYPES)


@pytest.mark.parametrize("name", TYPES)
def test_columns_and_rows(results, duck, name):
    types, rows = results(name)
    assert types == TYPES[name]
    (count,) = duck.execute(f"SELECT {ROWS.get(name, 'count(*) FROM documents')}").fetchall()[0]
    assert len(rows) == count


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    assert check_oracle.compare(spark, duck, QUERIES[name], ORACLE[name]) == "ok"


def test_ids_are_the_library_s(results, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    encoded = {r.doc_id: r for r in results("op1_trie_bpe")[1]}
    stored = {r.doc_id: r for r in results("op2_token_files")[1]}
    for doc_id in sorted(texts):
        ids = library.encode(texts[doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        row = encoded[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
        row = stored[doc_id]
        assert (row.start, row.n_tokens) == (start, len(ids) + 1)
        assert row.ids_crc32 == zlib.crc32(np.array([*ids, 1], "<u4").tobytes())
        start += len(ids) + 1


def test_personal_data_of_the_table(results, texts):
    for r in results("op3_disclosure")[1]:
        spans = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        kinds = re.findall("[a-z]+", spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k in ("email", "ip", "card", "phone")]
        assert set(filter(None, spans.split(","))) <= set(r.spans.split(","))
        assert spans or not r.spans


def test_vectors_of_the_table(results, duck):
    rows = duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    m = np.array([v for _, v in rows], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    links = dict(zip([k for k, _ in rows], (m @ m.T >= 0.95).sum(1) - 1))
    got = {r.vec_id: r.n_links for r in results("op7_multi_index")[1]}
    assert sum(got.values()) >= 0.9 * sum(links.values())
    assert all(got[k] <= links[k] for k in got)


def test_checksums_of_the_shards(results, texts):
    for r in results("op6_byte_shards")[1]:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)


def test_native_queries_use_no_python(spark):
    for name in ("op3_disclosure", "op4_host_reputation", "op5_licence_dice"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan, name
