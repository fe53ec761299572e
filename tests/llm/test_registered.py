"""The registered queries, with production parameters, against plain versions of what they promise, on the smallest test tables."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
import tokenizers
from test_pii import brute as personal
from test_simhash import components, slow_print

from luxflow.llm import queries

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{D}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def vectors():
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in pq.read_table(f"{D}/embeddings.parquet").to_pylist() if r["embedding"] is not None]
    return np.array([i for i, _ in rows]), np.stack([v for _, v in rows])


def run(spark, name):
    return queries.queries()[name](spark, D).collect()


def test_op1(spark, documents):
    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.encode_special_tokens = True
    want = {}
    for d in documents:
        ids = [*lib.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4").tobytes()
            want[d["doc_id"], k] = (at, len(part) // 4, zlib.crc32(part))
    got = run(spark, "op1_best_fit_packing")
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert [at for at, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(places) <= -(-sum(r.length for r in got) // 2048) + 1


def test_op2_recall(spark, vectors):
    ids, x = vectors
    got = {}
    for r in run(spark, "op2_nearest_neighbours"):
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q in np.nonzero(ids % 20 == 0)[0]:
        order = sorted((-s, i) for s, i in zip(x @ x[q], ids.tolist(), strict=True) if i != ids[q])[:20]
        hits.append(len({i for _, i in order} & got[ids[q]]) / len(order))
    assert np.mean(hits) >= 0.9


def test_op3(spark, documents):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for d in documents:
        ids = sp.encode(d["text"] or "", add_bos=True, add_eos=True)
        want.append((d["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, "op3_sentencepiece")) == sorted(want)


def test_op5(spark, documents):
    by_id = {d["doc_id"]: d for d in documents}
    got = run(spark, "op5_language_id")
    known = {d["lang"] for d in documents if d["lang"]}
    assert {r.doc_id for r in got} == set(by_id) and len(got) == len(documents)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, by_id[r.doc_id]["text"] or ""))) and r.lang_pred in known | {"und"} for r in got)
    held = [r for r in got if r.held_out and r.lang_pred != "und" and by_id[r.doc_id]["lang"]]
    assert np.mean([r.lang_pred == by_id[r.doc_id]["lang"] for r in held]) > 0.9


def test_op7(spark, documents):
    got = run(spark, "op7_toxicity")
    assert sorted(r.doc_id for r in got) == sorted(d["doc_id"] for d in documents)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_op8(spark, documents):
    prints = {d["doc_id"]: slow_print(d["text"]) for d in documents}
    ids = np.array(sorted(prints))
    want = components(np.array([prints[i] for i in ids.tolist()], np.uint64), ids)
    got = run(spark, "op8_simhash_near_dedup")
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_op10_base(spark, documents):
    got = {r.doc_id: r for r in run(spark, "op10_pii")}
    for d in documents:
        said = [f"{k}:{s}:{e}" for k, s, e in personal(d["text"])]
        r = got[d["doc_id"]]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(r.spans.split(",")) and all(re.fullmatch(r"(email|ip|card|phone):\d+:\d+", s) for s in r.spans.split(",") if s)
