"""The registered queries themselves, on a whole small table, against brute force of what they promise."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from kelpie.llm import bpe, queries, simhash
from kelpie.llm.common import durable

from . import test_minhash, test_pii, test_rules, test_suffix
from .helpers import SF


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: [r.asDict() for r in queries.QUERIES[name](spark, SF).collect()]


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_op1(docs, run):
    rows = run("op1_shards")
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    shards = defaultdict(list)
    for r in rows:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        shards[r["shard"]].append(r["slot"])
    assert set(shards) <= set(range(24)) and max(map(len, shards.values())) - min(len(shards[s]) for s in range(24)) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in shards.values())


def test_op2(docs, run):
    order = sorted(docs, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    rows = run("op2_simhash")
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    own = dict(zip(order, simhash.fingerprints([docs[k] for k in order])))
    for r in rows:
        t, n = docs[r["doc_id"]] or "", docs[after[r["doc_id"]]] or ""
        new = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        f, e, x = own[r["doc_id"]], simhash.fingerprints([new])[0], own[after[r["doc_id"]]]
        hexed = lambda v: "".join(f"{int(p):016x}" for p in v)
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), sha(new.encode()), hexed(f), hexed(e))
        assert r["near_edited"] == 1 - np.bitwise_count(f ^ e).sum() / 256 and r["near_next"] == 1 - np.bitwise_count(f ^ x).sum() / 256
        want = sum(int(np.bitwise_count(f ^ g).sum()) <= simhash.RADIUS for g in own.values()) if r["doc_id"] % 20 == 0 else None
        assert r["n_within"] == want


def test_op3(spark, docs, run):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = run("op3_langid")
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    right = []
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        letters = any(c.isalpha() for c in docs[r["doc_id"]] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        if r["held_out"] and letters:
            right.append(r["lang_pred"] == lang[r["doc_id"]])
    assert np.mean(right) > 0.9


def test_op4(docs, run):
    keys = sorted(docs)
    want = test_minhash.brute([docs[k] for k in keys], 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in run("op4_minhash")}
    assert got == {keys[i]: (n, keys[root], i == root) for i, (n, root) in want.items()}


def test_op5(docs, run):
    rows = run("op5_pii")
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        spans = test_pii.brute(docs[r["doc_id"]])
        listed = [f"{kind}:{a}:{b}" for a, _, b, kind in spans]
        count = Counter(kind for *_, kind in spans)
        assert {k: r[f"n_{k}"] for k in ("email", "ip", "card", "phone")} == {k: count[k] for k in ("email", "ip", "card", "phone")}
        assert r["base_sha256"] == sha(",".join(listed).encode()) and set(listed) <= set(r["spans"].split(","))
        starts = [int(x.split(":")[1]) for x in r["spans"].split(",") if x]
        assert starts == sorted(starts)


def test_op7(docs, run):
    own = Tokenizer.from_file(bpe.vocabulary())
    rows = run("op7_bpe")
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        ids = own.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(own.decode(ids, skip_special_tokens=False).encode()))


def test_op8(docs, run):
    rows = run("op8_rules")
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        n, chars, symbols, lines, repeated = test_rules.brute(docs[r["doc_id"]])
        failed = n < 50 or 100 * repeated > 50 * n
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (n, chars, symbols, lines, repeated, failed)
        assert r["kept"] == (not failed and r["rule"] == 0)


def check_pieces(texts, pieces):
    own = Tokenizer.from_file(bpe.vocabulary())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(texts)
    total = 0
    for k, ps in by_doc.items():
        ids, at = np.array([*own.encode(texts[k] or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
        total += at
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    assert len(by_sequence) == -(-total // 2048)


def test_op9(docs, run):
    check_pieces(docs, run("op9_packing"))


def brute_kept(keys, texts):
    raw, gone = test_suffix.brute(texts)
    return {k: (len(r), int(g.sum()), int((np.diff(np.r_[0, g.astype(int)]) == 1).sum()), np.frombuffer(r, np.uint8)[~g].tobytes()) for k, r, g in zip(keys, raw, gone)}


def test_op10(docs, run):
    keys = sorted(docs)
    want = {k: (*v[:3], sha(v[3])) for k, v in brute_kept(keys, [docs[k] for k in keys]).items()}
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in run("op10_suffix")} == want


def test_pipeline(spark, docs):
    """Each stage against brute force on what the stage before it kept; rules and added spans as learned."""
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "repeated passages", "personal data", "packing"]
    at = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = at.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = durable(stage(spark, at, SF))
        assert at.columns == columns
        kept[name] = {r.doc_id: r.text for r in at.collect()}
    verdict = {r["doc_id"] for r in queries.QUERIES["op8_rules"](spark, SF).where("kept").collect()}
    assert kept["quality rules"] == {k: docs[k] for k in verdict}
    before, keys = kept["quality rules"], sorted(kept["quality rules"])
    roots = test_minhash.brute([before[k] for k in keys], 5)
    assert kept["near-dedup"] == {k: before[k] for i, k in enumerate(keys) if roots[i][1] == i}
    before, keys = kept["near-dedup"], sorted(kept["near-dedup"])
    assert kept["repeated passages"] == {k: v[3].decode("utf-8", "ignore") for k, v in brute_kept(keys, [before[k] for k in keys]).items()}
    before, after = kept["repeated passages"], kept["personal data"]
    assert set(before) == set(after)
    for k, t in before.items():
        spans = test_pii.brute(t)
        assert (after[k] != t) >= bool(spans) and not any(t[a:b] in after[k] for a, _, b, kind in spans if kind == "email")
    pieces = [r.asDict() for r in corpus_pipeline.run(spark, SF).collect()]
    check_pieces(after, pieces)
    assert at.where(F.col("text").isNull()).count() == 0
