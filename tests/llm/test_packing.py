import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from kelpie.llm import bpe, packing

from .helpers import ODD, frame


def check(spark, texts):
    own = Tokenizer.from_file(bpe.vocabulary())
    pieces = packing.pack(frame(spark, texts), bpe.vocabulary()).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == set(range(len(texts)))
    for k, t in enumerate(texts):
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        copies = 2 if k < 2 else 1  # the first two rows are there twice
        assert sum(p.length for p in by_doc[k]) == copies * len(ids)
        for p in by_doc[k]:
            assert p.doc_tokens == len(ids) and zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
        if copies == 1:
            at = 0
            for p in sorted(by_doc[k], key=lambda p: p.start):
                assert p.start == at
                at += p.length
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    return pieces, by_seq


def test_every_id_lies_in_one_piece(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(400).select("text").collect()]
    check(spark, [*ODD, *docs, "hello world " * 3000])


def test_padding_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for parts, task in ((4, 4 << 20), (200, 4 << 20), (211, 1 << 14)):  # the last one: some 80 tasks, each of which leaves a window open
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            packing.TASK, keep = task, packing.TASK
            pieces = packing.pack(docs, bpe.vocabulary()).collect()
            packing.TASK = keep
            ids, windows = sum(p.length for p in pieces), len({p.sequence_id for p in pieces})
            assert 2048 * windows - ids < max(2048, 0.01 * ids)
            at = defaultdict(int)
            for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
                assert p.start == at[p.doc_id]
                at[p.doc_id] += p.length
            assert all(at[p.doc_id] == p.doc_tokens for p in pieces)
            found.append(ids)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(set(found)) == 1


def test_few_windows_have_room():
    rng = np.random.default_rng(1)
    rests = [rng.integers(0, 300, rng.integers(1, 900)).astype(np.uint16) for _ in range(500)]
    windows = packing.pack_run(rests, np.ones(300, np.float32), 400.0, 2048)
    assert all(sum(x[2] for x in w) == 2048 for w in windows[:-1])
    seen = sorted((d, a, n) for w in windows for d, a, n in w)
    at = defaultdict(int)
    for d, a, n in seen:
        assert at[d] == a
        at[d] += n
    assert all(at[d] == len(r) for d, r in enumerate(rests))


def test_seeds_take_the_best_by_brute_force_bm25():
    """The first neighbour of each seed is the unused rest that fits with the highest score, counted term by term."""
    rng = np.random.default_rng(8)
    rests = [rng.integers(0, 60, rng.integers(5, 90)).astype(np.uint16) for _ in range(120)]
    idf, mean, window = rng.random(60).astype(np.float32) + 0.1, 45.0, 128
    used = set()
    for now in packing.pack_run(rests, idf, mean, window):
        seed, begin, size = now[0]
        free = [d for d in range(len(rests)) if d not in used and d != seed]
        fits = [d for d in free if len(rests[d]) <= window - size]
        if len(now) > 1 and now[1][1] == 0 and now[1][2] == len(rests[now[1][0]]):
            score = {}
            for d in fits:
                t, c = np.unique(rests[d], return_counts=True)
                score[d] = sum(idf[x] * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * len(rests[d]) / mean)) for x, n in zip(t, c) if x in set(rests[seed].tolist()))
            assert score[now[1][0]] >= max(score.values()) - 1e-3
        used |= {d for d, _, _ in now}


def test_neighbours_share_terms():
    rng = np.random.default_rng(3)
    rests = [(rng.integers(0, 100, 500) + 100 * (i % 4)).astype(np.uint16) for i in range(80)]
    windows = packing.pack_run(rests, np.ones(400, np.float32), 500.0, 2048)
    pure = sum(len({d % 4 for d, _, _ in w}) == 1 for w in windows)
    assert pure > 0.7 * len(windows)


def test_every_free_neighbour_is_tried():
    # the nearest 60 don't fit beside the seed; two that fill the window come after them
    near = [np.r_[np.zeros(600), np.full(300, 1)].astype(np.uint16) for _ in range(60)]
    seed, small = np.zeros(1800, np.uint16), [np.r_[np.zeros(1), np.full(123, 2 + k)].astype(np.uint16) for k in range(2)]
    windows = packing.pack_run([seed, *near, *small], np.ones(4, np.float32), 900.0, 2048)
    assert [d for d, _, _ in windows[0]] == [0, 61, 62]


def test_all_terms_of_a_seed_count():
    # the seed shares its 24 heaviest terms with nobody, and lighter ones with the last row only
    seed = np.r_[np.repeat(np.arange(24), 10), np.arange(24, 100)].astype(np.uint16)
    others = [np.full(70, 200 + k, np.uint16) for k in range(12)]
    windows = packing.pack_run([seed, *others, np.arange(24, 100, dtype=np.uint16)], np.ones(300, np.float32), 150.0, 400)
    assert [d for d, _, _ in windows[0]][:2] == [0, 13]


def test_empty_table(spark):
    assert packing.pack(frame(spark).limit(0), bpe.vocabulary()).count() == 0
