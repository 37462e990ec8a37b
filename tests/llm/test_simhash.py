import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from kelpie.llm import common, simhash

from .helpers import ODD, SF, frame, thue_morse, words


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t, k=5):
    w = words(lower(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def one(text):
    return simhash.fingerprints([text])[0]


def test_edited_matches_brute_force(spark):
    texts = [*ODD, *[r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.key: r for r in simhash.edited(df).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        t, nxt = t or "", texts[k - 1] or ""  # descending ids; the smallest is followed by the largest
        h = len(t) // 2
        new = t[: len(t) - h] + nxt[:h]
        r = got[k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        f = np.array([r.f0, r.f1, r.f2, r.f3]).view(np.uint64)
        assert (f == one(t)).all()
        assert r.near_edited == simhash.alike(f[None], one(new)[None])[0] and r.near_next == simhash.alike(f[None], one(nxt)[None])[0]
    long = [r for r in got.values() if r.n_chars > 500]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.1


def test_repeated_and_single_rows(spark):
    df = frame(spark)
    assert simhash.edited(df).count() == df.count()
    assert simhash.edited(df.limit(0)).count() == 0
    only = simhash.edited(df.where("doc_id = 10")).collect()[0]
    assert only.near_next == 1.0


def test_votes_match_brute_force():
    texts = [*ODD, "a a a a b b c", *[f"x {w} x" for n in (1024, 2048) for w in thue_morse(n)]]
    for text, f in zip(texts, simhash.fingerprints(texts)):
        count = Counter(words(lower(text)))
        votes = [0] * 256
        for w, n in count.items():
            h = common.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0]
            bits = np.unpackbits(np.concatenate([common.mix(h ^ s) for s in simhash._SEEDS]).view(np.uint8))
            for k in range(256):
                votes[k] += (1 + int(math.log2(n))) * (1 if bits[k] else -1)
        assert np.unpackbits(f.view(np.uint8)).tolist() == [int(v > 0) for v in votes]
    long = simhash.fingerprints([w for n in (1024, 2048) for w in thue_morse(n)])
    assert len({tuple(f) for f in long.tolist()}) == 4


def test_search_finds_all_within_radius(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2, (25, 256), dtype=np.uint8)
    rows = []
    for b in base:
        for n in (0, 0, 1, 3, 7, 8, 12, 20, 23, 24, 31, 45):
            x = b.copy()
            x[rng.choice(256, n, replace=False)] ^= 1
            rows.append(x)
    f = np.packbits(np.array(rows), axis=1).view(np.int64)
    df = spark.createDataFrame([tuple(map(int, r)) for r in f], "f0 long, f1 long, f2 long, f3 long")
    bits = np.array(rows)
    apart = (bits[:, None] != bits[None]).sum(2)
    for radius in (0, 7, 8, 23, 45):
        got = {tuple(r)[:4]: r.n_within for r in simhash.search(df, df, radius).select("f0", "f1", "f2", "f3", "n_within").collect()}
        assert got == {tuple(map(int, r)): int((apart[i] <= radius).sum()) for i, r in enumerate(f)}
        pairs = simhash.matches(df, df, radius)
        assert pairs.count() == pairs.distinct().count()


def test_near_copies_are_found():
    """At least 0.9 of near copies lie within the radius: texts edited down to a similarity of 0.8, and the unequal pairs of the table itself."""
    rng = random.Random(1)
    texts = [r or "" for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()]
    sets = [shingles(t) for t in texts]
    pairs, seen = [], {}
    for i, s in enumerate(sets):
        met = Counter(j for x in s for j in seen.get(x, ()))
        pairs += [(texts[i], texts[j]) for j, n in met.items() if texts[i] != texts[j] and n >= 0.8 * len(s | sets[j])]
        for x in s:
            seen.setdefault(x, []).append(i)
    some = [w for t in texts[:50] for w in t.split()]
    edited = []
    for t, s in zip(texts, sets):
        w = t.split()
        while len(s) >= 20 and len(edited) < 200:
            w[rng.randrange(len(w))] = rng.choice(some)
            new = shingles(" ".join(w))
            if len(s & new) < 0.8 * len(s | new):
                break
            last = " ".join(w)
        else:
            continue
        edited.append((t, last))
    for found in (pairs, edited):
        one, two = simhash.fingerprints([a for a, _ in found]), simhash.fingerprints([b for _, b in found])
        assert len(found) >= 10 and (np.bitwise_count(one ^ two).sum(1) <= simhash.RADIUS).mean() >= 0.9


def test_fingerprint_replaces_clashing_columns(spark):
    out = simhash.fingerprint(frame(spark).withColumn("f0", F.lit("x"))).collect()
    assert len({(r.f0, r.f1, r.f2, r.f3) for r in out if r.text in (None, "", " ")}) == 1
