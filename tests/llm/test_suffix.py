import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kelpie.llm import suffix

from .helpers import ODD, frame


def brute(texts, least=200):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for d, r in enumerate(raw):
        for i in range(len(r) - least + 1):
            seen.setdefault(r[i : i + least], []).append((d, i))
    gone = [np.zeros(len(r), bool) for r in raw]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + least] = True
    return raw, gone


def check(spark, texts):
    df = frame(spark, texts)
    rows = [*texts, *texts[:2]]
    raw, gone = brute(rows)
    want = sorted((d % len(texts) if d >= len(texts) else d, len(r), int(g.sum()), int((np.diff(np.r_[0, g.astype(int)]) == 1).sum()), hashlib.sha256(np.frombuffer(r, np.uint8)[~g].tobytes()).hexdigest()) for d, (r, g) in enumerate(zip(raw, gone)))
    assert sorted(tuple(x) for x in suffix.digest(df).collect()) == want


def suffixes(before, core, behind, width):
    """A document's suffixes by column: bytes, the core as one symbol over all bytes, bytes."""
    whole = [*before.encode(), 1000 + core, *behind.encode()]
    return {width - len(before) + k: whole[k:] for k in range(len(whole))}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=6), st.integers(0, 2), st.text("ab", max_size=6)), min_size=1, max_size=14), st.integers(1, 5))
def test_rounds_insert_into_the_collection(strings, per_pass):
    """Every round: all suffixes so far are in order, and common prefixes of neighbours are right (up to a window)."""
    width = 6
    symbols = np.array([[0] * (width - len(x)) + [c + 1 for c in x.encode()] + [c + 1 for c in y.encode()] + [0] * (width - len(y)) for x, _, y in strings], np.uint8)
    core = np.array([c for _, c, _ in strings])
    every = [suffixes(*s, width) for s in strings]
    files = suffix.Files()
    placed = [[] for _ in strings]  # the empty suffixes
    seen = 0
    for j, docs, new, prefix in suffix.collection(symbols, core, files, per_pass):
        assert sorted(docs) == [d for d, e in enumerate(every) if j in e]
        for n, d in sorted(zip(new, docs)):
            placed.insert(n, every[d][j])
            seen += 1
        assert placed == sorted(placed)
        for n in range(1, len(placed)):
            same = next((k for k, (x, y) in enumerate(zip(placed[n - 1], placed[n])) if x != y), min(len(placed[n - 1]), len(placed[n])))
            assert prefix[n] == min(width + 1, same)
    assert seen == sum(map(len, every))
    hits = suffix.repeated_windows(symbols, core, files)
    files.close()
    for d, (x, c, y) in enumerate(strings):
        for k in range(width + 1):
            mine = (x[len(x) - k :], c, y[: width - k]) if len(x) >= k and len(y) >= width - k else None
            again = mine and any((u[len(u) - k :], v, w[: width - k]) == mine and len(u) >= k for e, (u, v, w) in enumerate(strings) if e != d)
            assert bool(hits[d] >> k & 1) == bool(again)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=2, max_size=700), st.randoms())
def test_least_of_far_ranges(values, rng):
    x = np.array(values, np.uint8)
    pairs = sorted(tuple(sorted(rng.sample(range(len(x)), 2))) for _ in range(40))
    a, b = np.array(pairs).T
    want = [min(values[i + 1 : j + 1]) for i, j in pairs]
    assert suffix._far_ranges(x, a, b).tolist() == want == suffix._ranges(x, a, b).tolist()


def test_matches_brute_force(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(260).select("text").collect()]
    check(spark, [*ODD, *docs])


def test_odd_repeats(spark):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared, again = text(400), text(230)
    phrase = text(60)
    texts = ["x" * 199, "y" * 200, "z" * 201, "ab" * 300, "q" * 1000 + text(50), shared, text(100) + shared[:250] + text(300), shared[100:] + shared[:199], text(40) + again + text(90) + again, again[:150] + text(20) + again[10:], *[text(150) + phrase + text(150) for _ in range(20)], *[text(20) + phrase + text(30) + phrase + text(200) for _ in range(5)]]
    texts += [shared[:205] + text(5) + shared[205:], shared, text(260), (phrase + text(100)) * 4]
    check(spark, texts)


def test_remove_and_long_texts(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefghijklmnop ") for _ in range(3000))
    df = frame(spark, [None, "", long, "é" + long[500:900], "keep me"])
    out = {r.doc_id: r.text for r in suffix.remove(df).collect()}
    assert out[0] is None and out[1] == "" and out[3] == "é" and out[2] == long[:500] + long[900:] and out[4] == "keep me"
    assert suffix.remove(df.limit(0)).count() == 0 and suffix.remove(df).columns == df.columns
    # long texts go through in chunks: the same anchors, and the same result, as in one piece
    rows = df.select(df.doc_id.alias("key"), df.n_chars.cast("long").alias("th"), "text").where("text is not null")
    whole, parts = (sorted(tuple(r) for r in suffix.anchor_table(rows, 200, 50, chunk).collect()) for chunk in (1 << 22, 700))
    assert whole == parts and len(whole) > 20
    assert {r.doc_id: r.text for r in suffix.remove(df, chunk=700).collect()} == out


def test_hot_anchors_by_finer_classes(spark):
    """Many texts share a passage and differ around it: with a low bound every anchor counts as crowded."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = text(260)
    texts = [text(rng.randrange(60, 200)) + shared[rng.randrange(60) : 260 - rng.randrange(60)] + text(rng.randrange(60, 200)) for _ in range(40)]
    texts += texts[:3]
    df = frame(spark, texts, extra=False)
    raw, gone = brute([*texts, *texts[:2]])
    want = sorted((d % len(texts), int(g.sum())) for d, g in enumerate(gone))
    assert sorted((r.doc_id, r.n_removed) for r in suffix.digest(df, hot=1).collect()) == want


def test_equal_pieces_at_the_ends_of_texts(spark):
    """A crowded anchor near the end or the beginning of texts: classes reach beyond them, windows don't."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = text(420)
    texts = [text(rng.randrange(60, 150)) + shared[:n] for n in (212, 212, 233, 233, 233, 260)] + [shared[420 - n :] + text(rng.randrange(60, 150)) for n in (207, 207, 231, 231, 254)]
    texts += [shared[a:b] + x for a, b in ((0, 211), (50, 263)) for x in ("", "", "z")]
    df = frame(spark, texts, extra=False)
    rows = [*texts, *texts[:2]]
    raw, gone = brute(rows)
    want = sorted((d % len(texts), len(r), int(g.sum()), hashlib.sha256(np.frombuffer(r, np.uint8)[~g].tobytes()).hexdigest()) for d, (r, g) in enumerate(zip(raw, gone)))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix.digest(df, hot=1).collect()) == want


def test_clashing_names(spark):
    df = frame(spark, ["x" * 500, None, "y"], extra=False).withColumnsRenamed({"lang": "th", "source": "_th", "n_chars": "xs"})
    out = suffix.remove(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text or "", r.th, r._th) for r in out.collect()) == [(0, "", "en", "src0"), (0, "", "en", "src0"), (1, "", "en", "src0"), (1, "", "en", "src0"), (2, "y", "en", "src0")]
