import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet  # noqa: F401
from tokenizers import Tokenizer

from kelpie.llm import bpe

from .helpers import ODD, SF, frame, thue_morse


def test_digest_matches_the_library(spark):
    own = Tokenizer.from_file(bpe.vocabulary())
    texts = [*ODD, "abcdef" * 3000, *[r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]]
    got = bpe.digest(frame(spark, texts), bpe.vocabulary()).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        ids = own.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_words_of_equal_polynomials(spark):
    own = Tokenizer.from_file(bpe.vocabulary())
    texts = [f"{x} and {y} {x}" for n in (64, 1024, 2048) for x, y in (thue_morse(n), thue_morse(n)[::-1])]
    for r in bpe.digest(frame(spark, texts, extra=False), bpe.vocabulary()).collect():
        assert r.ids_sha256 == hashlib.sha256(np.array(own.encode(texts[r.doc_id], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()


def test_equal_hashes_of_different_words(monkeypatch):
    """Even if all words of a length had one hash, letters decide."""
    monkeypatch.setattr(bpe, "placed_words", lambda *a, f=bpe.placed_words, **k: (lambda h, first, starts, lengths: (lengths.astype(np.uint64), first, starts, lengths))(*f(*a, **k)))
    enc = bpe.Encoder(bpe.vocabulary(), leaf=40)
    texts = ["cat dog cow", "dog", "a b c d e f g h " * 20, None]
    got = [x.tolist() for x in enc.encode_column(pa.array(texts), tree=True)]
    assert got == [enc.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_documents_are_encoded_by_joined_halves():
    docs = pa.parquet.read_table("/root/testdata/sf0.01/documents.parquet").column("text").combine_chunks()
    enc = bpe.Encoder(bpe.vocabulary())
    got = list(enc.encode_column(docs, tree=True))
    long = sum(len(t.encode()) > bpe.LEAF for t in docs.to_pylist() if t)
    assert long > 100 and enc.joins > 1.5 * long
    for t, ids in zip(docs.to_pylist(), got):
        assert ids.tolist() == enc.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_small_leaves_at_every_place():
    rng = random.Random(3)
    pieces = ["the ", "été ", "漢字 ", "it's\n", "e\u0301 ", "e\u0301", "naïve\t", "12,345 ", "x", " ", "<|endoftext|> ", "\u00a0", "word. "]
    for leaf in (16, 90):
        enc = bpe.Encoder(bpe.vocabulary(), leaf=leaf)
        texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 400))) for _ in range(60)]
        for t, ids in zip(texts, enc.encode_column(pa.array(texts), tree=True)):
            assert ids.tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, t
        assert enc.joins > 100


def test_tree_matches_the_library():
    rng = random.Random(1)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        small = bpe.Encoder(bpe.vocabulary(name), leaf=24)
        parts = ["ab", "abcdefghij", "a", "ha", "the", "'s'll!.,", "éèÉİ", "aé0123", "x'S<|endoftext|>y", "漢字かな", "é", " \t\x1c  ", "ßẞΣς", "\n \n"]
        for _ in range(1500):
            alphabet = "".join(rng.sample(parts, rng.randint(1, 3)))
            s = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300)))
            if rng.random() < 0.3:
                s = s[:5] * rng.randint(1, 60)
            want = small.tokenizer.encode(s, add_special_tokens=False).ids
            assert np.frombuffer(small.encode(s), "<u4").tolist() == want, (name, s)


def test_round_trip(spark):
    df = frame(spark)
    out = bpe.decode(bpe.encode(df, bpe.vocabulary()), bpe.vocabulary())
    assert out.columns == [*df.columns, "ids", "decoded"] and out.count() == df.count()
    assert bpe.encode(df.limit(0), bpe.vocabulary()).count() == 0
