"""Language identification by nearest centroids.

Texts are vectors of hashed byte n-grams (2 and 3 bytes, A-Z lowered), weighted by 1 + log of the count and by inverse
document frequency, and normalised. Each language has several centroids, from spherical k-means over a bounded sample
of its labelled rows; document frequencies come from all labelled rows. A text takes the language of the centroid with
the largest cosine and is rejected where that is further away than almost all the centroid's own texts.

A null text, or one without a letter, is `und` with score 0. Without labelled rows every text is `und`. Ties between
centroids go to the first in order of language and number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.llm.common import LOWER, blocks, column_bytes, lean

WIDTH = 1 << 12
#: Rows of each language that centroids are fitted on, in expectation; all rows where there are fewer.
SAMPLE = 600
CENTROIDS = 4
UND = "und"


def counts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, WIDTH) counts of hashed n-grams."""
    n, rows = len(raw), len(at) - 1
    x = LOWER[raw].astype(np.uint32)
    base = np.repeat(np.arange(rows, dtype=np.int64) * WIDTH, np.diff(at))
    last = np.repeat(at[1:], np.diff(at))
    out = np.zeros(rows * WIDTH, np.int64)
    for size in (2, 3):
        if n < size:
            continue
        h = x[: n - size + 1].copy()
        for j in range(1, size):
            h = h * np.uint32(257) + x[j : n - size + 1 + j]
        h = (h * np.uint32(0x9E3779B1)) >> np.uint32(20)
        ok = np.arange(n - size + 1) + size <= last[: n - size + 1]
        out += np.bincount((base[: n - size + 1] + h)[ok], minlength=rows * WIDTH)
    return out.reshape(rows, WIDTH)


def vectors(raw: np.ndarray, at: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts(raw, at).astype(np.float32)
    np.log1p(x, out=x)
    x *= idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _frequencies(rows: DataFrame) -> DataFrame:
    def run(batches):
        seen, n = np.zeros(WIDTH, np.int64), 0
        for b in batches:
            raw, at = column_bytes(b.column(0))
            for lo, hi in blocks(at, 1 << 18):
                for i in range(lo, hi, 128):
                    j = min(hi, i + 128)
                    seen += (counts(raw[at[i] : at[j]], at[i : j + 1] - at[i]) > 0).sum(0)
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.flatnonzero(seen), -1]), pa.array(np.r_[seen[seen > 0], n])], names=["dim", "n"])

    return rows.select("text").mapInArrow(lean(run), "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n"))


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of unit rows and each one's radius: the cosine that all but one in 500 of its rows reach, less a margin."""
    k = min(k, len(x))
    c = x.mean(0, keepdims=True)
    while len(c) < k:  # the row furthest from all centroids starts the next
        c = np.concatenate([c, x[np.argmin((x @ c.T).max(1))][None]])
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    best = x @ c.T
    own = best.argmax(1)
    return c, np.array([np.quantile(best[own == j, j], 0.002) * 0.8 if (own == j).any() else 1.0 for j in range(k)])


def fit(rows: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS) -> dict:
    """The model from rows(key, text, lang); rows with a null lang teach nothing."""
    rows = rows.where("lang is not null")
    freq = {r.dim: r.n for r in _frequencies(rows).collect()}  # WIDTH + 1 rows at most
    n = freq.pop(-1, 0)
    idf = np.zeros(WIDTH, np.float32)
    idf[list(freq)] = np.log((1 + n) / (1 + np.array(list(freq.values()), float))) + 1 if freq else 0
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {"idf": idf, "langs": [], "centroids": np.zeros((0, WIDTH), np.float32), "radius": np.zeros(0)}
    # below: about `sample` rows of each language, chosen by a hash of the key, so a hot language is no larger than others
    share = F.create_map(*[F.lit(y) for lang, size in sizes.items() for y in (lang, int(min(1.0, sample / size) * (1 << 30)))])
    chosen = rows.where(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1 << 30)) < share[F.col("lang")])

    def vec(batches):
        for b in batches:
            raw, at = column_bytes(b.column(0))
            for i in range(0, b.num_rows, 64):
                j = min(b.num_rows, i + 64)
                v = vectors(raw[at[i] : at[j]], at[i : j + 1] - at[i], idf).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i), pa.array([x.tobytes() for x in v])], names=["lang", "v"])

    def cluster(t: pa.Table) -> pa.Table:
        order = np.argsort([hash_order(x.as_py()) for x in t.column("v")], kind="stable")
        x = np.stack([np.frombuffer(t.column("v")[int(i)].as_py(), np.float16) for i in order]).astype(np.float32)
        x = x[np.linalg.norm(x, axis=1) > 0.5]
        if not len(x):
            return pa.table({"lang": t.column("lang")[:0], "c": pa.array([], pa.binary()), "r": pa.array([], pa.float64())})
        c, r = k_means(x, k)
        return pa.table({"lang": [t.column("lang")[0].as_py()] * len(c), "c": [y.astype(np.float32).tobytes() for y in c], "r": r.astype(np.float64)})

    found = sorted(tuple(r) for r in chosen.select("text", "lang").mapInArrow(lean(vec), "lang string, v binary").groupBy("lang").applyInArrow(cluster, "lang string, c binary, r double").collect())
    return {"idf": idf, "langs": [f[0] for f in found], "centroids": np.stack([np.frombuffer(f[1], np.float32) for f in found]) if found else np.zeros((0, WIDTH), np.float32), "radius": np.array([f[2] for f in found])}


def hash_order(v: bytes) -> int:
    import zlib

    return zlib.crc32(v)


def predict(docs: DataFrame, model: dict, text: str = "text", columns: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """docs with the predicted language, its cosine and whether distance speaks against it. Map only; columns so named are replaced."""
    import regex

    keep = [c for c in docs.columns if c not in columns]
    src = docs.select(*keep)
    letter = r"\p{L}"
    idf, langs, centroids, radius = model["idf"], np.array([*model["langs"], UND], object), model["centroids"], model["radius"]

    def run(batches: Iterator[pa.RecordBatch]):
        has = regex.compile(letter)
        for b in batches:
            col = b.column(keep.index(text))
            raw, at = column_bytes(col)
            best, score, far = np.full(b.num_rows, len(langs) - 1), np.zeros(b.num_rows), np.ones(b.num_rows, bool)
            if len(centroids):
                for lo, hi in blocks(at, 1 << 18):
                    for i in range(lo, hi, 128):
                        j = min(hi, i + 128)
                        c = vectors(raw[at[i] : at[j]], at[i : j + 1] - at[i], idf) @ centroids.T
                        top = c.argmax(1)
                        best[i:j], score[i:j] = top, c[np.arange(j - i), top]
                        far[i:j] = score[i:j] < radius[top]
                none = np.array([t is None or not has.search(t) for t in col.to_pylist()], bool)
                best[none], score[none], far[none] = len(langs) - 1, 0, True
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs[best].tolist(), pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(far)], names=[*keep, *columns])

    from pyspark.sql import types as T

    return src.mapInArrow(lean(run), T.StructType([*src.schema.fields, T.StructField(columns[0], T.StringType()), T.StructField(columns[1], T.DoubleType()), T.StructField(columns[2], T.BooleanType())]))


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))
