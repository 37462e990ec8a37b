"""What built-in functions can't express, as Arrow-batched functions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters, cut at the coarsest separator that a part contains, with up to `overlap` characters shared.

    A separator stays at the start of what follows it. Parts that are still too long go to the finer separators. Pieces are stripped;
    empty ones are left out.
    """
    level = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, finer = separators[level], separators[level + 1 :]
    parts = list(text) if sep == "" else [p for p in re.split(f"(?={re.escape(sep)})", text) if p]
    out: list[str] = []
    window: list[str] = []
    width = 0

    def close() -> None:
        piece = "".join(window).strip()
        if piece:
            out.append(piece)

    for part in parts:
        if len(part) > size and finer:
            if window:
                close()
                window, width = [], 0
            out.extend(split_text(part, size, overlap, finer))
            continue
        if window and width + len(part) > size:
            close()
            while window and (width > overlap or width + len(part) > size):
                width -= len(window.pop(0))
        window.append(part)
        width += len(part)
    if window:
        close()
    return out


def splitter(size: int, overlap: int) -> Callable[[Column], Column]:
    """A column function: text to array<string>; null gives an empty array."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size, overlap) if t else [])

    return split


def name_similarity(a: str, b: str) -> float:
    """1 for equal names, 0.92 for one within the other at similar length, else the ratio of matching blocks."""
    a, b = a.lower().strip(), b.lower().strip()
    return name_similarity_whole(a, b) or SequenceMatcher(None, a, b).ratio()


def name_similarity_whole(a: str, b: str) -> float:
    """The part of name_similarity() for equal and contained names: 0 for others."""
    short, long = sorted((a, b), key=len)
    return 1.0 if a == b else 0.92 if short in long and len(short) / len(long) > 0.6 else 0.0


def similar(a: str, b: str, least: float) -> bool:
    """Whether name_similarity() reaches `least`; bounds from lengths and letters spare most of the matching."""
    a, b = a.lower().strip(), b.lower().strip()
    if whole := name_similarity_whole(a, b):
        return whole >= least
    match = SequenceMatcher(None, a, b)
    return 2 * min(len(a), len(b)) >= least * (len(a) + len(b)) and match.quick_ratio() >= least and match.ratio() >= least


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else name_similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def hashed_embedding(text: str | None, width: int = 384) -> list[float]:
    """A unit vector of hashed words and letter triples: an offline stand-in, not the quality of a trained model."""
    v = np.zeros(width, np.float64)
    low = (text or "").lower()
    for t in re.findall(r"\w+", low) + [low[i : i + 3] for i in range(len(low) - 2)]:
        h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little")
        v[h % width] += 1.0 if h >> 63 else -1.0
    n = np.linalg.norm(v)
    return (v / n if n else v).astype(np.float32).tolist()


def embedder(encode: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 64) -> Callable[[Column], Column]:
    """A column function: text to array<float>. `encode` maps a list of texts to unit vectors; the default needs no model."""
    own = encode or (lambda texts: [hashed_embedding(t) for t in texts])

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(chunks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in chunks:
            rows: list[list[float]] = []
            for i in range(0, len(texts), batch):
                rows.extend(own([t or "" for t in texts.iloc[i : i + batch]]))
            yield pd.Series(rows)

    return embed


def overlap_score(query: str, text: str) -> float:
    """Share of the query's words in the text: an offline stand-in for a cross-encoder."""
    q = set(re.findall(r"\w+", query.lower()))
    return len(q & set(re.findall(r"\w+", text.lower()))) / len(q) if q else 0.0


def pair_scorer(score: Callable[[list[tuple[str, str]]], list[float]] | None = None) -> Callable[[Column, Column], Column]:
    """A column function: (query, text) to double."""
    own = score or (lambda pairs: [overlap_score(q, t) for q, t in pairs])

    @F.pandas_udf("double")
    def scored(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(own(list(zip(q.fillna(""), t.fillna(""), strict=True))), dtype="float64")

    return scored


def chat(model: Callable[[list[dict]], str]) -> Callable[[Column], Column]:
    """A column function: array<struct<role, content>> to the model's answer; an error gives an empty answer."""

    @F.pandas_udf("string")
    def answer(messages: pd.Series) -> pd.Series:
        def one(ms) -> str:
            try:
                return model([dict(m) if isinstance(m, dict) else m.asDict() for m in ms])
            except Exception:  # noqa: BLE001  a model that fails must not fail the batch; the row tells by being empty
                return ""

        return messages.map(one)

    return answer
