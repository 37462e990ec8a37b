"""Repeated passages by column-wise construction of collections' Burrows-Wheeler transforms.

Which bytes lie in a string of `least` bytes that also starts elsewhere? Documents are cut so that no string is lost:
of the grams in each window of `least` bytes, the one with the smallest hash is an anchor. Equal windows hold
equal anchors at equal places, so both lie within the segments around these anchors (at most 2 * least - gram
bytes), at the same distance from the anchor. Where all segments of an anchor are equal (one 64-bit BLAKE2 digest), they are repeated
as they are. Where they differ, the windows of a segment are dealt into classes of STEPS neighbouring starts. All windows of a class
share a core of at least `gram` bytes; around it stand at most STEPS - 1 bytes on each side. Only segments with an equal core (a 128-bit
digest) can share a window of the class, so cores deal the work, and an anchor that many texts share is split by its neighbourhood. Anchors with very
many different segments get shorter classes (FINE starts), whose equal pieces become one with a count before they meet.

The pieces that share a core become documents of a collection: bytes, the core as one symbol, bytes. Its transform is built
by columns from the last to the first: every round inserts one more symbol of each document, which puts one more suffix of each
in its place among all suffixes so far, and brings the common prefixes of neighbours up to date. Transform, common prefixes and columns
lie in external files that are read and written from beginning to end, PASS columns at a time. A suffix that shares as many symbols with a
neighbour as a window has starts a repeated string.

Rows are told apart by key and text; equal rows (repeated key and text) are repeats of each other. Null texts are
empty and have no spans. Bytes are UTF-8. Columns of any name may stand beside. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm.common import blocks, column_bytes, discard, durable, lean, mix, tidy

#: Documents of one collection, unless one core alone has more.
COLLECTION = 1 << 14
#: Window starts of a class; and of a class of an anchor with more different segments than HOT (or a 500th of all, if that is more).
STEPS, FINE, HOT, HOTTEST = 31, 8, 1000, 200_000
#: Columns inserted between a reading and a writing of the files.
PASS = 16
_BASE = 0x9E3779B97F4A7C15
_TABLES: list[np.ndarray] = []
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
CHUNK = 1 << 22
#: The symbol of a core, and what stands where a document has none. Bytes are raised by 1; UTF-8 has no byte over 0xF4.
CORE, NONE = 255, 0


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _TABLES or len(_TABLES[0]) < n:
        _TABLES.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(max(n, 1 << 19), base, np.uint64)
            x[0] = 1
            _TABLES.append(np.multiply.accumulate(x))
    return _TABLES[0][:n], _TABLES[1][:n]


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over x[i : i + w] for every i with a whole window."""
    done = 1
    while 2 * done <= w:
        x = f(x[: len(x) - done], x[done:])
        done *= 2
    return f(x[: len(x) - (w - done)], x[w - done :]) if w > done else x


def anchors(raw: np.ndarray, at: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, row, anchor hash, segment digest) in the concatenated texts raw with offsets at."""
    n, w = len(raw), least - gram + 1
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if n < least:
        return none
    power, inverse = _tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    end = at[row + 1]
    place = np.arange(n)
    grams = mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    grams[place[: n - gram + 1] + gram > end[: n - gram + 1]] = _TOP
    low = _slide(grams, w, np.minimum)  # of window i: n - least + 1 of them
    low[place[: n - least + 1] + least > end[: n - least + 1]] = 0
    wide = np.zeros(n - gram + 1 + w - 1, np.uint64)
    wide[w - 1 : w - 1 + len(low)] = low
    pick = np.flatnonzero((grams == _slide(wide, w, np.maximum)) & (grams != _TOP))
    if not len(pick):
        return none
    r = row[pick]
    a, b = np.maximum(pick - (least - gram), at[r]), np.minimum(pick + least, at[r + 1])
    segment = mix(digests(raw, a, b, 8)[:, 0] + ((pick - a) * 4096 + (b - a)).astype(np.uint64))
    return pick - at[r], r, grams[pick], segment


def digests(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """BLAKE2 digests of raw[begin : end], as rows of 64-bit numbers."""
    view, h = memoryview(np.ascontiguousarray(raw)), hashlib.blake2b
    out = b"".join([h(view[a:b], digest_size=size).digest() for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(out, np.uint64).reshape(-1, size // 8)


def anchor_table(docs: DataFrame, least: int, gram: int, chunk: int = CHUNK) -> DataFrame:
    """docs(key, th, text) to (key, th, pos, anchor, segment). Map only; long texts go by overlapping chunks."""

    def one(raw, at, lo, hi) -> Iterator[tuple]:
        if hi == lo + 1 and at[hi] - at[lo] > 2 * chunk:
            text = raw[at[lo] : at[hi]]
            for s in range(0, len(text), chunk):
                # one more segment of context on each side, so that what is kept is as in the whole text
                c = max(0, s - 2 * least)
                part = text[c : s + chunk + 2 * least]
                pos, _, a, seg = anchors(part, np.array([0, len(part)]), least, gram)
                keep = (pos + c >= s) & (pos + c < s + chunk)
                yield pos[keep] + c, np.full(keep.sum(), lo), a[keep], seg[keep]
        else:
            pos, r, a, seg = anchors(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], least, gram)
            yield pos, r + lo, a, seg

    def run(batches):
        for b in batches:
            raw, at = column_bytes(b.column(2))
            for lo, hi in blocks(at, 1 << 18):
                for pos, r, a, seg in one(raw, at, lo, hi):
                    if len(pos):
                        take = pa.array(r)
                        yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(pos.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(seg.view(np.int64))], names=["key", "th", "pos", "anchor", "segment"])

    return docs.mapInArrow(lean(run), f"key {docs.schema['key'].dataType.simpleString()}, th long, pos long, anchor long, segment long")


# ---------------------------------------------------------------- classes of windows and their cores


def classes(left: int, steps: int) -> list[int]:
    """First distances (from a window's start to the anchor, 0 to left) of classes of `steps` distances, or of all if there are fewer."""
    steps = min(steps, left + 1)
    return sorted({min(k, left + 1 - steps) for k in range(0, left + 1, steps)})


def pieces(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, pos: np.ndarray, least: int, gram: int, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, first distance, core digest, symbols around the core) of each class that has a whole core in its text.

    Item i is the anchor at pos[i] of the text raw[begin[i] : end[i]]. Symbols are bytes plus 1, as many before as behind the core.
    """
    width = min(steps, least - gram + 1) - 1
    out = []
    for first in classes(least - gram, steps):
        a, b = pos - first, pos + least - first - width  # the core: what windows with first to first + width bytes before the anchor share
        ok = np.flatnonzero((a >= begin) & (b <= end))
        if not len(ok):
            continue
        a, b = a[ok], b[ok]
        at = np.concatenate([a[:, None] + np.arange(-width, 0), b[:, None] + np.arange(width)], 1)
        symbols = raw[np.clip(at, 0, len(raw) - 1)] + np.uint8(1)
        edge = np.flatnonzero((a - width < begin[ok]) | (b + width > end[ok]))
        if len(edge):
            symbols[edge] *= (at[edge] >= begin[ok][edge, None]) & (at[edge] < end[ok][edge, None])
        core = digests(raw, a, b, 16).copy()
        core[:, 0] ^= mix(np.array([first + 1], np.uint64))  # an equal core at another distance from the anchor can be the same place
        out.append((ok, np.full(len(ok), first), core, symbols))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.uint64), np.zeros((0, 2 * width), np.uint8)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


# ---------------------------------------------------------------- the transform, column by column


class Files:
    """The external files of a task: columns, transform and common prefixes, opened once and used from beginning to end."""

    def __init__(self) -> None:
        self.folder = tempfile.TemporaryDirectory()
        self.columns, self.transform, self.prefixes = (open(os.path.join(self.folder.name, x), "w+b", buffering=0) for x in ("columns", "transform", "prefixes"))  # noqa: SIM115

    def close(self) -> None:
        for f in (self.columns, self.transform, self.prefixes):
            f.close()
        self.folder.cleanup()

    @staticmethod
    def put(f, x: np.ndarray) -> None:
        f.seek(0)
        view = memoryview(x.reshape(-1))
        while len(view):
            view = view[f.write(view) :]

    @staticmethod
    def get(f, n: int, at: int = 0) -> np.ndarray:
        f.seek(at)
        out = np.empty(n, np.uint8)
        view = memoryview(out)
        while len(view):
            view = view[f.readinto(view) :]
        return out


def _ranges(prefix: np.ndarray, after: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of prefix[after + 1 : last + 1] for each pair; best with rising `last`."""
    at = np.empty(2 * len(after), np.int64)
    at[::2], at[1::2] = after + 1, last + 1
    return np.minimum.reduceat(np.append(prefix, np.uint8(0)), at)[::2]


def _far_ranges(prefix: np.ndarray, after: np.ndarray, last: np.ndarray) -> np.ndarray:
    """As _ranges(), for pairs that lie far apart: minima within blocks, and a table of minima over 2**k blocks."""
    if not len(after):
        return np.zeros(0, np.uint8)
    side = 64
    full = np.full(-(-len(prefix) // side) * side, 255, np.uint8)
    full[: len(prefix)] = prefix
    square = full.reshape(-1, side)
    fore = np.minimum.accumulate(square, axis=1).ravel()
    rear = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    table = [square.min(1)]
    while len(table[-1]) > 1 << (len(table) - 1):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    a, b = after + 1, last
    x, y = a // side, b // side
    out = np.minimum(rear[a], fore[b])
    near = np.flatnonzero(x == y)
    for i in range(0, len(near), 1 << 14):
        n = near[i : i + (1 << 14)]
        at = (x[n] * side)[:, None] + np.arange(side)
        out[n] = np.where((at >= a[n, None]) & (at <= b[n, None]), full[at], 255).min(1)
    gap = y - x - 1
    level = np.zeros(len(gap), np.int64)
    level[gap > 0] = np.log2(gap[gap > 0]).astype(np.int64)
    for k in np.unique(level[gap > 0]).tolist():
        n = np.flatnonzero((gap > 0) & (level == k))
        out[n] = np.minimum(out[n], np.minimum(table[k][x[n] + 1], table[k][y[n] - (1 << k)]))
    return out


def collection(symbols: np.ndarray, core: np.ndarray, files: Files, per_pass: int = PASS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Inserts the columns of a collection from the last to the first: (column, documents, places of their new suffixes, common prefixes).

    A document is a row of symbols (as many before as behind its core) and the number of its core; NONE stands before its
    beginning and after its end. Documents are aligned at their cores. Suffixes of all columns stay in the transform; those without
    symbols come first. Entry i of the common prefixes is that of suffixes i - 1 and i, up to one more than half a row.
    """
    m, width = len(symbols), symbols.shape[1] // 2
    most = np.uint8(width + 1)
    files.put(files.columns, np.ascontiguousarray(symbols.T))
    files.put(files.transform, np.zeros(m, np.uint8))
    files.put(files.prefixes, np.zeros(m, np.uint8))
    size, place = m, np.arange(m)
    for high in range(2 * width, -1, -per_pass):
        before, prefix = files.get(files.transform, size), files.get(files.prefixes, size)
        low = max(0, high - per_pass + 1)
        start, stop = low - (low > width), high + (high < width)  # the core has no column in the file
        columns = files.get(files.columns, (stop - start) * m, start * m).reshape(-1, m)
        for j in range(high, low - 1, -1):
            s = np.full(m, CORE, np.uint8) if j == width else columns[j - (j > width) - start]
            docs = np.flatnonzero(s)
            if not len(docs):
                continue
            docs = docs[np.argsort(place[docs])]
            s, old = s[docs], place[docs]
            before[old] = s  # the transform: the symbol before each suffix
            to = np.argsort(before, kind="stable")
            count = np.bincount(before, minlength=256)
            if j == width:
                # cores are told apart by their numbers: the suffixes behind equal ones keep their order
                turn = np.lexsort((old, core[docs]))
                new = np.empty(len(docs), np.int64)
                new[turn] = size + m - count[NONE] - count[CORE] + np.arange(len(docs))
                back = np.full(len(docs), -1)
                same = np.flatnonzero(core[docs][turn][1:] == core[docs][turn][:-1])
                back[turn[same + 1]] = old[turn[same]]
                ahead = np.full(len(docs), -1)
                ahead[turn[same]] = old[turn[same + 1]]
            else:
                rank = np.empty(size, np.int32)
                rank[to] = np.arange(size, dtype=np.int32)
                k = rank[old].astype(np.int64)
                new = m + k - count[NONE]
                first = np.cumsum(count) - count
                back = np.where(k > first[s], to[k - 1], -1)
                ahead = np.where(k + 1 < (first + count)[s], to[np.minimum(k + 1, size - 1)], -1)
            shared = np.zeros((2, len(docs)), np.uint8)  # with the suffix before, with the one behind
            for side, a, b, has in ((0, back, old, back >= 0), (1, old, ahead, ahead >= 0)):
                if has.any():
                    least = (_far_ranges if j == width else _ranges)(prefix, a[has], b[has])
                    shared[side, has] = np.minimum(least, most - 1) + 1
            size += len(docs)
            stays = np.ones(size, bool)
            stays[new] = False
            for was, value in ((before, None), (prefix, shared[0])):
                grown = np.zeros(size, np.uint8)
                grown[stays] = was
                if value is None:
                    before = grown
                else:
                    grown[new] = value
                    inner = new + 1 < size
                    grown[new[inner] + 1] = shared[1, inner]
                    prefix = grown
            place[docs] = new
            yield j, docs, new, prefix
        files.put(files.transform, before)
        files.put(files.prefixes, prefix)


def whole_windows(symbols: np.ndarray) -> np.ndarray:
    """As bits, the distances d from which a window (d symbols before its core) lies in the text: near an end of it not all do."""
    width = symbols.shape[1] // 2
    before, behind = (symbols[:, :width] != NONE).sum(1), (symbols[:, width:] != NONE).sum(1)
    d = np.arange(width + 1)
    return (((d <= before[:, None]) & (width - d <= behind[:, None])).astype(np.int64) << d).sum(1)


def repeated_windows(symbols: np.ndarray, core: np.ndarray, files: Files) -> np.ndarray:
    """For each document the set of distances d, as bits, from which a window (d symbols before its core) has an equal one."""
    width = symbols.shape[1] // 2
    out = np.zeros(len(symbols), np.int64)
    for j, docs, new, prefix in collection(symbols, core, files):
        if j <= width:
            behind = np.append(prefix, np.uint8(0))[new + 1]
            hit = docs[(prefix[new] > width) | (behind > width)]
            out[hit] |= np.int64(1 << (width - j))
    return out


def _collections(batches):
    """Rows (c1, c2, item, symbols) in order of c1 and c2 to (item, hits); cores with one document are left out."""
    files = None
    held: list[tuple] = []
    many = 0

    def work(rows: list[tuple]):
        nonlocal files
        c1, c2, item = (np.concatenate([r[k] for r in rows]) for k in range(3))
        text = np.concatenate([r[3] for r in rows])
        new = np.r_[True, (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])]
        core = np.cumsum(new) - 1
        several = np.bincount(core)[core] > 1
        if several.any():
            files = files or Files()
            hits = repeated_windows(text[several], core[several], files)
            found = np.flatnonzero(hits)
            return pa.RecordBatch.from_arrays([pa.array(item[several][found]), pa.array(hits[found])], names=["item", "hits"])
        return None

    try:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            c1, c2, item = (b.column(k).to_numpy() for k in range(3))
            raw, at = column_bytes(b.column(3))
            text = raw.reshape(n, -1) if len(raw) else np.zeros((n, 0), np.uint8)
            begin = 0
            while begin < n:
                if held and many >= COLLECTION:
                    # goes on to the end of the core that the last row held belongs to
                    k1, k2 = held[-1][0][-1], held[-1][1][-1]
                    other = np.flatnonzero((c1[begin:] != k1) | (c2[begin:] != k2))
                    stop = begin + (int(other[0]) if len(other) else n - begin)
                    if stop > begin:
                        held.append((c1[begin:stop], c2[begin:stop], item[begin:stop], text[begin:stop]))
                        begin = stop
                    if len(other):
                        done = work(held)
                        held, many = [], 0
                        if done is not None:
                            yield done
                    continue
                stop = min(n, begin + COLLECTION - many)
                held.append((c1[begin:stop], c2[begin:stop], item[begin:stop], text[begin:stop]))
                many += stop - begin
                begin = stop
        if held:
            done = work(held)
            if done is not None:
                yield done
    finally:
        if files is not None:
            files.close()


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 200, gram: int = 50, chunk: int = CHUNK, hot: int = HOT) -> DataFrame:
    """(key, th, xs): for each row of docs with a repeated string, structs of pos, first and hits.

    th is xxhash64 of the text. Windows start first + d bytes before pos for each bit d of hits; hits of 0 stand for every window around the anchor at pos.
    """
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), F.col(text).alias("text"))
    table = durable(anchor_table(rows.where(F.octet_length("text") >= least), least, gram, chunk))
    # written first: a join of two exchanges is one whose hot anchors Spark can split
    shared = durable(table.groupBy("anchor").agg(F.count("pos").alias("c"), F.min("segment").alias("lo"), F.max("segment").alias("hi")).where("c > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("mixed")))
    met = durable(table.join(shared, "anchor"))
    discard(table)
    discard(shared)
    # different segments, once each, with a count; those met more than once are repeated as a whole
    kinds = durable(met.where("mixed").groupBy("anchor", "segment").agg(F.count("pos").alias("n"), F.min(F.struct("key", "th", "pos")).alias("x")).select(F.monotonically_increasing_id().alias("id"), "anchor", "segment", "n", "x.*"))
    limit = min(max(hot, kinds.count() // 500), HOTTEST)
    crowded = durable(kinds.groupBy("anchor").agg(F.count("id").alias("c")).where(F.col("c") > limit).select("anchor", F.lit(True).alias("fine")))
    need = kinds.join(crowded, "anchor", "left").groupBy("key", "th").agg(F.collect_list(F.struct("id", "pos", F.coalesce("fine", F.lit(False)).alias("fine"))).alias("a"))

    def cut(batches):
        names = ["c1", "c2", "item", "symbols", "fine", "windows"]
        for b in batches:
            raw, at = column_bytes(b.column(1))
            lists = b.column(0)
            items, row = lists.flatten(), np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            ids, pos, fine = (items.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            for slow, steps in ((False, STEPS), (True, FINE)):
                for lo in range(0, int((fine == slow).sum()), 1 << 14):
                    x = np.flatnonzero(fine == slow)[lo : lo + (1 << 14)]
                    i, first, core, symbols = pieces(raw, at[row[x]], at[row[x] + 1], pos[x] + at[row[x]], least, gram, steps)
                    flat = np.ascontiguousarray(symbols)
                    offsets = np.arange(len(flat) + 1, dtype=np.int32) * np.int32(flat.shape[1])
                    core = core.view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(core[:, 0]), pa.array(core[:, 1]), pa.array(ids[x][i] * 4096 + first), pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]), pa.array(np.full(len(flat), slow)), pa.array(whole_windows(flat) if slow else np.zeros(len(flat), np.int64))], names=names)

    both = rows.alias("r").join(need.alias("n"), F.col("r.key").eqNullSafe(F.col("n.key")) & (F.col("r.th") == F.col("n.th")))
    dealt = durable(both.select("n.a", "r.text").mapInArrow(lean(cut), "c1 long, c2 long, item long, symbols binary, fine boolean, windows long"))
    discard(crowded)
    tidy(docs.sparkSession)
    build = lambda df: df.repartition("c1").sortWithinPartitions("c1", "c2").mapInArrow(lean(_collections), "item long, hits long")
    # a text that stands twice in documents brings its pieces twice: as equal items they are one
    found = build(dealt.where("not fine").select("c1", "c2", "item", "symbols"))
    # pieces of hot anchors: equal ones become one with a count first, and if it is over 1 all windows of the class that lie in the text are repeated
    fine = dealt.where("fine")
    alike = durable(fine.groupBy("c1", "c2", "symbols").agg(F.min("item").alias("item"), F.countDistinct("item").alias("n")))
    again = fine.join(durable(alike.where("n > 1").select("c1", "c2", "symbols")), ["c1", "c2", "symbols"], "left_semi").where("windows <> 0").select("item", F.col("windows").alias("hits"))
    found = durable(found.unionByName(build(alike.select("c1", "c2", "item", "symbols"))).unionByName(again).select(F.shiftright("item", 12).alias("id"), F.expr("item & 4095").alias("first"), "hits"))
    discard(dealt)
    discard(alike)
    whole_struct = F.struct("pos", F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("hits")).alias("x")
    whole = met.where(~F.col("mixed")).select("key", "th", whole_struct)
    often = met.where("mixed").join(durable(kinds.where("n > 1").select("anchor", "segment")), ["anchor", "segment"], "left_semi").select("key", "th", whole_struct)
    parts = kinds.where("n = 1").join(found, "id").select("key", "th", F.struct("pos", "first", "hits").alias("x"))
    out = durable(whole.unionByName(often).unionByName(parts).groupBy("key", "th").agg(F.collect_list("x").alias("xs")))
    for done in (met, kinds, found):
        discard(done)
    return out


# ---------------------------------------------------------------- spans of rows


def spans(lists: pa.ListArray, at: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of the disjoint maximal repeated spans, in order, from the xs of repeated() for texts with offsets `at`."""
    none = np.zeros(0, np.int64)
    sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()), 0)
    items, row = lists.flatten(), np.repeat(np.arange(len(lists)), sizes)
    if not len(row):
        return none, none, none
    pos, first, hits = (items.field(k).to_numpy() for k in range(3))
    size = np.diff(at)[row]
    whole = hits == 0
    item, bit = np.nonzero(np.unpackbits(np.ascontiguousarray(hits).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    start = (pos - first)[item] - bit
    r = np.r_[row[whole], row[item]]
    begin = np.r_[np.maximum(0, pos[whole] - (least - gram)), start]
    end = np.r_[np.minimum(size[whole], pos[whole] + least), start + least]
    # texts lie one after another with a gap between, so that spans of different texts never touch
    shift = (at[:-1] + np.arange(len(lists)))[r]
    order = np.argsort(begin + shift, kind="stable")
    b, e, r = (begin + shift)[order], np.maximum.accumulate((end + shift)[order]), r[order]
    new = np.flatnonzero(np.r_[True, b[1:] > e[:-1]])
    r, b, e = r[new], b[new], e[np.r_[new[1:] - 1, len(e) - 1]]
    return r, b - (at[:-1] + np.arange(len(lists)))[r], e - (at[:-1] + np.arange(len(lists)))[r]


def cleared(raw: np.ndarray, at: np.ndarray, row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes outside the spans, and the offsets of the rows in them."""
    if not len(row):
        return raw, at
    edge = np.zeros(len(raw) + 1, np.int8)
    np.add.at(edge, begin + at[row], 1)
    np.add.at(edge, end + at[row], -1)
    keep = np.cumsum(edge[:-1], dtype=np.int8) == 0
    gone = np.bincount(row, end - begin, len(at) - 1).astype(np.int64)
    return raw[keep], at - np.r_[0, np.cumsum(gone)]


def with_spans(docs: DataFrame, work, schema, columns: list[str], key: str, text: str, least: int, gram: int, **more) -> DataFrame:
    """Runs work(columns, kept bytes and offsets, offsets before, rows of spans) over docs joined with their spans."""
    found = repeated(docs, key, text, least, gram, **more)
    th = F.xxhash64(F.coalesce(text, F.lit("")))
    # the columns of docs stand in one struct, so no name can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(key).alias("key"), th.alias("th"))
    joined = rows.alias("r").join(found.alias("f"), F.col("r.key").eqNullSafe(F.col("f.key")) & (F.col("r.th") == F.col("f.th")), "left")
    at_text = columns.index(text)

    def run(batches):
        for b in batches:
            cols = b.column(0).flatten()
            raw, at = column_bytes(cols[at_text])
            r, begin, end = spans(b.column(1), at, least, gram)
            yield work(cols, *cleared(raw, at, r, begin, end), at, r)

    return joined.select("r.row", "f.xs").mapInArrow(lean(run), schema)


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 200, gram: int = 50, **more) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans and the SHA-256 of what is kept."""

    def work(cols, kept, to, at, row):
        view, n = memoryview(np.ascontiguousarray(kept)), len(at) - 1
        sha = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([cols[0], pa.array(np.diff(at)), pa.array(np.diff(at) - np.diff(to)), pa.array(np.bincount(row, minlength=n)[:n]), pa.array(sha, pa.string())], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return with_spans(docs, work, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string", [key, text], key, text, least, gram, **more)


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 200, gram: int = 50, **more) -> DataFrame:
    """docs with every repeated byte taken out of the text (a character cut in two goes too); null texts stay null."""
    columns = docs.columns
    where = columns.index(text)

    def work(cols, kept, to, at, row):
        data = kept.tobytes()
        there = cols[where].is_valid().to_pylist()
        new = [data[a:b].decode("utf-8", "ignore") if t else None for a, b, t in zip(to[:-1].tolist(), to[1:].tolist(), there, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == where else c for i, c in enumerate(cols)], names=columns)

    return with_spans(docs, work, docs.schema, columns, key, text, least, gram, **more)
