"""Packing by lexical retrieval: a sharded BM25 index gives each seed its unused neighbours, which fill its window.

Documents become token ids plus an end id. Whole windows of a long document stand alone; what is left over (less than a
window) is packed. Token ids are the index's terms; document frequencies and the mean length come from all documents. Rests
go to shards by their most telling terms, so that likely neighbours meet; terms that are most telling for many documents
(copies of one text, say) are spread by a salt that grows with their document frequency, so no shard grows with a group.
A shard works in runs of SHARD rests: each run has an inverted index of its own; the longest unused rest is the seed,
its neighbours join by falling BM25 score while they fit, and the next one is cut to fill the window to the last id.
The last window of a run can have room left: its pieces go on into the next run, and those of a task's last run into a closing pass over
all such pieces, so that padding depends neither on the number of shards nor on that of partitions: one window of each CLOSING ids that
reach the closing pass can have room, and at least one.

A null or empty text is its end id alone. Rows that repeat are packed each on its own; ties go by key and ids. A table without rows gives
none. Texts of any length go through: only their rests meet others.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm import bpe
from kelpie.llm.common import column_bytes, discard, durable, lean, mix

WINDOW = 2048
SHARD = 2048
K1, B = 1.5, 0.75
#: Most telling terms that choose a shard.
TELLING = 8
#: Terms that more than one in so many rests of a run has are looked up in a table.
COMMON = 32
#: Bytes of ids that a task packs, and ids that a task of the closing pass packs.
TASK, CLOSING = 4 << 20, 1 << 19


def tokens(docs: DataFrame, path: str, end: int, key: str, text: str) -> DataFrame:
    """(key, ids): little-endian ids with the end id, 16 bits wide if the vocabulary allows, else 32."""
    wide = "<u2" if bpe.encoder(path).tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"

    def run(batches):
        own, last = bpe.encoder(path), np.array([end], wide)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                ids = [np.concatenate([x.astype(wide), last]).tobytes() for x in own.encode_column(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["key", "ids"])

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(lean(run), f"key {docs.schema[key].dataType.simpleString()}, ids binary")
    out.wide = wide  # type: ignore[attr-defined]
    return out


def frequencies(table: DataFrame, wide: str) -> tuple[np.ndarray, int, float]:
    """Document frequency of every id, number of documents, mean length. What reaches the driver is bounded by the vocabulary."""

    def run(batches):
        size, rows = 1 << 16, 128
        seen, n, total = np.zeros(size, np.int64), 0, 0
        there = np.zeros((rows, size), np.uint8)  # which ids each of some rows has
        for b in batches:
            raw, at = column_bytes(b.column(0))
            ids, at = raw.view(wide), at // int(wide[-1])
            for lo in range(0, b.num_rows, rows):
                hi = min(lo + rows, b.num_rows)
                part = ids[at[lo] : at[hi]]
                if wide != "<u2" and len(part) and (top := int(part.max())) >= size:
                    size = 2 * top
                    seen = np.r_[seen, np.zeros(size - len(seen), np.int64)]
                    there = np.zeros((rows, size), np.uint8)
                flat = np.repeat(np.arange(hi - lo) * size, np.diff(at[lo : hi + 1])) + part
                there.ravel()[flat] = 1
                seen += np.add.reduce(there[: hi - lo], axis=0, dtype=np.uint8)  # 128 at most
                there.ravel()[flat] = 0
            n, total = n + b.num_rows, total + len(ids)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1, -2]), pa.array(np.r_[seen[at], n, total])], names=["term", "n"])

    got = {r.term: r.n for r in table.select("ids").mapInArrow(lean(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, total = got.pop(-1, 0), got.pop(-2, 0)
    df = np.zeros(max(got, default=0) + 1, np.int64)
    df[list(got)] = list(got.values())
    return df, n, total / max(n, 1)


def counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids (at least one), sorted, and how often each occurs."""
    s = np.sort(ids)
    new = np.ones(len(s) + 1, bool)
    np.not_equal(s[1:], s[:-1], out=new[1:-1])
    first = np.flatnonzero(new)
    return s[first[:-1]], first[1:] - first[:-1]


def pack_run(rests: list[np.ndarray], idf: np.ndarray, mean: float, window: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (rest, begin, length) over all ids of the rests; every window but the last is full."""
    n = len(rests)
    terms, tf, size = [], [], np.array([len(r) for r in rests])
    for r in rests:
        t, c = counted(r)
        terms.append(t)
        tf.append(c)
    docs = np.repeat(np.arange(n), [len(t) for t in terms])
    allt, alltf = np.concatenate(terms), np.concatenate(tf)
    weight = idf[allt] * alltf * (K1 + 1) / (alltf + K1 * (1 - B + B * size[docs] / mean))
    # terms that many rests have go by a table with a row a rest, the others by posting lists
    common = np.flatnonzero(np.bincount(allt) > max(16, n // COMMON))
    column = np.full(int(allt.max()) + 1, -1)
    column[common] = np.arange(len(common))
    often = column[allt] >= 0
    table = np.zeros((2, n, len(common)), np.float32)
    table[0, docs[often], column[allt[often]]] = weight[often]
    table[1, docs[often], column[allt[often]]] = 1
    base = table[1] @ table[0].T  # row: seed, column: neighbour
    del table
    docs, allt, weight = docs[~often], allt[~often], weight[~often]
    order = np.argsort(allt, kind="stable")
    pterm, pdoc, pweight = allt[order], docs[order], weight[order]
    first, last = (np.searchsorted(pterm, np.arange(len(column)), side) for side in ("left", "right"))
    begin, used = np.zeros(n, np.int64), np.zeros(n, bool)
    by_size, head = np.argsort(-size, kind="stable"), 0
    windows = []
    carried = -1  # a rest that was cut goes on in the next window
    while True:
        if carried >= 0:
            seed, carried = carried, -1
        else:
            while head < n and used[by_size[head]]:
                head += 1
            if head == n:
                return windows
            seed = int(by_size[head])
        used[seed] = True
        now, room = [(seed, int(begin[seed]), int(size[seed] - begin[seed]))], window - int(size[seed] - begin[seed])
        if room:
            mine = terms[seed]
            score = base[seed].astype(np.float64)
            a, length = first[mine], last[mine] - first[mine]
            at = np.repeat(a - (np.cumsum(length) - length), length)
            at += np.arange(len(at))
            score += np.bincount(pdoc[at], pweight[at], minlength=n)
            score[used] = -1
            cut = -1
            while room:
                d = int(score.argmax())  # of equal ones the first
                if score[d] < 0:
                    break
                if size[d] <= room:
                    used[d] = True
                    now.append((d, 0, int(size[d])))
                    room -= int(size[d])
                    score[d] = -1
                elif cut < 0:
                    cut = d
                if cut >= 0:
                    score[size > room] = -1  # room only falls, so these never fit
            if room and cut >= 0:  # nothing that fits is left: the nearest of the others is cut
                used[cut] = True
                now.append((cut, 0, room))
                begin[cut], carried, room = room, cut, 0
        windows.append(now)


def pack(docs: DataFrame, path: str, end: int = 1, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    encoded = tokens(docs, path, end, key, text)
    wide = encoded.wide
    table = durable(encoded)
    df, n, mean = frequencies(table, wide)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5)).astype(np.float32)
    parts = max(1, -(-int(n * mean) * 2 // TASK))
    shards = 8 * parts
    target = max(1, n // shards)
    kind = docs.schema[key].dataType.simpleString()

    def rest(batches):
        hashed = mix(np.arange(1, len(df) + 1, dtype=np.uint64))  # of every id
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                out = []
                for k, x in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = np.frombuffer(x.as_py(), wide)
                    whole = len(ids) // window
                    crcs = [zlib.crc32(ids[i * window : (i + 1) * window].astype("<u4").tobytes()) for i in range(whole)]
                    t, c = counted(ids)
                    w = idf[t] * c / (c + K1)
                    t = t[np.argpartition(-w, TELLING)[:TELLING]] if len(t) > TELLING else t
                    pair = sorted(zip(hashed[t].tolist(), t.tolist(), strict=True))[:2]
                    first, second = pair[0][1], pair[-1][0]
                    spread = 1 + int(df[first]) // target
                    salt = (zlib.crc32(ids) + 31 * zlib.crc32(str(k).encode())) % spread
                    shard = zlib.crc32(b"%d %d" % (first, salt)) % shards
                    out.append((shard, second >> 1, len(ids), np.array(crcs, "<u4").tobytes(), ids[whole * window :].tobytes(), whole * window))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()))]], names=["key", "shard", "near", "n", "crcs", "rest", "since"])

    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def fill(batches, closing: bool):
        """Rows (key, n, crcs, rest, since) to pieces; those of the last window, if it has room, keep their ids for the closing pass."""
        from pyspark import TaskContext

        at = (int(closing) << 62) + (TaskContext.get().partitionId() << 36)
        held: list[tuple] = []
        key_type = None

        def piece(of: tuple, a: int, size: int, offset: int | None) -> tuple:
            k, total, _, rest, since = of
            ids = np.frombuffer(rest, wide)[a : a + size]
            if offset is None:
                return k, since + a, size, None, total, None, None, ids.tobytes()
            return k, since + a, size, zlib.crc32(ids.astype("<u4").tobytes()), total, at, offset, None

        def work(last: bool):
            nonlocal at, held
            rows = []
            for k, total, crcs, _, _ in held:
                for i, c in enumerate(np.frombuffer(crcs, "<u4").tolist()):
                    rows.append((k, i * window, window, c, total, at, 0, None))
                    at += 1
            kept = [h for h in held if len(h[3])]
            windows = pack_run([np.frombuffer(h[3], wide) for h in kept], idf, mean, window) if kept else []
            left = []
            if windows and not (closing and last) and sum(x[2] for x in windows[-1]) < window:
                left = windows.pop()
            for now in windows:
                offset = 0
                for d, a, size in now:
                    rows.append(piece(kept[d], a, size, offset))
                    offset += size
                at += 1
            if last:
                rows += [piece(kept[d], a, size, None) for d, a, size in left]
            held = [] if last else [(kept[d][0], kept[d][1], b"", np.frombuffer(kept[d][3], wide)[a : a + size].tobytes(), kept[d][4] + a) for d, a, size in left]
            cols = list(zip(*rows, strict=True)) or [()] * 8
            return pa.RecordBatch.from_arrays([pa.array(cols[0], key_type), *[pa.array(c, pa.int64()) for c in cols[1:7]], pa.array(cols[7], pa.binary())], names=[*names, "left"])

        for b in batches:
            key_type = b.column(0).type
            for k, total, crcs, r, since in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), b.column(4).to_pylist(), strict=True):
                held.append((k, total, crcs.as_py(), r.as_py(), since))
                if len(held) >= SHARD:
                    yield work(False)
        if held:
            yield work(True)

    schema = f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in names[1:]) + ", left binary"
    dealt = table.mapInArrow(lean(rest), f"key {kind}, shard long, near long, n long, crcs binary, rest binary, since long").repartition(parts, "shard").sortWithinPartitions("shard", "near", "key", "n", "rest")
    done = durable(dealt.select("key", "n", "crcs", "rest", "since").mapInArrow(lean(lambda x: fill(x, False)), schema))
    discard(table)
    open_pieces = done.where("left is not null").select(F.col(f"`{key}`").alias("key"), F.col("doc_tokens").alias("n"), F.lit(b"").alias("crcs"), F.col("left").alias("rest"), F.col("start").alias("since"))
    many = -(-(open_pieces.agg(F.sum(F.octet_length("rest"))).first()[0] or 0) // (CLOSING * int(wide[-1]))) or 1
    closed = open_pieces.repartition(many, F.xxhash64("key", "since", "rest")).sortWithinPartitions("key", "since", "rest").mapInArrow(lean(lambda x: fill(x, True)), schema)
    return done.where("left is null").unionByName(closed).select(*[f"`{c}`" for c in names])
