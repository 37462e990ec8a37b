"""SimHash fingerprints and Hamming search with permuted block tables.

Terms are the words of a text, lower case; a term's weight is 1 plus the whole part of the binary logarithm of its count. Its
256-bit hash votes with that weight, per bit for or against; the sign of the sum is the fingerprint's bit. Null and empty
texts have no terms and the fingerprint of zeros. Texts of any length are taken whole; rows that repeat have equal fingerprints.

Search: a fingerprint is cut into blocks, at least half as many as radius + 1, and there is a table for each, in which that block stands first.
Two fingerprints within the radius differ in one bit at most in some block. So a query looks into each table under its own block and under that
block with each single bit turned, which finds all; a pair counts only in the first table in which it meets, so none is found twice.
Equal fingerprints are one row with a count. Tables and queries are written before they meet, so that Spark can split a block that many have.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.llm.common import blocks, column_bytes, durable, lean, mix, words

BITS = 256
#: Words of a term. Single words lie nearest for near copies (median 14 bits at a five-word Jaccard of 0.8; pairs and triples: 22 and 28).
SHINGLE = 1
#: Documents of sf0.01 edited until their five-word Jaccard was just 0.8: 99 % lie within 23 bits; of unlike texts 0.1 % lie within 73.
RADIUS = 23
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
PARTS = ("f0", "f1", "f2", "f3")


def vote(terms: np.ndarray) -> np.ndarray:
    """The fingerprint of term hashes (with repeats), as four 64-bit numbers."""
    if not len(terms):
        return np.zeros(4, np.uint64)
    terms, count = np.unique(terms, return_counts=True)
    weight = 1 + np.log2(count).astype(np.int32)
    bits = np.unpackbits(mix(terms[:, None] ^ _SEEDS).view(np.uint8).reshape(len(terms), 32), axis=1)
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(bits), 255):  # sums of 255 bits fit in a byte
        votes += np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8)
    heavy = np.flatnonzero(weight > 1)
    if len(heavy):
        votes += ((weight[heavy, None] - 1) * bits[heavy]).sum(0)
    return np.packbits(2 * votes > weight.sum()).view(np.uint64)


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """(n, 4) 64-bit numbers."""
    out = np.zeros((len(texts), 4), np.uint64)
    raw, at = column_bytes(pa.array(texts, pa.large_string()))
    for lo, hi in blocks(at, 1 << 18):
        w, first = words(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        h = w[: len(w) - SHINGLE + 1] if len(w) >= SHINGLE else w[:0]  # shorter texts have their words as terms
        for j in range(1, SHINGLE):
            h = mix(h * np.uint64(0xD1342543DE82EF95) + w[j : j + len(h)])
        for i, a, b in zip(range(lo, hi), first[:-1].tolist(), first[1:].tolist(), strict=True):
            out[i] = vote(h[a : b - SHINGLE + 1] if b - a >= SHINGLE else w[a:b])
    return out


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns f0 to f3: the fingerprint as four 64-bit numbers. Map only; columns so named are replaced."""
    keep = [c for c in docs.columns if c not in PARTS]
    src = docs.select(*keep)

    def run(batches):
        for b in batches:
            f = fingerprints(b.column(keep.index(text)).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(f[:, k]) for k in range(4)]], names=[*keep, *PARTS])

    from pyspark.sql import types as T

    return src.mapInArrow(lean(run), T.StructType([*src.schema.fields, *[T.StructField(p, T.LongType()) for p in PARTS]]))


def as_hex(parts=PARTS) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(F.col(p)), 16, "0") for p in parts]))


def block_cuts(radius: int) -> list[tuple[int, int, int]]:
    """(part, first bit, bits) of the blocks: as many in each 64-bit part as the radius needs."""
    each = max(1, -(-(radius + 1) // 8))
    return [(p, k * (64 // each), 64 - (each - 1) * (64 // each) if k + 1 == each else 64 // each) for p in range(4) for k in range(each)]


def _block(part: Column, first: int, bits: int) -> Column:
    return part if bits == 64 else F.shiftrightunsigned(part, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def matches(fps: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(q0..q3, f0..f3, n, bits): for each distinct query fingerprint, the distinct ones of fps within `radius` (under 128) bits, itself
    included, with the number of their rows and their distance. Each pair comes once."""
    cuts = block_cuts(radius)
    asks = [p.replace("f", "q") for p in PARTS]
    rows = durable(fps.groupBy(*PARTS).agg(F.count("*").alias("n")))
    asked = durable(queries.select(*[F.col(p).alias(q) for p, q in zip(PARTS, asks, strict=True)]).distinct())
    one = [F.struct(F.lit(b).alias("b"), _block(F.col(PARTS[p]), first, bits).alias("v")) for b, (p, first, bits) in enumerate(cuts)]
    tables = rows.select(*PARTS, "n", F.explode(F.array(*one)).alias("x")).select("x.b", "x.v", *PARTS, "n")
    turn = lambda b, block: lambda mask: F.struct(F.lit(b).alias("b"), block.bitwiseXOR(mask).alias("v"))
    turned = []
    for b, (p, first, bits) in enumerate(cuts):
        masks = F.array(*[F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("long") for k in range(bits)], F.lit(0).cast("long"))
        turned.append(F.transform(masks, turn(b, _block(F.col(asks[p]), first, bits))))
    probes = asked.select(*asks, F.explode(F.concat(*turned)).alias("x")).select("x.b", "x.v", *asks)
    apart = [F.col(f).bitwiseXOR(F.col(q)) for f, q in zip(PARTS, asks, strict=True)]
    bits = sum((F.bit_count(x) for x in apart), F.lit(0))
    meets = F.lit(None).cast("int")  # the first block with one different bit at most
    for b, (p, first, n) in reversed(list(enumerate(cuts))):
        meets = F.when(F.bit_count(_block(apart[p], first, n)) <= 1, b).otherwise(meets)
    # the size of either side is guessed from before its rows were multiplied, so a broadcast could be far larger than thought
    both = tables.join(probes.hint("merge"), ["b", "v"]).where(bits <= radius).where(meets == F.col("b"))
    return both.select(*asks, *PARTS, "n", bits.cast("long").alias("bits"))


def search(fps: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(f0..f3, n_within): for each distinct query fingerprint, the rows of fps within `radius` bits, itself included (see matches).

    Pairs are summed where they meet, before the shuffle by query.
    """
    near = matches(fps, queries, radius)
    return near.groupBy("q0", "q1", "q2", "q3").agg(F.sum("n").alias("n_within")).withColumnsRenamed({f"q{k}": f"f{k}" for k in range(4)})


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 minus the share of different bits, row by row."""
    return 1 - np.bitwise_count(a ^ b).sum(1) / BITS


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, whose second half is the next document's beginning.

    Documents follow each other by descending key (equal keys by text, null keys last), the first after the last. Rows are
    dealt by key ranges and go through in order; the last row of a range waits for the first of the next, which a
    small join brings.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    way = [F.col("key").desc_nulls_last(), F.xxhash64("text")]
    count = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(count, *way).sortWithinPartitions(*way)
    kind = docs.schema[key].dataType.simpleString()
    one = f"key {kind}, n_chars long, edited_sha256 string, " + ", ".join(f"{x}{k} long" for x in "fe" for k in range(4)) + ", near_edited double, near_next double"

    def pairs(keys: list, texts: list[str], heads: list[str], fp: np.ndarray, fp_next: np.ndarray) -> list[pa.Array]:
        new = [t[: len(t) - len(t) // 2] + h[: len(t) // 2] for t, h in zip(texts, heads, strict=True)]
        e = fingerprints(new)
        return [pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in new], pa.string()), *[pa.array(x[:, k].view(np.int64)) for x in (fp, e) for k in range(4)], pa.array(alike(fp, e)), pa.array(alike(fp, fp_next))]

    names = ["key", "n_chars", "edited_sha256", *[f"{x}{k}" for x in "fe" for k in range(4)], "near_edited", "near_next"]

    def run(batches):
        from pyspark import TaskContext

        pid, held, first = TaskContext.get().partitionId(), None, True
        nothing = lambda n: pa.nulls(n)

        def row(what, k, t):
            cols = [pa.array([k], key_type), *[nothing(1).cast(x) for x in types[1:]], pa.array([what]), pa.array([pid], pa.int64()), pa.array([t], pa.string())]
            return pa.RecordBatch.from_arrays(cols, names=[*names, "what", "pid", "text"])

        types = [None, pa.int64(), pa.string(), *[pa.int64()] * 8, pa.float64(), pa.float64()]
        for b in batches:
            key_type = b.column(0).type
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                keys, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                fp = fingerprints(texts)
                if first:
                    yield row("first", keys[0], texts[0])
                    first = False
                if held:
                    keys, texts, fp = [held[0], *keys], [held[1], *texts], np.concatenate([held[2], fp])
                held = keys[-1], texts[-1], fp[-1:]
                if len(keys) > 1:
                    cols = pairs(keys[:-1], texts[:-1], texts[1:], fp[:-1], fp[1:])
                    n = len(keys) - 1
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:-1], key_type), *cols, pa.array(["done"] * n), nothing(n).cast(pa.int64()), nothing(n).cast(pa.string())], names=[*names, "what", "pid", "text"])
        if held:
            yield row("last", held[0], held[1])

    table = durable(dealt.mapInArrow(lean(run), one + ", what string, pid long, text string"))
    # one row a range: which range follows which is a list as long as the ranges are many
    order = sorted(r.pid for r in table.where("what = 'first'").select("pid").collect())
    done = table.where("what = 'done'").select(*names)
    if not order:
        return done
    follow = docs.sparkSession.createDataFrame(list(zip(order, order[1:] + order[:1], strict=True)), "pid long, next long")
    heads = table.where("what = 'first'").select(F.col("pid").alias("next"), F.col("text").alias("head"))
    ends = table.where("what = 'last'").select("key", "text", "pid").join(F.broadcast(follow), "pid").join(heads, "next").select("key", "text", "head")

    def close(batches):
        for b in batches:
            if b.num_rows:
                texts, heads = b.column(1).to_pylist(), b.column(2).to_pylist()
                yield pa.RecordBatch.from_arrays([b.column(0), *pairs(b.column(0).to_pylist(), texts, heads, fingerprints(texts), fingerprints(heads))], names=names)

    return done.unionByName(ends.mapInArrow(lean(close), one))
