"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations make a whole signature: sigma scatters a shingle over the circle of 32-bit numbers, and coordinate k is
the least value of pi over the shingles after a circular shift by k. Signatures are cut into bands; sets that
agree on a band meet in its bucket. Equal sets are one node from the start. A bucket is never paired out: each
node is held against the bucket's most typical member, then nodes that this left in other components against
the next typical ones. In buckets that still hold several components and have untried pairs, an exact prefix index finds all partners of
the nodes outside the largest component: shingles are ordered from rare to frequent, and two sets that are alike enough share one among
their first, at places that leave room for the overlap they need. Candidates pass a test of sizes and of
the signatures' agreement (it would lose a pair at the threshold once in 10**9), then an exact one on the full sets.

Null and empty texts have no shingles and are linked with nothing. Rows with the same key and different texts are
different nodes. A null key never is a component's id unless the component has no other. Input columns may have any name. A table
without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpie.llm.common import blocks, column_bytes, discard, durable, lean, mix, words
from kelpie.llm.components import components

ROWS, BANDS = 5, 32
WIDTH = ROWS * BANDS
#: Share of equal signature coordinates (8 bits each) from which a candidate is verified; 6 standard deviations under 0.8.
AGREE = 0.6
#: So many of a bucket's most typical members are tried before the prefix index takes over.
TYPICAL = 6
#: Nodes (of about 60 bytes) that may be broadcast.
SMALL = 200_000


def _pi(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place (the finaliser of a well-known 32-bit hash)."""
    t = np.empty_like(x)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
        np.right_shift(x, np.uint32(shift), out=t)
        np.bitwise_xor(x, t, out=x)
        if factor:
            np.multiply(x, np.uint32(factor), out=x)
    return x


def _sigma(x: np.ndarray) -> np.ndarray:
    x = x * np.uint32(0x9E3779B1)
    return x ^ (x >> np.uint32(15))


_SHIFTS = np.arange(WIDTH, dtype=np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least values of pi over all shifts: WIDTH numbers."""
    at = _sigma((shingles >> np.uint64(32)).astype(np.uint32))
    out = np.full(WIDTH, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(at), 512):
        np.minimum(out, _pi(at[i : i + 512, None] + _SHIFTS).min(0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for c in sig.reshape(BANDS, ROWS).astype(np.uint64).T:
        key = mix(key + c)
    return key


def shingle_sets(text: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; of the whole sequence if it has fewer words."""
    raw, at = column_bytes(text)
    for lo, hi in blocks(at):
        w, first = words(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        h = w
        for j in range(1, k):
            h = mix(h[: len(w) - j] * np.uint64(0xD1342543DE82EF95) + w[j:]) if len(w) > j else h[:0]
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(h[a : b - k + 1])
            elif b > a:
                x = w[a : a + 1]
                for j in range(a + 1, b):
                    x = mix(x * np.uint64(0xA24BAED4963EE407) + w[j : j + 1])
                yield mix(x + np.uint64(b - a))
            else:
                yield w[:0]


def set_hash(s: np.ndarray) -> bytes:
    """128 bits that equal sets share and others don't."""
    return np.array([mix(s).sum(), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum() + np.uint64(len(s))], np.uint64).tobytes()


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, th, text): rows with a hash of their text, by which rows with equal keys are told apart."""
    return docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("th"), F.col(f"`{text}`").alias("text"))


def features(rows: DataFrame, k: int) -> DataFrame:
    """Per row of keyed(): key, th, n_shingles, set_hash (null for the empty set), bands, sketch. Map only."""

    def run(batches):
        for b in batches:
            n, ids, bands, sketch = [], [], [], []
            for s in shingle_sets(b.column(2), k):
                n.append(len(s))
                sig = signature(s) if len(s) else None
                ids.append(set_hash(s) if len(s) else None)
                bands.append(band_keys(sig).tobytes() if len(s) else None)
                sketch.append(sig.astype(np.uint8).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), *[pa.array(x, pa.binary()) for x in (ids, bands, sketch)]], names=["key", "th", "n_shingles", "set_hash", "bands", "sketch"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"key {kind}, th long, n_shingles long, set_hash binary, bands binary, sketch binary")


def _buckets(nodes: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            keys = np.frombuffer(b"".join(x.as_py() for x in b.column(1)), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], names=["bk", "sid"])

    return nodes.select("sid", "bands").mapInArrow(lean(run), "bk long, sid long")


def _apart(members: DataFrame, larger_than: int | None) -> DataFrame:
    """Members (bk, sid, root) of buckets with several components, and whether each is outside the bucket's largest one."""
    sizes = members.groupBy("bk", "root").agg(F.count("sid").alias("size"))
    major = sizes.groupBy("bk").agg(F.max_by("root", F.struct("size", "root")).alias("major"), F.count("root").alias("roots"), F.sum("size").alias("all"))
    major = major.where("roots > 1") if larger_than is None else major.where((F.col("roots") > 1) & (F.col("all") > larger_than))
    return members.join(major.select("bk", "major"), "bk").select("bk", "sid", (F.col("root") != F.col("major")).alias("minor"), *(["root"] if larger_than is not None else []))


def _prefix_pairs(rest: DataFrame, test: _Verifier) -> DataFrame:
    """Candidate pairs (a, b) of a minor node and any other of rest(sid, root, minor): all that can reach the threshold.

    With shingles in order of their frequency here, the first one that two sets share stands so early in both that enough
    is left for the overlap they need. A row is therefore good for partners up to a certain size only; sizes go by
    classes, so a frequent shingle meets only partners for which it can be the first.
    """
    percent = test.percent

    def longs(batches):
        for b in batches:
            values = pa.py_buffer(b"".join(x.as_py() for x in b.column(1)))
            sizes = np.array([len(x.as_py()) // 8 for x in b.column(1)], np.int32)
            flat = pa.Array.from_buffers(pa.int64(), int(sizes.sum()), [None, values])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), flat)], names=["sid", "s"])

    ids = rest.select("sid")
    sets = durable(test.sets(ids).join(ids, "sid", "left_semi").dropDuplicates(["sid"]).mapInArrow(lean(longs), "sid long, s array<long>"))
    each = sets.select("sid", F.explode("s").alias("token"))
    often = each.groupBy("token").agg(F.count("sid").alias("df")).where("df > 1")
    shared = each.join(often, "token").groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ts"))
    sized = sets.select("sid", F.size("s").alias("n")).join(shared, "sid").join(rest, "sid")
    # tokens that only one set has come first in its order; place i leaves n - i
    first = F.col("n") - F.size("ts")
    reach = F.floor(F.col("n") * (100 - percent) / 100).cast("int") + 1 - first
    rows = sized.withColumn("first", first).where(reach > 0).select("sid", "n", "root", "minor", "first", F.posexplode(F.slice("ts", 1, reach)).alias("k", "t"))
    room = (F.col("n") - F.col("first") - F.col("k")) * (100 + percent) / percent - F.col("n")  # the largest partner
    rows = durable(rows.withColumn("most", F.floor(room + 1e-6).cast("int")).select("sid", "n", "root", "minor", "most", F.col("t.token").alias("token")))
    size_class = lambda x: F.floor(F.log(F.greatest(x, F.lit(1)).cast("double")) / 0.03 + 1e-9).cast("int")
    least = F.ceil(F.col("n") * percent / 100 - 1e-6).cast("int")
    probes = rows.where(F.col("minor") & (F.col("most") >= least)).withColumn("c", F.explode(F.sequence(size_class(least), size_class(F.least(F.col("most"), F.ceil(F.col("n") * 100 / percent).cast("int"))))))
    others = rows.withColumn("c", size_class(F.col("n")))
    both = probes.alias("p").join(others.alias("o"), ["token", "c"])
    fits = (F.col("o.n") <= F.col("p.most")) & (F.col("p.n") <= F.col("o.most")) & (F.col("p.root") != F.col("o.root"))
    return both.where(fits).select(F.least("p.sid", "o.sid").alias("a"), F.greatest("p.sid", "o.sid").alias("b")).distinct()


class _Verifier:
    """Tests candidate pairs (a, b) of nodes, first by size and sketch, then on the full sets."""

    def __init__(self, rows: DataFrame, nodes: DataFrame, k: int, percent: int):
        self.rows, self.nodes, self.k, self.percent = rows, nodes, k, percent
        self.written: list[DataFrame] = []
        self.known: DataFrame | None = None  # full sets so far, so that texts are gone through again only for new nodes

    def likely(self, pairs: DataFrame) -> DataFrame:
        n = self.nodes.select("sid", "n_shingles", "sketch")
        one = n.select(F.col("sid").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
        two = n.select(F.col("sid").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
        both = pairs.join(one, "a").join(two, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.percent)

        def run(batches):
            for b in batches:
                if b.num_rows:
                    x, y = (np.frombuffer(b"".join(v.as_py() for v in b.column(c)), np.uint8).reshape(-1, WIDTH) for c in (2, 3))
                    hit = pa.array((x == y).sum(1) >= AGREE * WIDTH)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(hit)

        return both.select("a", "b", "sa", "sb").mapInArrow(lean(run), "a long, b long")

    def sets(self, ids: DataFrame) -> DataFrame:
        """(sid, s): the full shingle sets, sorted 64-bit hashes, of the nodes ids(sid) and others. Equal rows of documents repeat them."""
        k = self.k
        new = ids if self.known is None else ids.join(self.known.select("sid"), "sid", "left_anti")
        need = durable(new.join(self.nodes.select("sid", "rep", "set_hash"), "sid"))
        n = need.count()
        if not n:
            discard(need)
            return self.known if self.known is not None else ids.select("sid", F.lit(b"").alias("s")).limit(0)

        def run(batches):
            for b in batches:
                out = [(i, s) for i, want, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), shingle_sets(b.column(2), k), strict=True) if len(s) and set_hash(s) == want]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1].tobytes() for x in out], pa.binary())], names=["sid", "s"])

        # up to SMALL nodes are sent to the texts; more of them are joined by a shuffle of both
        want = need.select("sid", "set_hash", F.col("rep.key").alias("k2"), F.col("rep.th").alias("h2"))
        same = F.col("key").eqNullSafe(F.col("k2")) & (F.col("th") == F.col("h2"))
        found = durable(self.rows.join(F.broadcast(want) if n <= SMALL else want, same).select("sid", "set_hash", "text").mapInArrow(lean(run), "sid long, s binary"))
        discard(need)
        self.written.append(found)
        self.known = found if self.known is None else self.known.unionByName(found)
        return self.known

    def links(self, pairs: DataFrame) -> DataFrame | None:
        likely = durable(self.likely(pairs))
        ids = likely.select(F.col("a").alias("sid")).union(likely.select("b")).distinct()
        if likely.isEmpty():
            discard(likely)
            return None
        percent, full = self.percent, self.sets(ids)
        both = likely.join(full.select(F.col("sid").alias("a"), F.col("s").alias("sa")), "a").join(full.select(F.col("sid").alias("b"), F.col("s").alias("sb")), "b")

        def exact(batches):
            for b in batches:
                hit = []
                for x, y in zip(b.column(2), b.column(3), strict=True):
                    x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    hit.append(100 * same >= percent * (len(x) + len(y) - same))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

        out = durable(both.select("a", "b", "sa", "sb").mapInArrow(lean(exact), "a long, b long").distinct())
        discard(likely)
        return out


def linked(docs: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """(key, th, n_shingles, component, least): per row of docs its hash, its component (null without shingles) and that one's smallest key."""
    rows = keyed(docs, key, text)
    feats = durable(features(rows, k))
    grouped = feats.where("set_hash is not null").groupBy("set_hash").agg(F.min(F.struct(F.col("key").isNull().alias("no"), "key", "th")).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = durable(grouped.withColumn("sid", F.monotonically_increasing_id()))  # written once, so the numbers stay
    buckets = _buckets(nodes)
    shared = buckets.groupBy("bk").agg(F.count("sid").alias("c")).where("c > 1")
    members = durable(buckets.join(shared, "bk"))
    weight = members.groupBy("sid").agg(F.sum("c").alias("weight"))  # the most typical members share their buckets with most
    members2 = durable(members.join(weight, "sid").select("bk", "sid", "weight"))
    discard(members)
    members = members2
    test = _Verifier(rows, nodes, k, percent)
    typical = Window.partitionBy("bk").orderBy(F.desc("weight"), F.desc("sid"))
    top = durable(members.withColumn("turn", F.row_number().over(typical)).where(F.col("turn") <= TYPICAL).select("bk", F.col("sid").alias("top"), "turn"))
    found, roots = None, None

    def step(pairs: DataFrame) -> None:
        nonlocal found, roots
        new = test.links(pairs)
        if new is not None:
            old = [x for x in (found, roots) if x is not None]
            if found is not None:
                old.append(new)
            found = new if found is None else durable(found.unionByName(new).distinct())
            roots = components(found)
            for x in old:
                discard(x)

    def rooted(df: DataFrame, name: str = "sid", out: str = "root") -> DataFrame:
        if roots is None:
            return df.withColumn(out, F.col(name))
        return df.join(roots.select(F.col("node").alias(name), F.col("root").alias(out)), name, "left").withColumn(out, F.coalesce(out, name))

    def pairs_of(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()

    # first everything against the most typical member of its bucket, then what is left apart against the next ones
    step(pairs_of(members.join(top.where("turn = 1"), "bk").where("sid <> top"), "sid", "top"))
    step(pairs_of(rooted(_apart(rooted(members), None)).join(rooted(top.where("turn > 1"), "top", "top_root"), "bk").where("minor and sid <> top and root <> top_root"), "sid", "top"))
    # in larger buckets with several components, pairs can still be untried
    rest = durable(_apart(rooted(members), TYPICAL).groupBy("sid", "root").agg(F.max("minor").alias("minor")))
    step(_prefix_pairs(rest, test))
    node_root = nodes.select("sid", "set_hash", F.col("rep.key").alias("key"))
    node_root = node_root.withColumn("root", F.col("sid")) if roots is None else node_root.join(roots.withColumnsRenamed({"node": "sid"}), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    node_root = durable(node_root)
    least = durable(node_root.groupBy("root").agg(F.min("key").alias("least")))  # written, so that the join can split a large component
    ids = node_root.join(least, "root").select("set_hash", F.col("root").alias("component"), "least")
    out = durable(feats.select("key", "th", "n_shingles", "set_hash").join(ids, "set_hash", "left").drop("set_hash"))
    for x in (feats, nodes, members, top, rest, node_root, least, found, roots, *test.written):
        discard(x)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: key, n_shingles, component_id (the smallest key linked with it, directly or not; its own without shingles).

    Links: Jaccard similarity of k-word shingle sets of at least `percent` / 100.
    """
    own = F.when(F.col("component").isNull(), F.col("key")).otherwise(F.col("least"))
    return linked(docs, key, text, k, percent).select(F.col("key").alias(key), "n_shingles", own.alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of near-duplicates, with docs' columns: that with the smallest key (a null key only if there is no other).

    Rows that repeat a key and a text are one document. Rows that repeat a key with unlike texts are documents of their own. Of rows
    of one component with the smallest key that with most shingles stays, then that with the least hash. Rows without shingles are linked with nothing and all stay.
    """
    out = linked(docs, key, text, k, percent)
    first = F.min(F.struct(F.col("key").isNull().alias("no"), "key", (-F.col("n_shingles")).alias("n"), "th"))
    chosen = durable(out.where("component is not null").groupBy("component").agg(first.alias("x")).select(F.col("x.key").alias("key"), F.col("x.th").alias("th")).distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").alias("key"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("th"))
    alone = F.col("key").eqNullSafe(F.col("k2")) & (F.col("th") == F.col("h2"))
    one = rows.join(chosen.select(F.col("key").alias("k2"), F.col("th").alias("h2")), alone, "left_semi")
    one = one.groupBy("key", "th").agg(F.first("row").alias("row"))  # rows that are equal in key and text
    bare = out.where("component is null").select(F.col("key").alias("k2"), F.col("th").alias("h2")).distinct()
    rest = rows.join(bare, alone, "left_semi")
    return one.select("row.*").unionByName(rest.select("row.*"))
