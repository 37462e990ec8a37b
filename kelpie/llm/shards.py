"""Sharding by balanced label propagation.

Documents that share a hub (a link is a hub of two; copies of a text share one) are linked. Labels start at random, evenly.
In each round every hub counts its members' labels, every document adds up its hubs' counts, and those that prefer
another shard ask to move there (every second round only to one with room). Moves between two shards are let through as far as others
come back or there is room under the quota, by a hash of the document. Documents without links fill what is left. The last step makes
counts equal: what a shard has over its share goes to shards with too few, documents without links first. Hub counts are partial aggregates; documents of hot hubs
are joined under salts, and there are at most HOT such hubs. Nothing but 24 x 24 sums reaches the driver.

Rounds end when linked pairs on one shard no longer grow in number. Law `rows`: shard sizes differ by one row at most. Null texts count as 8 bytes. Rows that repeat are placed each on
its own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpie.llm.common import discard, durable

HOT = 1000
SALTS = 64
#: Rows that one task numbers, on the average, in large tables.
BUCKET = 50_000
#: Nodes for each task that writes a table of a round; small tables are cut into few files, so joins with them need no exchange.
TASK = 20_000
_MOST = float(1 << 62)


def _share(*what) -> F.Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*what), 2).cast("double") / F.lit(_MOST)


def propagate(nodes: DataFrame, links: DataFrame, shards: int, most: float, gain: float = 0.001) -> DataFrame:
    """nodes(node, label) after moves that bring linked nodes together; links(node, hub). No shard takes in more than `most` nodes.

    Rounds go on until two of them, one of each kind, have raised the number of linked pairs on one shard by less than `gain` of
    all linked pairs. Hubs with one member link nothing and are left out.
    """
    hubs = links.groupBy("hub").agg(F.count("node").alias("size")).where("size > 1")
    total = nodes.count()
    least = max(1000, total // HOT)
    parts = max(8, total // TASK)
    hubs = durable(hubs, parts)
    hot = hubs.where(F.col("size") >= least)  # HOT rows at most, as sizes add up to the number of links
    tied = links.join(hubs.select("hub"), "hub").join(F.broadcast(hot.select("hub", F.lit(SALTS).alias("salts"))), "hub", "left")
    tied = durable(tied.select("node", "hub", F.coalesce(F.pmod(F.xxhash64("node", F.lit(3)), F.col("salts")), F.lit(0)).cast("int").alias("salt"), F.coalesce("salts", F.lit(1)).alias("salts")), parts)
    nodes = durable(nodes, parts)
    pairs = lambda n: F.coalesce(F.sum(F.col(n).cast("double") * (F.col(n) - 1) / 2), F.lit(0.0))
    every, most_together, stale, k = hubs.agg(pairs("size")).first()[0], -1.0, 0, 0
    discard(hubs)
    while True:
        counts = durable(tied.join(nodes, "node").groupBy("hub", "salts", "label").agg(F.count("node").alias("c")), parts)
        together = counts.agg(pairs("c")).first()[0]
        if together > most_together + gain * every or most_together < 0:
            most_together, stale = together, 0
        else:
            stale += 1
        if stale == 2 or together >= every:
            discard(counts)
            break
        # one row a hub and salt, with a count for each label that occurs: at most `shards` of them
        heard = counts.groupBy("hub", "salts").agg(F.collect_list(F.struct("label", "c")).alias("v")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        votes = tied.select("node", "hub", "salt").join(heard.select("hub", "salt", "v"), ["hub", "salt"])
        # a hub's tie goes to one label for all its members, or pairs would change places for ever
        votes = votes.select("node", F.explode(F.transform("v", lambda x: F.struct(x.label.alias("to"), (x.c + _share("hub", x.label)).alias("w")))).alias("x"))
        sizes = {r.label: r.n for r in nodes.groupBy("label").agg(F.count("node").alias("n")).collect()}
        if k % 2:
            closed = [s for s in range(shards) if sizes.get(s, 0) >= most * 0.99]
            votes = votes.join(nodes, "node").where(~F.col("x.to").isin(closed) | (F.col("x.to") == F.col("label"))).select("node", "x")
        best = votes.groupBy("node", "x.to").agg(F.sum("x.w").alias("w")).groupBy("node").agg(F.max_by("to", "w").alias("to"))
        moves = durable(best.join(nodes, "node").where("to <> label").select("node", "label", "to"), parts)
        asked = {(r.label, r.to): r.n for r in moves.groupBy("label", "to").agg(F.count("node").alias("n")).collect()}
        let = quotas(asked, sizes, shards, most)
        k += 1
        if not any(let.values()):
            discard(moves)
            discard(counts)
            continue
        table = nodes.sparkSession.createDataFrame([(a, b, float(p)) for (a, b), p in let.items()], "label int, to int, p double")
        gone = moves.join(F.broadcast(table), ["label", "to"]).where(_share("node", F.lit(99 + k)) < F.col("p")).select("node", F.col("to").alias("new"))
        now = durable(nodes.join(gone, "node", "left").select("node", F.coalesce("new", "label").alias("label")), parts)
        for x in (moves, counts, nodes):
            discard(x)
        nodes = now
    discard(tied)
    return nodes


def quotas(asked: dict, sizes: dict, shards: int, most: float) -> dict:
    """For each pair of shards the share of those who ask that may move: as many as come back, and into free room."""
    back = {(a, b): min(n, asked.get((b, a), 0)) for (a, b), n in asked.items()}
    out = {}
    for b in range(shards):
        more = {a: n - back[a, c] for (a, c), n in asked.items() if c == b}
        room = max(0.0, most - sizes.get(b, 0))
        whole = sum(more.values())
        for a, n in more.items():
            out[a, b] = min(1.0, (back[a, b] + (min(n, room * n / whole) if whole else 0)) / asked[a, b])
    return out


def even(nodes: DataFrame, shards: int, buckets: int) -> DataFrame:
    """nodes(node, label, linked) to (node, shard, slot): gapless slots, and counts that differ by one at most.

    Rows are numbered within small buckets, whose sums (shards x buckets x 2 rows) give each bucket its first number.
    """
    bucket = F.pmod(F.xxhash64("node", F.lit(9)), F.lit(buckets)) + F.when(F.col("linked"), 0).otherwise(buckets)
    rows = nodes.withColumn("bucket", bucket.cast("int"))
    sums = rows.groupBy("label", "bucket").agg(F.count("node").alias("n"))
    first = sums.withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy("label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sizes = {r.label: r.n for r in sums.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    total = sum(sizes.values())
    due = {s: total // shards + (s < total % shards) for s in range(shards)}
    # shards that are over give the end of their numbers to a pool, which fills the others in order
    pool, over, want = 0, {}, []
    for s in range(shards):
        over[s] = pool - min(sizes.get(s, 0), due[s])
        pool += max(0, sizes.get(s, 0) - due[s])
    given = 0
    for s in range(shards):
        need = due[s] - min(sizes.get(s, 0), due[s])
        if need:
            want.append((given, given + need, s, sizes.get(s, 0)))
            given += need
    nth = F.row_number().over(Window.partitionBy("label", "bucket").orderBy("node")) - 1
    out = rows.withColumn("k", nth).join(first.select("label", "bucket", "first"), ["label", "bucket"]).withColumn("slot", F.col("k") + F.col("first"))
    limit, lift = (F.create_map(*[F.lit(y) for s in range(shards) for y in (s, int(d[s]))])[F.col("label")] for d in (due, over))
    out = out.withColumn("p", F.when(F.col("slot") >= limit, F.col("slot") + lift))
    shard, slot = F.col("label"), F.col("slot")
    for a, b, s, size in want:
        inside = (F.col("p") >= a) & (F.col("p") < b)
        shard, slot = F.when(inside, s).otherwise(shard), F.when(inside, F.col("p") - a + size).otherwise(slot)
    return out.select("node", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24, links: DataFrame | None = None) -> DataFrame:
    """Per row: key, size, text_crc32, law, shard, slot, grown_shard.

    links(key, hub) replaces the links between equal texts; a hub joins all documents that name it.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(t) + F.lit(8)).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.xxhash64(t, F.octet_length(t)).alias("hub"))
    rows = durable(rows.withColumn("node", F.monotonically_increasing_id()))  # written once, so the numbers stay
    tied = rows.select("node", "hub") if links is None else rows.join(links.select(F.col(key).alias("key"), F.col("hub").alias("h2")), "key").select("node", F.col("h2").alias("hub"))
    start = rows.select("node", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("label"))
    several = durable(tied.groupBy("hub").agg(F.count("node").alias("c")).where("c > 1"))  # written, so that the join can split hot hubs
    linked = durable(tied.join(several, "hub").select("node").distinct())
    total = rows.count()
    moved = propagate(start.join(linked, "node"), tied, shards, total / shards)
    alone = start.join(linked, "node", "left_anti")
    nodes = durable(moved.select("node", "label", F.lit(True).alias("linked")).unionByName(alone.withColumn("linked", F.lit(False))))
    placed = even(nodes, shards, max(64, total // (shards * BUCKET)))
    out = rows.join(placed, "node")
    return out.select(F.col("key").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
