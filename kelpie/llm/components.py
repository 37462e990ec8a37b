"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm.common import discard, durable

#: Links for each task that writes a table of a round; small tables are cut into few files, so joins with them need no exchange.
TASK = 50_000


def components(links: DataFrame) -> DataFrame:
    """(node, root): each node of links(a, b) with the smallest node it reaches.

    Every round ties neighbours to the smallest node seen and is written to the shared folder; rounds grow with the
    logarithm of the longest path. Stars are pre-aggregated by minimum and written; joins then put one row a node against the
    links themselves, whose exchange the adaptive skew join can split for a node with very many links. Null ends and loops are ignored.
    The result is a table in the shared folder.
    """
    e = durable(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        now = tuple(e.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state:
            out = durable(e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct()), parts)
            discard(e)
            return out
        state, parts = now, max(8, now[0] // TASK)
        both = e.union(e.select("v", "u"))
        least = durable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), parts)
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        out = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small)
        new = durable(out.distinct(), parts)
        for x in (e, least):
            discard(x)
        e = new
