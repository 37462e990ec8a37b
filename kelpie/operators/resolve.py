"""Entity resolution: near-equal names become one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.config import DEFAULT, Settings
from kelpie.functions.text import is_protected, strip
from kelpie.functions.udf import similar


def find_duplicates(nodes: DataFrame, s: Settings = DEFAULT, respect_protected: bool = False) -> DataFrame:
    """(bucket, group_no, name, place, canonical): groups of names, greedily formed around the first name not yet taken.

    Names longer than two characters meet by their first letters, lower case, in order; a name under two labels is there twice.
    A group's canonical name is its longest with a space, else its longest, the first of equals. Groups form within a bucket, so a
    bucket is one task; respect_protected leaves hardware identifiers out.
    """
    names = nodes.where(F.col("name").isNotNull() & (F.length(strip(F.col("name"))) > 2))
    if respect_protected:
        names = names.where(~is_protected(F.col("name")))
    names = names.select(F.substring(F.lower("name"), 1, s.name_prefix).alias("bucket"), "name")
    # buckets of one name can't form groups
    several = names.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
    limit = s.similarity

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        found = sorted(pdf["name"])
        taken: set[str] = set()
        rows = []
        no = 0
        for i, a in enumerate(found):
            if a in taken:
                continue
            group = [a, *[b for j, b in enumerate(found) if j != i and b not in taken and similar(a, b, limit)]]
            if len(group) > 1:
                spaced = [x for x in group if " " in x] or group
                best = max(spaced, key=len)
                rows += [(pdf["bucket"].iloc[0], no, x, k, best) for k, x in enumerate(group)]
                taken.update(group)
                no += 1
        return pd.DataFrame(rows, columns=["bucket", "group_no", "name", "place", "canonical"])

    return names.join(several, "bucket").groupBy("bucket").applyInPandas(greedy, "bucket string, group_no int, name string, place int, canonical string")


def mapping(groups: DataFrame) -> DataFrame:
    """(name, canonical) of the names that go."""
    return groups.where("name <> canonical").select("name", "canonical").distinct()


def duplicate_stats(groups: DataFrame) -> DataFrame:
    """groups, mergeable (sizes less one) and effective_merges (names that really go: equal names under two labels don't)."""
    per = groups.groupBy("bucket", "group_no").agg(F.count("*").alias("n"), F.count_if(F.col("name") != F.col("canonical")).alias("m"))
    return per.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("mergeable"), F.coalesce(F.sum("m"), F.lit(0)).alias("effective_merges"))


def apply_merges(nodes: DataFrame, edges: DataFrame, merges: DataFrame, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after merges(name, canonical): ends move to every node of the canonical name, self edges go, equal edges become one.

    Moved edges lose their chunk, others keep it. Each name goes to its canonical one directly.
    """
    if dry_run:
        return nodes, edges
    n = nodes.select("node_id", "name")
    to = n.join(merges, "name").select(F.col("node_id").alias("old"), "canonical").join(n.select(F.col("node_id").alias("new"), F.col("name").alias("canonical")), "canonical").select("old", "new")
    gone = n.join(merges, "name", "left_semi").select(F.col("node_id").alias("old"))
    out = edges
    for end in ("src_id", "dst_id"):
        moved = out.join(to.withColumnRenamed("old", end), end, "left").withColumn("chunk_id", F.when(F.col("new").isNull(), F.col("chunk_id"))).withColumn(end, F.coalesce("new", end)).drop("new")
        out = moved.select(*edges.columns)
    names = n.select(F.col("node_id").alias("src_id"), F.col("name").alias("_a")), n.select(F.col("node_id").alias("dst_id"), F.col("name").alias("_b"))
    touched = edges.select("src_id", "rel_type", "dst_id", F.lit(True).alias("_same"))
    out = out.join(names[0], "src_id").join(names[1], "dst_id").join(touched, ["src_id", "rel_type", "dst_id"], "left")
    out = out.where(F.col("_same").isNotNull() | (F.col("_a") != F.col("_b"))).groupBy("src_id", "rel_type", "dst_id").agg(F.max("chunk_id").alias("chunk_id"))
    out = out.join(gone.withColumnRenamed("old", "src_id"), "src_id", "left_anti").join(gone.withColumnRenamed("old", "dst_id"), "dst_id", "left_anti")
    return nodes.join(merges, "name", "left_anti").select(*nodes.columns), out.select(*edges.columns)
