import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from kelpie.llm import shards
from kelpie.llm.common import durable

from .helpers import frame


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = shards.shard_documents(df, **kw).collect()
    assert len(out) == len(rows)
    sizes = Counter(r.shard for r in out)
    n = kw.get("shards", 24)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(n)) <= 1 and set(sizes) <= set(range(n))
    for s in range(n):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes.get(s, 0)))
    texts = dict(rows)
    for r in out:
        t = (texts[r.doc_id] or "").encode()
        assert r.size == len(t) + 8 and r.text_crc32 == zlib.crc32(t) and r.law == "rows" and r.grown_shard is None
    return out


def test_copies_meet_and_counts_are_even(spark):
    rows = [(k, f"text {k // 4}" if k < 1600 else f"alone {k}") for k in range(3000)]
    out = check(spark, rows)
    where = defaultdict(set)
    for r in out:
        if r.doc_id < 1600:
            where[r.doc_id // 4].add(r.shard)
    assert sum(len(v) == 1 for v in where.values()) > 0.85 * len(where)


def test_a_hot_group_is_split_no_more_than_it_must(spark):
    rows = [(k, "same" if k < 1200 else f"alone {k}") for k in range(3600)]
    out = check(spark, rows)
    hot = Counter(r.shard for r in out if r.doc_id < 1200)
    assert sum(sorted(hot.values())[-12:]) >= 0.65 * 1200


def test_links_of_ones_own(spark):
    rows = [(k, f"t{k}") for k in range(400)]
    links = spark.createDataFrame([(k, k // 10) for k in range(400)], "doc_id long, hub long")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = shards.shard_documents(df, shards=4, links=links).collect()
    own = defaultdict(Counter)
    for r in out:
        own[r.doc_id // 10][r.shard] += 1
    assert sum(max(c.values()) for c in own.values()) > 0.8 * 400


def test_odd_rows(spark):
    df = frame(spark)
    out = shards.shard_documents(df)
    assert out.count() == df.count()
    assert out.where("doc_id = 0").select("size", "text_crc32").distinct().collect() == [(8, 0)]
    assert shards.shard_documents(df.limit(0)).count() == 0
    assert shards.shard_documents(df.withColumn("doc_id", F.lit(None).cast("long"))).count() == df.count()


def test_small_tables_of_rounds_lie_in_few_files(spark, monkeypatch):
    """With many shuffle partitions a round of few nodes must not write (and read again) a file for each partition."""
    files = []

    def counted(df, *more):
        files.append(len((out := durable(df, *more)).inputFiles()))
        return out

    monkeypatch.setattr(shards, "durable", counted)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        nodes = spark.range(600).select(F.col("id").alias("node"), F.pmod(F.xxhash64("id"), F.lit(4)).cast("int").alias("label"))
        out = shards.propagate(nodes.repartition(40, "node"), nodes.select("node", F.floor(F.col("node") / 10).alias("hub")), 4, 150)
        assert out.count() == 600 and len(files) > 4 and max(files) <= 8
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
