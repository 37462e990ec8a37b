"""python -m kelpie ingest|index|graph-stats|resolve|query ...: a thin command line over kelpie.plans."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from kelpie.config import Settings
from kelpie.operators import graph, resolve
from kelpie.plans import retrieval
from kelpie.sources import files


def main() -> None:
    p = argparse.ArgumentParser(prog="kelpie")
    sub = p.add_subparsers(dest="do", required=True)
    for name in ("ingest", "index", "stats", "resolve", "query"):
        q = sub.add_parser(name)
        q.add_argument("store")
        if name == "ingest":
            q.add_argument("folder")
        if name == "query":
            q.add_argument("text")
        if name == "resolve":
            q.add_argument("--run", action="store_true", help="write the merged graph; otherwise only report")
            q.add_argument("--threshold", type=float, default=0.88)
    a = p.parse_args()
    spark = SparkSession.builder.appName("kelpie").getOrCreate()
    if a.do == "ingest":
        retrieval.ingest(spark, a.folder, a.store)
    elif a.do == "index":
        retrieval.build_index(spark, a.store)
    elif a.do == "query":
        engine = retrieval.load(spark, a.store)
        asked = spark.createDataFrame([("q", a.text)], "query_id string, query string")
        found, triples = retrieval.hybrid_search(engine, asked)
        texts = engine.parents.unionByName(engine.chunks).select("chunk_id", "source_file", "page_number", "text")
        found.join(texts, "chunk_id").orderBy("rank").show(truncate=100)
        if triples is not None:
            triples.orderBy("rank").show(truncate=False)
    else:
        nodes, edges = spark.read.parquet(f"{a.store}/nodes"), spark.read.parquet(f"{a.store}/edges")
        if a.do == "stats":
            graph.graph_summary(nodes, edges).show()
            return
        groups = resolve.find_duplicates(nodes, Settings(similarity=a.threshold))
        resolve.duplicate_stats(groups).show()
        groups.orderBy("bucket", "group_no", "place").show(50, truncate=False)
        if a.run:
            new_nodes, new_edges = resolve.apply_merges(nodes, edges, resolve.mapping(groups))
            files.save(new_nodes, f"{a.store}/nodes_merged")
            files.save(new_edges, f"{a.store}/edges_merged")


if __name__ == "__main__":
    main()
