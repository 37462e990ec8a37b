"""Whole plans: ingest, graph build and hybrid retrieval over a batch of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.config import DEFAULT, Settings
from kelpie.operators import dense, fusion, graph, lexical, sections
from kelpie.sources import files


@dataclass(frozen=True)
class Engine:
    """What queries run on. Optional parts are left out where there are none: retrieval then goes without them."""

    chunks: DataFrame
    vectors: DataFrame
    index: lexical.LexicalIndex | None = None
    parents: DataFrame | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    encode: Callable | None = None
    scorer: Callable | None = None
    model: str = ""
    settings: Settings = DEFAULT


def ingest(spark: SparkSession, folder: str, store: str, encode: Callable | None = None, s: Settings = DEFAULT, parsers: dict | None = None) -> Engine:
    """Files to stored chunks, vectors and lexical index, and an engine on them."""
    elements = files.read_elements(spark, folder, parsers)
    parents = sections.build_parents(elements, s)
    files.save(parents, f"{store}/parents_raw")
    parents = spark.read.parquet(f"{store}/parents_raw")
    children = sections.build_children(parents, s)
    files.save_chunks(sections.with_child_ids(parents, children).unionByName(children), f"{store}/chunks")
    return build_index(spark, store, encode, s)


def build_index(spark: SparkSession, store: str, encode: Callable | None = None, s: Settings = DEFAULT) -> Engine:
    children = files.load_chunks(spark, f"{store}/chunks", "child")
    files.save(dense.embed(children, encode), f"{store}/vectors")
    lexical.store_bm25(children, f"{store}/lexical", s)
    return load(spark, store, encode, s)


def load(spark: SparkSession, store: str, encode: Callable | None = None, s: Settings = DEFAULT) -> Engine:
    from pyspark.errors import AnalysisException

    def graph_table(name: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{store}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    return Engine(files.load_chunks(spark, f"{store}/chunks", "child"), spark.read.parquet(f"{store}/vectors"), lexical.LexicalIndex.load(spark, f"{store}/lexical"), files.load_chunks(spark, f"{store}/chunks", "parent"), graph_table("nodes"), graph_table("edges"), encode, None, "", s)


def build_graph(spark: SparkSession, chunks: DataFrame, store: str, model: Callable[[list[dict]], str], sample: int = 0) -> tuple[DataFrame, DataFrame]:
    """Extracts from parents (or all chunks where there are none), validates, upserts and stores nodes and edges. sample: first chunks only, 0 for all."""
    from kelpie.operators.answer import extract

    todo = sections.kg_chunks(chunks)
    todo = sections.ordered(todo) if "chunk_ord" not in todo.columns else todo
    todo = todo.orderBy("chunk_ord", "chunk_id").limit(sample) if sample else todo
    files.save(extract(todo, model), f"{store}/raw")
    entities, relations, _ = graph.validate_extractions(spark.read.parquet(f"{store}/raw"))
    nodes, edges = graph.upsert_graph(entities, relations)
    files.save(nodes, f"{store}/nodes")
    files.save(edges, f"{store}/edges")
    return spark.read.parquet(f"{store}/nodes"), spark.read.parquet(f"{store}/edges")


def hybrid_search(e: Engine, queries: DataFrame, expander: Callable[[str], str] | None = None, subs: DataFrame | None = None, k: int | None = None, hints=None) -> tuple[DataFrame, DataFrame | None]:
    """(chunks, triples) of queries(query_id, query[, embedding]).

    chunks(query_id, chunk_id, score, rank): vector and lexical lists over all sub-queries, graph list, fusion, source diversity, parents, reranking if
    there is a scorer. The three lists are independent branches of one plan that meet by query.
    """
    s = e.settings
    subs = fusion.expand(queries, expander) if subs is None else subs
    sid = F.concat_ws("#", F.col("query_id").cast("string"), F.col("sub").cast("string"))
    keyed = subs.withColumn("sid", sid)
    own = keyed.join(queries.select("query_id", "embedding"), "query_id") if "embedding" in queries.columns else dense.embed_queries(keyed, e.encode, e.model, s)

    def back(hits: DataFrame) -> DataFrame:
        return fusion.best_of(hits.withColumnRenamed("query_id", "sid").join(keyed.select("sid", "query_id", "sub"), "sid"))

    ask = own.select(F.col("sid").alias("query_id"), "query", "embedding")
    vector = back(dense.vector_search(e.vectors, ask, s.vector_k))
    words = back(lexical.bm25_search(e.index, ask.select("query_id", "query"), s.lexical_k, s)) if e.index is not None else vector.limit(0)
    triples = graph.triple_search(e.nodes, e.edges, queries, s.graph_k, s) if e.nodes is not None else None
    fused = fusion.cut(fusion.fuse(vector, words, s, triples, e.chunks), s.lexical_k)
    cands = fused.join(e.chunks.select("chunk_id", "source_file"), "chunk_id").select("query_id", "chunk_id", "source_file", "score", "rank")
    cands = fusion.diversify(cands, queries, s.lexical_k, hints).select("query_id", "chunk_id", "score", "rank")
    if e.parents is not None:
        cands = fusion.swap_parents(cands, e.chunks, e.parents)
    if e.scorer is not None:
        texts = e.chunks if e.parents is None else e.chunks.select("chunk_id", "source_file", "text").unionByName(e.parents.select("chunk_id", "source_file", "text"))
        return fusion.rerank(cands, queries, texts, k or s.vector_k, e.scorer, hints, s), triples
    return fusion.top(cands, k or s.vector_k), triples
