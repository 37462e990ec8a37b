"""From ranked lists to the final chunks of each query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.config import DEFAULT, Settings
from kelpie.functions.text import source_hints, strip
from kelpie.functions.udf import pair_scorer


def needs_expansion(query: Column) -> Column:
    """Whether a query has ten words or more."""
    return F.size(F.split(strip(query), r"\s+")) >= 10


def sub_queries(query: Column, answer: Column) -> Column:
    """array<string>: the query, then up to three lines of more than ten characters of the model's answer (null: none)."""
    lines = F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), "\n"), strip), lambda x: F.length(x) > 10)
    return F.concat(F.array(query), F.slice(lines, 1, 3))


def expand(queries: DataFrame, model: Callable[[str], str] | None = None) -> DataFrame:
    """(query_id, sub, query): sub 0 is the query itself; long ones get sub-questions from the model, if there is one."""
    if model is None:
        return queries.select("query_id", F.lit(0).alias("sub"), "query")
    from kelpie.functions.udf import chat

    prompt = F.concat(F.lit("Split the question below into two or three short questions, one a line, that together cover its answer. Give the lines alone.\n\nQuestion: "), "query")
    asked = chat(lambda ms: model(ms[0]["content"]))(F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))))
    subs = F.when(needs_expansion(F.col("query")), sub_queries(F.col("query"), asked)).otherwise(F.array("query"))
    return queries.select("query_id", F.posexplode(subs).alias("sub", "query"))


def best_of(hits: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score, seen): best score over sub-queries; seen orders by the place where it was first found."""
    place = F.struct("sub", "rank")
    return hits.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.min(place).alias("seen"))


def ranked(hits: DataFrame, *ties: Column) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), *ties)
    return hits.withColumn("rank", F.row_number().over(w))


def graph_hits(candidates: DataFrame, triples: DataFrame, chunks: DataFrame) -> DataFrame:
    """candidates(query_id, chunk_id, ...) with hits: how many distinct ends of the query's triples the chunk's text contains, lower case.

    Candidates are hashed and the texts stream past them, so no text is sorted (and spilled).
    """
    ends = triples.select("query_id", F.lower("source").alias("e")).unionByName(triples.select("query_id", F.lower("target").alias("e")))
    names = ends.groupBy("query_id").agg(F.collect_set("e").alias("names"))  # ten triples a query at most
    text = chunks.select("chunk_id", F.lower("text").alias("_low"))
    out = candidates.hint("shuffle_hash").join(text, "chunk_id", "left").join(names, "query_id", "left")
    return out.withColumn("hits", F.coalesce(F.size(F.filter("names", lambda x: F.col("_low").contains(x))), F.lit(0))).withColumn("hits", F.greatest("hits", F.lit(0))).drop("_low", "names")


def fuse(vector: DataFrame, lexical: DataFrame, s: Settings = DEFAULT, triples: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """Reciprocal rank fusion: (query_id, chunk_id, score, first, vec_rank, bm25_rank, graph_rank).

    vector and lexical are best_of() results. Every candidate is in the graph list too, in order of hits, then of the vector list, then of the
    lexical one as found; its weight is half. Ties of the fused score keep that first order.
    """
    v = ranked(vector, F.col("seen"), F.col("chunk_id")).select("query_id", "chunk_id", F.col("rank").alias("vec_rank"))
    b = ranked(lexical, F.col("seen"), F.col("chunk_id")).select("query_id", "chunk_id", F.col("rank").alias("bm25_rank"), F.col("seen").alias("bm25_seen"))
    both = v.join(b, ["query_id", "chunk_id"], "full")
    both = both.withColumn("first", F.struct(F.col("vec_rank").isNull().alias("late"), F.col("vec_rank").alias("v"), F.col("bm25_seen").alias("b"), F.col("chunk_id").alias("c")))
    both = graph_hits(both, triples, chunks) if triples is not None else both.withColumn("hits", F.lit(0))
    w = Window.partitionBy("query_id").orderBy(F.desc("hits"), "first")
    both = both.withColumn("graph_rank", F.row_number().over(w))
    part = lambda rank, weight: F.coalesce(F.lit(weight) / (s.rrf_k + F.col(rank)), F.lit(0.0))
    return both.withColumn("score", part("vec_rank", 1.0) + part("bm25_rank", 1.0) + part("graph_rank", s.graph_weight)).drop("bm25_seen")


def cut(fused: DataFrame, k: int) -> DataFrame:
    return ranked(fused, F.col("first")).where(F.col("rank") <= k)


def diversify(cands: DataFrame, queries: DataFrame, k: int, hints: Column | None = None) -> DataFrame:
    """cands(query_id, chunk_id, source_file, score, rank): the first chunk of each hinted source moves to the front, others keep their order."""
    q = queries.select("query_id", (source_hints(F.col("query")) if hints is None else hints).alias("hints"))
    out = cands.join(q, "query_id")
    hinted = F.exists("hints", lambda h: F.coalesce(F.col("source_file").contains(h), F.lit(False)))
    w = Window.partitionBy("query_id", "source_file").orderBy("rank")
    out = out.withColumn("_lift", hinted & (F.row_number().over(w) == 1))
    order = Window.partitionBy("query_id").orderBy(F.desc("_lift"), "rank")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_lift")


def swap_parents(cands: DataFrame, chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score, rank): children give way to their parents, each once at its first place; a child whose parent isn't stored stays."""
    ids = parents.select(F.col("chunk_id").alias("_p")).distinct()
    own = chunks.select("chunk_id", "parent_id")
    out = cands.join(own, "chunk_id", "left").join(ids, F.col("parent_id") == F.col("_p"), "left").withColumn("_id", F.coalesce("_p", "chunk_id"))
    first = out.groupBy("query_id", F.col("_id").alias("chunk_id")).agg(F.min_by("score", "rank").alias("score"), F.min("rank").alias("rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def rerank_scores(scored: DataFrame) -> DataFrame:
    """scored(query_id, raw, hinted, ...) with score: hinted chunks are lifted to 0.3 of the range, then all is stretched to 0..1."""
    w = Window.partitionBy("query_id")
    low, high = F.min("raw").over(w), F.max("raw").over(w)
    out = scored.withColumn("_low", low).withColumn("_range", high - low)
    out = out.withColumn("_s", F.when(F.col("hinted"), F.greatest(F.col("raw"), F.col("_low") + 0.3 * F.col("_range"))).otherwise(F.col("raw")))
    low2, high2 = F.min("_s").over(w), F.max("_s").over(w)
    span = F.when(high2 - low2 == 0, 1.0).otherwise(high2 - low2)
    return out.withColumn("score", (F.col("_s") - low2) / span).drop("_low", "_range", "_s")


def rerank(cands: DataFrame, queries: DataFrame, texts: DataFrame, k: int, scorer: Callable | None = None, hints: Column | None = None, s: Settings = DEFAULT) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best by the scorer over (query, text's beginning); queries with one candidate keep it as it is."""
    q = queries.select("query_id", "query", (source_hints(F.col("query")) if hints is None else hints).alias("hints"))
    t = texts.select("chunk_id", "source_file", F.substring("text", 1, s.rerank_cap).alias("_t"))
    out = cands.join(q, "query_id").join(t, "chunk_id").withColumn("raw", pair_scorer(scorer)(F.col("query"), F.col("_t")))
    out = out.withColumn("hinted", F.exists("hints", lambda h: F.coalesce(F.col("source_file").contains(h), F.lit(False))))
    one = F.count("*").over(Window.partitionBy("query_id")) == 1
    out = rerank_scores(out.withColumnRenamed("score", "_old").withColumn("_one", one)).withColumn("score", F.when(F.col("_one"), F.col("_old")).otherwise(F.col("score")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")


def top(cands: DataFrame, k: int) -> DataFrame:
    return cands.where(F.col("rank") <= k)
