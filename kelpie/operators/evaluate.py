"""Retrieval quality against benchmark questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate(truth: DataFrame, ranked: DataFrame, triples: DataFrame | None = None) -> DataFrame:
    """Per question: source_recall, entity_recall, graph_fired, triple_count, chunk_count, top_score. Recalls aren't rounded.

    truth(query_id, level, expected_source, expected_entities), ranked(query_id, rank, score, source_file, text), triples(query_id, source, target).
    An expected source counts if a retrieved one contains it; an entity if, case aside, a text or an end of a triple contains it.
    """
    got = ranked.groupBy("query_id").agg(F.collect_set("source_file").alias("files"), F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x.text), " ")).alias("texts"), F.count("*").alias("chunk_count"), F.min_by("score", "rank").alias("top_score"))
    out = truth.select("query_id", "level", "expected_source", "expected_entities").join(got, "query_id", "left")
    if triples is not None:
        facts = triples.groupBy("query_id").agg(F.lower(F.array_join(F.collect_list(F.concat_ws(" ", "source", "target")), " ")).alias("facts"), F.count("*").alias("triple_count"))
        out = out.join(facts, "query_id", "left")
    else:
        out = out.withColumn("facts", F.lit("")).withColumn("triple_count", F.lit(0).cast("long"))
    text = F.concat_ws(" ", F.coalesce("texts", F.lit("")), F.coalesce("facts", F.lit("")))
    share = lambda xs, test: F.coalesce(F.size(F.filter(xs, test)), F.lit(0)) / F.greatest(F.size(xs), F.lit(1))
    return out.select(
        "query_id", "level", share(F.col("expected_source"), lambda s: F.exists("files", lambda f: f.contains(s))).alias("source_recall"), share(F.col("expected_entities"), lambda e: text.contains(F.lower(e))).alias("entity_recall"),
        (F.coalesce("triple_count", F.lit(0)) > 0).alias("graph_fired"), F.coalesce("triple_count", F.lit(0)).alias("triple_count"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce("top_score", F.lit(0.0)).alias("top_score"),
    )


def summarize(scores: DataFrame) -> DataFrame:
    """Means by level and over all (level null)."""
    return scores.rollup("level").agg(F.count("*").alias("queries"), F.avg("source_recall").alias("source_recall"), F.avg("entity_recall").alias("entity_recall"), F.avg(F.col("graph_fired").cast("double")).alias("graph_fired"), F.avg("top_score").alias("top_score"))


def progress(total: DataFrame, processed: DataFrame, per_day: int = 672) -> DataFrame:
    """processed, remaining, percent and days left at a daily rate."""
    n = total.agg(F.count("*").alias("total")).crossJoin(processed.agg(F.countDistinct("chunk_id").alias("processed")))
    left = F.col("total") - F.col("processed")
    return n.select("processed", left.alias("remaining"), (100.0 * F.col("processed") / F.greatest("total", F.lit(1))).alias("percent"), (left / per_day).alias("days"))


def last_runs(runs: DataFrame, k: int = 5) -> DataFrame:
    return runs.orderBy(F.desc("date")).limit(k)


def token_usage(calls: DataFrame, price_in: float = 0.15, price_out: float = 0.60) -> DataFrame:
    """Sums of calls(tokens_in, tokens_out) and their cost; prices are for a million."""
    from kelpie.functions.text import token_cost

    out = calls.agg(F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"))
    return out.withColumn("cost", token_cost(F.col("tokens_in"), F.col("tokens_out"), price_in, price_out))


def report(scores: DataFrame) -> DataFrame:
    """One printable line a question, in order of level and id."""
    line = F.format_string("[%s] sources %.0f%%  entities %.0f%%  graph %s  %d chunks, %d triples, top %.4f", F.col("query_id").cast("string"), 100 * F.col("source_recall"), 100 * F.col("entity_recall"), F.when(F.col("graph_fired"), "yes").otherwise("no"), F.col("chunk_count"), F.col("triple_count"), F.col("top_score").cast("double"))
    return scores.orderBy("level", "query_id").select("level", "query_id", line.alias("line"))
