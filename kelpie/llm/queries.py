"""The queries opN_<name> on the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm import bpe, langid, minhash, packing, pii, rules, shards, simhash, suffix, warc
from kelpie.llm.common import durable, read, tidy


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 24, its slot, and the size and CRC of its text; law `rows`. No ties: rows are numbered within hash buckets."""
    return shards.shard_documents(read(spark, sf_dir, "documents"), shards=24)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_within: for ids divisible by 20, the texts whose fingerprints differ in simhash.RADIUS of 256 bits at most."""
    out = durable(simhash.edited(read(spark, sf_dir, "documents")))
    tidy(spark)  # the texts that were dealt by ranges
    asked = out.where("key % 20 = 0")
    near = simhash.search(out.select(*simhash.PARTS), asked)
    near = asked.select("key", *simhash.PARTS).distinct().join(near, list(simhash.PARTS)).groupBy("key").agg(F.max("n_within").alias("n_within"))
    e = tuple(p.replace("f", "e") for p in simhash.PARTS)
    cols = ["n_chars", "edited_sha256", simhash.as_hex().alias("fingerprint"), simhash.as_hex(e).alias("edited_fingerprint"), "near_edited", "near_next", "n_within"]
    return out.join(near, "key", "left").select(F.col("key").alias("doc_id"), *cols)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by the nearest centroid, learnt from documents whose remainder isn't 2; `und` where there is no letter."""
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()).select(F.col("doc_id").alias("key"), "text", "lang"))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, similarity of 0.8 or more: set sizes and components of every document; empty texts are alone."""
    out = minhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), k=2)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document; a null text is empty."""
    # the candidates are few, so they are written once and both the counts and the result come from them
    spans = durable(pii.candidates(read(spark, sf_dir, "documents").select("doc_id", "text")).select("row.doc_id", "spans"))
    out = spans.select("doc_id", pii.accepted(pii.learn(spans)).alias("a")).withColumn("b", F.filter("a", lambda x: x.base))
    counts = [F.size(F.filter("b", pii.of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in pii.BASE]
    return out.select("doc_id", *counts, F.sha2(pii.listed(F.col("b")), 256).alias("base_sha256"), pii.listed(F.col("a")).alias("spans"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit with the latest earlier response of its canonical address, or as an orphan."""
    out = warc.resolve(warc.captures(read(spark, sf_dir, "pages")))
    fields = F.array_sort(F.transform(F.map_entries("headers"), lambda x: F.concat_ws("=", x.key, x.value)))
    return out.select(F.col("id").alias("page_id"), "url", "time", "response_id", "response_time", "status", F.array_join(fields, ";").alias("headers"), "digest")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and their decoding, as digests, of every document; a null text has none."""
    return bpe.digest(read(spark, sf_dir, "documents"), bpe.vocabulary())


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document; `rule` is the number of the learned rule that rejects it, or 0."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = rules.judged(docs, rules.learn(docs, read(spark, sf_dir, "labels")))
    return out.select("row.doc_id", *[F.col("s")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept", "rule")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2,048 ids; a null text is its end id alone."""
    return packing.pack(read(spark, sf_dir, "documents"), bpe.vocabulary())


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each document's bytes lies in strings of 200 that also start elsewhere; null texts are empty."""
    return suffix.digest(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_shards, op2_simhash, op3_langid, op4_minhash, op5_pii, op6_warc, op7_bpe, op8_rules, op9_packing, op10_suffix)}

ORACLES = {
    "op6_warc": r"""
WITH cut AS (
  SELECT page_id, url AS raw, md5(coalesce(html, '')) AS tag,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
  FROM pages
), parts AS (
  SELECT page_id, raw, tag,
         regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^(?:www\.|m\.)', ''), ':(?:80|443)$', '') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)(?:=|$)'))) AS args
  FROM cut
), pages2 AS (
  SELECT page_id, raw, tag, host || path || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS url FROM parts
), asked AS (
  SELECT page_id, tag, url, 2 * page_id + 1 + 2 * (page_id * 7919 % 5000) AS time FROM pages2
), found AS (
  SELECT a.page_id, a.url, a.time, a.tag, r.page_id AS response_id, r.tag AS rtag,
         row_number() OVER (PARTITION BY a.page_id ORDER BY r.page_id DESC) AS k
  FROM asked a LEFT JOIN pages2 r ON r.url = a.url AND 2 * r.page_id < a.time
)
SELECT page_id, url, time, response_id, 2 * response_id AS response_time,
       CASE WHEN response_id IS NULL THEN 'orphan' WHEN tag = rtag THEN 'resolved' ELSE 'mismatch' END AS status,
       CASE WHEN tag = rtag THEN 'content-type=text/html;date=t' || time || ';etag=' || tag
            ELSE 'content-type=none;date=t' || time || ';etag=' || tag END AS headers,
       CASE WHEN tag = rtag THEN rtag END AS digest
FROM found WHERE k = 1
""",
}
