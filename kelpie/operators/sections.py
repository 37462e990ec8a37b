"""Elements to sections, parents and children."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpie.config import DEFAULT, Settings
from kelpie.functions.text import is_blank, strip
from kelpie.functions.udf import splitter
from kelpie.operators.durable import cut


def sections(elements: DataFrame) -> DataFrame:
    """One row a section: source_file, section, heading_path, page, types, bbox, table_data, text.

    A section holds what stands between two headings; one without text runs on into the next. Its page is that of the heading that
    ends it, or of the file's last element; its path is that of the headings before it. A heading of size 14 or more starts a new
    path, of 12 or more (or of size 0) keeps one level above it, others two. In closed form: the top level is the last heading of
    size 14 up to there (or the first of all), the second the last one since then, the third the last smaller one since that.
    """
    file = Window.partitionBy("path").orderBy("elem_seq")
    e = elements.withColumn("is_h", (F.col("element_type") == "heading").cast("int"))
    size = F.coalesce("font_size", F.lit(0.0))
    rank = F.when(F.col("is_h") == 0, None).when(size >= 14, 1).when((size >= 12) | (size <= 0), 2).otherwise(3)
    e = e.withColumn("h", F.sum("is_h").over(file)).withColumn("rank", rank)
    # a first heading of any size is a root
    e = e.withColumn("rank", F.when((F.col("is_h") == 1) & (F.col("h") == 1), 1).otherwise(F.col("rank")))
    e = e.withColumn("head", F.when(F.col("is_h") == 1, F.struct("elem_seq", strip(F.col("text")).alias("t"), "rank")))
    e = e.withColumn("one", F.last(F.when(F.col("rank") == 1, F.col("head")), ignorenulls=True).over(file)).withColumn("root", F.col("one.elem_seq"))
    e = e.withColumn("two_", F.last(F.when(F.col("rank") == 2, F.col("head")), ignorenulls=True).over(file))
    own = Window.partitionBy("path", "root").orderBy("elem_seq")
    # below a root, a heading of the third rank without a second one takes its place; the next replaces nothing but the third
    e = e.withColumn("first_below", F.first(F.when(F.col("rank") > 1, F.col("head")), ignorenulls=True).over(own))
    e = e.withColumn("two", F.when(F.col("two_.elem_seq") > F.col("root"), F.col("two_")).otherwise(F.col("first_below")))
    e = e.withColumn("three_", F.last(F.when(F.col("rank") == 3, F.col("head")), ignorenulls=True).over(own))
    e = e.withColumn("three", F.when(F.col("three_.elem_seq") > F.col("two.elem_seq"), F.col("three_")))
    e = e.withColumn("heading_path", F.filter(F.array("one.t", "two.t", "three.t"), lambda x: x.isNotNull()))
    last_page = F.last("page").over(file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    following = F.first(F.when(F.col("is_h") == 1, F.col("page")), ignorenulls=True).over(file.rowsBetween(1, Window.unboundedFollowing))
    e = e.withColumn("end_page", F.coalesce(following, last_page))
    body = e.where("is_h = 0")
    told = body.groupBy("path", "source_file", "h").agg(F.bool_or(~is_blank(F.col("text"))).alias("has"))
    # a section without text runs on into the next one that has some
    ahead = Window.partitionBy("path").orderBy("h").rowsBetween(0, Window.unboundedFollowing)
    told = told.withColumn("section", F.first(F.when(F.col("has"), F.col("h")), ignorenulls=True).over(ahead)).where("section is not null")
    body = body.join(told.select("path", "h", "section"), ["path", "h"])
    at_own = F.col("h") == F.col("section")
    in_order = F.array_sort(F.collect_list(F.struct("elem_seq", "text")))
    return body.groupBy("path", "source_file", "section").agg(
        F.min(F.when(at_own, F.col("end_page"))).alias("page"),
        F.first(F.when(at_own, F.col("heading_path")), ignorenulls=True).alias("heading_path"),
        F.min_by("bbox", "elem_seq").alias("bbox"),
        F.min_by("table_data", F.when(F.col("element_type") == "table", F.col("elem_seq"))).alias("table_data"),
        F.count_if(F.col("element_type") == "table").alias("tables"),
        F.count_if(F.col("element_type") == "ocr").alias("ocrs"),
        F.count_if(F.col("element_type") == "figure").alias("figures"),
        F.count("*").alias("elements"),
        F.array_join(F.transform(F.filter(in_order, lambda x: ~is_blank(x.text)), lambda x: x.text), "\n\n").alias("text"),
    )


def build_parents(elements: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Parents (schemas.CHUNKS without children's ids) of all files: ids <file>__par<parents before>_<piece>."""
    pieces = splitter(s.parent_size, s.parent_overlap)
    out = sections(elements).withColumn("pieces", pieces(F.col("text")))
    out = out.withColumn("before", F.coalesce(F.sum(F.size("pieces")).over(Window.partitionBy("path").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.select("*", F.posexplode("pieces").alias("i", "piece"))
    kind = F.when(F.col("ocrs") > F.col("elements") / 2, "ocr").when(F.col("figures") > 0, "figure").when((F.col("tables") > 0) & (F.col("i") == 0), "table").otherwise("text")
    return out.select(
        F.concat("source_file", F.lit("__par"), F.col("before") + F.col("i"), F.lit("_"), "i").alias("chunk_id"), "source_file", F.col("page").alias("page_number"), F.col("piece").alias("text"), kind.alias("chunk_type"),
        F.lit("parent").alias("content_level"), F.lit("").alias("parent_id"), F.array().cast("array<string>").alias("child_ids"), "heading_path", "bbox", "table_data",
        F.struct(F.array_join("heading_path", " > ").alias("heading"), F.col("i").alias("section_index")).alias("metadata"),
    )


def build_children(parents: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Children of parents: a table stays whole, other texts are split; ids <parent>__c<piece>."""
    pieces = splitter(s.child_size, s.child_overlap)
    table = F.col("chunk_type") == "table"
    out = parents.withColumn("pieces", F.when(table, F.array("text")).otherwise(pieces(F.col("text")))).select("*", F.posexplode("pieces").alias("i", "piece"))
    return out.select(
        F.concat("chunk_id", F.lit("__c"), "i").alias("chunk_id"), "source_file", "page_number", F.col("piece").alias("text"), "chunk_type", F.lit("child").alias("content_level"), F.col("chunk_id").alias("parent_id"),
        F.array().cast("array<string>").alias("child_ids"), "heading_path", "bbox", F.when(table, F.col("table_data")).alias("table_data"), "metadata",
    )


def with_child_ids(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Parents with the ids of their children, in order."""
    i = F.regexp_extract("chunk_id", "__c([0-9]+)$", 1).cast("int")
    ids = children.groupBy("parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(i.alias("i"), "chunk_id"))), lambda x: x.chunk_id).alias("_ids"))
    out = parents.join(ids.withColumnRenamed("parent_id", "_p"), F.col("chunk_id") == F.col("_p"), "left")
    return out.withColumn("child_ids", F.coalesce("_ids", "child_ids")).select(*parents.columns)


def ordered(chunks: DataFrame) -> DataFrame:
    """chunks with chunk_ord, a number that grows with file name, parent, piece and child. No task sees all rows: ranges are sorted on their own.

    Written to the checkpoint folder at once, so the numbers stay as they are.
    """
    number = lambda pattern: F.coalesce(F.nullif(F.regexp_extract("chunk_id", pattern, 1), F.lit("")).cast("int"), F.lit(-1))
    keys = ["source_file", number("__par([0-9]+)_"), number("__par[0-9]+_([0-9]+)"), number("__c([0-9]+)$"), "chunk_id"]
    return cut(chunks.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("chunk_ord", F.monotonically_increasing_id()))


def kg_chunks(chunks: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """What a graph is built from: parents if there are any, else all chunks; without those processed before."""
    some = chunks.where("content_level = 'parent'").limit(1).select(F.lit(True).alias("_some"))
    out = chunks.join(F.broadcast(some), how="left", on=F.lit(True)).where("content_level = 'parent' OR _some IS NULL").drop("_some")
    return out if processed is None else out.join(processed, "chunk_id", "left_anti")
