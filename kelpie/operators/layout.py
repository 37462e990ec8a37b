"""Page layout: lines, headings, tables and what needs text recognition."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kelpie.config import DEFAULT, Settings
from kelpie.functions.text import strip
from kelpie.schemas import BBOX, TABLE


def average_size(spans: DataFrame, pages: int = 5, default: float = 10.0) -> DataFrame:
    """(source_file, avg_size): mean font size of the spans above 0 on the first pages, each span alike; else the default."""
    ok = (F.col("page") <= pages) & (F.col("font_size") > 0)
    return spans.groupBy("source_file").agg(F.coalesce(F.avg(F.when(ok, F.col("font_size"))), F.lit(default)).alias("avg_size"))


def lines(spans: DataFrame) -> DataFrame:
    """Lines from spans(source_file, page, block, line, span, text, font_size, font, bbox): text, largest size, bold if any font is; blank lines go."""
    parts = F.array_sort(F.collect_list(F.struct("span", "text")))
    out = spans.groupBy("source_file", "page", "block", "line").agg(
        strip(F.array_join(F.transform(parts, lambda x: x.text), "")).alias("text"),
        F.coalesce(F.max("font_size"), F.lit(0.0)).alias("font_size"),
        F.coalesce(F.bool_or(F.lower("font").contains("bold")), F.lit(False)).alias("is_bold"),
        F.first("bbox", ignorenulls=True).alias("bbox"),
    )
    return out.where("text <> ''")


def is_heading(font_size: Column, is_bold: Column, text: Column, avg_size: Column, s: Settings = DEFAULT) -> Column:
    return (font_size > avg_size * s.heading_ratio) | (is_bold & (F.length(text) < s.heading_length))


def outside_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks whose box meets no table's box on the same page (boxes that only touch don't meet)."""
    t = tables.select("source_file", "page", F.col("bbox").alias("_t"))
    meets = (F.col("bbox.x0") < F.col("_t.x1")) & (F.col("bbox.x1") > F.col("_t.x0")) & (F.col("bbox.y0") < F.col("_t.y1")) & (F.col("bbox.y1") > F.col("_t.y0"))
    same = (blocks["source_file"] == t["source_file"]) & (blocks["page"] == t["page"])
    return blocks.join(t, same & meets, "left_anti")


def needs_ocr(elements: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Pages whose text, joined and stripped, has fewer characters than the threshold."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("elem_seq", "text"))), lambda x: x.text), " ")
    return elements.groupBy("source_file", "page").agg(strip(text).alias("page_text")).where(F.length("page_text") < s.ocr_below).select("source_file", "page")


def recognise(pages: DataFrame, read: Callable[[bytes], str]) -> DataFrame:
    """Elements of type ocr from pages(path, source_file, page, image): what `read` finds on the image; blank or failed pages give none."""

    @F.pandas_udf(StringType())
    def text(images: pd.Series) -> pd.Series:
        def one(raw) -> str:
            try:
                return read(bytes(raw)).strip()
            except Exception:  # noqa: BLE001  a page that can't be read is an empty page
                return ""

        return images.map(one)

    out = pages.withColumn("text", text("image")).where("text <> ''")
    return out.select("path", "source_file", F.lit(0).alias("elem_seq"), F.lit("ocr").alias("element_type"), "text", "page", F.lit(None).cast(BBOX).alias("bbox"), F.lit(None).cast(TABLE).alias("table_data"), F.lit(0.0).alias("font_size"), F.lit(False).alias("is_bold"))


def with_captions(elements: DataFrame, captions: DataFrame) -> DataFrame:
    """Elements and figure captions of the same files, in reading order."""
    return reading_order(elements.unionByName(captions))


def table_data(cells: Column) -> Column:
    """struct<headers, rows> of a grid: the first row is the header; a grid of one row is header and row."""
    text = F.transform(cells, lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit(""))))
    return F.when(F.size(cells) > 0, F.struct(F.get(text, 0).alias("headers"), F.when(F.size(cells) > 1, F.slice(text, 2, F.size(cells) - 1)).otherwise(text).alias("rows")))


def table_markdown(table: Column) -> Column:
    """A table as Markdown: pipes, a line of dashes below the header; empty for none."""

    def row(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: strip(F.coalesce(c, F.lit("")))), " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.transform(table.headers, lambda c: F.lit("---")), " | "), F.lit(" |"))
    body = F.transform(table.rows, row)
    head = F.when(F.size(table.headers) > 0, F.array(row(table.headers), rule)).otherwise(F.array().cast("array<string>"))
    return F.coalesce(F.array_join(F.concat(head, body), "\n"), F.lit(""))


def reading_order(elements: DataFrame) -> DataFrame:
    """elem_seq anew by page, upper edge of the box (none: 0), old place."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("page", F.coalesce("bbox.y0", F.lit(0.0)), "elem_seq")
    return elements.withColumn("elem_seq", (F.row_number().over(w) - 1).cast("int"))
