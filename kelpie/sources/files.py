"""Readers of document files into page elements, and stores."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie import schemas
from kelpie.sources.pdf import parse_pdf

#: Reads the bytes of a file into rows (element_type, text, page, bbox, table_data, font_size, is_bold) of dicts.
Parser = Callable[[bytes], list[dict]]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def parse_txt(raw: bytes) -> list[dict]:
    """The whole file as one element; bytes that aren't UTF-8 are dropped."""
    return [{"element_type": "text", "text": raw.decode("utf-8", "ignore"), "page": 1}]


def parse_docx(raw: bytes) -> list[dict]:
    """The body's non-blank paragraphs; those in a style named Heading... are headings. A file that can't be read gives nothing."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            styles: dict[str, str] = {}
            if "word/styles.xml" in z.namelist():
                for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                    name = s.find(f"{_W}name")
                    styles[s.get(f"{_W}styleId", "")] = name.get(f"{_W}val", "") if name is not None else ""
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
            out = []
            for p in body.findall(f"{_W}p") if body is not None else []:
                tag = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
                text = "".join(x.text or "" if x.tag == f"{_W}t" else tag.get(x.tag, "") for x in p.iter()).strip()
                if text:
                    style = p.find(f"{_W}pPr/{_W}pStyle")
                    ref = style.get(f"{_W}val", "") if style is not None else ""
                    heading = (styles.get(ref) or ref).lower().startswith("heading")
                    out.append({"element_type": "heading" if heading else "text", "text": text, "page": 1, "is_bold": heading})
            return out
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []


PARSERS: dict[str, Parser] = {".txt": parse_txt, ".docx": parse_docx, ".doc": parse_docx, ".pdf": parse_pdf}


def read_elements(spark: SparkSession, path: str, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """Elements of all files under path whose suffix has a parser; others are ignored.

    PDF text comes from a small reader (sources.pdf). Another parser can take its place, as parsers={**PARSERS, ".pdf": ...}; it may give
    elements of type text, heading, table, figure and ocr with boxes and font sizes (operators.layout makes them from spans and tables).
    A parser that fails on a file gives no elements for it.
    """
    own = PARSERS if parsers is None else parsers
    pattern = "*{" + ",".join(sorted({v for s in own for v in (s, s.upper())})) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)

    def run(frames):
        for pdf in frames:
            rows = []
            for at, raw in zip(pdf["path"], pdf["content"], strict=True):
                name = at.rsplit("/", 1)[-1]
                try:
                    found = own[re.search(r"\.[^.]*$", name)[0].lower()](raw)
                except Exception:  # noqa: BLE001  one broken file must not end the load
                    found = []
                for i, x in enumerate(found):
                    rows.append((at, name, i, x["element_type"], x["text"], x.get("page", 1), x.get("bbox"), x.get("table_data"), float(x.get("font_size", 0.0)), bool(x.get("is_bold", False))))
            yield pd.DataFrame(rows, columns=["path", "source_file", "elem_seq", "element_type", "text", "page", "bbox", "table_data", "font_size", "is_bold"])

    return files.select("path", "content").mapInPandas(run, schemas.ELEMENTS)


def same_names(elements: DataFrame) -> DataFrame:
    """File names that occur in several folders: their chunk ids would collide."""
    return elements.groupBy("source_file").agg(F.countDistinct("path").alias("paths")).where("paths > 1")


def import_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from one JSON array; missing fields are null."""
    return spark.read.schema(schemas.CHUNKS).option("multiLine", "true").json(path)


def save_chunks(chunks: DataFrame, path: str) -> None:
    """Parquet, one folder a content level, so that readers of one level skip the other."""
    chunks.write.mode("overwrite").partitionBy("content_level").parquet(path)


def load_chunks(spark: SparkSession, path: str, level: str | None = None) -> DataFrame:
    """Stored chunks; where an id is stored twice the later row (by its place in the files) counts. A missing store is empty."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schemas.CHUNKS)
    df = df if level is None else df.where(F.col("content_level") == level)
    rest = F.struct(*[c for c in df.columns if c != "chunk_id"])
    return df.select("chunk_id", rest.alias("_r"), F.monotonically_increasing_id().alias("_at")).groupBy("chunk_id").agg(F.max_by("_r", "_at").alias("_r")).select("chunk_id", "_r.*")


def save(df: DataFrame, path: str) -> None:
    """Vectors, lexical index tables, nodes and edges are plain Parquet tables; an empty frame clears one."""
    df.write.mode("overwrite").parquet(path)


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark questions from one JSON document with `levels` keyed level_<n>, one row a question.

    A single expected source becomes a list of one; a page range that is no pair of numbers becomes nulls.
    """
    raw = spark.read.option("wholetext", "true").text(path).select(F.parse_json("value").alias("v"))
    raw.createOrReplaceTempView("_kelpie_benchmark")
    v = "variant_get(q.value, '$.{}', '{}')"
    pick = {"query_id": ("id", "string"), "query": ("query", "string"), "category": ("category", "string"), "retrieval_type": ("retrieval_type", "string"), "answer_type": ("answer_type", "string"), "ground_truth": ("ground_truth", "string"), "expected_entities": ("expected_entities", "array<string>"), "expected_relations": ("expected_relations", "array<string>"), "tags": ("metadata_tags", "array<string>")}
    cols = ", ".join(f"{v.format(*x)} AS {name}" for name, x in pick.items())
    out = spark.sql(f"""
        SELECT CAST(regexp_extract(l.key, '([0-9]+)', 1) AS INT) AS level, variant_get(l.value, '$.label', 'string') AS level_label, q.pos AS pos, {cols},
          coalesce(try_variant_get(q.value, '$.expected_source', 'array<string>'), array(try_variant_get(q.value, '$.expected_source', 'string'))) AS expected_source,
          try_variant_get(q.value, '$.expected_page_range[0]', 'int') AS page_from, try_variant_get(q.value, '$.expected_page_range[1]', 'int') AS page_to
        FROM _kelpie_benchmark, LATERAL variant_explode(variant_get(v, '$.levels')) AS l, LATERAL variant_explode(variant_get(l.value, '$.queries')) AS q
    """)
    return out


def select_queries(queries: DataFrame, query_id: str | None = None, level: int | None = None, smoke: bool = False) -> DataFrame:
    """By id, else by level, else the first of each level, else all."""
    if query_id is not None:
        return queries.where(F.col("query_id") == query_id)
    if level is not None:
        return queries.where(F.col("level") == level)
    if smoke:
        first = queries.groupBy("level").agg(F.min_by("query_id", "pos").alias("query_id"))
        return queries.join(F.broadcast(first), ["level", "query_id"], "left_semi")
    return queries


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id) from a JSON progress file's processed_chunk_ids; a file that is missing or can't be read gives none."""
    from pyspark.errors import AnalysisException

    try:
        raw = spark.read.option("wholetext", "true").text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "chunk_id string")
    ids = F.expr("try_variant_get(try_parse_json(value), '$.processed_chunk_ids', 'array<string>')")
    return raw.select(F.explode(ids).alias("chunk_id")).distinct()


def inline_queries(spark: SparkSession, levels: dict[int, tuple[str, list[str]]]) -> DataFrame:
    """(query_id, level, level_label, query) from level: (label, questions)."""
    rows = [(f"L{level}Q{k}", level, label, q) for level, (label, qs) in sorted(levels.items()) for k, q in enumerate(qs, 1)]
    return spark.createDataFrame(rows, "query_id string, level int, level_label string, query string")
