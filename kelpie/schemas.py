"""Schemas of the engine's tables."""

from __future__ import annotations

BBOX = "struct<x0:double,y0:double,x1:double,y1:double>"
TABLE = "struct<headers:array<string>,rows:array<array<string>>>"
ELEMENTS = f"path string, source_file string, elem_seq int, element_type string, text string, page int, bbox {BBOX}, table_data {TABLE}, font_size double, is_bold boolean"
CHUNKS = (
    "chunk_id string, source_file string, page_number int, text string, chunk_type string, content_level string, parent_id string, child_ids array<string>, "
    f"heading_path array<string>, bbox {BBOX}, table_data {TABLE}, metadata struct<heading:string,section_index:int>"
)
VECTORS = "chunk_id string, embedding array<float>"
NODES = "node_id string, label string, name string, source string, entity_type string, created long, protected boolean"
EDGES = "src_id string, rel_type string, dst_id string, chunk_id string"
RAW = "chunk_id string, chunk_ord long, source_file string, raw string"
TRUTH = (
    "query_id string, level int, level_label string, query string, category string, expected_entities array<string>, expected_relations array<string>, "
    "expected_source array<string>, page_from int, page_to int, retrieval_type string, answer_type string, ground_truth string, tags array<string>"
)
CHUNK_TYPES = ("text", "table", "figure", "ocr")
LEVELS = ("parent", "child")
