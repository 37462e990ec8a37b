"""The second half of the query catalogue: building (layout, sections, stores, graph), serving (hints, expansion, answers) and reports.

As in catalogue.py, every query runs over whole tables, and has DuckDB SQL where SQL can say the same.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie import schemas, vocab
from kelpie.config import Settings
from kelpie.functions import text as T
from kelpie.operators import answer, evaluate, fusion, graph, layout, lexical, resolve, sections
from kelpie.operators.durable import cut, shared_folder
from kelpie.plans import catalogue as C
from kelpie.plans.catalogue import query, table
from kelpie.sources import files
from kelpie.streaming import incremental

#: Sizes beyond every text: nothing is split, so SQL can say what parents and children are.
WHOLE = Settings(parent_size=1 << 30, child_size=1 << 30)


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


_LINES = "lines AS (SELECT doc_id, i - 1 AS i, string_split(text, chr(10))[i] AS line FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i))"

# ---------------------------------------------------------------- layout and sections


@query(f"""WITH {_LINES},
words AS (SELECT doc_id, i, k - 1 AS k, string_split(line, ' ')[k] AS w FROM lines, LATERAL (SELECT unnest(range(1, len(string_split(line, ' ')) + 1)) AS k)),
spans AS (SELECT *, i % 8 + 1 AS page, ((doc_id * 7 + i * 3 + length(w)) % 9 + 6)::DOUBLE AS size, length(w) % 5 = 0 AS bold FROM words),
mean AS (SELECT doc_id, coalesce(avg(size) FILTER (page <= 5 AND size > 0), 10.0) AS avg_size FROM spans GROUP BY doc_id),
l AS (SELECT doc_id, page, i, {_trim("string_agg(w, '' ORDER BY k)")} AS text, max(size) AS font_size, bool_or(bold) AS is_bold FROM spans GROUP BY doc_id, page, i)
SELECT doc_id, i AS line, md5(text) AS text, font_size, is_bold, font_size > avg_size * 1.15 OR (is_bold AND length(text) < 120) AS heading FROM l JOIN mean USING (doc_id) WHERE text <> ''""")
def layout_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Words of documents as spans of lines, with sizes and fonts from their lengths: lines and headings."""
    words = C.doc_lines(spark, sf).select("doc_id", "i", F.posexplode(F.split("line", " ", -1)).alias("k", "w"))
    spans = words.select(
        F.col("doc_id").alias("source_file"), (F.col("i") % 8 + 1).alias("page"), F.lit(0).alias("block"), F.col("i").alias("line"), F.col("k").alias("span"), F.col("w").alias("text"),
        ((F.col("doc_id") * 7 + F.col("i") * 3 + F.length("w")) % 9 + 6).cast("double").alias("font_size"), F.when(F.length("w") % 5 == 0, "Arial-BoldMT").otherwise("ArialMT").alias("font"), F.lit(None).cast(schemas.BBOX).alias("bbox"),
    )
    out = layout.lines(spans).join(layout.average_size(spans), "source_file")
    heading = layout.is_heading(F.col("font_size"), F.col("is_bold"), F.col("text"), F.col("avg_size"))
    return out.select(F.col("source_file").alias("doc_id"), F.col("line").cast("long").alias("line"), F.md5("text").alias("text"), "font_size", "is_bold", heading.alias("heading"))


@query(f"""WITH {_LINES} SELECT doc_id, i % 5 AS page FROM lines GROUP BY doc_id, i % 5 HAVING length({_trim("string_agg(line, ' ' ORDER BY i)")}) < 50""")
def ocr_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth line of a document makes a page: pages with too little text."""
    e = C.doc_lines(spark, sf).select(F.col("doc_id").alias("source_file"), (F.col("i") % 5).alias("page"), F.col("i").alias("elem_seq"), F.col("line").alias("text"))
    return layout.needs_ocr(e).select(F.col("source_file").alias("doc_id"), F.col("page").cast("long").alias("page"))


@query(f"""WITH g AS (SELECT item_id, list_transform(string_split(text, chr(10)), lambda l: list_transform(string_split(l, ' ')[1:4], lambda c: {_trim('c')})) AS cells FROM benchmark),
p AS (SELECT item_id, list_transform(cells, lambda r: '| ' || array_to_string(r, ' | ') || ' |') AS rows, '| ' || array_to_string(list_transform(cells[1], lambda c: '---'), ' | ') || ' |' AS rule FROM g)
SELECT item_id, rows[1] || chr(10) || rule || chr(10) || array_to_string(CASE WHEN len(rows) > 1 THEN rows[2:] ELSE rows END, chr(10)) AS markdown FROM p""")
def table_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """The first four words of each line of a benchmark text as a row of a grid."""
    cells = F.transform(F.split("text", "\n", -1), lambda line: F.slice(F.split(line, " ", -1), 1, 4))
    return table(spark, sf, "benchmark").select("item_id", layout.table_markdown(layout.table_data(cells)).alias("markdown"))


@query("""WITH e AS (SELECT doc_id * 2 AS id, source, doc_id % 9 AS page, CASE WHEN doc_id % 4 = 0 THEN 0.0 ELSE (doc_id * 53 % 700)::DOUBLE END AS y FROM documents
  UNION ALL SELECT item_id * 2 + 1, 'src' || (item_id % 20), item_id % 9, (item_id * 41 % 500)::DOUBLE FROM benchmark)
SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY page, y, id) - 1 AS seq FROM e""")
def caption_order(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as elements of their source, benchmark items as captions: one reading order a source."""

    def element(df: DataFrame, seq, path, page, y0) -> DataFrame:
        box = F.struct(F.lit(0.0).alias("x0"), y0.alias("y0"), F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1"))
        return df.select(path.alias("path"), seq.cast("int").alias("elem_seq"), seq.alias("id"), page.alias("page"), F.when(y0.isNotNull(), box).alias("bbox"))

    d, b = F.col("doc_id"), F.col("item_id")
    text = element(table(spark, sf, "documents"), d * 2, F.col("source"), d % 9, F.when(d % 4 != 0, (d * 53 % 700).cast("double")))
    captions = element(table(spark, sf, "benchmark"), b * 2 + 1, F.concat(F.lit("src"), (b % 20).cast("string")), b % 9, (b * 41 % 500).cast("double"))
    return layout.with_captions(text, captions).select("id", F.col("path").alias("source"), F.col("elem_seq").cast("long").alias("seq"))


_PARENTS = f"""{_LINES},
e AS (SELECT *, length(line) BETWEEN 1 AND 24 AS h, CASE (doc_id + i) % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 11.0 WHEN 2 THEN 12.5 ELSE 15.0 END AS size, i // 3 + 1 AS page,
  CASE WHEN length(line) % 11 = 0 THEN 'table' WHEN length(line) % 7 = 0 THEN 'ocr' WHEN length(line) % 13 = 0 THEN 'figure' ELSE 'text' END AS kind FROM lines),
n AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM e),
r AS (SELECT *, CASE WHEN NOT h THEN NULL WHEN no = 1 OR size >= 14 THEN 1 WHEN size >= 12 OR size <= 0 THEN 2 ELSE 3 END AS rank FROM n),
p AS (SELECT *, max(CASE WHEN rank = 1 THEN i END) OVER w AS one, max(CASE WHEN rank = 2 THEN i END) OVER w AS last_two FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
q AS (SELECT *, CASE WHEN last_two > one THEN last_two ELSE min(CASE WHEN rank > 1 THEN i END) OVER o END AS two, max(CASE WHEN rank = 3 THEN i END) OVER o AS last_three FROM p WINDOW o AS (PARTITION BY doc_id, one ORDER BY i)),
s AS (SELECT *, CASE WHEN last_three > two THEN last_three END AS three,
  coalesce(min(CASE WHEN h THEN page END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), max(page) OVER (PARTITION BY doc_id)) AS end_page FROM q),
told AS (SELECT doc_id, no, min(CASE WHEN has THEN no END) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS section FROM (SELECT doc_id, no, bool_or({_trim('line')} <> '') AS has FROM s WHERE NOT h GROUP BY doc_id, no)),
named AS (SELECT s.*, told.section, {_trim('a.line')} AS t1, {_trim('b.line')} AS t2, {_trim('c.line')} AS t3 FROM s JOIN told USING (doc_id, no)
  LEFT JOIN lines a ON a.doc_id = s.doc_id AND a.i = s.one LEFT JOIN lines b ON b.doc_id = s.doc_id AND b.i = s.two LEFT JOIN lines c ON c.doc_id = s.doc_id AND c.i = s.three WHERE NOT h AND told.section IS NOT NULL),
sec AS (SELECT doc_id, section, min(CASE WHEN no = section THEN end_page END) AS page, any_value(array_to_string(list_filter([t1, t2, t3], lambda x: x IS NOT NULL), ' > ')) FILTER (no = section) AS heading,
  count(*) AS elements, count(*) FILTER (kind = 'table') AS tables, count(*) FILTER (kind = 'ocr') AS ocrs, count(*) FILTER (kind = 'figure') AS figures, arg_min(line, i) FILTER (kind = 'table') AS cell,
  string_agg(line, chr(10) || chr(10) ORDER BY i) FILTER ({_trim('line')} <> '') AS text FROM named GROUP BY doc_id, section),
parent AS (SELECT *, doc_id || '__par' || (row_number() OVER (PARTITION BY doc_id ORDER BY section) - 1) || '_0' AS chunk_id,
  CASE WHEN ocrs > elements / 2 THEN 'ocr' WHEN figures > 0 THEN 'figure' WHEN tables > 0 THEN 'table' ELSE 'text' END AS kind FROM sec)"""


def line_elements(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents as elements of every type; those of 1 to 24 characters are headings of four sizes."""
    n, size = F.length("line"), (F.col("doc_id") + F.col("i")) % 4
    kind = F.when(n.between(1, 24), "heading").when(n % 11 == 0, "table").when(n % 7 == 0, "ocr").when(n % 13 == 0, "figure").otherwise("text")
    grid = F.array(F.array("line"))
    return C.doc_lines(spark, sf).select(
        F.col("doc_id").cast("string").alias("path"), F.col("doc_id").cast("string").alias("source_file"), F.col("i").alias("elem_seq"), kind.alias("element_type"), F.col("line").alias("text"),
        (F.floor(F.col("i") / 3) + 1).cast("int").alias("page"), F.lit(None).cast(schemas.BBOX).alias("bbox"), F.when(kind == "table", layout.table_data(grid)).alias("table_data"),
        F.when(size == 0, 0.0).when(size == 1, 11.0).when(size == 2, 12.5).otherwise(15.0).alias("font_size"), F.lit(False).alias("is_bold"),
    )


@query(f"""WITH {_PARENTS} SELECT chunk_id, page::INT AS page, kind, heading, md5({_trim('text')}) AS text, cell FROM parent""")
def build_parents(spark: SparkSession, sf: str) -> DataFrame:
    """Sections as parents: ids, end pages, types, breadcrumbs over three levels, first tables."""
    out = sections.build_parents(line_elements(spark, sf), WHOLE)
    return out.select("chunk_id", F.col("page_number").alias("page"), F.col("chunk_type").alias("kind"), F.col("metadata.heading").alias("heading"), F.md5("text").alias("text"), F.get(F.col("table_data.headers"), 0).alias("cell"))


@query(f"""WITH {_PARENTS} SELECT chunk_id, 'parent' AS level, '' AS parent_id, chunk_id || '__c0' AS children, kind FROM parent
UNION ALL SELECT chunk_id || '__c0', 'child', chunk_id, '', kind FROM parent""")
def chunk_store(spark: SparkSession, sf: str) -> DataFrame:
    """Parents and children, stored by level and loaded again; each row is stored twice, and the later one counts."""
    parents = cut(sections.build_parents(line_elements(spark, sf), WHOLE))
    children = sections.build_children(parents, WHOLE)
    both = sections.with_child_ids(parents, children).unionByName(children)
    at = shared_folder(spark)
    files.save_chunks(both.unionByName(both), f"{at}/chunks")
    out = files.load_chunks(spark, f"{at}/chunks", "parent").unionByName(files.load_chunks(spark, f"{at}/chunks", "child"))
    return out.select("chunk_id", F.col("content_level").alias("level"), "parent_id", F.array_join("child_ids", ",").alias("children"), F.col("chunk_type").alias("kind"))


@query(f"WITH {_PARENTS} SELECT chunk_id FROM parent WHERE doc_id % 3 <> 0")
def graph_sources(spark: SparkSession, sf: str) -> DataFrame:
    """What a graph is built from where there are parents: those alone, without the ones done before."""
    parents = cut(sections.build_parents(line_elements(spark, sf), WHOLE))
    both = parents.unionByName(sections.build_children(parents, WHOLE))
    done = parents.where(F.col("source_file").cast("long") % 3 == 0).select("chunk_id")
    return sections.kg_chunks(both, done).select("chunk_id")


@query("SELECT doc_id AS chunk_id FROM documents")
def graph_sources_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Without parents a graph is built from all chunks."""
    return sections.kg_chunks(C.chunks(spark, sf).withColumn("content_level", F.lit("child"))).select("chunk_id")


@query("SELECT item_id, md5(text || chr(10)) AS text, 1 AS page, 'text' AS kind FROM benchmark")
def load_text_files(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts written as one .txt file each and read back as elements; other files beside them are left out."""
    at = shared_folder(spark)
    table(spark, sf, "benchmark").select("item_id", F.col("text").alias("value")).repartition("item_id").write.partitionBy("item_id").text(f"{at}/files")
    table(spark, sf, "region").write.json(f"{at}/files/other")
    e = files.read_elements(spark, f"{at}/files")
    return e.select(F.regexp_extract("path", "item_id=([0-9]+)/", 1).cast("long").alias("item_id"), F.md5("text").alias("text"), "page", F.col("element_type").alias("kind"))


# ---------------------------------------------------------------- stored index, graph leg, hints, expansion


@query(f"WITH {C._INDEX}, {C._BENCH}, {C._bm25('asked', 16)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM top")
def stored_bm25(spark: SparkSession, sf: str) -> DataFrame:
    """The lexical index saved, loaded again and searched."""
    at = shared_folder(spark)
    lexical.build_bm25(C.chunks(spark, sf)).save(at)
    out = lexical.bm25_search(lexical.LexicalIndex.load(spark, at), C.bench_queries(spark, sf), 16)
    return out.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {C._INDEX}, {C._DOCQ}, {C._bm25('asked', 16)}, {C._VECTOR}, {C._FUSED.split('firsts AS')[0]}
names AS (SELECT query_id, list_distinct([lower(string_split(query, ' ')[1]), lower(string_split(query, ' ')[2])]) AS ns FROM asked),
hit AS (SELECT c.*, len(list_filter(ns, lambda n: n IS NOT NULL AND contains(lower(d.text), n))) AS hits FROM cand c LEFT JOIN documents d ON d.doc_id = c.chunk_id JOIN names USING (query_id)),
firsts AS (SELECT *, row_number() OVER w AS pos, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, (vr IS NULL), vr, seen, chunk_id) AS gr FROM hit WINDOW w AS (PARTITION BY query_id ORDER BY (vr IS NULL), vr, seen, chunk_id)),
fused AS (SELECT query_id, chunk_id, hits, pos, gr, coalesce(1.0::DOUBLE / (60 + vr), 0) + coalesce(1.0::DOUBLE / (60 + br), 0) + 0.5::DOUBLE / (60 + gr) AS score FROM firsts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) AS rank FROM fused)
SELECT query_id, chunk_id, hits, gr AS graph_rank, round(score, 9) AS score, rank FROM ranked WHERE rank <= 16""")
def graph_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Fusion with the graph leg: a query's first two words stand as the ends of its triple, and are looked for in the candidates' texts."""
    q, v, b = C._lists(spark, sf)
    words = F.split("query", " ", -1)
    triples = q.select("query_id", F.get(words, 0).alias("source"), F.get(words, 1).alias("target"))
    out = fusion.cut(fusion.fuse(v, b, triples=triples, chunks=C.chunks(spark, sf)), 16)
    return out.select("query_id", "chunk_id", F.col("hits").cast("long").alias("hits"), F.col("graph_rank").cast("long").alias("graph_rank"), F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


_HINTS = ", ".join("CASE WHEN contains(low, {}) THEN [{}] ELSE [] END".format(_sql(k), ", ".join(map(_sql, v))) for k, v in vocab.SOURCE_HINTS.items())


@query(f"""WITH q AS (SELECT doc_id AS id, lower(text) AS low FROM documents UNION ALL SELECT -item_id - 1, lower(text) FROM benchmark UNION ALL SELECT -100000 - r_regionkey, lower('Which robot uses I2C in ' || r_name) FROM region)
SELECT id, array_to_string(list_sort(list_distinct(flatten([{_HINTS}]))), ',') AS hints FROM q""")
def source_hints(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(table(spark, sf, "benchmark").select((-F.col("item_id") - 1).alias("id"), "text"))
    r = table(spark, sf, "region").select((F.lit(-100000) - F.col("r_regionkey")).cast("long").alias("id"), F.concat(F.lit("Which robot uses I2C in "), "r_name").alias("text"))
    return q.unionByName(r).select("id", F.array_join(T.source_hints(F.col("text")), ",").alias("hints"))


@query(rf"""WITH t AS (SELECT doc_id, text, len(regexp_split_to_array({_trim('text')}, '\s+')) >= 10 AS expands, list_filter(list_transform(string_split(text, chr(10)), lambda l: {_trim('l')}), lambda l: length(l) > 10)[1:3] AS ls FROM documents)
SELECT doc_id, expands, 1 + len(ls) AS subs, md5(array_to_string(list_concat([text], ls), '|')) AS digest FROM t""")
def query_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as questions and as a model's answers to them: the gate, and the sub-questions that are taken from the lines."""
    subs = fusion.sub_queries(F.col("text"), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", fusion.needs_expansion(F.col("text")).alias("expands"), F.size(subs).cast("long").alias("subs"), F.md5(F.array_join(subs, "|")).alias("digest"))


@query(rf"""WITH q AS (SELECT item_id, text, len(regexp_split_to_array({_trim('text')}, '\s+')) >= 10 AS long FROM benchmark)
SELECT item_id AS query_id, 0::BIGINT AS sub, md5(text) AS query FROM q UNION ALL SELECT item_id, 1, md5('what is ' || length(text) || ' about') FROM q WHERE long""")
def expand_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Long benchmark texts get a sub-question from a model, short ones stay alone."""
    asked = fusion.expand(C.bench_queries(spark, sf), lambda prompt: f"short\nwhat is {len(prompt.split('Question: ', 1)[1])} about\n")
    return asked.select("query_id", F.col("sub").cast("long").alias("sub"), F.md5("query").alias("query"))


# ---------------------------------------------------------------- graph: increments, checks, context, extraction


def _halves(df: DataFrame, first: bool) -> DataFrame:
    return df.where(F.col("chunk_ord") < 10) if first else df.where(F.col("chunk_ord") >= 10)


@query(f"WITH {C._GRAPH} SELECT * FROM edges")
def graph_increment(spark: SparkSession, sf: str) -> DataFrame:
    """The graph in two increments: the second is added to what the first has stored, with the edges of one build over all."""
    e, r = C.entities_relations(spark, sf)
    old = [cut(x) for x in graph.upsert_graph(_halves(e, True), _halves(r, True))]
    return graph.upsert_graph(_halves(e, False), _halves(r, False), *old)[1]


@query(f"WITH {C._GRAPH} SELECT node_id, label, name, created::BIGINT AS created FROM nodes")
def graph_increment_nodes(spark: SparkSession, sf: str) -> DataFrame:
    e, r = C.entities_relations(spark, sf)
    old = [cut(x) for x in graph.upsert_graph(_halves(e, True), _halves(r, True))]
    return graph.upsert_graph(_halves(e, False), _halves(r, False), *old)[0].select("node_id", "label", "name", "created")


@query(f"WITH {C._GRAPH} SELECT label, name, 2::BIGINT AS n FROM nodes WHERE label = 'Component'")
def duplicate_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The uniqueness check over nodes of which one label is there twice."""
    nodes, _ = C.written_graph(spark, sf)
    return graph.duplicate_nodes(nodes.unionByName(nodes.where("label = 'Component'")))


@query(f"""WITH {C._GRAPH}, {C._BOTH}, start AS (SELECT r_regionkey AS query_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY r_regionkey ORDER BY name, node_id) AS k FROM region JOIN nodes ON contains(lower(name), lower(r_name))) WHERE k <= 5),
reach AS (SELECT query_id, node_id FROM start UNION SELECT query_id, b FROM start JOIN both_ways ON a = node_id),
inside AS (SELECT r.query_id, x.name AS source, rel_type AS relation, y.name AS target, row_number() OVER (PARTITION BY r.query_id ORDER BY x.name, rel_type, y.name, src_id, dst_id) AS n
  FROM reach r JOIN edges e ON e.src_id = r.node_id JOIN reach r2 ON r2.query_id = r.query_id AND r2.node_id = e.dst_id JOIN nodes x ON x.node_id = src_id JOIN nodes y ON y.node_id = dst_id)
SELECT query_id, source || ' --[' || relation || ']--> ' || target AS triple, n FROM inside WHERE n <= 50""")
def entity_context(spark: SparkSession, sf: str) -> DataFrame:
    """Relations around nodes by a part of their names, as text."""
    nodes, edges = C.written_graph(spark, sf)
    out = graph.entity_context(nodes, edges, table(spark, sf, "region").select(F.col("r_regionkey").alias("query_id"), F.col("r_name").alias("name")))
    return out.select("query_id", T.triple_text(F.col("source"), F.col("relation"), F.col("target")).alias("triple"), F.col("n").cast("long").alias("n"))


@query("""WITH s AS (SELECT s_suppkey::VARCHAR AS chunk_id, (length(s_name) + s_nationkey) % 7 AS kind FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT chunk_id, kind = 0 AS needs_retry, CASE WHEN kind IN (0, 3) THEN 0 ELSE 6 END AS entities_raw FROM s""")
def retry_flags(spark: SparkSession, sf: str) -> DataFrame:
    report = graph.validate_extractions(C.raw_answers(spark, sf))[2]
    return report.select("chunk_id", "needs_retry", F.col("entities_raw").cast("int").alias("entities_raw"))


def _stub(messages: list[dict]) -> str:
    """A model whose answers follow from the prompt: an entity for each of the last two words; broken at first for every third length."""
    prompt = messages[0]["content"]
    text = prompt.split("Text:\n", 1)[1]
    again = "\n\n" in text
    text = text.split("\n\n", 1)[0]
    if len(text) % 3 == 0 and not again:
        return "I can't say."
    a, b = text.split("@", 1)
    return json.dumps({"entities": [{"name": a, "type": "ic"}, {"name": b, "type": "register"}], "relations": [{"source": a, "relation": "part of", "target": b}]})


@query("""SELECT s_suppkey::VARCHAR AS chunk_id, length(s_name || '@' || n_name) % 3 = 0 AS retried, s_name || ' --[PART_OF]--> ' || n_name AS triple FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def extract_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Extraction by a model with one more try, and validation of what it says."""
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    chunks = s.select(F.col("s_suppkey").cast("string").alias("chunk_id"), F.col("s_suppkey").cast("long").alias("chunk_ord"), F.lit("f").alias("source_file"), F.concat_ws("@", "s_name", "n_name").alias("text"))
    raw = cut(answer.extract(chunks, _stub))
    _, relations, _ = graph.validate_extractions(raw)
    return raw.select("chunk_id", "retried").join(relations.select("chunk_id", T.triple_text(F.col("source"), F.col("relation"), F.col("target")).alias("triple")), "chunk_id")


@query("""WITH g AS (SELECT p_partkey % 50 AS b, p_partkey % 7 AS g, lower(p_name) AS name, max(lower(p_name)) OVER (PARTITION BY p_partkey % 50, p_partkey % 7) AS canonical FROM part),
per AS (SELECT b, g, count(*) AS n, count(*) FILTER (name <> canonical) AS m FROM g GROUP BY b, g)
SELECT count(*) AS groups, sum(n - 1)::BIGINT AS mergeable, sum(m)::BIGINT AS effective_merges FROM per""")
def merge_stats(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    p = table(spark, sf, "part").select((F.col("p_partkey") % 50).alias("bucket"), (F.col("p_partkey") % 7).alias("group_no"), F.lower("p_name").alias("name"))
    return resolve.duplicate_stats(p.withColumn("canonical", F.max("name").over(Window.partitionBy("bucket", "group_no"))))


# ---------------------------------------------------------------- progress, budget, selections, reports


@query("""WITH done AS (SELECT count(DISTINCT doc_id) AS processed FROM labels), n AS (SELECT count(*) AS total FROM documents)
SELECT processed, total - processed AS remaining, round(100.0 * processed / total, 6) AS percent, round((total - processed)::DOUBLE / 672, 6) AS days FROM done, n""")
def build_progress(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.progress(C.chunks(spark, sf), table(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id")))
    return out.select("processed", "remaining", F.round("percent", 6).alias("percent"), F.round("days", 6).alias("days"))


@query("""WITH l AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL))
SELECT doc_id AS chunk_id, CASE WHEN n <= 20 THEN 'large' ELSE 'small' END AS phase FROM l WHERE n <= 70""")
def daily_budget(spark: SparkSession, sf: str) -> DataFrame:
    """A day's calls of two models over the chunks that are left; the quota is the feature."""
    c = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("n_chars").alias("chunk_ord"))
    return incremental.budget(c, table(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id")), [("large", 20), ("small", 50)]).select("chunk_id", "phase")


@query("SELECT doc_id AS run, n_chars * 1000000 + doc_id AS date FROM documents ORDER BY date DESC LIMIT 5")
def last_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The last five runs; five is the feature."""
    return evaluate.last_runs(table(spark, sf, "documents").select(F.col("doc_id").alias("run"), (F.col("n_chars") * 1000000 + F.col("doc_id")).cast("long").alias("date")))


_LEVELS = "b AS (SELECT item_id, item_id % 5 + 1 AS level, text FROM benchmark)"


@query(f"""WITH {_LEVELS} SELECT 'smoke' AS mode, min(item_id) AS item_id FROM b GROUP BY level UNION ALL SELECT 'level', item_id FROM b WHERE level = 3 UNION ALL SELECT 'one', item_id FROM b WHERE item_id = 7 UNION ALL SELECT 'all', item_id FROM b""")
def select_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark questions by id, by level, the first of each level, and all."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 5 + 1).alias("level"), F.col("item_id").alias("pos"))
    modes = {"smoke": {"smoke": True}, "level": {"level": 3}, "one": {"query_id": 7}, "all": {}}
    parts = [files.select_queries(b, **how).select(F.lit(mode).alias("mode"), F.col("query_id").alias("item_id")) for mode, how in modes.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT * FROM (VALUES ('L1Q1', 1, 'easy', 'a'), ('L1Q2', 1, 'easy', 'b'), ('L2Q1', 2, 'hard', 'c')) AS t(query_id, level, level_label, query)")
def inline_queries(spark: SparkSession, sf: str) -> DataFrame:
    return files.inline_queries(spark, {2: ("hard", ["c"]), 1: ("easy", ["a", "b"])})


@query(f"""WITH {C._INDEX}, {C._BENCH}, {C._bm25('asked', 8)},
truth AS (SELECT item_id AS query_id, item_id % 5 + 1 AS level, ['src' || (item_id % 20), 'src' || ((item_id + 7) % 20)] AS srcs, string_split(lower(text), ' ')[1:3] AS ents, string_split(text, ' ')[2] AS fact FROM benchmark),
got AS (SELECT query_id, list(DISTINCT source) AS files, lower(string_agg(text, ' ' ORDER BY rank)) AS texts, count(*) AS chunks FROM top JOIN documents ON doc_id = chunk_id GROUP BY query_id)
SELECT query_id, level, query_id % 2 = 0 AS graph_fired, CASE WHEN query_id % 2 = 0 THEN 1 ELSE 0 END AS triple_count, coalesce(chunks, 0) AS chunk_count,
  round(len(list_filter(srcs, lambda x: len(list_filter(coalesce(files, []), lambda f: contains(f, x))) > 0))::DOUBLE / 2, 6) AS source_recall,
  round(len(list_filter(ents, lambda e: contains(coalesce(texts, '') || ' ' || CASE WHEN query_id % 2 = 0 THEN lower(fact) || ' end' ELSE '' END, e)))::DOUBLE / greatest(len(ents), 1), 6) AS entity_recall
FROM truth LEFT JOIN got USING (query_id)""")
def graph_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recalls a question, with triples for every second one."""
    q, c, b = C.bench_queries(spark, sf), C.chunks(spark, sf), table(spark, sf, "benchmark")
    top = lexical.bm25_search(C.index(spark, sf), q, 8).join(c.select("chunk_id", "source_file", "text"), "chunk_id")
    src = lambda n: F.concat(F.lit("src"), ((F.col("item_id") + n) % 20).cast("string"))
    truth = b.select(F.col("item_id").alias("query_id"), (F.col("item_id") % 5 + 1).alias("level"), F.array(src(0), src(7)).alias("expected_source"), F.slice(F.split(F.lower("text"), " "), 1, 3).alias("expected_entities"))
    triples = q.where("query_id % 2 = 0").select("query_id", F.get(F.split("query", " "), 1).alias("source"), F.lit("end").alias("target"))
    out = evaluate.evaluate(truth, top, triples)
    return out.select("query_id", "level", "graph_fired", F.col("triple_count").cast("int").alias("triple_count"), "chunk_count", F.round("source_recall", 6).alias("source_recall"), F.round("entity_recall", 6).alias("entity_recall"))


@query("""SELECT item_id % 5 + 1 AS level, item_id AS query_id, '[' || item_id || '] sources ' || (50 * (item_id % 3)) || '%  entities ' || (25 * (item_id % 5)) || '%  graph ' || CASE WHEN item_id % 2 = 0 THEN 'yes' ELSE 'no' END || '  ' || (item_id % 9) || ' chunks, ' || (item_id % 4) || ' triples, top ' || printf('%.4f', (item_id % 8) / 8.0) AS line FROM benchmark""")
def console_report(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id")
    scores = table(spark, sf, "benchmark").select(
        i.alias("query_id"), (i % 5 + 1).alias("level"), (0.5 * (i % 3)).alias("source_recall"), (0.25 * (i % 5)).alias("entity_recall"), (i % 2 == 0).alias("graph_fired"), (i % 9).alias("chunk_count"), (i % 4).alias("triple_count"), ((i % 8) / 8.0).alias("top_score")
    )
    return evaluate.report(scores)


# ---------------------------------------------------------------- prompts, answers, small talk

_REPLIES = " ".join(f"WHEN {_sql(k)} THEN {_sql(v)}" for k, v in vocab.CASUAL_REPLIES.items())


@query(f"""WITH t AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT -1 - i, 0, ([{', '.join(_sql(f' {c.title()}!? ') for c in vocab.CASUAL)}])[i + 1] FROM range({len(vocab.CASUAL)}) r(i)),
k AS (SELECT *, {_trim(f"rtrim({_trim('lower(text)')}, '!?.')")} AS key FROM t)
SELECT conv_id, turn, key IN ({C._CASUAL}) AS casual, CASE key {_REPLIES} ELSE {_sql(vocab.CASUAL_DEFAULT)} END AS reply FROM k""")
def casual_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations, and every small-talk phrase in another spelling."""
    more = spark.createDataFrame([(-1 - i, 0, f" {c.title()}!? ") for i, c in enumerate(vocab.CASUAL)], "conv_id long, turn long, text string")
    t = table(spark, sf, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text").unionByName(more)
    return t.select("conv_id", "turn", T.is_casual(F.col("text")).alias("casual"), T.casual_reply(F.col("text")).alias("reply"))


_RANKED = "r AS (SELECT source AS query_id, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents)"


def _ranked(spark: SparkSession, sf: str, k: int) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    d = table(spark, sf, "documents").select(F.col("source").alias("query_id"), F.col("source").alias("source_file"), F.col("doc_id").alias("page_number"), "text", rank.alias("rank"))
    return d.where(F.col("rank") <= k).withColumn("score", 1.0 / F.col("rank"))


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    """One triple a rank for the sources with an even number."""
    s = table(spark, sf, "documents").select(F.col("source").alias("query_id")).distinct().where(F.regexp_extract("query_id", "([0-9]+)$", 1).cast("int") % 2 == 0)
    return s.select("query_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("rank")).select("query_id", "rank", F.col("query_id").alias("source"), F.lit("HAS_PIN").alias("relation"), F.concat(F.lit("p"), "rank").alias("target"))


_CONTEXT = f"""{_RANKED},
c AS (SELECT query_id, '## Retrieved document context' || chr(10) || chr(10) || string_agg('[' || rank || '] score=' || printf('%.3f', 1.0 / rank) || ' | ' || query_id || ' | page ' || doc_id || chr(10) || {_trim('text')} || chr(10), chr(10) ORDER BY rank)
  || CASE WHEN regexp_extract(query_id, '([0-9]+)$', 1)::INT % 2 = 0 THEN chr(10) || chr(10) || '## Knowledge graph relationships [KG]' || chr(10) || chr(10) || '  • ' || query_id || ' --[HAS_PIN]--> p1' || chr(10) || '  • ' || query_id || ' --[HAS_PIN]--> p2' ELSE '' END AS context
  FROM r WHERE rank <= 4 GROUP BY query_id)"""


@query(f"WITH {_CONTEXT} SELECT query_id, md5(context) AS context FROM c")
def context_with_triples(spark: SparkSession, sf: str) -> DataFrame:
    r = _ranked(spark, sf, 4)
    return answer.context_block(r, _facts(spark, sf), r.select("query_id").distinct()).select("query_id", F.md5("context").alias("context"))


@query(f"""WITH {_CONTEXT} SELECT query_id, 3 AS messages, md5(context || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '**Question:** what is in ' || query_id || chr(10) || chr(10) || 'Cite every fact with [N] or [KG] and close with a ## Sources section.') AS ask, {_sql(answer.SYSTEM)} AS system FROM c""")
def build_messages(spark: SparkSession, sf: str) -> DataFrame:
    """System text, history, context and question of each source."""
    r = _ranked(spark, sf, 4)
    q = r.select("query_id").distinct().withColumn("query", F.concat(F.lit("what is in "), "query_id")).withColumn("history", F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content"))))
    out = answer.build_messages(q, answer.context_block(r, _facts(spark, sf), q))
    last = F.element_at("messages", -1)
    return out.select("query_id", F.size("messages").alias("messages"), F.md5(last.content).alias("ask"), F.get("messages", 0).content.alias("system"))


@query(f"""WITH {_CONTEXT}, p AS (SELECT query_id, array_to_string(list('[' || rank || '] ' || query_id || ' — page ' || doc_id ORDER BY rank), ';') AS refs FROM r WHERE rank <= 4 GROUP BY query_id)
SELECT query_id, 'seen ' || (length(context) > 0)::INT || ' of 2' AS answer, refs, CASE WHEN regexp_extract(query_id, '([0-9]+)$', 1)::INT % 2 = 0 THEN query_id || ' --[HAS_PIN]--> p1;' || query_id || ' --[HAS_PIN]--> p2' END AS triples FROM c JOIN p USING (query_id)""")
def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers by a model that tells what it was given, with all passages as sources."""
    r = _ranked(spark, sf, 4)
    q = r.select("query_id").distinct().withColumn("query", F.concat(F.lit("what is in "), "query_id"))
    out = answer.generate(q, r, _facts(spark, sf), lambda ms: f"seen {int('[1] score=1.000' in ms[-1]['content'])} of {len(ms)}")
    return out.select("query_id", "answer", F.array_join(F.transform("source_pages", lambda x: x.ref), ";").alias("refs"), F.array_join("triples", ";").alias("triples"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn // 3, turn) AS n FROM conversations")
def citation_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers that go on from one search of a conversation to the next."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.floor(F.col("turn") / 3).alias("search"), F.col("turn").alias("rank"))
    return answer.number_citations(c).select(F.col("query_id").alias("conv_id"), F.col("rank").alias("turn"), F.col("n").cast("long").alias("n"))


# ---------------------------------------------------------------- resumed builds, agent rounds, models


@query("""SELECT s_suppkey::VARCHAR AS chunk_id, 1::BIGINT AS times, s_name || ' --[PART_OF]--> ' || n_name AS triple FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def resumed_build(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs over a folder of chunk files: the second has new files beside the old ones, and a chunk that was done before; each chunk is done once."""
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    names = {"chunk_id": F.col("s_suppkey").cast("string"), "source_file": F.lit("f"), "text": F.concat_ws("@", "s_name", "n_name"), "content_level": F.lit("child")}
    kinds = spark.createDataFrame([], schemas.CHUNKS).schema
    chunks = s.select("s_suppkey", *[(names[f.name] if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])
    at = shared_folder(spark)
    for part in (chunks.where("s_suppkey % 3 <> 0"), chunks.where("s_suppkey % 3 = 0 OR s_suppkey % 5 = 0")):
        part.drop("s_suppkey").write.mode("append").parquet(f"{at}/in")
        incremental.run_increment(spark, f"{at}/in", f"{at}/store", _stub, f"{at}/stream")
    done = incremental.read_table(spark, f"{at}/store/progress", incremental.PROGRESS).groupBy("chunk_id").agg(F.count("*").alias("times"))
    kind = "chunk_id string, source string, relation string, target string"
    found = incremental.read_table(spark, f"{at}/store/relations", kind).select("chunk_id", T.triple_text(F.col("source"), F.col("relation"), F.col("target")).alias("triple"))
    return done.join(found, "chunk_id")


def _agent(messages: list[dict]) -> str:
    """Looks for passages, then for relations, then ends with what it saw."""
    seen = [m["content"] for m in messages if m["content"].startswith("Observation:")]
    question = messages[1]["content"].split("Question: ", 1)[1].split("\n", 1)[0]
    if len(seen) == 0:
        return f"Thought: look\nAction: vector_search\nAction Input: {question}"
    if len(seen) == 1:
        return f"Thought: relate\nAction: graph_search\nAction Input: {question.split()[-1]}"
    return f"Thought: done\nAction: finish\nAction Input: {sum(x.count('(score=') for x in seen)} passages, {sum(x.count('[KG] ') for x in seen)} relations"


@query(f"""WITH {C._GRAPH}, {C._BOTH}, start AS (SELECT r_regionkey AS query_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY r_regionkey ORDER BY name, node_id) AS k FROM region JOIN nodes ON contains(lower(name), lower(r_name))) WHERE k <= 5)
SELECT r_regionkey AS query_id, '3 passages, ' || least(5, count(DISTINCT e.src_id || e.rel_type || e.dst_id)) || ' relations' AS answer, 3 AS iterations, 3 AS passages FROM region JOIN start ON query_id = r_regionkey JOIN edges e ON e.dst_id = node_id OR e.src_id = node_id
WHERE NOT contains(r_name, ' ') GROUP BY r_regionkey""")
def agent_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """An agent asked about regions of one word: passages, then relations (five different ones a term), then its answer in the third round."""
    nodes, edges = C.written_graph(spark, sf)
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("source_file"), F.lit(1).alias("page_number"), F.substring("text", 1, 400).alias("text"))
    q = table(spark, sf, "region").where("NOT contains(r_name, ' ')").select(F.col("r_regionkey").alias("query_id"), F.concat(F.lit("What is in "), "r_name").alias("query"))
    from kelpie.operators.dense import embed

    out = answer.run_agent(q, d, cut(embed(d)), nodes, edges, _agent)
    return out.select("query_id", "answer", "iterations", F.size("source_pages").alias("passages"))


@query("SELECT doc_id, 384 AS width, 1.0::DOUBLE AS norm FROM documents WHERE length(trim(text)) > 3")
def embed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of all documents by the offline embedder: width and length."""
    from kelpie.operators.dense import dot, embed

    v = embed(table(spark, sf, "documents").where("length(trim(text)) > 3").select(F.col("doc_id").alias("chunk_id"), "text"))
    return v.select(F.col("chunk_id").alias("doc_id"), F.size("embedding").alias("width"), F.round(F.sqrt(dot(F.col("embedding"), F.col("embedding"))), 3).alias("norm"))


@query("""WITH p AS (SELECT p_partkey, lower(p_name) AS n FROM part WHERE length(p_name) > 3)
SELECT p_partkey, 0.92::DOUBLE AS plural, 1.0::DOUBLE AS same, 0.0::DOUBLE AS apart FROM p""")
def name_likeness(spark: SparkSession, sf: str) -> DataFrame:
    """Likeness of part names to their plural, to themselves in capitals, and to a name that shares no letter."""
    from kelpie.functions.udf import similarity

    p = table(spark, sf, "part").where("length(p_name) > 3").select("p_partkey", F.lower("p_name").alias("n"))
    return p.select("p_partkey", similarity("n", F.concat("n", F.lit("s"))).alias("plural"), similarity("n", F.upper("n")).alias("same"), similarity("n", F.lit("0123456789")).alias("apart"))


@query("""WITH s AS (SELECT s_suppkey::VARCHAR AS chunk_id, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE (length(s_name) + s_nationkey) % 7 NOT IN (0, 2, 3))
SELECT chunk_id, 'entity' AS what, s_name AS a, 'Ic' AS b, '' AS c FROM s UNION ALL SELECT chunk_id, 'entity', lower(s_name), 'Pin', '' FROM s UNION ALL SELECT chunk_id, 'entity', 'the', 'Pin', '' FROM s
UNION ALL SELECT chunk_id, 'entity', n_name, 'StrangeBoard', '' FROM s UNION ALL SELECT chunk_id, 'entity', 'text', 'Entity', '' FROM s UNION ALL SELECT chunk_id, 'relation', s_name, 'IS_A', n_name FROM s
UNION ALL SELECT chunk_id, 'relation', n_name, 'X', lower(n_name) FROM s UNION ALL SELECT chunk_id, 'relation', lower(s_name), 'IS_AN', lower(n_name) FROM s""")
def lenient_parse(spark: SparkSession, sf: str) -> DataFrame:
    e, r = graph.lenient(C.raw_answers(spark, sf))
    out = e.select("chunk_id", F.lit("entity").alias("what"), F.col("name").alias("a"), F.col("label").alias("b"), F.lit("").alias("c"))
    return out.unionByName(r.select("chunk_id", F.lit("relation").alias("what"), F.col("source").alias("a"), F.col("relation").alias("b"), F.col("target").alias("c")))


@query(f"""WITH {C._GRAPH} SELECT '"' || node_id || '" [label="' || name || '"]' AS line FROM nodes UNION ALL SELECT '"' || src_id || '" -> "' || dst_id || '" [label="' || rel_type || '"]' FROM edges""")
def graph_drawing(spark: SparkSession, sf: str) -> DataFrame:
    return graph.drawing(*C.written_graph(spark, sf))
