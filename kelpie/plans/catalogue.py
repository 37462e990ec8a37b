"""The driver's query catalogue: the engine's operators on its tables, each with DuckDB SQL where SQL can say the same.

Search queries are the rows whose id is divisible by 20, against all rows, or the whole benchmark table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie import schemas, vocab
from kelpie.functions import text as T
from kelpie.functions.udf import splitter
from kelpie.operators import answer, dense, evaluate, fusion, graph, layout, lexical, resolve, sections
from kelpie.operators.durable import cut, shared_folder
from kelpie.plans import retrieval

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """documents as chunks: the source stands for the file."""
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_file"), F.lit(1).alias("page_number"), "text", F.lit("").alias("parent_id"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def bench_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def doc_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a vector whose id is divisible by 20, asked with their text and vector."""
    d = table(spark, sf, "documents").where("doc_id % 20 = 0").join(table(spark, sf, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    return d.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"), "embedding", F.col("source"))


def index(spark: SparkSession, sf: str) -> lexical.LexicalIndex:
    """The lexical index of documents, written once and then read by whatever searches it."""
    return lexical.store_bm25(chunks(spark, sf), shared_folder(spark))


# ---------------------------------------------------------------- lexical and dense

_KEEP = ", ".join(f"'{t}'" for t in vocab.LEXICAL_KEEP)
_TOKENS = f"list_filter(regexp_extract_all(lower(coalesce({{}}, '')), '[a-z0-9][a-z0-9/]*'), lambda t: length(t) > 2 OR t IN ({_KEEP}))"
_INDEX = f"""
toks AS MATERIALIZED (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents),
corpus AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
post AS MATERIALIZED (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY doc_id, dl, term),
dfs AS MATERIALIZED (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, corpus GROUP BY term),
mean AS (SELECT avg(raw) AS avg_idf FROM dfs),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * avg_idf ELSE raw END AS idf FROM dfs, mean)"""


def _bm25(asked: str, k: int) -> str:
    """CTEs up to top(query_id, chunk_id, score, rank); asked(query_id, query) must come before."""
    return f"""
asked_terms AS MATERIALIZED (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_TOKENS.format('query')}) AS term FROM {asked}) GROUP BY query_id, term),
scored AS MATERIALIZED (SELECT query_id, doc_id AS chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM asked_terms JOIN post USING (term) JOIN idf USING (term), corpus GROUP BY query_id, doc_id),
best AS MATERIALIZED (SELECT query_id, max(score) AS best FROM scored GROUP BY query_id),
placed AS MATERIALIZED (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scored),
top AS (SELECT query_id, chunk_id, CASE WHEN best > 0 THEN score / best ELSE score END AS score, rank FROM placed JOIN best USING (query_id) WHERE rank <= {k} AND score > 0)"""


_VECTOR = """
vec AS (SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, s AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(s, 9) DESC, v.vec_id) AS rank
  FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q, embeddings v, LATERAL (SELECT list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s)) WHERE rank <= 8)"""


@query(f"WITH {_VECTOR} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM vec")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    asked = v.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    return dense.vector_search(v, asked, 8).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_INDEX} SELECT term, df, round(idf, 9) AS idf, n, round(avgdl, 6) AS avgdl FROM idf, corpus")
def bm25_stats(spark: SparkSession, sf: str) -> DataFrame:
    x = index(spark, sf)
    return x.terms.crossJoin(F.broadcast(x.stats)).select("term", "df", F.round("idf", 9).alias("idf"), "n", F.round("avgdl", 6).alias("avgdl"))


_BENCH = "asked AS (SELECT item_id AS query_id, text AS query FROM benchmark)"


@query(f"WITH {_INDEX}, {_BENCH}, {_bm25('asked', 16)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM top")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    out = lexical.bm25_search(index(spark, sf), bench_queries(spark, sf), 16)
    return out.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# ---------------------------------------------------------------- fusion

_DOCQ = "asked AS (SELECT doc_id AS query_id, text AS query, source AS own FROM documents JOIN embeddings ON doc_id = vec_id WHERE doc_id % 20 = 0)"
_FUSED = """
vecr AS (SELECT query_id, chunk_id, rank AS vr FROM vec WHERE query_id IN (SELECT query_id FROM asked)),
topr AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rank, chunk_id) AS br, rank AS seen FROM top),
cand AS (SELECT query_id, chunk_id, vr, br, seen FROM vecr FULL JOIN topr USING (query_id, chunk_id)),
firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (vr IS NULL), vr, seen, chunk_id) AS gr FROM cand),
fused AS (SELECT query_id, chunk_id, gr, coalesce(1.0::DOUBLE / (60 + vr), 0) + coalesce(1.0::DOUBLE / (60 + br), 0) + 0.5::DOUBLE / (60 + gr) AS score FROM firsts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, gr) AS rank FROM fused)"""


def _lists(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    q = doc_queries(spark, sf)
    v = dense.vector_search(vectors(spark, sf), q.select("query_id", "embedding"), 8)
    b = lexical.bm25_search(index(spark, sf), q.select("query_id", "query"), 16)
    once = lambda df: fusion.best_of(df.withColumn("sub", F.lit(0)))
    return q, once(v), once(b)


@query(f"WITH {_INDEX}, {_DOCQ}, {_bm25('asked', 16)}, {_VECTOR}, {_FUSED} SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM ranked WHERE rank <= 16")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    _, v, b = _lists(spark, sf)
    return fusion.cut(fusion.fuse(v, b), 16).select("query_id", "chunk_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_INDEX}, {_DOCQ}, {_bm25('asked', 16)}, {_VECTOR}, {_FUSED},
cut AS (SELECT r.query_id, r.chunk_id, r.score, r.rank, d.source, a.own FROM ranked r JOIN documents d ON d.doc_id = r.chunk_id JOIN asked a ON a.query_id = r.query_id WHERE rank <= 16),
lift AS (SELECT *, contains(source, own) AND row_number() OVER (PARTITION BY query_id, source ORDER BY rank) = 1 AS up FROM cut),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY up DESC, rank) AS place FROM lift)
SELECT query_id, chunk_id, round(score, 9) AS score, place AS rank FROM final WHERE place <= 8""")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """The whole retrieval plan with the query document's source as the hint."""
    q, c = doc_queries(spark, sf), chunks(spark, sf)
    engine = retrieval.Engine(c, vectors(spark, sf), index(spark, sf))
    subs = q.select("query_id", F.lit(0).alias("sub"), "query")
    out, _ = retrieval.hybrid_search(engine, q.select("query_id", "query", "embedding", "source"), subs=subs, hints=F.array("source"))
    return out.select("query_id", "chunk_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


_SUBS = """subs AS (SELECT item_id, sub - 1 AS sub, string_split(text, chr(10))[sub] AS query FROM benchmark, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS sub)),
asked AS (SELECT item_id * 1000 + sub AS query_id, query FROM subs)"""


@query(f"""WITH {_INDEX}, {_SUBS}, {_bm25('asked', 16)}
SELECT query_id // 1000 AS query_id, chunk_id, round(max(score), 6) AS score, min((query_id % 1000) * 100 + rank) AS seen FROM top GROUP BY query_id // 1000, chunk_id""")
def subquery_best_score(spark: SparkSession, sf: str) -> DataFrame:
    q = bench_queries(spark, sf).select("query_id", F.posexplode(F.split("query", "\n", -1)).alias("sub", "query"))
    hits = lexical.bm25_search(index(spark, sf), q.select((F.col("query_id") * 1000 + F.col("sub")).alias("query_id"), "query"), 16)
    hits = hits.select(F.floor(F.col("query_id") / 1000).alias("query_id"), (F.col("query_id") % 1000).alias("sub"), "chunk_id", "score", "rank")
    out = fusion.best_of(hits)
    return out.select("query_id", "chunk_id", F.round("score", 6).alias("score"), (F.col("seen.sub") * 100 + F.col("seen.rank")).cast("long").alias("seen"))


@query(f"""WITH {_INDEX}, {_BENCH}, {_bm25('asked', 16)},
lift AS (SELECT t.*, source, (contains(source, 'src3') OR contains(source, 'src11')) AND row_number() OVER (PARTITION BY query_id, source ORDER BY rank) = 1 AS up FROM top t JOIN documents ON doc_id = chunk_id)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY up DESC, rank) AS rank FROM lift""")
def source_diversity(spark: SparkSession, sf: str) -> DataFrame:
    q, c = bench_queries(spark, sf), chunks(spark, sf)
    top = lexical.bm25_search(index(spark, sf), q, 16).join(c.select("chunk_id", "source_file"), "chunk_id")
    out = fusion.diversify(top, q, 16, F.array(F.lit("src3"), F.lit("src11")))
    return out.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))


@query("""WITH lines AS (SELECT doc_id, source, lang, i - 1 AS i, string_split(text, chr(10))[i] AS line FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i)),
c AS (SELECT source AS query_id, doc_id, lang, doc_id * 100000 + i AS cid, row_number() OVER (PARTITION BY source ORDER BY length(line) DESC, doc_id * 100000 + i) AS rank FROM lines),
p AS (SELECT query_id, CASE WHEN lang = 'en' THEN doc_id ELSE cid END AS chunk_id, min(rank) AS rank FROM c GROUP BY ALL)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM p""")
def parent_swap(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as children of documents; only English documents are stored as parents. Queries are sources, ranked by line length."""
    from pyspark.sql import Window

    lines = doc_lines(spark, sf).withColumn("chunk_id", F.col("doc_id") * 100000 + F.col("i"))
    w = Window.partitionBy("source").orderBy(F.desc(F.length("line")), "chunk_id")
    cands = lines.select(F.col("source").alias("query_id"), "chunk_id", F.length("line").cast("double").alias("score"), F.row_number().over(w).alias("rank"))
    parents = table(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("chunk_id"))
    out = fusion.swap_parents(cands, lines.select("chunk_id", F.col("doc_id").alias("parent_id")), parents)
    return out.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query("""WITH lines AS (SELECT doc_id, i - 1 AS i, string_split(text, chr(10))[i] AS line FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i)),
e AS (SELECT *, length(line) BETWEEN 1 AND 24 AS h FROM lines),
n AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY i) AS no, first_value(CASE WHEN h THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS one,
  last_value(CASE WHEN h THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS two FROM e),
s AS (SELECT doc_id, no, any_value(one) AS one, any_value(two) AS two, string_agg(line, chr(10) || chr(10) ORDER BY i) FILTER (trim(line) <> '') AS text FROM n WHERE NOT h GROUP BY doc_id, no)
SELECT doc_id, no::BIGINT AS section, CASE WHEN one IS NULL THEN '' WHEN no = 1 THEN trim(one) ELSE trim(one) || ' > ' || trim(two) END AS heading, text FROM s WHERE text IS NOT NULL""")
def line_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents as elements; those of 1 to 24 characters are headings without a size."""
    lines = doc_lines(spark, sf)
    heading = F.length("line").between(1, 24)
    e = lines.select(
        F.col("doc_id").cast("string").alias("path"), F.col("doc_id").cast("string").alias("source_file"), F.col("i").alias("elem_seq"), F.when(heading, "heading").otherwise("text").alias("element_type"),
        F.col("line").alias("text"), F.lit(1).alias("page"), F.lit(None).cast(schemas.BBOX).alias("bbox"), F.lit(None).cast(schemas.TABLE).alias("table_data"), F.lit(0.0).alias("font_size"), F.lit(False).alias("is_bold"),
    )
    return sections.sections(e).select(F.col("source_file").cast("long").alias("doc_id"), F.col("section").cast("long").alias("section"), F.array_join("heading_path", " > ").alias("heading"), "text")


@query()
def split_children(spark: SparkSession, sf: str) -> DataFrame:
    pieces = splitter(256, 32)
    return table(spark, sf, "documents").select("doc_id", F.posexplode(pieces(F.col("text"))).alias("i", "piece"))


# ---------------------------------------------------------------- terms and ontology

_STOP = ", ".join(f"'{t}'" for t in vocab.QUERY_STOPWORDS)
_TECH = ", ".join(f"'{t}'" for t in vocab.TECHNICAL_TERMS)
_HUB = ", ".join(f"'{t}'" for t in vocab.HUB_TERMS)


@query(rf"""WITH w AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z0-9_\-.]+') AS ws FROM benchmark),
u AS (SELECT item_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
t AS (SELECT item_id, ws[i] AS term, 2 * (i - 1) AS pos FROM u WHERE lower(ws[i]) IN ({_TECH}) OR (lower(ws[i]) NOT IN ({_STOP}) AND length(ws[i]) > 1)
  UNION ALL SELECT item_id, ws[i] || ' ' || ws[i + 1], 2 * (i - 1) + 1 FROM u WHERE i < len(ws) AND NOT (lower(ws[i]) IN ({_STOP}) AND lower(ws[i + 1]) IN ({_STOP}))),
f AS (SELECT item_id, term, min(pos) AS pos FROM t GROUP BY item_id, term)
SELECT item_id AS query_id, term, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN lower(term) IN ({_TECH}) THEN 0 WHEN lower(term) IN ({_HUB}) THEN 2 ELSE 1 END, pos, term) AS turn FROM f""")
def query_terms(spark: SparkSession, sf: str) -> DataFrame:
    return graph.candidates(bench_queries(spark, sf)).withColumn("turn", F.col("turn").cast("long"))


def _values(rows: dict[str, str], name: str) -> str:
    text = ", ".join("('{}', '{}')".format(k.replace("'", "''"), v) for k, v in rows.items())
    return f"SELECT * FROM (VALUES {text}) AS t(raw, {name})"


_TYPES = {"pin": "Pin", "Pin": "Pin", "PIN ": "Pin", "GPIO pin": "Pin", "Timer/Counter": "Peripheral", "motor driver board": "Module", "USB": "Interface", "ic": "Component", "specification": "Parameter", "concept": "Component", "strange": "Component", "": "Component", "clock generator": "Signal", "User Manual": "Document", "Register": "Register"}
_RELATIONS = {"is a": "IS_TYPE", "wired-to": "CONNECTS_TO", "HAS_PIN": "HAS_PIN", "has pin": "HAS_PIN", "!!!": "BELONGS_TO", "": "RELATED_TO", "uses": "COMMUNICATES_VIA", "controls the": "CONTROLS", "part": "PART_OF", "zzz": "RELATED_TO", "Publishes  To": "PUBLISHES_TO", "depends-on": "REQUIRES"}
_NAMES = {"adc0": "true", "ADC9": "false", "Timer1": "true", "sda": "true", " MOSI ": "true", "D13": "true", "D130": "false", "PORTA": "true", "PORTZ": "false", "TCCR1A": "true", "sensor": "false"}


@query(_values(_TYPES, "type"))
def map_entity_type(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(k,) for k in _TYPES], "raw string").withColumn("type", T.entity_type(F.col("raw")))


@query(_values(_RELATIONS, "relation"))
def map_relation_type(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(k,) for k in _RELATIONS], "raw string").withColumn("relation", T.relation_type(F.col("raw")))


@query(_values(_NAMES, "protected"))
def is_protected(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(k,) for k in _NAMES], "raw string").withColumn("protected", T.is_protected(F.col("raw")).cast("string"))


# ---------------------------------------------------------------- graph


def raw_answers(spark: SparkSession, sf: str) -> DataFrame:
    """One model answer a supplier, with defects: names too short, stopwords, repeats, self loops, unknown relations; some fenced, some broken."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    body = F.concat(
        F.lit('{"entities":[{"name":"'), "s_name", F.lit('","type":"ic"},{"name":"'), F.lower("s_name"), F.lit('","type":"pin"},{"name":"the","type":"pin"},{"name":"'), "n_name",
        F.lit('","type":"strange board"},"text",{"name":7}],"relations":[{"source":"'), "s_name", F.lit('","relation":"is a","target":"'), "n_name", F.lit('"},{"source":"'), "n_name", F.lit('","relation":"x","target":" '), F.lower("n_name"),
        F.lit(' "},{"source":"'), F.lower("s_name"), F.lit('","relation":"IS AN","target":"'), F.lower("n_name"), F.lit('"}]}'),
    )
    kind = F.length("s_name") + F.col("s_nationkey")
    raw = F.when(kind % 7 == 0, F.lit("no answer")).when(kind % 7 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind % 7 == 2, F.concat(F.lit("Sure: "), body, F.lit(" ok"))).when(kind % 7 == 3, F.lit("[]")).otherwise(body)
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("string").alias("chunk_id"), F.col("s_suppkey").cast("long").alias("chunk_ord"), F.lit("suppliers").alias("source_file"), raw.alias("raw"))


@query("""WITH s AS (SELECT s_suppkey::VARCHAR AS chunk_id, s_name, n_name, (length(s_name) + s_nationkey) % 7 AS kind FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT chunk_id, 'entity' AS what, s_name AS a, 'Component' AS b, '' AS c FROM s WHERE kind NOT IN (0, 3)
UNION ALL SELECT chunk_id, 'entity', n_name, 'Component', '' FROM s WHERE kind NOT IN (0, 3)
UNION ALL SELECT chunk_id, 'relation', s_name, 'IS_TYPE', n_name FROM s WHERE kind NOT IN (0, 3)
UNION ALL SELECT chunk_id, 'report', CASE kind WHEN 0 THEN 'skipped' WHEN 3 THEN 'error' ELSE 'ok' END, CASE WHEN kind IN (0, 3) THEN '0/0' ELSE '2/6' END, CASE WHEN kind IN (0, 3) THEN '0/0' ELSE '1/3' END FROM s""")
def extract_validate(spark: SparkSession, sf: str) -> DataFrame:
    e, r, report = graph.validate_extractions(raw_answers(spark, sf))
    share = lambda a, b: F.concat_ws("/", F.col(a).cast("string"), F.col(b).cast("string"))
    out = e.select("chunk_id", F.lit("entity").alias("what"), F.col("name").alias("a"), F.col("type").alias("b"), F.lit("").alias("c"))
    out = out.unionByName(r.select("chunk_id", F.lit("relation").alias("what"), F.col("source").alias("a"), F.col("relation").alias("b"), F.col("target").alias("c")))
    return out.unionByName(report.select("chunk_id", F.lit("report").alias("what"), F.col("state").alias("a"), share("entities_kept", "entities_raw").alias("b"), share("relations_kept", "relations_raw").alias("c")))


def entities_relations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Regions, nations, suppliers and customers as extractions: a supplier's chunk names it and its nation, and places it there."""
    t = {n: table(spark, sf, n) for n in ("region", "nation", "supplier", "customer")}
    n = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    e = lambda df, name, kind, at: df.select(F.col(at).cast("string").alias("chunk_id"), F.col(at).cast("long").alias("chunk_ord"), F.lit(0).alias("pos"), F.col(name).alias("name"), F.lit(kind).alias("type"), F.lit("tables").alias("source"))
    r = lambda df, a, rel, b, at: df.select(F.col(at).cast("string").alias("chunk_id"), F.col(at).cast("long").alias("chunk_ord"), F.lit(0).alias("pos"), F.col(a).alias("source"), F.lit(rel).alias("relation"), F.col(b).alias("target"))
    s, c = (t[x].join(t["nation"], F.col(f"{x[0]}_nationkey") == F.col("n_nationkey")) for x in ("supplier", "customer"))
    entities = e(t["region"], "r_name", "Module", "r_regionkey").unionByName(e(n, "n_name", "Component", "n_nationkey")).unionByName(e(s, "s_name", "Pin", "s_suppkey"))
    relations = r(n, "n_name", "PART_OF", "r_name", "n_nationkey").unionByName(r(s, "s_name", "BELONGS_TO", "n_name", "s_suppkey")).unionByName(r(c, "c_name", "BELONGS_TO", "n_name", "c_custkey"))
    return entities, relations


def stored_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return graph.upsert_graph(*entities_relations(spark, sf))


def written_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The graph as searches find it: computed once, as stored tables would be."""
    nodes, edges = stored_graph(spark, sf)
    return cut(nodes), cut(edges)


_GRAPH = """
ent AS (SELECT r_name AS name, 'Module' AS label, min(r_regionkey) AS created FROM region GROUP BY 1 UNION ALL SELECT n_name, 'Component', min(n_nationkey) FROM nation GROUP BY 1 UNION ALL SELECT s_name, 'Pin', min(s_suppkey) FROM supplier GROUP BY 1),
rel AS (SELECT n_name AS a, 'PART_OF' AS t, r_name AS b, n_nationkey AS o FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT s_name, 'BELONGS_TO', n_name, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT c_name, 'BELONGS_TO', n_name, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
said AS (SELECT name, min(o) AS o FROM (SELECT a AS name, o FROM rel UNION ALL SELECT b, o FROM rel) GROUP BY name),
nodes AS (SELECT label || ':' || name AS node_id, label, name, created FROM ent UNION ALL SELECT ':' || s.name, '', s.name, s.o FROM said s LEFT JOIN (SELECT name, min(created) AS created FROM ent GROUP BY name) e ON e.name = s.name WHERE e.name IS NULL OR s.o < e.created),
edges AS (SELECT x.node_id AS src_id, t AS rel_type, y.node_id AS dst_id, arg_min(o::VARCHAR, o) AS chunk_id FROM rel JOIN nodes x ON x.name = a AND x.created <= o JOIN nodes y ON y.name = b AND y.created <= o GROUP BY ALL)"""


@query(f"WITH {_GRAPH} SELECT node_id, label, name, created::BIGINT AS created FROM nodes")
def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return stored_graph(spark, sf)[0].select("node_id", "label", "name", "created")


@query(f"WITH {_GRAPH} SELECT * FROM edges")
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return stored_graph(spark, sf)[1]


@query(f"WITH {_GRAPH} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS relations")
def graph_summary(spark: SparkSession, sf: str) -> DataFrame:
    return graph.graph_summary(*stored_graph(spark, sf))


_BOTH = "both_ways AS (SELECT src_id AS a, dst_id AS b FROM edges UNION SELECT dst_id, src_id FROM edges)"


@query(f"""WITH RECURSIVE {_GRAPH}, {_BOTH}, walk AS (SELECT node_id AS start, node_id, 0 AS depth FROM nodes WHERE label = 'Module' UNION SELECT start, b, depth + 1 FROM walk JOIN both_ways ON a = node_id WHERE depth < 3)
SELECT DISTINCT start, node_id FROM walk""")
def graph_khop(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = written_graph(spark, sf)
    start = nodes.where("label = 'Module'").select(F.col("node_id").alias("start"), "node_id")
    return graph.khop(edges, start, 3, ["start"])


_ASK = "asked AS (SELECT r_regionkey AS query_id, 'Which nations are in ' || r_name || ' and who is Supplier there' AS query FROM region)"


def region_queries(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "region")
    return r.select(F.col("r_regionkey").alias("query_id"), F.concat(F.lit("Which nations are in "), "r_name", F.lit(" and who is Supplier there")).alias("query"))


_TERMS = rf"""
w AS (SELECT query_id, regexp_extract_all(query, '[A-Za-z0-9_\-.]+') AS ws FROM asked),
u AS (SELECT query_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
t AS (SELECT query_id, ws[i] AS term, 2 * (i - 1) AS pos FROM u WHERE lower(ws[i]) IN ({_TECH}) OR (lower(ws[i]) NOT IN ({_STOP}) AND length(ws[i]) > 1)
  UNION ALL SELECT query_id, ws[i] || ' ' || ws[i + 1], 2 * (i - 1) + 1 FROM u WHERE i < len(ws) AND NOT (lower(ws[i]) IN ({_STOP}) AND lower(ws[i + 1]) IN ({_STOP}))),
cands AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN lower(term) IN ({_TECH}) THEN 0 WHEN lower(term) IN ({_HUB}) THEN 2 ELSE 1 END, min(pos), term) AS turn FROM t GROUP BY query_id, term),
named AS (SELECT src_id, dst_id, x.name AS source, rel_type AS relation, y.name AS target FROM edges JOIN nodes x ON x.node_id = src_id JOIN nodes y ON y.node_id = dst_id)"""


@query(f"""WITH {_GRAPH}, {_ASK}, {_TERMS},
hit AS (SELECT query_id, turn, source, relation, target, row_number() OVER (PARTITION BY query_id, turn ORDER BY source, relation, target, src_id, dst_id) AS n
  FROM cands JOIN named ON contains(lower(source), lower(term)) OR contains(lower(target), lower(term)))
SELECT query_id, turn, source, relation, target, n FROM hit WHERE n <= 30""")
def graph_onehop(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = written_graph(spark, sf)
    out = graph.one_hop(nodes, edges, graph.candidates(region_queries(spark, sf)), 30)
    return out.select("query_id", F.col("turn").cast("long").alias("turn"), "source", "relation", "target", F.col("n").cast("long").alias("n"))


@query(f"""WITH RECURSIVE {_GRAPH}, {_BOTH}, {_ASK}, {_TERMS},
start AS (SELECT * FROM (SELECT query_id, turn, node_id, row_number() OVER (PARTITION BY query_id, turn ORDER BY name, node_id) AS k FROM cands JOIN nodes ON contains(lower(name), lower(term))) WHERE k <= 5),
walk AS (SELECT query_id, turn, node_id, 0 AS depth FROM start UNION SELECT query_id, turn, b, depth + 1 FROM walk JOIN both_ways ON a = node_id WHERE depth < 3),
reach AS (SELECT DISTINCT query_id, turn, node_id FROM walk),
inside AS (SELECT r.query_id, r.turn, n.*, row_number() OVER (PARTITION BY r.query_id, r.turn ORDER BY source, relation, target, src_id, dst_id) AS n
  FROM reach r JOIN named n ON n.src_id = r.node_id JOIN reach r2 ON r2.query_id = r.query_id AND r2.turn = r.turn AND r2.node_id = n.dst_id),
one AS (SELECT query_id, turn, source, relation, target, min(n) AS n FROM inside WHERE n <= 50 GROUP BY ALL),
five AS (SELECT *, row_number() OVER (PARTITION BY query_id, turn ORDER BY n) AS m FROM one),
uniq AS (SELECT query_id, source, relation, target, min(turn * 100 + m) AS first FROM five WHERE m <= 5 GROUP BY ALL),
rel2 AS (SELECT u.*, (SELECT 10 * (count(DISTINCT lower(term)) FILTER (contains(lower(source), lower(term))) + count(DISTINCT lower(term)) FILTER (contains(lower(target), lower(term)))) FROM cands c WHERE c.query_id = u.query_id) AS relevance FROM uniq u),
fin AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, first) AS rank FROM rel2)
SELECT query_id, source, relation, target, relevance, rank FROM fin WHERE rank <= 10""")
def triple_search(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = written_graph(spark, sf)
    out = graph.triple_search(nodes, edges, region_queries(spark, sf))
    return out.select("query_id", "source", "relation", "target", F.col("relevance").cast("long").alias("relevance"), F.col("rank").cast("long").alias("rank"))


@query()
def entity_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Part names and their plurals as nodes."""
    p = table(spark, sf, "part").select(F.lower("p_name").alias("name"))
    names = p.unionByName(p.select(F.concat("name", F.lit("s")).alias("name"))).distinct()
    return resolve.find_duplicates(names)


@query(f"""WITH {_GRAPH}, gone AS (SELECT n_name AS name, r_name AS canonical FROM nation JOIN region ON n_regionkey = r_regionkey),
to_ AS (SELECT x.node_id AS old, y.node_id AS new FROM gone JOIN nodes x USING (name) JOIN nodes y ON y.name = canonical),
m AS (SELECT coalesce(a.new, src_id) AS src_id, rel_type, coalesce(b.new, dst_id) AS dst_id, CASE WHEN a.new IS NULL AND b.new IS NULL THEN chunk_id END AS chunk_id FROM edges LEFT JOIN to_ a ON a.old = src_id LEFT JOIN to_ b ON b.old = dst_id)
SELECT src_id, rel_type, dst_id, max(chunk_id) AS chunk_id FROM m JOIN nodes x ON x.node_id = src_id JOIN nodes y ON y.node_id = dst_id WHERE x.name <> y.name GROUP BY ALL""")
def edge_redirect(spark: SparkSession, sf: str) -> DataFrame:
    """Nations merge into their regions."""
    nodes, edges = written_graph(spark, sf)
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return resolve.apply_merges(nodes, edges, n.select(F.col("n_name").alias("name"), F.col("r_name").alias("canonical")))[1]


# ---------------------------------------------------------------- resume, rerank, evaluation, prompts


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def resume_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    from kelpie.streaming.incremental import remaining

    c = chunks(spark, sf)
    left = remaining(c, table(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id")))
    return left.select(F.col("chunk_id").alias("doc_id"), F.col("source_file").alias("source"))


@query(f"""WITH {_VECTOR}, raw AS (SELECT query_id, chunk_id, score, rank, coalesce(contains(source, 'src3'), false) AS hinted FROM vec JOIN documents ON doc_id = chunk_id),
low AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM raw WINDOW w AS (PARTITION BY query_id)),
lift AS (SELECT *, CASE WHEN hinted THEN greatest(score, lo + 0.3 * (hi - lo)) ELSE score END AS s FROM low),
span AS (SELECT *, min(s) OVER w AS lo2, max(s) OVER w AS hi2 FROM lift WINDOW w AS (PARTITION BY query_id))
SELECT query_id, chunk_id, round((s - lo2) / CASE WHEN hi2 = lo2 THEN 1.0 ELSE hi2 - lo2 END, 6) AS score FROM span""")
def rerank_minmax(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    top = dense.vector_search(v, v.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding"), 8)
    raw = top.join(chunks(spark, sf).select("chunk_id", "source_file"), "chunk_id").select("query_id", "chunk_id", F.col("score").alias("raw"), F.col("source_file").contains("src3").alias("hinted"))
    return fusion.rerank_scores(raw).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_INDEX}, {_BENCH}, {_bm25('asked', 8)},
truth AS (SELECT item_id AS query_id, item_id % 5 + 1 AS level, ['src' || (item_id % 20), 'src' || ((item_id + 7) % 20)] AS srcs, string_split(lower(text), ' ')[1:3] AS ents FROM benchmark),
got AS (SELECT query_id, list(DISTINCT source) AS files, lower(string_agg(text, ' ' ORDER BY rank)) AS texts, arg_min(score, rank) AS top_score FROM top JOIN documents ON doc_id = chunk_id GROUP BY query_id),
s AS (SELECT level, len(list_filter(srcs, lambda x: len(list_filter(coalesce(files, []), lambda f: contains(f, x))) > 0))::DOUBLE / greatest(len(srcs), 1) AS sr,
  len(list_filter(ents, lambda e: contains(coalesce(texts, '') || ' ', e)))::DOUBLE / greatest(len(ents), 1) AS er, coalesce(top_score, 0) AS ts FROM truth LEFT JOIN got USING (query_id))
SELECT level, count(*) AS queries, round(avg(sr), 6) AS source_recall, round(avg(er), 6) AS entity_recall, round(avg(ts), 6) AS top_score FROM s GROUP BY ROLLUP (level)""")
def benchmark_rollup(spark: SparkSession, sf: str) -> DataFrame:
    q, c, b = bench_queries(spark, sf), chunks(spark, sf), table(spark, sf, "benchmark")
    top = lexical.bm25_search(index(spark, sf), q, 8).join(c.select("chunk_id", "source_file", "text"), "chunk_id")
    src = lambda n: F.concat(F.lit("src"), ((F.col("item_id") + n) % 20).cast("string"))
    truth = b.select(F.col("item_id").alias("query_id"), (F.col("item_id") % 5 + 1).alias("level"), F.array(src(0), src(7)).alias("expected_source"), F.slice(F.split(F.lower("text"), " "), 1, 3).alias("expected_entities"))
    out = evaluate.summarize(evaluate.evaluate(truth, top))
    return out.select("level", "queries", *[F.round(c, 6).alias(c) for c in ("source_recall", "entity_recall", "top_score")])




@query("""WITH b AS (SELECT doc_id, doc_id % 7 AS page, (doc_id * 37 % 500)::DOUBLE AS x0, (doc_id * 53 % 700)::DOUBLE AS y0 FROM documents),
t AS (SELECT item_id % 7 AS page, (item_id * 41 % 500)::DOUBLE AS x0, (item_id * 59 % 700)::DOUBLE AS y0 FROM benchmark)
SELECT doc_id FROM b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.page = b.page AND b.x0 < t.x0 + 60 AND b.x0 + 20 > t.x0 AND b.y0 < t.y0 + 60 AND b.y0 + 20 > t.y0)""")
def overlap_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    def boxes(df: DataFrame, key: str, a: int, b: int, size: int) -> DataFrame:
        x, y = (F.col(key) * a % 500).cast("double"), (F.col(key) * b % 700).cast("double")
        return df.select(F.col(key), F.lit("f").alias("source_file"), (F.col(key) % 7).alias("page"), F.struct(x.alias("x0"), y.alias("y0"), (x + size).alias("x1"), (y + size).alias("y1")).alias("bbox"))

    return layout.outside_tables(boxes(table(spark, sf, "documents"), "doc_id", 37, 53, 20), boxes(table(spark, sf, "benchmark"), "item_id", 41, 59, 60)).select("doc_id")


@query("""WITH r AS (SELECT source AS query_id, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
c AS (SELECT query_id, string_agg('[' || rank || '] score=' || printf('%.3f', 1.0 / rank) || ' | ' || query_id || ' | page ' || doc_id || chr(10) || trim(text, ' ' || chr(10) || chr(9) || chr(13)) || chr(10), chr(10) ORDER BY rank) AS texts FROM r WHERE rank <= 8 GROUP BY query_id)
SELECT query_id, '## Retrieved document context' || chr(10) || chr(10) || texts AS context FROM c""")
def context_block(spark: SparkSession, sf: str) -> DataFrame:
    """Per source, its eight longest documents as a context."""
    from pyspark.sql import Window

    d = table(spark, sf, "documents")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    r = d.select(F.col("source").alias("query_id"), F.col("source").alias("source_file"), F.col("doc_id").alias("page_number"), "text", rank.alias("rank")).where("rank <= 8").withColumn("score", 1.0 / F.col("rank"))
    none = spark.createDataFrame([], "query_id string, rank int, source string, relation string, target string")
    return answer.context_block(r, none, r.select("query_id").distinct())


_CASUAL = ", ".join("'" + t.replace("'", "''") + "'" for t in vocab.CASUAL)


@query(f"SELECT conv_id, turn, trim(rtrim(trim(lower(text), ' ' || chr(10)), '!?.'), ' ' || chr(10)) IN ({_CASUAL}) AS casual FROM conversations")
def casual_gate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", T.is_casual(F.col("text")).alias("casual"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' THEN '' ELSE trim(text, ' ' || chr(10)) END AS thought, CASE WHEN role = 'user' THEN 'finish' ELSE 'vector_search' END AS action,
CASE WHEN role = 'user' THEN trim(text, ' ' || chr(10)) ELSE 'find ' || conv_id END AS action_input FROM conversations""")
def agent_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as an agent's answers: those of users are free text, others follow the form."""
    c = table(spark, sf, "conversations")
    said = F.when(F.col("role") == "user", F.col("text")).otherwise(F.concat(F.lit("Thought: "), "text", F.lit("\nAction: vector_search\nAction Input: find "), F.col("conv_id").cast("string"), F.lit("\n")))
    return c.select("conv_id", "turn", T.agent_step(said).alias("s")).select("conv_id", "turn", "s.thought", "s.action", "s.action_input")


@query("SELECT sum(length(text))::BIGINT AS tokens_in, sum(length(role))::BIGINT AS tokens_out, round(sum(length(text)) / 1e6 * 0.15 + sum(length(role)) / 1e6 * 0.6, 4) AS cost FROM conversations")
def token_usage(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select(F.length("text").cast("long").alias("tokens_in"), F.length("role").cast("long").alias("tokens_out"))
    return evaluate.token_usage(c)
