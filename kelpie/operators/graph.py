"""Knowledge graph: validation of extractions, upserts, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.config import DEFAULT, Settings
from kelpie.functions.text import clean_json, edge_label, entity_type, is_protected, node_label, query_terms, relation_type, strip, term_class, tolerant_json, valid_name, valid_relation
from kelpie.operators.durable import cut

# ---------------------------------------------------------------- validation


def _plain(v: str) -> str:
    """SQL for the text of a VARIANT as a Python program would print it: null as None, booleans with a capital, missing as empty."""
    kind = f"schema_of_variant({v})"
    return f"CASE WHEN {v} IS NULL THEN '' WHEN {kind} = 'VOID' THEN 'None' WHEN {kind} = 'BOOLEAN' THEN initcap(variant_get({v}, '$', 'string')) ELSE variant_get({v}, '$', 'string') END"


def _numbered(v: str) -> str:
    """As _plain, but a whole number written with a fraction keeps it."""
    return f"CASE WHEN {v} IS NOT NULL AND schema_of_variant({v}) RLIKE '^(DOUBLE|FLOAT|DECIMAL)' AND variant_get({v}, '$', 'string') RLIKE '^-?[0-9]+$' THEN concat(variant_get({v}, '$', 'string'), '.0') ELSE {_plain(v)} END"


def parse(raw: DataFrame) -> DataFrame:
    """raw(chunk_id, chunk_ord, source_file, raw) with v (VARIANT) and state: ok, skipped (no JSON), error (no object, or a list that is none)."""
    df = raw.withColumn("v", tolerant_json(F.col("raw")))

    def listed(name: str) -> Column:
        # a missing list is an empty one; JSON's null is not
        x = f"try_variant_get(v, '$.{name}', 'variant')"
        return F.expr(f"{x} IS NULL") | F.coalesce(F.expr(f"schema_of_variant({x})").startswith("ARRAY"), F.lit(False))

    good = F.expr("schema_of_variant(v)").startswith("OBJECT") & listed("entities") & listed("relations")
    return df.withColumn("state", F.when(F.col("v").isNull(), "skipped").when(good, "ok").otherwise("error"))


def _items(parsed: DataFrame, name: str, fields: tuple[str, ...]) -> DataFrame:
    at = parsed.where("state = 'ok'").select("chunk_id", "chunk_ord", "source_file", F.expr(f"try_variant_get(v, '$.{name}', 'array<variant>')").alias("xs"))
    out = at.select("chunk_id", "chunk_ord", "source_file", F.posexplode("xs").alias("pos", "x")).where(F.expr("schema_of_variant(x)").startswith("OBJECT"))
    return out.select("chunk_id", "chunk_ord", "source_file", "pos", *[strip(F.expr(_numbered(f"variant_get(x, '$.{f}')"))).alias(f) for f in fields])


def _first(df: DataFrame, keys: list[Column]) -> DataFrame:
    w = Window.partitionBy("chunk_id", *keys).orderBy("pos")
    return df.withColumn("_n", F.row_number().over(w))


def validate_extractions(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, report) of raw model answers.

    Entities and relations that pass are kept once a chunk (case aside), the first standing; the report counts raw and kept ones, lists
    what was discarded and why, and says whether to ask again (nothing parsed, or nothing in it).
    """
    parsed = parse(raw)
    e = _items(parsed, "entities", ("name", "type")).withColumn("ok", valid_name(F.col("name")))
    e = _first(e, ["ok", F.lower("name")]).withColumn("kept", F.col("ok") & (F.col("_n") == 1))
    entities = e.where("kept").select("chunk_id", "chunk_ord", "pos", "name", entity_type(F.col("type")).alias("type"), F.col("source_file").alias("source"))
    r = _items(parsed, "relations", ("source", "relation", "target"))
    fault = F.when(~valid_relation(F.col("source"), F.col("relation"), F.col("target")), "invalid").when(~valid_name(F.col("source")), "bad_source").when(~valid_name(F.col("target")), "bad_target")
    r = r.withColumn("fault", fault).withColumn("canon", relation_type(F.col("relation")))
    r = _first(r, ["fault", F.lower("source"), "canon", F.lower("target")]).withColumn("kept", F.col("fault").isNull() & (F.col("_n") == 1))
    relations = r.where("kept").select("chunk_id", "chunk_ord", "pos", "source", F.col("canon").alias("relation"), "target")
    gone_e = e.where("not kept").groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.concat(F.when(F.col("ok"), "duplicate:'").otherwise("invalid_name:'"), "name", F.lit("'")))).alias("discarded_entities"))
    gone_r = r.where("not kept").groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.concat(F.coalesce("fault", F.lit("duplicate")), F.lit(":"), F.concat_ws("-", "source", "relation", "target")))).alias("discarded_relations"))
    size = lambda name: F.when(F.col("state") == "ok", F.coalesce(F.size(F.expr(f"try_variant_get(v, '$.{name}', 'array<variant>')")), F.lit(0))).otherwise(0)
    report = parsed.select("chunk_id", "state", F.greatest(size("entities"), F.lit(0)).alias("entities_raw"), F.greatest(size("relations"), F.lit(0)).alias("relations_raw"))
    kept = lambda df, name: df.groupBy("chunk_id").agg(F.count("*").alias(name))
    for x in (kept(entities, "entities_kept"), kept(relations, "relations_kept"), gone_e, gone_r):
        report = report.join(x, "chunk_id", "left")
    report = report.fillna(0, ["entities_kept", "relations_kept"]).withColumn("parse_ok", F.col("state") != "skipped")
    retry = ~F.col("parse_ok") | ((F.col("state") == "ok") & (F.col("entities_raw") == 0) & (F.col("relations_raw") == 0))
    return entities, relations, report.withColumn("needs_retry", retry)


def lenient(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities(chunk_id, pos, name, label), relations(chunk_id, pos, source, relation, target)) of raw answers, without an ontology.

    For trying prompts out: an entity may be a bare string (label Entity), labels are the type's words in capitals, nothing is deduplicated.
    An answer that is no JSON object as it stands (code fences aside) gives nothing, nor does a name that is no text.
    """
    v = raw.withColumn("v", F.try_parse_json(clean_json(F.col("raw")))).where(F.expr("schema_of_variant(v)").startswith("OBJECT"))
    items = lambda name: v.select("chunk_id", F.posexplode(F.expr(f"try_variant_get(v, '$.{name}', 'array<variant>')")).alias("pos", "x"))
    text = lambda f: F.expr(f"CASE WHEN schema_of_variant(try_variant_get(x, '$.{f}', 'variant')) = 'STRING' THEN try_variant_get(x, '$.{f}', 'string') END")
    bare = F.expr("CASE WHEN schema_of_variant(x) = 'STRING' THEN variant_get(x, '$', 'string') END")
    # a letter behind anything but a letter is a capital
    words = F.initcap(F.regexp_replace(strip(F.coalesce(text("type"), F.lit("Entity"))), r"([^\p{L}])", "$1 "))
    label = F.coalesce(F.nullif(F.regexp_replace(words, "[^A-Za-z0-9]", ""), F.lit("")), F.lit("Entity"))
    entities = items("entities").select("chunk_id", "pos", strip(F.coalesce(bare, F.nullif(text("name"), F.lit("")))).alias("name"), F.when(bare.isNotNull(), "Entity").otherwise(label).alias("label"), bare.isNotNull().alias("bare"))
    entities = entities.where("name IS NOT NULL AND (name <> '' OR NOT bare)").drop("bare")
    relations = items("relations").where((text("source") != "") & (text("target") != ""))
    return entities, relations.select("chunk_id", "pos", strip(text("source")).alias("source"), edge_label(F.coalesce(text("relation"), F.lit(""))).alias("relation"), strip(text("target")).alias("target"))


def drawing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line): the graph in the DOT language, a line a node and a line an edge; wrap them in `digraph { ... }`."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('\\"')), F.lit('"'))
    node = nodes.select(F.concat(quoted("node_id"), F.lit(" [label="), quoted("name"), F.lit("]")).alias("line"))
    return node.unionByName(edges.select(F.concat(quoted("src_id"), F.lit(" -> "), quoted("dst_id"), F.lit(" [label="), quoted("rel_type"), F.lit("]")).alias("line")))


# ---------------------------------------------------------------- upserts


def upsert_graph(entities: DataFrame, relations: DataFrame, old_nodes: DataFrame | None = None, old_edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after all chunks in order, added to old ones. Columns as in schemas.NODES and schemas.EDGES; created is the order of the chunk.

    A node is (label, name): the first chunk creates it, the last sets source, type and protected. A relation attaches to every node of its end's
    name that exists by its chunk (a chunk's entities come first); where none does, it creates one without a label. An edge is (source node, type,
    target node) and keeps its first chunk.
    """
    e = entities.select("chunk_ord", "pos", "name", "source", F.col("type").alias("entity_type"), node_label(F.col("type")).alias("label"))
    at = F.struct("chunk_ord", "pos")
    new = e.groupBy("label", "name").agg(F.min("chunk_ord").alias("created"), F.max_by("source", at).alias("source"), F.max_by("entity_type", at).alias("entity_type"))
    r = relations.select("chunk_id", "chunk_ord", "pos", "source", edge_label(F.col("relation")).alias("rel_type"), "target")
    old = None if old_nodes is None else old_nodes.select("label", "name", F.lit(-1).cast("long").alias("created"), F.col("created").alias("was"), "source", "entity_type")
    known = new.select("label", "name", "created") if old is None else new.select("label", "name", "created").unionByName(old.select("label", "name", "created")).groupBy("label", "name").agg(F.min("created").alias("created"))
    ends = r.select("chunk_ord", F.col("source").alias("name")).unionByName(r.select("chunk_ord", F.col("target").alias("name"))).groupBy("name").agg(F.min("chunk_ord").alias("mentioned"))
    bare = ends.join(known.groupBy("name").agg(F.min("created").alias("known")), "name", "left").where("known IS NULL OR mentioned < known").select(F.lit("").alias("label"), "name", F.col("mentioned").alias("created"))
    every = known.unionByName(bare).groupBy("label", "name").agg(F.min("created").alias("created"))
    node_id = F.concat_ws(":", "label", "name")
    info = new.select("label", "name", "source", "entity_type")
    nodes = every.join(info, ["label", "name"], "left")
    if old is not None:
        back = old.select("label", "name", "was", F.col("source").alias("_s"), F.col("entity_type").alias("_t"))
        nodes = nodes.join(back, ["label", "name"], "left").withColumn("source", F.coalesce("source", "_s")).withColumn("entity_type", F.coalesce("entity_type", "_t")).withColumn("created", F.coalesce("was", "created"))
    nodes = nodes.select(node_id.alias("node_id"), "label", "name", "source", "entity_type", F.col("created").cast("long").alias("created"), F.when(F.col("label") != "", is_protected(F.col("name"))).alias("protected"))
    by = every.select(node_id.alias("id"), "name", "created")
    a, b = by.alias("a"), by.alias("b")
    met = r.join(a, (F.col("a.name") == F.col("source")) & (F.col("a.created") <= F.col("chunk_ord"))).join(b, (F.col("b.name") == F.col("target")) & (F.col("b.created") <= F.col("chunk_ord")))
    edges = met.groupBy(F.col("a.id").alias("src_id"), "rel_type", F.col("b.id").alias("dst_id")).agg(F.min_by("chunk_id", F.struct("chunk_ord", "pos")).alias("chunk_id"))
    if old_edges is not None:
        edges = edges.withColumn("_new", F.lit(1)).unionByName(old_edges.withColumn("_new", F.lit(0))).groupBy("src_id", "rel_type", "dst_id").agg(F.min_by("chunk_id", "_new").alias("chunk_id"))
    return nodes, edges


def duplicate_nodes(nodes: DataFrame) -> DataFrame:
    """The uniqueness check: (label, name) that occur more than once."""
    return nodes.groupBy("label", "name").agg(F.count("*").alias("n")).where("n > 1")


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("relations")))


# ---------------------------------------------------------------- search


def candidates(queries: DataFrame) -> DataFrame:
    """(query_id, term, turn): a query's candidate terms, technical ones first and hubs last, else as they stand in the query."""
    t = queries.select("query_id", F.explode(query_terms(F.col("query"))).alias("x")).select("query_id", "x.term", "x.pos")
    w = Window.partitionBy("query_id").orderBy(term_class(F.col("term")), "pos", "term")
    return t.select("query_id", "term", F.row_number().over(w).alias("turn"))  # a few dozen rows a query


def matching_nodes(nodes: DataFrame, cands: DataFrame, limit: int | None) -> DataFrame:
    """(query_id, turn, node_id): nodes whose name contains the term, case aside; the first `limit` by name and id.

    The batch of terms is the small side: distinct terms are broadcast to the nodes when they are few (2,000 by count), else they
    are cut to three letters and joined with the names' runs of three, which every containing name has.
    """
    terms = cands.select(F.lower("term").alias("low")).distinct()
    n = nodes.where("name is not null").select("node_id", "name", F.lower("name").alias("lname"))
    if terms.limit(2001).count() <= 2000:
        met = n.join(F.broadcast(terms), F.col("lname").contains(F.col("low")))
    else:
        # terms of one or two characters (letters, digits, three marks) are some 1,500 different ones at most
        short = n.join(F.broadcast(terms.where("length(low) < 3")), F.col("lname").contains(F.col("low")))
        grams = n.withColumn("g", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("lname") - 2, F.lit(1))), lambda i: F.substring(F.col("lname"), i, F.lit(3))))))
        long = grams.join(terms.where("length(low) >= 3").withColumn("g", F.substring("low", 1, 3)), "g").where(F.col("lname").contains(F.col("low"))).drop("g")
        met = short.unionByName(long.select(*short.columns))
    if limit is not None:
        w = Window.partitionBy("low").orderBy("name", "node_id")
        met = met.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit)
    return cands.select("query_id", "turn", F.lower("term").alias("low")).join(met.select("low", "node_id"), "low").select("query_id", "turn", "node_id")


def khop(edges: DataFrame, start: DataFrame, hops: int, keys: list[str]) -> DataFrame:
    """(keys, node_id): nodes within `hops` steps of start(keys, node_id), either way, start included.

    Each step's front is written to the checkpoint folder, so the plan doesn't double with every hop; only new nodes go on.
    """
    both = edges.select(F.col("src_id").alias("node_id"), F.col("dst_id").alias("next")).unionByName(edges.select(F.col("dst_id").alias("node_id"), F.col("src_id").alias("next"))).distinct()
    front = reached = cut(start.select(*keys, "node_id").distinct())
    for _ in range(hops):
        step = front.join(both, "node_id").select(*keys, F.col("next").alias("node_id")).distinct()
        front = cut(step.join(reached, [*keys, "node_id"], "left_anti"))
        reached = reached.unionByName(front)
    return reached


def _named(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.select(F.col("node_id"), "name")
    a, b = n.select(F.col("node_id").alias("src_id"), F.col("name").alias("source")), n.select(F.col("node_id").alias("dst_id"), F.col("name").alias("target"))
    return edges.select("src_id", "rel_type", "dst_id").join(a, "src_id").join(b, "dst_id").select("src_id", "dst_id", "source", F.col("rel_type").alias("relation"), "target")


def expand_triples(nodes: DataFrame, edges: DataFrame, start: DataFrame, hops: int, limit: int) -> DataFrame:
    """(query_id, turn, source, relation, target, n): edges among what each turn reaches, in order of their parts, `limit` of them at most."""
    reach = khop(edges, start, hops, ["query_id", "turn"])
    inside = reach.withColumnRenamed("node_id", "src_id").join(edges.select("src_id", "rel_type", "dst_id"), "src_id").join(reach.withColumnRenamed("node_id", "dst_id"), ["query_id", "turn", "dst_id"])
    names = nodes.select("node_id", "name")
    out = inside.join(names.select(F.col("node_id").alias("src_id"), F.col("name").alias("source")), "src_id").join(names.select(F.col("node_id").alias("dst_id"), F.col("name").alias("target")), "dst_id")
    w = Window.partitionBy("query_id", "turn").orderBy("source", "rel_type", "target", "src_id", "dst_id")
    return out.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).select("query_id", "turn", "source", F.col("rel_type").alias("relation"), "target", "n")


def one_hop(nodes: DataFrame, edges: DataFrame, cands: DataFrame, limit: int = 30) -> DataFrame:
    """The search without expansion: edges one of whose ends contains the term."""
    met = matching_nodes(nodes, cands, None)
    named = _named(nodes, edges)
    hit = met.withColumnRenamed("node_id", "src_id").join(named, "src_id").unionByName(met.withColumnRenamed("node_id", "dst_id").join(named, "dst_id"), allowMissingColumns=True).distinct()
    w = Window.partitionBy("query_id", "turn").orderBy("source", "relation", "target", "src_id", "dst_id")
    return hit.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).select("query_id", "turn", "source", "relation", "target", "n")


def triple_search(nodes: DataFrame, edges: DataFrame, queries: DataFrame, k: int | None = None, s: Settings = DEFAULT, expand: bool = True) -> DataFrame:
    """(query_id, source, relation, target, score, relevance, rank): the k triples that mention most of a query's terms.

    Each term brings its first five different triples; a triple's relevance is 10 for each term (case aside) in its source and
    again in its target; ties keep the order in which terms were served.
    """
    k = s.graph_k if k is None else k
    cands = candidates(queries)
    if expand:
        found = expand_triples(nodes, edges, matching_nodes(nodes, cands, s.nodes_per_candidate), s.hops, s.edges_per_candidate)
    else:
        found = one_hop(nodes, edges, cands, s.edges_one_hop)
    one = found.groupBy("query_id", "turn", "source", "relation", "target").agg(F.min("n").alias("n"))
    five = one.withColumn("m", F.row_number().over(Window.partitionBy("query_id", "turn").orderBy("n"))).where(F.col("m") <= s.triples_per_candidate)
    unique = five.groupBy("query_id", "source", "relation", "target").agg(F.min(F.struct("turn", "m")).alias("first"))
    terms = cands.groupBy("query_id").agg(F.collect_set(F.lower("term")).alias("terms"))
    hits = lambda c: F.size(F.filter("terms", lambda t: F.lower(c).contains(t)))
    out = unique.join(terms, "query_id").withColumn("relevance", 10 * (hits("source") + hits("target")))
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "first")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "source", "relation", "target", F.lit(1.0).alias("score"), "relevance", "rank")


def entity_context(nodes: DataFrame, edges: DataFrame, names: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Relations one step around the nodes whose names contain names(query_id, name)."""
    cands = names.select("query_id", F.col("name").alias("term"), F.lit(1).alias("turn"))
    return expand_triples(nodes, edges, matching_nodes(nodes, cands, s.nodes_per_candidate), 1, s.edges_per_candidate)
