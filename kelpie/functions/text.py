"""Column expressions for names, terms, relations and model output."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from kelpie import vocab

_BLANK = r"(?U)[\s\x1c-\x1f]"


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends (trim() takes spaces only)."""
    return F.regexp_replace(x, rf"^{_BLANK}+|{_BLANK}+$", "")


def is_blank(x: Column) -> Column:
    return F.coalesce(strip(x) == "", F.lit(True))


def lookup(table: Mapping[str, str], x: Column) -> Column:
    """table[x], or null. A map literal: it is built once, on the driver."""
    pairs = [F.lit(v) for item in table.items() for v in item]
    return F.try_element_at(F.create_map(*pairs), x)


def inverse(groups: Mapping[str, Sequence[str]]) -> dict[str, str]:
    return {alias: name for name, aliases in groups.items() for alias in aliases}


# ---------------------------------------------------------------- lexical terms


def lexical_tokens(text: Column, keep: Sequence[str] = vocab.LEXICAL_KEEP) -> Column:
    """Lower-case runs of letters, digits and slashes; short ones only if they are in `keep`."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9][a-z0-9/]*"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 2) | t.isin(*keep))


def query_terms(query: Column, technical: Sequence[str] = vocab.TECHNICAL_TERMS, stop: Sequence[str] = vocab.QUERY_STOPWORDS) -> Column:
    """array<struct<term, pos>> of a query's candidate terms, distinct, each with its first position.

    Words that are technical or no stopwords of one letter or more, and pairs of neighbours unless both are stopwords. A pair
    stands half a step after its first word.
    """
    words = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(r"[A-Za-z0-9_\-.]+"), F.lit(0))

    def fits(w: Column) -> Column:
        low = F.lower(w)
        return low.isin(*technical) | (~low.isin(*stop) & (F.length(w) > 1))

    singles = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("term"), (2 * i).alias("pos"))), lambda x: fits(x.term))
    pairs = F.transform(words, lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1)).alias("term"), (2 * i + 1).alias("pos"), (F.lower(w).isin(*stop) & F.lower(F.get(words, i + 1)).isin(*stop)).alias("dull")))
    pairs = F.filter(F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda x: ~x.dull)
    # equal terms stand side by side once sorted; the array is bound to a name, as a lambda would work it out anew for each element
    by_term = F.array_sort(F.concat(singles, F.transform(pairs, lambda x: F.struct(x.term.alias("term"), x.pos.alias("pos")))))
    first = F.get(F.transform(F.array(by_term), lambda b: F.filter(b, lambda x, i: (i == 0) | (F.get(b, i - 1).term != x.term))), F.lit(0))
    in_order = F.array_sort(F.transform(first, lambda x: F.struct(x.pos.alias("pos"), x.term.alias("term"))))
    return F.transform(in_order, lambda x: F.struct(x.term.alias("term"), x.pos.alias("pos")))


def term_class(term: Column) -> Column:
    """0 technical, 1 general, 2 hub: the order in which candidates are served."""
    low = F.lower(term)
    return F.when(low.isin(*vocab.TECHNICAL_TERMS), 0).when(low.isin(*vocab.HUB_TERMS), 2).otherwise(1)


def source_hints(query: Column, hints: Mapping[str, Sequence[str]] = vocab.SOURCE_HINTS) -> Column:
    """array<string>, sorted and distinct: parts of source names that a query's words point to (plain substrings)."""
    low = F.lower(F.coalesce(query, F.lit("")))
    lists = [F.when(low.contains(term), F.array(*map(F.lit, parts))).otherwise(F.array().cast("array<string>")) for term, parts in hints.items()]
    return F.array_sort(F.array_distinct(F.concat(*lists))) if lists else F.array().cast("array<string>")


# ---------------------------------------------------------------- ontology


def is_protected(name: Column, patterns: Sequence[str] = vocab.PROTECTED) -> Column:
    return F.coalesce(strip(name).rlike("(?i)^(?:" + "|".join(patterns) + ")$"), F.lit(False))


def entity_type(raw: Column) -> Column:
    """The canonical type: canonical as it stands, else by alias, else by the first keyword it contains, else the default."""
    low = F.lower(strip(raw))
    keyword = F.lit(None).cast("string")
    for word, kind in reversed(vocab.TYPE_KEYWORDS):
        keyword = F.when(low.contains(word), kind).otherwise(keyword)
    mapped = F.coalesce(lookup(inverse(vocab.TYPE_ALIASES), low), keyword, F.lit(vocab.DEFAULT_ENTITY_TYPE))
    return F.when(raw.isin(*vocab.ENTITY_TYPES), raw).when(F.coalesce(raw, F.lit("")) == "", vocab.DEFAULT_ENTITY_TYPE).otherwise(mapped)


def normal_relation(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(raw), "[^A-Z0-9]+", "_"), "^_+|_+$", "")


def relation_type(raw: Column) -> Column:
    """The canonical relation: as it stands, else by alias of its normal form, else by containment either way.

    Containment goes through the relations in alphabetical order (an order that the rule itself leaves open), so an empty normal form,
    which everything contains, gives the first of them.
    """
    n = normal_relation(raw)
    near = F.lit(None).cast("string")
    for kind in sorted(vocab.RELATION_TYPES, reverse=True):
        near = F.when(n.contains(kind) | F.lit(kind).contains(n), kind).otherwise(near)
    mapped = F.coalesce(lookup(inverse(vocab.RELATION_ALIASES), n), F.when(n.isin(*vocab.RELATION_TYPES), n), near, F.lit(vocab.DEFAULT_RELATION_TYPE))
    return F.when(raw.isin(*vocab.RELATION_TYPES), raw).when(F.coalesce(raw, F.lit("")) == "", vocab.DEFAULT_RELATION_TYPE).otherwise(mapped)


def valid_name(name: Column) -> Column:
    s = strip(F.coalesce(name, F.lit("")))
    return (F.length(s) >= 2) & ~F.lower(s).isin(*vocab.NAME_STOPWORDS) & ~s.rlike(r"(?U)^\d+$")


def valid_relation(source: Column, relation: Column, target: Column) -> Column:
    empty = (F.coalesce(source, F.lit("")) == "") | (F.coalesce(relation, F.lit("")) == "") | (F.coalesce(target, F.lit("")) == "")
    return ~empty & (F.lower(strip(source)) != F.lower(strip(target)))


def edge_label(relation: Column) -> Column:
    """Upper case, letters and underscores only."""
    return F.coalesce(F.nullif(F.regexp_replace(F.replace(F.upper(relation), F.lit(" "), F.lit("_")), "[^A-Z_]", ""), F.lit("")), F.lit(vocab.DEFAULT_RELATION_TYPE))


def node_label(kind: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(kind, r"[^\p{L}\p{N}]", ""), F.lit("")), F.lit(vocab.DEFAULT_ENTITY_TYPE))


def triple_text(source: Column, relation: Column, target: Column) -> Column:
    return F.concat(source, F.lit(" --["), relation, F.lit("]--> "), target)


# ---------------------------------------------------------------- model output


def clean_json(raw: Column) -> Column:
    return strip(F.regexp_replace(raw, "```(?:json)?", ""))


def tolerant_json(raw: Column) -> Column:
    """VARIANT of a model's answer: without code fences, else what stands between the first and the last brace, else null."""
    clean = clean_json(raw)
    inner = F.regexp_extract(clean, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(clean), F.try_parse_json(F.nullif(inner, F.lit(""))))


def agent_step(text: Column) -> Column:
    """struct<thought, action, action_input> of an agent's answer; without an action the whole answer ends the run."""
    thought = strip(F.regexp_extract(text, r"(?s)Thought:\s*(.+?)(?=\nAction:|\z)", 1))
    action = F.regexp_extract(text, r"(?U)Action:\s*(\w+)", 1)
    given = strip(F.regexp_extract(text, r"(?s)Action Input:\s*(.+?)(?=Thought:|Observation:|\n?\z)", 1))
    none = action == ""
    return F.struct(thought.alias("thought"), F.when(none, "finish").otherwise(action).alias("action"), F.when(none, strip(text)).otherwise(given).alias("action_input"))


def casual_key(query: Column) -> Column:
    return strip(F.regexp_replace(F.lower(strip(query)), "[!?.]+$", ""))


def is_casual(query: Column) -> Column:
    return F.coalesce(casual_key(query).isin(*vocab.CASUAL), F.lit(False))


def casual_reply(query: Column, replies: Mapping[str, str] = vocab.CASUAL_REPLIES, default: str = vocab.CASUAL_DEFAULT) -> Column:
    return F.coalesce(lookup(replies, casual_key(query)), F.lit(default))


def token_cost(tokens_in: Column, tokens_out: Column, price_in: float = 0.15, price_out: float = 0.60) -> Column:
    """Prices are for a million tokens."""
    return F.round(tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out, 4)
