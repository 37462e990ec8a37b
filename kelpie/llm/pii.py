"""Personal data by weak supervision, with DataFrame expressions only.

Candidate spans come from patterns. Three labelers vote on each (yes, no or nothing): the shape of the value, a
gazetteer of known parts (mail suffixes, country codes, card issuers, key names), and the words before it.
Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is per kind, and
a final logistic classifier is trained on the estimated truth over votes and shape features. What is counted has
a fixed number of patterns, so what reaches the driver does not grow with the corpus.

Base spans (the four contract kinds with their own checks) always stay; the classifier adds spans. A null text is empty.
Spans are code points, end exclusive. Nothing is collected from hot rows: every row is worked on alone, so repeated rows get equal
spans, and a text takes steps in proportion to its length and its matches. Input columns may have any name. A table without rows
teaches nothing and gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of the base kinds. They match what the plain forms match, leftmost and non-overlapping, but can't backtrack:
#: a run of letters that could start an address is tried from its beginning only (or from the end of the match before).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Patterns of further candidates, on which only the classifier decides.
MORE = {
    "secret": r"(?<![A-Za-z0-9_])(?:(?i:pass(?:word|wd|phrase)?|pwd|secret|token|credentials?|(?:(?:api|access|private|secret|auth)[_-]?)?key|authorization)[\"']?\x20{0,3}(?:[=:]|is\x20)\x20{0,3}(?:[Bb]earer\x20)?[\"']?[A-Za-z0-9_/+.=~-]{8,}+[\"']?"
    r"|A[KS]IA[A-Z0-9]{16}|[spr]k[_-](?:live[_-]|test[_-])?[A-Za-z0-9]{16,}+|gh[pousr]_[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]++)?|-----BEGIN\x20[A-Z\x20]{0,30}PRIVATE\x20KEY-----)",
    "number": r"(?<![0-9+.-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9.-])",
}
KINDS = (*BASE, *MORE)
LEAF = 512
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?!0)(?:[0-9]{1,2}|1[0-9]{2}|2[01][0-9]|22[0-3])\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": r"^(?:(?i:pass|pwd|secret|token|credential|api|access|private|auth)|A[KS]IA|[spr]k[_-]|gh[pousr]_|xox|eyJ|-----)",
    "number": r"^\(?(?!000|666|9)[2-8]",
}
CONTEXT = {
    "email": r"(?i)(?:mail|contact|correo|courriel|write|from|to)\W*$", "ip": r"(?i)(?:ip|host|server|address|addr|from)\W*$", "card": r"(?i)(?:card|visa|karte|carte|tarjeta|pay|number)\W*$",
    "phone": r"(?i)(?:phone|call|tel|fax|mobile|telefon|number)\W*$", "secret": r"(?i)(?:key|login|user|auth|env|export)\W*$", "number": r"(?i)(?:ssn|social|phone|call|tel|fax|security)\W*$",
}
AGAINST = r"(?i)(?:version|v|isbn|issn|order|page|figure|section|no|nr|id)[.:#]?\s*$"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]+", "")


def luhn(x: Column) -> Column:
    """Whether the digits of x pass the Luhn check."""
    d = F.reverse(digits(x))
    doubled = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    value = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.when(i % 2 == 0, doubled(F.substring(d, i, F.lit(1)).cast("int"))).otherwise(F.substring(d, i, F.lit(1)).cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, b: a + b) % 10 == 0


def shaped(kind: str, x: Column) -> Column:
    """The check that a match of the kind must pass; for base kinds, exactly the contract's."""
    n = F.length(digits(x))
    return {
        "email": F.lit(True),
        "ip": x.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$"),
        "card": F.when(n.between(12, 19), luhn(x)).otherwise(False),
        "phone": n.between(9, 15),
        "secret": (x.rlike("[A-Za-z][^=:]*[0-9]|[0-9][^=:]*[A-Za-z]|[=:][^=:]*[0-9]") & (F.length(x) >= 14)) | x.startswith("-----"),
        "number": n.between(9, 10),
    }[kind]


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once; a lambda would otherwise work it out for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, join, side: int = 64) -> Column:
    """For each element of an array that isn't empty, the join (sum or greatest, 0 for none) of those before it.

    Elements go by blocks, so a text with n matches takes about n * side steps, not n * n.
    """
    fold = lambda x: F.aggregate(x, F.lit(0), join)

    def over(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.ceil(F.size(v) / side).cast("int") - 1)
        whole = F.transform(blocks, lambda b: fold(F.slice(v, b * side + 1, F.lit(side))))
        first = let(whole, lambda w: F.transform(w, lambda _, b: fold(F.slice(w, F.lit(1), b))))
        return let(first, lambda f: F.transform(v, lambda _, i: join(F.get(f, F.floor(i / side).cast("int")), fold(F.slice(v, i - i % side + 1, i % side)))))

    return let(values, over)


def placed(kind: str, pattern: str, text: Column, matches: Column) -> Column:
    """array<struct<kind, start, end, value, before>> of the pattern's matches; `before` is the end of the gap before a match.

    Places come from the lengths of matches and of the gaps between them, as a search from the text's beginning for each would not be linear.
    """

    def over(gaps: Column) -> Column:
        before = F.zip_with(gaps, F.concat(F.array(F.lit("")), matches), lambda g, m: F.coalesce(F.length(g), F.lit(0)) + F.coalesce(F.length(m), F.lit(0)))
        # element i of `before`: match i - 1 and the gap behind it, so starts are running sums that take their own element in
        start = let(before, lambda b: F.zip_with(running(b, lambda x, y: x + y), b, lambda x, y: x + y))
        one = lambda s, v, i: F.struct(F.lit(kind).alias("kind"), F.get(s, i).alias("start"), (F.get(s, i) + F.length(v)).alias("end"), v.alias("value"), F.substring(F.get(gaps, i), F.greatest(F.length(F.get(gaps, i)) - 23, F.lit(1)), F.lit(24)).alias("before"))
        return let(start, lambda s: F.transform(matches, lambda v, i: one(s, v, i)))

    return let(F.split(text, pattern, -1), over)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, t, spans): the columns of docs as a struct, the text, and array<struct<kind, start, end, base, v1, v2, v3, f>>, every candidate with its votes.

    f packs shape features: length class and whether the value has separators. Columns of docs may have any name.
    """
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    every = {**BASE, **MORE}
    for kind, pattern in every.items():
        quick = F.col("t").rlike(NEEDS[kind]) if kind in NEEDS else F.lit(True)
        df = df.withColumn(f"m_{kind}", F.when(quick, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    some = lambda kind: F.size(f"m_{kind}") > 0
    df = df.withColumns({f"f_{kind}": F.when(some(kind), placed(kind, pattern, F.col("t"), F.col(f"m_{kind}"))).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,value:string,before:string>>")) for kind, pattern in every.items()})

    def voted(kind: str):
        def one(x: Column) -> Column:
            shape = F.when(shaped(kind, x.value), 1).otherwise(-1)
            known = F.when(x.value.rlike(GAZETTEER[kind]), 1).otherwise(0 if kind in ("email", "phone") else -1)
            context = F.when(x.before.rlike(CONTEXT[kind]), 1).when(x.before.rlike(AGAINST), -1).otherwise(0)
            size = F.least(F.floor(F.length(x.value) / 8), F.lit(3)).cast("int")
            parts = F.when(x.value.rlike(r"[\x20()=:-]"), 4).otherwise(0)
            base = shaped(kind, x.value) if kind in BASE else F.lit(False)
            return F.struct(x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end"), base.alias("base"), shape.alias("v1"), known.alias("v2"), context.alias("v3"), (size + parts).alias("f"))

        return lambda x: one(x)

    spans = F.concat(*[F.transform(f"f_{kind}", voted(kind)) for kind in every])
    return df.select("row", "t", spans.alias("spans"))


# ---------------------------------------------------------------- the model, from counts of patterns


def expected(rows: list[tuple[tuple[int, int, int], int]], rounds: int = 40) -> list[float]:
    """The probability of truth of each vote pattern, from (votes, count), by expectation-maximisation.

    Votes count as independent given the truth, with three outcomes each; labelers start as better than chance, with 20
    pseudo-counts, which keep their first reading where data say little.
    """
    first = {True: {1: 0.7, 0: 0.2, -1: 0.1}, False: {1: 0.15, 0: 0.35, -1: 0.5}}
    prior, rates, truth = 0.5, [{s: dict(r) for s, r in first.items()} for _ in range(3)], [0.5] * len(rows)
    total = sum(n for _, n in rows)
    for _ in range(rounds):
        for k, (votes, _) in enumerate(rows):
            yes, no = prior, 1 - prior
            for r, v in zip(rates, votes, strict=True):
                yes, no = yes * r[True][v], no * r[False][v]
            truth[k] = yes / (yes + no)
        prior = min(0.98, max(0.02, sum(p * n for p, (_, n) in zip(truth, rows, strict=True)) / total))
        for j in range(3):
            for side in (True, False):
                seen = {v: 20 * first[side][v] + sum((p if side else 1 - p) * n for p, (vs, n) in zip(truth, rows, strict=True) if vs[j] == v) for v in (1, 0, -1)}
                rates[j][side] = {v: c / sum(seen.values()) for v, c in seen.items()}
    return truth


def fit(counts: list[tuple[str, int, int, int, int, int]]) -> dict[str, list[float]]:
    """Per kind, weights of the final classifier, from (kind, v1, v2, v3, f, count).

    The classifier is logistic, trained on the expected truth. A kind without candidates is absent.
    """
    out = {}
    for kind in {c[0] for c in counts}:
        rows = [(c[1:4], c[4], c[5]) for c in counts if c[0] == kind]
        truth = expected([(votes, n) for votes, _, n in rows])
        w = [0.0] * 13  # bias, (yes, no) of each labeler, six features
        total = sum(n for *_, n in rows)
        for _ in range(300):
            grad = [0.0] * 13
            for (votes, f, n), p in zip(rows, truth, strict=True):
                x = inputs(votes, f)
                miss = (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x, strict=True)))))) - p) * n / total
                grad = [g + miss * b for g, b in zip(grad, x, strict=True)]
            w = [a - 2.0 * (g + 1e-4 * a) for a, g in zip(w, grad, strict=True)]
        out[kind] = w
    return out


def inputs(votes: tuple[int, int, int], f: int) -> list[float]:
    return [1.0, *[float(v == s) for v in votes for s in (1, -1)], *[float(f % 4 == k) for k in range(4)], float(f >= 4), float(f < 4)]


def learn(spans: DataFrame) -> dict[str, list[float]]:
    """Counts the vote patterns of `spans` over all rows (there are at most 6 x 27 x 8) and fits the model."""
    x = spans.select(F.explode("spans").alias("x")).groupBy("x.kind", "x.v1", "x.v2", "x.v3", "x.f").count()
    return fit(sorted(tuple(r) for r in x.collect()))


def probability(model: dict[str, list[float]], x: Column) -> Column:
    """The classifier as an expression over a struct of `spans`."""
    out = F.lit(0.0)
    for kind, w in sorted(model.items()):
        z = F.lit(w[0])
        for j, v in enumerate((x.v1, x.v2, x.v3)):
            z = z + F.when(v == 1, w[1 + 2 * j]).when(v == -1, w[2 + 2 * j]).otherwise(0.0)
        for k in range(4):
            z = z + F.when(x.f % 4 == k, w[7 + k]).otherwise(0.0)
        z = z + F.when(x.f >= 4, w[11]).otherwise(w[12])
        out = F.when(x.kind == kind, 1 / (1 + F.exp(-z))).otherwise(out)
    return out


def order(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def accepted(model: dict[str, list[float]], spans: str = "spans") -> Column:
    """The base spans and those that the classifier takes, as array<struct<start, rank, end, kind, base>> in order."""
    taken = F.filter(spans, lambda x: x.base | (probability(model, x) >= 0.5))
    return F.sort_array(F.transform(taken, lambda x: F.struct(x.start.alias("start"), order(x.kind).alias("rank"), x.end.alias("end"), x.kind.alias("kind"), x.base.alias("base"))))


def of_kind(kind: str):
    return lambda x: x.kind == kind


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def united(spans: Column) -> Column:
    """array<struct<start, end, kind>> of spans in order of start (at least one), where overlapping ones are one with the first one's kind."""

    def over(a: Column) -> Column:
        def cut(reach: Column) -> Column:  # reach: the furthest end before each span
            begins = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: F.get(a, i).start >= F.get(reach, i))
            last = F.array_max(F.transform(a, lambda x: x.end))
            return let(last, lambda top: let(begins, lambda b: F.transform(b, lambda i, k: F.struct(F.get(a, i).start.alias("start"), F.coalesce(F.get(reach, F.get(b, k + 1)), top).alias("end"), F.get(a, i).kind.alias("kind")))))

        return let(running(F.transform(a, lambda x: x.end), lambda x, y: F.greatest(x, y)), cut)

    return let(spans, over)


def between(leaves: Column, a: Column, b: Column) -> Column:
    """The characters a to b (exclusive) of a text that is cut into leaves of LEAF characters."""
    first = F.floor(a / LEAF).cast("int")
    some = F.array_join(F.slice(leaves, first + 1, F.floor((b - 1) / LEAF).cast("int") - first + 1), "")
    return F.when(b > a, F.substring(some, a % LEAF + 1, b - a)).otherwise("")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every accepted span of the text replaced by its kind in brackets; overlapping spans become one.

    The first of two passes counts vote patterns, the second rewrites. Rows keep their columns, whatever their names; null texts stay null.
    """
    model = learn(candidates(docs.select(F.col(f"`{text}`").alias("text"))))
    df = candidates(docs, text).select("row", "t", accepted(model).alias("a"))
    df = df.withColumn("b", F.when(F.size("a") > 0, united(F.col("a"))))
    # the text in leaves, as a search from its beginning for each span would not be linear
    df = df.withColumn("leaves", F.when(F.size("a") > 0, F.regexp_extract_all("t", F.lit(f"(?s).{{1,{LEAF}}}"), F.lit(0))))
    since = lambda i: F.when(i == 0, 0).otherwise(F.get("b", i - 1).end)
    pieces = F.transform("b", lambda x, i: F.concat(between(F.col("leaves"), since(i), x.start), F.lit("["), F.upper(x.kind), F.lit("]")))
    tail = between(F.col("leaves"), F.element_at("b", -1).end, F.length("t"))
    new = F.when(F.size("a") > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col("row")[text])
    return df.select(*[(new if c == text else F.col("row")[c]).alias(c) for c in docs.columns])
