"""Quality rules: text statistics and a learned decision list, all as DataFrame expressions.

statistics() measures every whole text with built-in functions. learn() grows ordered rules from labelled
statistics by sequential covering: conditions `statistic >= t` or `<= t` are added while they gain on a growing
set, pruned from the end on a pruning set, and a rule is kept only if it is nearly always right on the latter;
the rejected rows it covers are then taken away and the next rule is grown. decide() turns the list into
one ordered chain of conditional expressions.

Null or empty texts have no words, so they fail the base rule. Rows whose label is null, and a labels table
without rows, teach nothing: then the list is empty and the base rule alone decides. Repeated rows get equal
verdicts; of the texts under one labelled key the least one teaches. The columns of the input stand in a struct, so any names may occur.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: At most so many labelled rows (in expectation) are fitted on; they are chosen by a hash of the id.
SAMPLE = 20_000
FEATURES = ("words", "chars_a_word", "symbols_a_word", "marks_a_word", "capitals_a_char", "digits_a_char", "repeated_share", "same_lines", "distinct_share")


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """(row, s): the columns of df as one struct, so that none can clash, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the FEATURES."""
    df = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    df = df.withColumn("w", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    df = df.withColumn("c", F.array_join("w", "")).withColumn("n", F.size("w").cast("long"))
    df = df.withColumn("l", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD)))
    windows = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    df = df.withColumn("h", F.when(F.col("n") >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("again", F.size(F.array_distinct("h")) < F.size("h"))
    df = df.withColumn("o", F.when(F.col("again"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    twice = F.filter("o", lambda x, k: (x.h == F.get("o", k - 1).h) | (x.h == F.get("o", k + 1).h))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x.i, x.i + 1, x.i + 2)))))
    df = df.withColumn("r", F.when(F.col("again"), covered).otherwise(0).cast("long"))

    def count(chars: str) -> Column:
        return F.length(F.regexp_replace("c", f"[^{chars}]+", "")).cast("long")

    n, c = F.greatest(F.col("n"), F.lit(1)), F.greatest(F.length("c"), F.lit(1))
    symbols, lines = count(r"#*$%&|<>"), F.size("l")
    df = df.withColumn("k", symbols).withColumn("d", (lines - F.size(F.array_distinct("l"))).cast("long"))
    stats = {
        "n_words": F.col("n"), "word_chars": F.length("c").cast("long"), "n_symbols": F.col("k"), "n_dup_lines": F.col("d"), "n_repeat_words": F.col("r"),
        "words": F.col("n").cast("double"), "chars_a_word": F.length("c") / n, "symbols_a_word": F.col("k") / n, "marks_a_word": count("!?.,;:") / n, "capitals_a_char": count("A-ZÀ-ÖØ-Þ") / c,
        "digits_a_char": count("0-9") / c, "repeated_share": F.col("r") / n, "same_lines": F.col("d") / F.greatest(lines, F.lit(1)), "distinct_share": F.size(F.array_distinct("w")) / n,
    }
    return df.withColumn("s", F.struct(*[v.alias(k) for k, v in stats.items()])).select("row", "s")


@dataclass(frozen=True)
class Rule:
    """Reject where all conditions (statistic, '>=' or '<=', threshold) hold."""

    conditions: tuple[tuple[str, str, float], ...]

    def column(self, stats: str = "s") -> Column:
        out = F.lit(True)
        for name, op, t in self.conditions:
            x = F.col(stats)[name]
            out = out & ((x >= t) if op == ">=" else (x <= t))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{name} {op} {t:.4g}" for name, op, t in self.conditions)

    def covers(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, op, t in self.conditions:
            v = x[:, FEATURES.index(name)]
            out &= v >= t if op == ">=" else v <= t
        return out


def cover(x: np.ndarray, bad: np.ndarray, most_rules: int = 12, most_conditions: int = 3, right: float = 0.985, least: int = 8, steps: int = 64) -> list[Rule]:
    """Sequential covering over rows of FEATURES. `right`: share of covered pruning rows that must be bad."""
    part = np.arange(len(x)) % 3 == 0
    grow_x, grow_y, prune_x, prune_y = x[~part], bad[~part], x[part], bad[part]
    rules: list[Rule] = []
    while len(rules) < most_rules and grow_y.sum() >= least:
        conditions: list[tuple[str, str, float]] = []
        held = np.ones(len(grow_x), bool)
        while len(conditions) < most_conditions:
            p, n = grow_y[held].sum(), (~grow_y[held]).sum()
            if not n or not p:
                break
            best = (1e-9, None, None)
            for f, name in enumerate(FEATURES):
                v = grow_x[:, f]
                values = np.unique(np.quantile(v[held & grow_y], np.linspace(0, 1, steps), method="nearest"))
                order = np.sort(v[held])
                for t in values:
                    for op in (">=", "<="):
                        k = np.searchsorted(order, t, "left" if op == ">=" else "right") - (op == ">=")
                        t2 = t if k < 0 or k >= len(order) else (t + order[k]) / 2
                        now = held & (v >= t2 if op == ">=" else v <= t2)
                        p2, n2 = grow_y[now].sum(), (~grow_y[now]).sum()
                        if p2 >= least // 2:
                            gain = p2 * (np.log2(p2 / (p2 + n2)) - np.log2(p / (p + n)))
                            if gain > best[0]:
                                best = (gain, (name, op, float(t2)), now)
            if best[1] is None:
                break
            conditions.append(best[1])
            held = best[2]
        if not conditions:
            break

        def worth(k: int) -> float:
            hit = Rule(tuple(conditions[:k])).covers(prune_x)  # noqa: B023
            p, n = prune_y[hit].sum(), (~prune_y[hit]).sum()
            return (p - n) / (p + n) if p + n else -1.0

        rule = Rule(tuple(conditions[: max(range(1, len(conditions) + 1), key=lambda k: (round(worth(k), 6), -k))]))
        hit, hit_g = rule.covers(prune_x), rule.covers(grow_x)
        p, n = prune_y[hit].sum() + grow_y[hit_g].sum(), (~prune_y[hit]).sum() + (~grow_y[hit_g]).sum()
        if prune_y[hit].sum() < 1 or p / (p + n) < right or p < least:
            break
        rules.append(rule)
        grow_x, grow_y, prune_x, prune_y = grow_x[~hit_g], grow_y[~hit_g], prune_x[~hit], prune_y[~hit]
    return rules


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> list[Rule]:
    """The decision list that tells label 0 from others; fitted on about `sample` labelled rows, or all if fewer."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("_y"))
    n = known.count()
    if not n:
        return []
    chosen = known.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(1)), F.lit(1 << 30)) < int(min(1.0, sample / n) * (1 << 30)))
    # the chosen rows are a bounded sample, so this side may be broadcast at any size of the corpus; of a repeated key one text is taken
    some = docs.select(F.col(key).alias("k"), F.col("text")).join(F.broadcast(chosen.select(F.col(key).alias("k"), F.col("_y").alias("y"))), "k").groupBy("k", "y").agg(F.min("text").alias("text"))
    stats = measured(some).select("row.k", "row.y", *[F.col("s")[f].alias(f) for f in FEATURES])
    rows = sorted(tuple(r) for r in stats.collect())
    if not rows:
        return []
    x = np.array([r[2:] for r in rows], float)
    order = np.random.default_rng(7).permutation(len(x))
    return cover(x[order], (np.array([r[1] for r in rows]) == 0)[order])


def decide(rules: list[Rule], stats: str = "s") -> Column:
    """0 where no rule holds, else the number of the first that does: an ordered conditional expression."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.column(stats), k).otherwise(out)
    return out


def base_failed(stats: str = "s", least_words: int = 50, repeated: int = 50) -> Column:
    s = F.col(stats)
    return (s.n_words < least_words) | (100 * s.n_repeat_words > repeated * s.n_words)


def judged(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """(row, s, base_failed, rule, kept): the columns of docs as a struct, the statistics, the number of the rule that rejects it (or 0), and the verdict."""
    out = measured(docs, text).withColumn("base_failed", base_failed()).withColumn("rule", decide(rules))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    # a filter would be moved below the statistics, and each use of a statistic would be written out in it; a generator stays between
    return out.select(F.explode(F.array(F.struct("row", "s", "base_failed", "rule", "kept"))).alias("x")).select("x.*")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that neither the base rule nor a learned rule rejects, with docs' columns, whatever their names."""
    return judged(docs, learn(docs, labels)).where("kept").select("row.*")
