import numpy as np
from pyspark.sql import functions as F

from kelpie.llm import rules

from .helpers import ODD, SF, frame, words


def brute(text):
    w = words(text)
    spots = {}
    for i in range(len(w) - 2):
        spots.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for v in spots.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_statistics_match_brute_force(spark):
    texts = [*ODD, *[r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]]
    got = rules.measured(frame(spark, texts)).select("row.doc_id", "s.*").collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])


def test_list_is_learned_and_keeps_clean_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    learned = rules.learn(docs, labels)
    assert learned
    out = rules.judged(docs, learned).select("row.doc_id", "kept").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    kept = {r.quality: r.k for r in out}
    assert kept[0] < 0.1 and kept[1] > 0.93


def test_no_labels_and_no_rows(spark):
    empty = frame(spark).limit(0)
    labels = spark.createDataFrame([(1, None), (None, 0)], "doc_id long, quality int")
    assert rules.learn(frame(spark), labels) == []
    assert rules.keep_good(empty, labels).count() == 0
    assert rules.keep_good(frame(spark), labels).columns == frame(spark).columns


def test_conditional_expression_matches_the_list(spark):
    """decide() against the rules gone through one after another in Python."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    learned = rules.learn(docs, labels)
    for r in rules.judged(docs, learned).select("s", "rule", "base_failed", "kept").collect():
        x = np.array([[r.s[f] for f in rules.FEATURES]])
        assert r.rule == next((k for k, rule in enumerate(learned, 1) if rule.covers(x)[0]), 0)
        assert r.base_failed == (r.s.n_words < 50 or 100 * r.s.n_repeat_words > 50 * r.s.n_words) and r.kept == (not r.base_failed and r.rule == 0)


def test_clashing_names_and_repeated_keys(spark):
    good = " ".join(f"word{i}" for i in range(80))
    df = spark.createDataFrame([(1, good, "a", "b", 1.0), (1, "short", "a", "b", 1.0), (2, None, "c", "d", 2.0)], "doc_id long, text string, _t string, row string, `s` double")
    out = rules.keep_good(df, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, good, "a", "b", 1.0)]


def test_cover_prunes_to_the_condition_that_matters():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(rules.FEATURES)))
    bad = x[:, 2] >= 0.8
    learned = rules.cover(x, bad)
    assert len(learned) == 1 and learned[0].conditions[0][:2] == ("symbols_a_word", ">=") and len(learned[0].conditions) == 1
