import random

from pyspark.sql import functions as F

from kelpie.llm import minhash

from .helpers import ODD, SF, frame, thue_morse, words


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def sets(text, k):
    w = words(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(texts, k):
    s = [sets(t, k) for t in texts]
    root = list(range(len(s)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: (len(s[i]), top(i)) for i in range(len(s))}


def check(spark, texts, k):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, texts), k=k).collect()}
    assert got == brute(texts, k)


def test_matches_brute_force(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("text").collect()]
    check(spark, [*ODD, *docs[:500]], 2)


def test_chains_and_short_texts(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base)]
    for step in range(40):  # a chain: each a word further from the first, the ends far apart
        x = list(base)
        for i in range(step):
            x[i] = f"v{i}"
        texts.append(" ".join(x))
    for _ in range(150):  # many variants of one text that are nearer to it than to each other
        x = list(base)
        for i in rng.sample(range(60), rng.randint(1, 4)):
            x[i] = f"u{rng.randint(0, 999)}"
        texts.append(" ".join(x))
    texts += ["a b", "b a", "A  b", "solo", "solo", "a b c d e f", "a b c d e f g"]
    check(spark, texts, 2)


def test_words_of_equal_polynomials(spark):
    texts = [f"x {w}" for n in (1024, 2048) for w in thue_morse(n)] + [f"y {w} z" for w in thue_morse(1024)]
    check(spark, texts, 2)
    assert len({r.component_id for r in minhash.near_duplicates(frame(spark, texts, extra=False), k=2).collect()}) == len(texts)


def test_keep_one(spark):
    df = frame(spark).withColumn("th", F.lit("x")).withColumn("component", F.lit(1)).withColumn("row", F.lit(None).cast("string"))
    out = minhash.keep_one(df)
    assert out.columns == df.columns
    rows = out.collect()
    want = {}
    for i, (n, root) in brute(ODD, 5).items():
        if n == 0 or root == i:
            want[i] = ODD[i]
    assert {r.doc_id: r.text for r in rows} == want and 0 in want
    assert minhash.keep_one(df.limit(0)).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert minhash.keep_one(docs.union(docs)).count() == minhash.keep_one(docs).where(F.col("doc_id").isNotNull()).count()


def test_keep_one_of_repeated_and_null_keys(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long), (1, "another text of some words here"), (1, "another text of some words here"), (None, long + " end"), (None, "alone with a null key so far"), (None, "alone with a null key so far"), (3, "alone with a null key so far"), (None, None), (4, None)]
    out = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, long), (1, "another text of some words here"), (3, "alone with a null key so far"), (None, None), (4, None)], key=str)


def test_small_tables_of_rounds_lie_in_few_files(spark, monkeypatch):
    """With many shuffle partitions the rounds over few links must not write a file for each partition."""
    from kelpie.llm import common, components

    files = []

    def counted(df, *more):
        files.append(len((out := common.durable(df, *more)).inputFiles()))
        return out

    monkeypatch.setattr(components, "durable", counted)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = spark.range(300).where("id % 10 <> 9").selectExpr("id AS a", "id + 1 AS b")
        out = components.components(links).collect()
        assert sorted((r.node, r.root) for r in out) == [(k, k - k % 10) for k in range(300)]
        assert len(files) > 3 and max(files[1:]) <= 8  # the first holds the links as they came
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
