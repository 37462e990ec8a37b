import numpy as np
from pyspark.sql import functions as F

from kelpie.llm import langid

from .helpers import SF, frame


def test_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.where(~langid.held_out()).select(F.col("doc_id").alias("key"), "text", "lang")
    model = langid.fit(rows)
    assert set(model["langs"]) == {"de", "en", "es", "fr"} and len(model["langs"]) > 8
    out = langid.predict(docs.where(langid.held_out()), model)
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97
    odd = langid.predict(frame(spark), model).collect()
    assert len(odd) == frame(spark).count()
    for r in odd:
        assert (r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text))
        assert 0 <= r.score <= 1
    assert langid.predict(frame(spark).limit(0), model).count() == 0
    foreign = langid.predict(spark.createDataFrame([("漢字かな" * 50,)], "text string"), model).first()
    assert foreign.rejected


def test_nothing_to_learn(spark):
    rows = frame(spark).select(F.col("doc_id").alias("key"), "text", F.lit(None).cast("string").alias("lang"))
    out = langid.predict(frame(spark), langid.fit(rows)).collect()
    assert {r.lang_pred for r in out} == {"und"}


def brute_vector(text, idf):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    x = np.zeros(langid.WIDTH)
    for size in (2, 3):
        for i in range(len(raw) - size + 1):
            h = 0
            for c in raw[i : i + size]:
                h = (h * 257 + c) % (1 << 32)
            x[(h * 0x9E3779B1 % (1 << 32)) >> 20] += 1
    v = np.log1p(x) * idf
    return v / max(np.linalg.norm(v), 1e-9), x > 0


def test_vectors_centroids_and_rejection_match_brute_force(spark):
    """Document frequencies, vectors, nearest centroid and rejection counted one by one in Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.select(F.col("doc_id").alias("key"), "text", "lang"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen = sum(brute_vector(t, 1.0)[1].astype(int) for t in texts.values())
    idf = np.where(seen > 0, np.log((1 + len(texts)) / (1 + seen)) + 1, 0)
    assert np.allclose(model["idf"], idf, atol=1e-5)
    assert np.allclose(np.linalg.norm(model["centroids"], axis=1), 1, atol=1e-4) and (model["radius"] < 1).all()
    for r in langid.predict(docs.select("doc_id", "text"), model).collect():
        v, _ = brute_vector(texts[r.doc_id], idf)
        cosine = model["centroids"] @ v
        best = int(cosine.argmax())
        if r.lang_pred != langid.UND and np.sort(cosine)[-1] - np.sort(cosine)[-2] > 1e-4:
            assert r.lang_pred == model["langs"][best] and abs(r.score - min(1, max(0, cosine[best]))) < 1e-3
            assert r.rejected == (cosine[best] < model["radius"][best]) or abs(cosine[best] - model["radius"][best]) < 1e-3


def test_k_means_puts_rows_to_their_nearest_centroid():
    rng = np.random.default_rng(2)
    mean = np.eye(3, 8)
    x = np.concatenate([m + 0.05 * rng.random((40, 8)) for m in mean])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c, radius = langid.k_means(x, 3)
    own = (x @ c.T).argmax(1)
    assert [len(set(own[i : i + 40])) for i in (0, 40, 80)] == [1, 1, 1] and len(set(own)) == 3
    assert ((x @ c.T).max(1) >= radius[own]).all()
