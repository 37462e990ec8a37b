import random

from pyspark.sql import functions as F

from kelpie.llm import warc


def test_canonical(spark):
    urls = {
        "https://www.Example.com:443/a/?b=2&a=1&utm_source=x#top": "example.com/a?a=1&b=2", "http://m.example.com/a?a=1&b=2": "example.com/a?a=1&b=2", "example.com": "example.com", "http://example.com/": "example.com",
        "http://example.com/x?ref=q": "example.com/x", "": "", "HTTP://EX.org:8080/Path": "ex.org:8080/Path",
    }
    df = spark.createDataFrame([(u,) for u in urls] + [(None,)], "u string").select("u", warc.canonical(F.col("u")).alias("c"))
    assert {r.u: r.c for r in df.collect()} == urls | {None: None}


def test_as_of_join_matches_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for k in range(700):
        kind = rng.choice(["response", "revisit"])
        url = rng.choice([None, "http://a.org/hot", "http://a.org/hot", "http://b.org/%d" % rng.randint(0, 30)])
        head = {x: rng.choice("123") for x in ("etag", "last-modified", "date", "content-type") if rng.random() < 0.6}
        rows.append((k, url, rng.randint(0, 300), kind, head if rng.random() < 0.95 else None, rng.choice(["d1", None])))
    df = spark.createDataFrame(rows, "id long, uri string, time long, kind string, headers map<string,string>, digest string")
    got = {r.id: r for r in warc.resolve(df, span=20).collect()}
    assert len(got) == sum(r[3] == "revisit" for r in rows)
    for k, url, t, kind, head, digest in rows:
        if kind == "response":
            continue
        before = [r for r in rows if r[3] == "response" and url is not None and r[1] == url and r[2] < t]
        r = got[k]
        if not before:
            assert r.status == "orphan" and r.response_id is None
            continue
        f = max(before, key=lambda x: (x[2], x[0]))
        assert r.response_id == f[0]
        mine, theirs = head or {}, f[4] or {}
        same = next((mine[x] == theirs[x] for x in ("etag", "last-modified") if x in mine and x in theirs), digest == f[5] if digest and f[5] else True)
        assert r.status == ("resolved" if same else "mismatch")
        if same and f[4] is not None:
            assert r.headers == {**theirs, **{x: v for x, v in mine.items() if x in warc.PERMITTED}}


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = warc.resolve(warc.captures(pages))
    assert out.count() == pages.count()
    assert warc.resolve(warc.captures(pages.limit(0))).count() == 0
