"""Documents that hold the odd cases, and small brute-force helpers."""

SF = "/root/testdata/sf0.001"
WS = " \t\n\v\f\r"


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


ODD = [
    None, "", " ", "\n\n", "a", "a b", "a b", "A B", "word " * 400, "x" * 5000, "the cat sat on the mat " * 30, "été naïve 漢字 \x00   z", "line one\nline one\n\n \nline two", "a b c", "!!! ### $$$ %%%",
    "mail bob@example.com now, or +1 (317) 555-2213; ip 10.0.0.1, card 4111 1111 1111 1111.", "😀 bob@x.org 😀 1.2.3.4.5.6.7.8 300.1.1.1 a@b a@b.c.d_x@y.zz",
]


def thue_morse(n, letters="ab"):
    """The Thue-Morse word of length n and its complement: a polynomial hash modulo 2**64 can't tell long ones apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


def frame(spark, texts=ODD, extra=True):
    """documents with repeated rows and columns whose names clash with what operators add."""
    rows = [(k, t, "en", "src0", None if t is None else len(t), "s", 1) for k, t in enumerate(texts)]
    rows += rows[:2]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame([r if extra else r[:5] for r in rows], schema + (", score string, shard int" if extra else ""))
