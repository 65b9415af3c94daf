"""Text steps that must read and split each text once, and count before they shuffle."""

from collections import Counter

from pyspark.sql import functions as F

from quillmark import queries  # noqa: F401
from quillmark.operators import segments, terms
from quillmark.plans import session


def test_pairs_are_counted_before_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(segments, "CHUNK", 7, raising=False)
    lists = [["b", "a", "b", None, "c"], [], None, ["é", "z", "𝒳", "～", "z"], ["x"], [None], ["a", "b"] * 9]
    rows = spark.createDataFrame([(x,) for x in lists], "w array<string>").coalesce(1)
    want = Counter()
    for x in lists:
        words = [w for w in x or [] if w is not None]
        for k, w in enumerate(words):
            for v in words[k + 1 : k + 4]:
                if v != w:
                    want[tuple(sorted((w, v), key=lambda s: s.encode()))] += 1
    got = segments.cooccurrences(rows, "w", 3)
    assert {(r.a, r.b): r.n for r in got.collect()} == want
    assert "explode" not in got._jdf.queryExecution().optimizedPlan().toString()  # no row a pair and place


def test_texts_are_split_once(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(terms, "settled", lambda df: asked.append(df._jdf.queryExecution().optimizedPlan().toString()) or session.settled(df))
    texts = ["The -rock-n-roll' Band plays 天气 真 了", None, "", "band plays band's", "ab a 你好吗"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {r.k: list(r.t) for r in rows.select("k", terms.content_tokens(F.col("text")).alias("t")).collect()}
    assert got == {0: ["rock-n-roll", "band", "plays", "天气"], 1: [], 2: [], 3: ["band", "plays", "band's"], 4: ["你好吗"]}
    assert {r.k: r.n_terms for r in terms.tfidf(rows, "k").collect()} == {0: 7, 1: 0, 2: 0, 3: 5, 4: 1}
    assert sum("regexp_extract_all" in p for p in asked) == 1
