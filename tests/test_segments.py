"""Spans of paragraphs and sentences, their warnings, and co-occurrence graphs."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmark.operators import segments


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('He met Dr. Who. Then 3.5 came! "Yes?" J. R. left', ["He met Dr. Who.", "Then 3.5 came!", '"Yes?"', "J. R. left"]),
        ("Wait... what?! Yes。好！ no end", ["Wait...", "what?!", "Yes。", "好！", "no end"]),
        ("On 2024-01-02. Next (see U.S.A. law). End.", ["On 2024-01-02. Next (see U.S.A. law).", "End."]),
        (" \n ", []),
        ("One.) Two.", ["One.)", "Two."]),
    ],
)
def test_sentences(text, want):
    assert [text[a:b] for a, b in segments.sentence_spans(text, 0, len(text))] == want


def test_units_and_warnings(spark):
    texts = [(1, "  a b.\n c\n \n\n(d e. ] f Mr."), (2, None), (3, ""), (4, "\n\n \n"), (1, "twice.")]
    rows = segments.text_units(spark.createDataFrame([(*t, "x") for t in texts], "id long, text string, start string"), "id").collect()
    body = texts[0][1]
    first = [r for r in rows if r.id == 1 and not r.text.startswith("twice")]
    assert [(r.unit_id, body[r.start : r.end], r.warnings) for r in sorted(first, key=lambda r: r.unit_id)] == [
        ("P0001", "a b.\n c", []),
        ("P0001.S0001", "a b.", []),
        ("P0001.S0002", "c", []),
        ("P0002", "(d e. ] f Mr.", []),
        ("P0002.S0001", "(d e.", ["unbalanced_bracket_fragment"]),
        ("P0002.S0002", "] f Mr.", ["starts_with_closing_bracket", "unbalanced_bracket_fragment", "ends_with_non_terminal_abbreviation"]),
    ]
    assert {r.id for r in rows} == {1}


def test_spans_hold_every_word(spark):
    r = random.Random(1)
    texts = [(k, "".join(r.choice(["word", " ", "\n", "\n\n", ".", "é", "。", ")", "Mr.", "5", "\t"]) for _ in range(60))) for k in range(80)]
    rows = segments.text_units(spark.createDataFrame(texts, "id long, text string"), "id").collect()
    for k, text in texts:
        own = sorted((x.start, x.end) for x in rows if x.id == k and x.sentence)
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(own))
        assert "".join(text[a:b] for a, b in own).split() == "".join(text[a:b] for a, b in own).split()
        assert "".join("".join(text[a:b] for a, b in own).split()) == "".join(text.split())


def test_cooccurrences(spark):
    r = random.Random(2)
    rows = [[r.choice("aaabcd") for _ in range(r.randrange(15))] for _ in range(30)] + [None, [], ["a", None, "b"]]
    got = {(x.a, x.b): x.n for x in segments.cooccurrences(spark.createDataFrame([(x,) for x in rows], "w array<string>"), "w", 3).collect()}
    want = Counter()
    for row in rows:
        w = [x for x in row or [] if x is not None]
        want.update(tuple(sorted((w[i], w[j]))) for i in range(len(w)) for j in range(i + 1, min(i + 4, len(w))) if w[i] != w[j])
    assert got == dict(want)


def test_sample_graphs(spark):
    rows = [("s", u, f"N{k}", "entity") for u in (1, 2) for k in range(10)] + [("s", 1, "ran", "event"), ("s", 2, "RAN ", "event"), ("t", 1, "x", "event"), ("u", None, None, "entity")]
    df = spark.createDataFrame(rows, "sample string, unit long, name string, kind string")
    got = {x.sample: (x.nodes, x.edges, x.top_share, x.score) for x in segments.sample_graphs(df, "sample", "unit").collect()}
    assert got == {"s": (11, 8, 0.5, 8 + 11 - 50), "t": (1, 0, 0.0, 1)}
