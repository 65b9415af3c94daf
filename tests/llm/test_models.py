"""Models and text-changing stages against plain versions, and the stages' edge cases."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmark.llm import common, mixing, near_dedup, quality, substring_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_kneser_ney(texts, order):
    """Log probability of (context, symbol) under interpolated modified Kneser-Ney, by dictionaries."""
    counts = {order: Counter()}
    for t in texts:
        p = tuple(quality.points(t).tolist())
        counts[order].update(p[k : k + order] for k in range(len(p) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cuts, totals, held = {}, defaultdict(int), defaultdict(float)
    for n, level in counts.items():
        of = Counter(level.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.0
        cuts[n] = [max(0.05, k - (k + 1) * y * of[k + 1] / of[k]) if of[k] and of[k + 1] else 0.5 * k for k in (1, 2, 3)]
        for g, c in level.items():
            totals[n, g[:-1]] += c
            held[n, g[:-1]] += cuts[n][min(c, 3) - 1]

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / (len(counts[1]) + 1)
        below = p(gram[1:])
        if not totals[n, gram[:-1]]:
            return below
        c = counts[n][gram]
        return (max(c - cuts[n][min(c, 3) - 1], 0) if c else 0) / totals[n, gram[:-1]] + held[n, gram[:-1]] / totals[n, gram[:-1]] * below

    return lambda gram: math.log(p(gram))


def test_quality_against_a_plain_model(spark, monkeypatch):
    """Log probabilities of seen and unseen n-grams, over a model of many shards of which few are kept."""
    monkeypatch.setattr(quality, "SHARD_ROWS", 40)
    monkeypatch.setattr(quality, "KEPT_SHARDS", 2)
    draw = random.Random(4)
    texts = ["".join(draw.choice("abc é") for _ in range(40)) for _ in range(12)]
    df = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    path, n = quality.sharded(quality.kneser_ney(quality.count_grams(df)))
    assert n > 5
    plain, shards = plain_kneser_ney(texts, quality.ORDER), quality.Shards(path, n)
    asked = [*texts[:4], "".join(draw.choice("abcxy é") for _ in range(60)), "zzz"]
    for t in asked:
        got = shards.log_probability(quality.grams(t), "en")
        points = quality.points(t).tolist()
        want = [plain(tuple(points[k : k + quality.ORDER])) for k in range(len(points) - quality.ORDER + 1)]
        assert np.allclose(got, want, atol=1e-6)
        assert len(shards.kept) <= 2


def test_ordinal_fit_is_a_minimum():
    """The fitted parameters against the likelihood itself: no step in any direction lowers it by much."""
    draw = random.Random(3)
    rows = [Counter({1: 1 + k % 3, 2 + k % 40: 1}) for k in range(200)] + [Counter({500 + k % 5: 1 + k % 4, 2 + k % 40: 1}) for k in range(60)]
    toxic = np.arange(260) >= 200
    model, y = toxicity.fit(rows, toxic), toxicity.severity(rows, toxic)
    each = np.where(toxic, min(5.0, 0.25 / toxic.mean()), 1.0) / len(rows)

    def loss(w, theta):
        score = np.array([sum(w[b] * math.log1p(c) for b, c in r.items()) for r in rows])
        p = 1 / (1 + np.exp(theta[None, :] - score[:, None]))
        target = y[:, None] > np.arange(len(theta))[None, :]
        return float((-np.where(target, np.log(p), np.log1p(-p)) * each[:, None]).sum() + 0.5 * toxicity.RIDGE * (w**2).sum())

    w, theta = model.weights.astype(float), model.thresholds
    best = loss(w, theta)
    for _ in range(30):
        dw, dt = np.zeros_like(w), np.array([draw.uniform(-0.05, 0.05) for _ in theta])
        for b in np.flatnonzero(w):
            dw[b] = draw.uniform(-0.05, 0.05)
        assert loss(w + dw, theta + dt) >= best - 2e-3
    found = model.above(np.array([sum(w[b] * math.log1p(c) for b, c in r.items()) for r in rows])).sum(1)
    assert found[toxic].min() > found[~toxic].max()


def windows(words, n):
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


def test_no_common_run_of_fifty_words_is_left(spark):
    """Random documents that share passages: afterwards no two places share 50 words, and every removed word run stands."""
    draw = random.Random(8)
    words = lambda n: [f"w{draw.randrange(5000)}" for _ in range(n)]
    passages = [words(draw.randrange(52, 120)) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(draw.randrange(1, 4)):
            parts.append(words(draw.randrange(20, 80)))
            if draw.random() < 0.7:
                parts.append(draw.choice(passages))
        gap = draw.choice([" ", "\n", " "])
        rows.append((i, gap.join(" ".join(p) for p in parts)))
    out = {r.doc_id: r.text for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen, left = set(), [t.split() for t in out.values()]
    for w in left:
        here = windows(w, 50)
        assert not here & seen
        seen |= here
    stands = set().union(*(windows(w, 12) for w in left))
    for p in passages:
        if any(windows(p, len(p)) <= windows(t.split(), len(p)) for _, t in rows):
            assert len(windows(p, 12) - stands) <= 24, "a passage went from every document"


def test_a_passage_never_loses_its_last_copy(spark):
    """The copy that stays may not lie in a line that itself goes as a near copy of another line."""
    draw = random.Random(5)
    words = lambda n: [f"v{draw.randrange(9000)}" for _ in range(n)]
    passage, around = words(60), words(240)
    edited = [x if k % 20 != 10 else "changed" for k, x in enumerate(passage)]
    rows = [
        (1, " ".join(around[:120] + edited + around[120:])),
        (2, " ".join(around[:120] + passage + around[120:])),
        (3, " ".join(words(50) + passage + words(50))),
    ]
    out = [r.text.split() for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert any(windows(passage, 60) <= windows(w, 60) for w in out)


def stage_rows():
    text = "some words that make a text of its own number "
    rows = [(k, text + " ".join(f"x{k}y{j}" for j in range(30)), "en", "s", 10) for k in range(12)]
    rows += [(20, rows[0][1], "en", "s", 10), (21, None, None, None, None), (None, "text without an id", "en", "s", 3), (22, "", "de", "t", 0)]
    return [*rows, rows[3]]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:4]])
def test_stages_with_odd_rows(spark, stage):
    """Nulls, repeated rows, empty and no texts, and an empty table pass every stage."""
    sf = "/root/testdata/sf0.001"
    docs = spark.createDataFrame(stage_rows(), DOCS)
    kept = stage(spark, docs, sf).collect()
    assert {r.doc_id for r in kept} >= set(range(12)) and tuple(kept[0].__fields__) == corpus_pipeline.COLUMNS
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_stages_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame(stage_rows(), DOCS)
    names = ["_gone", "gone", "_id", "_hash", "_spans", "cut_id", "cut_spans", "_size", "_taken", "mix_size", "_twice", "twice", "bucket", "share", "component_id", "kept"]
    wide = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    labels = common.table(spark, "/root/testdata/sf0.001", "labels")
    for out in (quality.filter_documents(wide, labels), near_dedup.drop_near_duplicates(wide), substring_dedup.rewrite_documents(wide), mixing.repeat_documents(wide)):
        rows = out.collect()
        assert out.columns == wide.columns and rows and all(r[n] == k for r in rows for k, n in enumerate(names))


def test_one_id_in_two_sources(spark):
    rows = [(1, "a b c d e f g h i j", "p"), (1, "k l m n o p q r s t", "q"), *[(10 + k, "u v w x", "p" if k % 3 else "q") for k in range(60)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.source_size] += r.taken
    got = mixing.repeat_documents(docs).groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()
    assert sorted(r.n for r in got) == sorted(want.values())


def test_no_rows(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = common.table(spark, "/root/testdata/sf0.001", "labels")
    assert near_dedup.near_duplicates(docs).count() == 0
    assert toxicity.rate_toxicity(docs, labels).count() == 0
    assert quality.judge_quality(docs, labels).count() == 0


def test_very_long_texts(spark):
    text = " ".join(f"t{k % 7919}" for k in range(60_000))
    docs = spark.createDataFrame([(1, text, "en"), (2, "short text", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(2, 1)], "doc_id long, quality int")
    assert quality.judge_quality(docs, labels).where("doc_id = 1").first().n_grams == len(text) + 1
    assert substring_dedup.dedup_substrings(docs.limit(1)).first().text.split()[:7919] == text.split()[:7919]


def test_run_of_the_pipeline(spark):
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = pieces.collect()
    assert rows and max(r.offset + r.length for r in rows) <= 4096
    ends = Counter()
    for r in rows:
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 4096


def test_tables_of_an_operator_are_deleted(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    with common.scratch(spark) as kept:
        first = common.written(docs.select("doc_id"), "first")
        kept.append(common.written(first.where("doc_id > 3"), "second"))
    assert kept[0].count() > 0
    with pytest.raises(Exception, match="(?i)exist|not found|FAILED_READ"):
        first.count()


def test_other_tokenizer_files_are_read_by_the_library(spark):
    from quillmark.llm import wordids
    from quillmark.llm.queries import tokenizer_path

    ids = wordids.WordIds(tokenizer_path("byte_bpe_50k.json"))
    assert not ids.plain and wordids.WordIds(tokenizer_path()).plain
    text = "Hello world, this  is\ta text."
    assert np.frombuffer(ids.encode(text), "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids
