"""Near-duplicates, repeated passages, toxicity, quality and the pipeline against brute force and held-out labels."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmark.llm import common, components, mixing, near, near_dedup, quality, substring_dedup, toxicity

SF = "/root/testdata/sf0.001"


def prose(seed, n):
    draw = random.Random(seed)
    return [f"w{draw.randrange(10_000)}" for _ in range(n)]


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def brute_components(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    at = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    for i, s in sets.items():
        for j, k in Counter(j for x in s for j in at[x] if j > i).items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def edited(words, k, seed):
    draw, out = random.Random(seed), list(words)
    for at in draw.sample(range(len(out)), k):
        out[at] = f"e{seed}x{at}"
    return out


def near_rows():
    base, rows = prose(1, 150), []
    rows += [(10 + k, " ".join(edited(base, k % 6, k))) for k in range(60)]  # a tight group, mostly out of reach of each other
    rows += [(200 + k, "Exact copy of a short text here") for k in range(5)] + [(300, "exact COPY of a\tshort text  here")]
    rows += [(400, None), (401, ""), (402, "two words"), (403, "Two Words"), (404, " ".join(prose(9, 12_000)))]
    return rows


def test_near_duplicates(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows + [(None, "exact copy of a short text here"), rows[0]], "doc_id long, text string")
    got = near_dedup.near_duplicates(df.withColumns({c: F.lit(0) for c in ("node", "comp", "bands", "key")})).collect()
    want = brute_components(rows)
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept, r.n_shingles) == (want[r.doc_id], want[r.doc_id] == r.doc_id, len(shingles(dict(rows)[r.doc_id])))


def test_near_duplicates_on_the_table(spark):
    docs = common.table(spark, SF, "documents")
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()} == want
    kept = [r.doc_id for r in near_dedup.drop_near_duplicates(docs.union(docs)).collect()]
    assert sorted(kept) == sorted(set(want.values()))


def test_sketches_keep_links_and_drop_strangers(spark):
    minmax = near.MinMax(36, 7)
    rng = np.random.default_rng(5)
    common_, rows = rng.integers(0, 1 << 63, 1000, dtype=np.uint64), []
    for share in (0.93, 0.6):  # Jaccard 0.87 and 0.43
        n = int(1000 * share)
        for _ in range(20):
            own = [np.unique(np.concatenate([common_[:n], rng.integers(0, 1 << 63, 1000 - n, dtype=np.uint64)])) for _ in range(2)]
            rows.append((share, *[minmax.sketches(minmax.values(s, np.zeros(1, np.int64)))[0].tolist() for s in own]))
    df = spark.createDataFrame(rows, "share double, a array<long>, b array<long>")
    got = df.groupBy("share").agg(F.count_if(near.may_link("a", "b", 85)).alias("n")).collect()
    assert {r.share: r.n for r in got} == {0.93: 20, 0.6: 0}


def test_band_keys_of_a_long_text_do_not_depend_on_cuts():
    minmax = near.MinMax(12, 3)
    x = np.random.default_rng(3).integers(0, 1 << 63, 300_000, dtype=np.uint64)
    starts = np.array([0, 7, 200_000, 200_001])
    whole = minmax.keys(minmax.values(x, starts))
    for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(x)], strict=True)):
        assert (minmax.keys(minmax.values(x[s:e], np.zeros(1, np.int64)))[0] == whole[k]).all()


def test_components(spark):
    draw = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(draw.randrange(100), draw.randrange(100)) for _ in range(60)] + [(500, 500 + k) for k in range(1, 300)]
    up = {n: n for e in edges for n in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for e in edges for n in e if e[0] != e[1]}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_grow_by_further_links(spark):
    """Links that come later join components and new nodes; the names are as if all had been there, in few files."""
    draw = random.Random(7)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(held, ("40", "false"), strict=True):
            spark.conf.set(k, v)
        first = components.components(frame(edges[:150]))
        assert len(first.inputFiles()) < 10
        got = components.extended(first, frame(edges[150:]))
        want = components.components(frame(edges))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def sentences(seed, n):
    w = prose(seed, n)
    return " ".join(x + ("." if k % 9 == 8 else "") for k, x in enumerate(w)) + "."


def test_substring_dedup(spark):
    passage, other = sentences(77, 60), sentences(78, 70)
    near_copy = " ".join(edited(other.split(), 1, 3))
    rows = [
        (1, f"{sentences(1, 40)}\n{passage}\n{sentences(2, 40)}"),
        (2, f"{sentences(3, 40)}\n{passage}"),
        (3, f"{sentences(4, 40)} {passage} {sentences(5, 60)}"),  # inside a line
        (4, f"{other}\nshort line\n{sentences(6, 30)}"),
        (5, f"{near_copy}\nshort line\n{sentences(7, 30)}"),
        (6, sentences(8, 90)),
        (7, None),
        (8, ""),
        (9, passage),
        (None, passage),
    ]
    df = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string").withColumn("cls", F.lit("x"))
    got = defaultdict(list)
    for r in substring_dedup.dedup_substrings(df).collect():
        got[r.doc_id].append(r)
    text = {i: t for i, t in rows}
    for same in (1, 4, 6, 7, 8, None):
        assert all(r.text == text[same] and r.n_removed == 0 for r in got[same])
    assert len(got[6]) == 2
    assert got[2][0].text.strip() == text[2].split("\n")[0]
    assert got[5][0].text == "\n".join(text[5].split("\n")[1:])
    assert got[9][0].text == ""
    assert substring_dedup.dedup_substrings(df.limit(0)).count() == 0


def test_passage_inside_a_line(spark):
    passage = sentences(77, 60)
    rows = [(1, passage), (3, f"{sentences(4, 40)} {passage} {sentences(5, 60)}")]
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3].n_removed >= 1 and len(got[3].text) <= len(rows[1][1]) - 80


@pytest.mark.parametrize("sf", [pytest.param("sf0.01", marks=pytest.mark.xfail(reason="open: about 38 toxic documents to learn from find 9 of 14")), "sf0.1"])
def test_toxicity_held_out(spark, sf):
    sf = f"/root/testdata/{sf}"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    train, held = labels.where("doc_id % 4 <> 1"), labels.where("doc_id % 4 = 1")
    scored = toxicity.rate_toxicity(docs, train).join(held.select("doc_id", F.col("toxic").alias("label")), "doc_id").collect()
    right = Counter((r.label == 1, r.toxic) for r in scored)
    assert right[(True, True)] >= 0.8 * (right[(True, True)] + right[(True, False)])
    assert right[(False, True)] <= 0.02 * len(scored)
    odd = spark.createDataFrame([(1, None), (None, ""), (3, "x " * 50_000)], "doc_id long, text string")
    rows = toxicity.rate_toxicity(odd, labels.limit(0)).collect()
    assert len(rows) == 3 and not any(r.toxic for r in rows)


def test_toxicity_held_out_in_each_language(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    train, held = labels.where("doc_id % 4 <> 1"), labels.where("doc_id % 4 = 1 AND toxic = 1")
    scored = toxicity.rate_toxicity(docs, train).withColumnRenamed("toxic", "toxic_found").join(held, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    got = {r.lang: r.n / r.all for r in scored.groupBy("lang").agg(F.count_if(F.col("toxic_found")).alias("n"), F.count("*").alias("all")).collect()}
    assert set(got) == {"de", "en", "es", "fr"} and min(got.values()) >= 0.7, got


def test_ordinal_thresholds_are_ordered():
    rows = [Counter({1: 1, 2: k % 3, 3: 1}) for k in range(60)] + [Counter({7: 1 + k % 9, 3: 1}) for k in range(60)]
    model = toxicity.fit(rows, np.arange(120) >= 60)
    above = model.above(np.array([-2.0, 0.0, 5.0]))
    assert (np.diff(model.thresholds) >= 0).all() and (np.diff(above, axis=1) <= 0).all() and (np.diff(above, axis=0) >= 0).all()


def test_quality_probabilities_sum_to_one(spark):
    texts = spark.createDataFrame([("en", "abab abba baab"), ("en", "aabb"), ("de", "zzyx")], "lang string, text string")
    path, n = quality.sharded(quality.kneser_ney(quality.count_grams(texts)))
    shards = quality.Shards.of(path, n)
    seen = sorted({*"abab abba baabaabb"} | {chr(quality.STOP)})
    for context in ("aba", "bbb", "zab", "qqq"):
        code = [quality.grams_of(context, x) for x in [*seen, "￮"]]
        p = np.exp(shards.log_probability(np.array(code, np.uint64), "en"))
        assert p.sum() == pytest.approx(1, abs=1e-6) and (p > 0).all()
    assert shards.log_probability(np.array([1], np.uint64), "xx") is None


def test_quality_filter(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    rows = quality.judge_quality(docs, labels).join(labels, "doc_id").collect()
    kept = Counter((r.quality, r.kept) for r in rows)
    assert kept[(1, True)] >= 0.99 * (kept[(1, True)] + kept[(1, False)])
    assert kept[(0, False)] >= 0.8 * (kept[(0, False)] + kept[(0, True)])
    odd = spark.createDataFrame([(1, None, "en"), (2, "", None), (None, "text", "en"), (4, "text", None)], "doc_id long, text string, lang string")
    assert all(r.kept for r in quality.judge_quality(odd, labels.limit(0)).collect())


def test_repeated_documents(spark):
    docs = common.table(spark, SF, "documents")
    mixed = mixing.repeat_documents(docs)
    want = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    got = mixed.groupBy("doc_id").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {k: v for k, v in want.items() if v}
    assert mixed.columns == docs.columns


def test_pipeline(spark):
    docs = common.table(spark, SF, "documents")
    n = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, SF), name)
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        n.append(docs.count())
    assert n[0] > n[1] > n[2] == n[3]
    texts = brute_components([(r.doc_id, r.text) for r in docs.dropDuplicates(["doc_id"]).collect()], 80)
    assert len(set(texts.values())) >= 0.97 * len(texts)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.agg(F.sum("length")).first()[0] == pieces.where("start = 0").agg(F.sum("doc_tokens")).first()[0]


def test_every_passage_of_fifty_words_goes(spark):
    """A passage anywhere in a line, or spread over short lines, goes whole; the rest of the text stays."""
    rows = [(1, " ".join(prose(500, 200)))]
    words = rows[0][1].split()
    for k in range(40):
        n = 50 + k % 20
        own = [*prose(600 + k, 30 + k), *words[k : k + n], *prose(700 + k, 45)]
        gap = "\n" if k % 4 == 3 else " "
        rows.append((10 + k, (gap if k % 4 == 3 else " ").join(own)))
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0
    for k in range(40):
        assert got[10 + k].text.split() == [*prose(600 + k, 30 + k), *prose(700 + k, 45)], k


def test_a_tight_group_mostly_out_of_reach(spark, monkeypatch):
    """Many near copies of one text, most pairs below the threshold: exact components, rows in proportion to members."""
    base, rows = prose(41, 150), []
    rows += [(k, " ".join(edited(base, k % 9, k))) for k in range(600)]
    rows += [(1000 + k, " ".join(edited(prose(42, 150), 7, k))) for k in range(300)]  # far apart from each other
    made = []
    real = near.written

    def counted(df, name, *args):
        table = real(df, name, *args)
        if name.startswith("links-"):
            made.append(table.count())
        return table

    monkeypatch.setattr(near, "written", counted)
    monkeypatch.setattr(near, "BLOCK_ITEMS", 5000)  # many blocks
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)
    assert sum(made) <= 4 * len(rows)


@pytest.mark.parametrize("parts", [1, 4])
@pytest.mark.parametrize("turned", [False, True])
def test_one_id_with_several_texts(spark, parts, turned):
    """Links of any of an id's texts are links of the id, whatever the order of rows."""
    a, b = (" ".join(f"{c}{k}" for k in range(300)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, "something else of six words"), (4, a + " z"), (9, "alone here"), (9, None)]
    rows = rows[::-1] if turned else rows
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9}


def test_texts_that_are_taken_together_keep_their_own_units():
    r = random.Random(11)
    words = ["eins", "zwei", "Drei", "vier", "fünf", "日本", "six", "SIX", "x" * 90]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts = ["", "\n", line(49), line(50), line(51), "one two " * 60, " \t".join(line(3) for _ in range(40)), *["\n".join(line(r.randrange(30)) for _ in range(9)) for _ in range(9)], ""]
    together = substring_dedup.Words([t.encode() for t in texts])
    minmax = near.MinMax(substring_dedup.BANDS, substring_dedup.ROWS)
    for part in (lambda w: substring_dedup._line_units(w, minmax), substring_dedup._run_units):
        text, *cols = part(together)
        for k, t in enumerate(texts):
            own, *alone = part(substring_dedup.Words([t.encode()]))
            assert not own.any() and all(np.array_equal(a[text == k], b) for a, b in zip(cols, alone, strict=True))
    text, at, _ = together.runs()
    for k, t in enumerate(texts):
        begins = (at[text == k] - together.word[k]).tolist()
        for b in range(len(t.split()) - 49):  # of any 50 words a whole run is selected
            assert any(b <= x <= b + 24 for x in begins)
    hashes = {}
    for h, w in zip(together.hash.tolist(), " ".join(texts).encode().lower().split(), strict=True):
        assert hashes.setdefault(w, h) == h
    assert len(set(hashes.values())) == len(hashes)


def test_removals_come_in_few_files(spark):
    """A small table of removals is no file a shuffle partition."""
    line = " ".join(f"word{k}" for k in range(40))
    rows = [(k, f"{line} {k % 30}\n{' '.join(f'w{k}x{j}' for j in range(60))}") for k in range(60)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(held, ("40", "false"), strict=True):
            spark.conf.set(k, v)
        gone = substring_dedup.removals(texts)
        assert gone.count() > 0
        assert len(gone.inputFiles()) < 5
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
