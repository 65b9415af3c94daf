"""Communities, vocabularies, policy search, classifiers and answer items against plain versions."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import answers, calibrate, community, learning, terms


def q_of(labels, pairs):
    m = sum(w for *_, w in pairs)
    ends = Counter()
    for a, b, w in pairs:
        ends[labels[a]] += w
        ends[labels[b]] += w
    return sum(w for a, b, w in pairs if labels[a] == labels[b]) / m - sum(k * k for k in ends.values()) / (4 * m * m)


def greedy(nodes, pairs):
    """Plain greedy agglomeration: the best merge of two communities until none gains."""
    labels = {n: n for n in nodes}
    while True:
        now, best = q_of(labels, pairs), None
        for a, b in itertools.combinations(sorted(set(labels.values())), 2):
            q = q_of({n: a if c == b else c for n, c in labels.items()}, pairs)
            if q > now + 1e-12 and (best is None or q > best[0]):
                best = (q, a, b)
        if best is None:
            return now
        labels = {n: best[1] if c == best[2] else c for n, c in labels.items()}


def cliques(sizes, seed, extra=4):
    r, pairs, start, groups = random.Random(seed), {}, 0, []
    for s in sizes:
        group = list(range(start, start + s))
        groups.append(group)
        pairs.update({p: 1 for p in itertools.combinations(group, 2) if r.random() < 0.8})
        start += s
    for a, b in zip(groups, groups[1:], strict=False):
        pairs[a[0], b[-1]] = 1
    for _ in range(extra):
        a, b = sorted(r.sample(range(start), 2))
        pairs[a, b] = r.choice([1, 2])
    return list(range(start)), [(a, b, w) for (a, b), w in pairs.items()]


def star(n):
    return list(range(n + 3)), [(0, k, 1) for k in range(1, n)] + [(n, n + 1, 3), (n + 1, n + 2, 3), (0, n, 1)]


@pytest.mark.parametrize("graph", [cliques([5, 6, 4], 1), cliques([4, 4, 4, 5], 2, 8), star(12)], ids=["cliques", "noisy", "star"])
def test_communities_are_a_local_optimum(spark, graph):
    nodes, pairs = graph
    n = spark.createDataFrame([(k,) for k in nodes] + [(99,)], "node_id long")
    e = spark.createDataFrame([(b, a, w) for a, b, w in pairs] + [(1, 1, 9), (None, 2, 5), (2, 77, 5)], "source long, target long, evidence_count long")
    gains = []
    labels = {r.node_id: r.community for r in community.modularity_communities(n, e, min_gain=0.0, watch=lambda phase, gain: gains.append(gain)).collect()}
    assert labels.pop(99) == 99 and set(labels) == set(nodes)
    assert all(c == min(k for k, v in labels.items() if v == c) for c in labels.values())
    q = q_of(labels, pairs)
    assert all(g > 0 for g in gains)
    assert q >= greedy(nodes, pairs) - 1e-9
    near = defaultdict(set)
    for a, b, _ in pairs:
        near[a].add(labels[b])
        near[b].add(labels[a])
    for v, c in ((v, c) for v in nodes for c in near[v] - {labels[v]}):
        assert q_of({**labels, v: c}, pairs) <= q + 1e-9  # no single move gains
    for a, b in itertools.combinations(set(labels.values()), 2):
        assert q_of({k: a if c == b else c for k, c in labels.items()}, pairs) <= q + 1e-9  # no merge gains
    rows = spark.createDataFrame([(a, b, float(w)) for a, b, w in pairs], "a long, b long, w double")
    assert community.modularity(spark.createDataFrame(list(labels.items()), "node_id long, community long"), rows) == pytest.approx(q)


def test_no_edges(spark):
    n = spark.createDataFrame([(1,), (2,), (2,), (None,)], "node_id long")
    e = spark.createDataFrame([], "source long, target long, evidence_count long")
    assert sorted(map(tuple, community.modularity_communities(n, e).collect())) == [(1, 1), (2, 2)]


def test_term_spans(spark):
    r = random.Random(4)
    bits = ["new", "New", "York", "york", " ", "  ", "\n", "-", "é", "a", "ab", "ab_c", "x-y", ".", "日本", "(", "O'Neil"]
    texts = {str(k): "".join(r.choice(bits) for _ in range(r.randrange(40))) for k in range(60)}
    words = ["New York", "new", "ab", "x-y", "a", "O'Neil", "york new york", "(", "one two three four five", " ", "York  new"]
    got = terms.term_spans(spark.createDataFrame([*texts.items(), ("n", None)], "id string, text string"), spark.createDataFrame([(w,) for w in [*words, "new"]], "term string"), "id")
    want = set()
    for key, text in texts.items():
        for w in words:
            tokens = terms._WORD.findall(w.strip())
            if not 0 < len(tokens) <= terms.MOST_WORDS:
                continue
            escaped = re.sub(r"(\\\s)+", r"\\s+", re.escape(w.lower()))
            for start in range(len(text)):
                m = re.compile(escaped).match(text.lower(), start)
                word = lambda c: bool(re.match("[A-Za-z0-9_]", c))
                if m and not (start and word(text[start - 1]) and word(text[start])) and not (m.end() < len(text) and word(text[m.end()]) and word(text[m.end() - 1])):
                    want.add((key, w, start, m.end()))
    assert {tuple(x) for x in got.collect()} == want and want


def test_salience_search(spark):
    r = random.Random(3)
    rows = [(*[round(r.uniform(0, 10), 1) for _ in calibrate.AXES], r.choice([0, 1, 2, 3])) for _ in range(300)]
    df = spark.createDataFrame(rows, ", ".join(f"{a} double" for a in calibrate.AXES) + ", target int")
    best, course = calibrate.search_salience(df, "target", random_count=12, passes=2, seed=1)
    assert all(a >= b for a, b in zip(course, course[1:], strict=False)) and course[-1] < course[0]
    axes = {a: np.array([x[k] for x in rows]) for k, a in enumerate(calibrate.AXES)}
    said, target = calibrate.salience_predictions(axes, best), np.array([x[-1] for x in rows])
    penalty = np.mean([calibrate.salience_penalty(t, p) for t, p in zip(target, said, strict=True)])
    f1 = np.mean([2 * ((said == k) & (target == k)).sum() / ((said == k).sum() + (target == k).sum()) for k in range(4) if ((said == k) | (target == k)).any()])
    assert course[-1] == pytest.approx(penalty + 0.35 * (1 - (said == target).mean()) + 0.15 * (1 - f1))
    assert calibrate.search_salience(df.repartition(3), "target", random_count=12, passes=2, seed=1) == (best, course)


def test_classifiers_beat_the_commonest_route(spark):
    r = random.Random(6)
    rows = []
    for k in range(600):
        route = r.choice([0.0, 0.0, 1.0, 2.0, 3.0])
        rows.append((k, float(route + r.gauss(0, 0.4)), float(r.random()), None if k % 50 == 0 else route * route + r.gauss(0, 1), route if k % 97 else None))
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, route double")
    cases = learning.examples(df, "id", ["a", "b", "c"], "route")
    again = learning.examples(df.repartition(5), "id", ["a", "b", "c"], "route")
    assert {(x.id, x.fold) for x in cases.collect()} == {(x.id, x.fold) for x in again.collect()}
    models = learning.route_models(trees=5, rounds=2)
    judged = learning.evaluate_models(cases, models, folds=3)
    assert judged.groupBy("model", "id").count().where("count <> 1").isEmpty()
    metrics = {x.model: x for x in learning.route_metrics(judged).collect()}
    assert set(metrics) == set(models) and all(m.exact > 0.6 for m in metrics.values())
    found = learning.importances(models["decision_tree"]().fit(cases), ["a", "b", "c"])
    assert found[0][1] in ("a", "c") and sum(w for *_, w in found) == pytest.approx(1.0)
    assert len(learning.importances(models["logistic_regression"]().fit(cases), ["a", "b", "c"], top=2)) == 8


def test_ranking_metrics(spark):
    r = random.Random(8)
    rows = [(f"{k}", k // 7, float(r.random() < 0.3), round(r.random(), 1)) for k in range(400)]
    got = learning.ranking_metrics(spark.createDataFrame(rows, "id string, packet_id long, label double, probability double")).first()
    pos = [x[3] for x in rows if x[2]]
    neg = [x[3] for x in rows if not x[2]]
    assert got.roc_auc == pytest.approx(np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]), abs=1e-5)
    at = [(sum(p >= s for p in pos), sum(n >= s for n in neg)) for s in pos]
    assert got.average_precision == pytest.approx(np.mean([p / (p + n) for p, n in at]), abs=1e-5)
    firsts = []
    for packet in {x[1] for x in rows}:
        ranked = sorted((x for x in rows if x[1] == packet), key=lambda x: (-x[3], x[0]))
        firsts += [next(k + 1 for k, x in enumerate(ranked) if x[2])] if any(x[2] for x in ranked) else []
    assert (got.packets, got.mrr) == (len(firsts), pytest.approx(np.mean([1 / k for k in firsts]), abs=1e-5))


def test_answer_items(spark):
    rows = [
        (3, "Same    text", "context_only", "checked", "can_answer", ["w2", "w1"], ["bm25"], ["r3"], ["e"]),
        (1, "same text", "context_only", "checked", "background_only", ["w1"], None, ["r1", "r2"], None),
        (2, "SAME TEXT ", "context_only", "checked", "supporting_context", None, ["embedding", "bm25"], ["r2", "r4", "r5"], ["e"]),
        (4, None, "context_only", "checked", "background_only", [], [], [], ["b", "a"]),
        (5, " ", "context_only", "checked", "background_only", [], [], [], ["a", "b"]),
        (6, "same text", "direct_evidence", "checked", "background_only", [], [], [], []),
    ]
    df = spark.createDataFrame(rows, "position long, text string, type string, evidence_support string, use_policy string, warnings array<string>, retrieved_by array<string>, reasons array<string>, evidence_refs array<string>")
    got = {x.position: x for x in answers.merge_items(df.withColumn("q", F.lit(1)), ["q"]).collect()}
    assert {k: v.n_items for k, v in got.items()} == {1: 3, 4: 2, 6: 1}
    one = got[1]
    assert (one.text, one.use_policy, one.warnings, one.retrieved_by, one.reasons) == ("Same    text", "can_answer", ["w1", "w2"], ["embedding", "bm25"], ["r1", "r2", "r4", "r5"])
    assert got[4].text_key == "refs:a|b"
