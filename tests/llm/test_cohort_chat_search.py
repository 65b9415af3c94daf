"""Retention by secondary sort, chat formatting and ranked search against plain Python."""

import datetime
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import chat, cohort, lexical

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, rank string, piece string"
BEGIN = datetime.datetime(2024, 1, 1)
DAY = datetime.timedelta(days=1)


def clicks(n, seed, clients=12):
    """Skewed clicks with nulls, ties, repeats and late rows; client 3 has most of them."""
    r, rows = random.Random(seed), []
    for k in range(n):
        ts = BEGIN + DAY * r.randrange(100) + datetime.timedelta(microseconds=r.choice([0, 0, 1, 86_399_999_999]))
        client = 3 if r.random() < 0.5 else r.choice([None, *range(clients)])
        rows.append((r.choice([k, k, None]), r.choice([ts, ts, ts, None]), r.choice([ts, ts, None]), client, r.choice(["purchase", "view", "view", None]), r.choice([1.005, -2.5, None, math.nan]), "{}", "x", "y"))
    return rows + r.sample(rows, n // 5)


def plain_retention(rows, city):
    states = defaultdict(set)
    key = lambda row: tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in row)
    for row in {key(x) for x in rows}:
        click, ts, arrived, client = row[:4]
        if ts is None or client is None:
            continue
        h = zlib.crc32(str(click).encode()) if click is not None else 1
        states[1].add(row)
        if arrived is not None and arrived + (DAY * (h % 100) if h % 3 == 0 else 0 * DAY) < datetime.datetime(2024, 3, 1):
            states[0].add(row)
    start = {s: {} for s in (0, 1)}
    for s, own in states.items():
        for x in own:
            if x[4] == "purchase":
                start[s][x[3]] = min(x[1], start[s].get(x[3], x[1]))
    group = lambda t: (t - datetime.datetime(1970, 1, 1)) // DAY // 3
    cells = defaultdict(lambda: [set(), 0])
    for s, own in states.items():
        for x in own:
            if x[3] in start[s] and x[1] >= start[s][x[3]]:
                t = start[s][x[3]]
                cell = cells[s, city.get(x[3]) or "", group(t), (x[1] - t) // (3 * DAY)]
                cell[0].add(x[3])
                cell[1] += 0 if x[5] in (None, "nan") else math.floor(100 * x[5] + 0.5)
    moved = {c for c in start[0] if group(start[0][c]) != group(start[1][c])}
    return sorted((*k, len(u), sum(zlib.crc32(str(c).encode()) for c in u), len(u & moved), cents) for k, (u, cents) in cells.items())


@pytest.mark.parametrize("batch", [7, 10_000])
def test_retention(spark, batch):
    rows, city = clicks(900, 5), {c: "Ä" if c % 3 else None for c in range(8)}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        people = spark.createDataFrame([(c, v, "extra") for c, v in city.items()] + [(1, "Ä", "again")], "client_id long, city string, users string")
        got = cohort.retention(spark.createDataFrame(rows, CLICKS).repartition(5), people)
        assert got.columns == ["state", "segment", "cohort", "period", "users", "users_crc32", "moved", "cents"]
        assert sorted(map(tuple, got.collect())) == plain_retention(rows, city)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_hot_client_is_dealt_to_pieces(spark):
    df = spark.createDataFrame(clicks(900, 6, clients=3), CLICKS)
    runs = cohort.client_periods(df)
    assert runs.where("client_id = 3").agg(F.countDistinct("piece")).first()[0] > 1


def test_retention_of_nothing(spark):
    assert cohort.retention(spark.createDataFrame([], CLICKS), spark.createDataFrame([], "client_id long, city string")).count() == 0


TURNS = "conv_id long, turn long, role string, text string, formatted string, blocks string"


def plain_chat(rows):
    groups = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out, escaped = {}, lambda t: t.replace("\\", "\\b").replace("<", "\\l").encode()
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (*t[:2], escaped(t[2]), escaped(t[3])))
        spelled = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256(spelled.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    r = random.Random(2)
    bits = ["", "<", "\\", "\\b", "\\l", "<turn>", "</turn>\n", "<part>", "<text>", "\n", "é", "日本", "a b", "$1"]
    text = lambda: "".join(r.choice(bits) for _ in range(r.randrange(6)))
    rows = [(r.choice([1, 2, 3, 4, None]), r.choice([1, 1, 2, 3, 9, None]), r.choice(["user", "assistant", "assistant", None, "<x>\\"]), r.choice([text(), text(), None]), "c", "d") for _ in range(120)]
    rows += [(5, k, "assistant" if k % 3 else "user", f"{k}é<" * (k % 5), "c", "d") for k in range(700)] + [(6, 1, "user", "x" * 200_000, "", "")]
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    formatted = chat.format_conversations(df)
    got = {x[0]: tuple(x[1:5]) for x in chat.digests(formatted).collect()}
    assert got == plain_chat(rows)
    for row in formatted.collect():
        whole = row.formatted.encode()
        assert all(b"<" not in whole[s.start : s.start + s.length] for s in row.loss)
        assert row.formatted.count("<turn>") == row.formatted.count("</turn>\n")
        roles = re.findall("<turn>(.*?)<text>", row.formatted, re.S)
        assert all(a != b for a, b in zip(roles, roles[1:], strict=False))  # adjacent turns of a role are one block


def test_chat_is_native_and_takes_no_rows(spark):
    df = chat.digests(chat.format_conversations(spark.createDataFrame([], TURNS)))
    assert df.count() == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


DOCS = "doc_id long, text string, score string, item_id string"


def plain_ranks(docs, items, top):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(d[0], Counter(w)) for d in docs if (w := cut(d[1]))]
    n_docs, n_words = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(cut(text))
    out = []
    for item, terms in wanted.items():
        scores = []
        for doc, bag in bags:
            m = 100 - 50 + (50 * sum(bag.values()) * n_docs) // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in terms if bag[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, k + 1, None if no else doc, -s) for k, (s, no, doc) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def corpus(n, seed):
    r = random.Random(seed)
    word = lambda: r.choice(["The", "of", "x_y", "é", "Σίσυφος"]) if r.random() < 0.5 else f"w{int(r.expovariate(0.02))}"
    rows = [(r.choice([k, k, k, None]), " ".join(word() for _ in range(r.choice([0, 1, 5, 30, 200]))), "a", "b") for k in range(n)]
    return [*rows, *rows[:20], (n + 1, None, "a", "b"), (n + 2, "-- \x7f", "a", "b"), (n + 3, "w1 " * 3000, "a", "b")]


@pytest.mark.parametrize("how", [{"shard_docs": 40, "window": 8, "block_terms": 30}, {}])
def test_ranks(spark, how):
    docs = corpus(500, 3)
    items = [(k, d[1]) for k, d in enumerate(docs[:12])] + [(2, "w7 w9"), (99, None), (100, "."), (None, "the w3")]
    got = lexical.rank_documents(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string"), top=10, **how)
    assert sorted(map(tuple, got.collect()), key=str) == plain_ranks(docs, items, 10)


def test_words_in_slices():
    text = "Ab c-D \u00e9e_f 12 ".encode() * 50
    assert [w for part in lexical.words(text, 7) for w in part] == [w for part in lexical.words(text) for w in part]


def test_no_documents(spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.rank_documents(spark.createDataFrame([], DOCS), items).count() == 0
    assert lexical.rank_documents(spark.createDataFrame([(1, "a", "", "")], DOCS), items.limit(0)).count() == 0


def test_wand_skips_documents():
    """With a full heap of good documents, those of frequent terms alone are never scored."""
    r = np.random.default_rng(1)
    n = 20_000
    frequent, rare = np.arange(n), np.sort(r.choice(n, 60, replace=False))
    lists = [(frequent, r.integers(1, 100, n), 99), (rare, r.integers(900, 1000, 60), 999)]
    heap = lexical._Heap(50)
    scored = lexical.wand(lists, n, heap, np.arange(n), np.ones(n, bool))
    exact = lists[0][1].copy()
    exact[rare] += lists[1][1]
    assert list(heap.score) == sorted(exact, reverse=True)[:50]
    assert scored < n / 2
