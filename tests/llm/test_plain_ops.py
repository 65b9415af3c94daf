"""Operators whose results a few lines of Python give too: packing, media, URLs, token files, mixing, fingerprints."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import common, media, merkle, mixing, packing, token_files, url_filter, wordids
from quillmark.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
ODD = [
    (1, "Hello's World_1 ½ naïve café!! <|endoftext|> x", "b"),
    (2, None, None),
    (3, "", "a"),
    (4, "one two three. Four five.\nsix " * 400, "a"),
    (4, "one two three. Four five.\nsix " * 400, "a"),
    (5, "日本語 ΑΣ Σ İstanbul é \x1c tab wide", "c"),
    (None, "null id", "b"),
    (7, "x" * 5000, "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    clashing = ["start", "length", "size", "target", "digest", "host", "_block", "bucket"]
    return df.withColumns({c: F.lit("x") for c in clashing})


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def documents(spark):
    return common.table(spark, SF, "documents")


def test_word_ids_agree_with_the_library(spark, encode):
    mine = wordids.word_ids(tokenizer_path())
    texts = [t for _, t, _ in ODD] + [r.text for r in documents(spark).select("text").collect()]
    for t in texts:
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == encode(t)


@pytest.mark.parametrize("which", ["odd", "table"])
def test_packing(spark, odd, encode, which):
    docs = odd if which == "odd" else documents(spark)
    rows = packing.pack(docs, tokenizer_path()).collect()
    want = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        want[r.doc_id].append(encode(r.text) + [2])
    parts, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        parts[r.doc_id].append((r.start, r.length, r.doc_tokens, ids))
        seqs[r.sequence_id].append((r.offset, r.length))
    assert parts.keys() == want.keys()
    for doc, texts in want.items():
        pieces = sorted(parts[doc])
        for text in texts:  # repeated rows have the same pieces each
            at = 0
            while at < len(text):
                k = next(k for k, p in enumerate(pieces) if p[0] == at)
                _, n, total, ids = pieces.pop(k)
                assert total == len(text) and ids == text[at : at + n]
                at += n
        assert not pieces
    for spans in seqs.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
        assert sum(n for _, n in spans) <= 4096
    total = sum(len(t) for ts in want.values() for t in ts)
    assert len(seqs) <= math.ceil(total / 4096) + docs.rdd.getNumPartitions()


def test_packing_balances_cost():
    packer = packing.Packer(0, 100, 50, 1.0, 0.01)
    for k in range(400):
        packer.add(k, bytes(4 * (5 + k * 7 % 60)))
    packer.finish()
    used, cost = defaultdict(int), defaultdict(float)
    for _, _, n, _, s, _, _ in packer.out:
        used[s] += n
        cost[s] += packer.cost(n)
    assert max(used.values()) == 100 and 100 * len(used) - sum(used.values()) < 100
    cost = list(cost.values())
    assert np.std(cost) < 0.15 * np.mean(cost)


@pytest.mark.parametrize("which", ["odd", "table"])
def test_token_files(spark, odd, encode, which):
    docs = odd if which == "odd" else documents(spark)
    folder = common.new_path(spark, "t")
    manifest = token_files.write_token_files(docs, folder, tokenizer_path(), seq_len=64)
    got = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    want = sorted((r.doc_id if r.doc_id is not None else -1, crc(encode(r.text) + [1])) for r in docs.collect())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    first = manifest.orderBy("shard").first()
    reader = token_files.SequenceReader(first.tokens_uri)
    tokens, mask = reader.sequence(0)
    assert len(tokens) == 64 and mask.sum() == min(64, first.n_tokens)
    assert tokens.base is not None  # a view of the file, not a copy


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_media(spark, odd):
    docs = odd
    text = F.coalesce("text", F.lit(""))
    store = media.store_payloads(docs.select(F.encode(text, "UTF-8").alias("payload")))
    seqs = media.parse_pages(media.documents_as_pages(docs), id_col="doc_id")
    rows = media.resolve(media.references(seqs, id_col="doc_id"), media.read_features(store)).collect()
    assert len(rows) == len(ODD)
    texts = {i: (t or "").encode() for i, t, _ in ODD}
    by_text = defaultdict(set)
    for r in rows:
        raw = texts[r.doc_id]
        pad = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.payload_bytes, r.payload_sha256) == (len(pad), hashlib.sha256(pad).hexdigest())
        assert r.tail_crc32 == zlib.crc32(pad[-64:]) and r.caption == f"payload of {len(raw)} bytes"
        stored = f"P5\n64 {len(pad) // 64}\n255\n".encode() + pad
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        by_text[raw].add(r.feature)
    assert all(len(f) == 1 and None not in f for f in by_text.values())


def test_interleaving():
    d = "ab" * 32
    html = f"<h1>T</h1>one<br>two &amp; <figure><img src='sha256:{d}'><figcaption>cap <b>x</b></figcaption></figure>three<script>no</script><img alt=a src=y>"
    items = media.Interleaver().parsed(html)
    assert [(i["pos"], i["kind"], i["text"], i["digest"], i["caption"]) for i in items] == [
        (0, "text", "T", None, None),
        (1, "text", "one", None, None),
        (2, "text", "two &", None, None),
        (3, "media", None, d, "cap x"),
        (4, "text", "three", None, None),
        (5, "media", None, None, "a"),
    ]
    assert media.Interleaver().parsed(None) == [] == media.Interleaver().parsed("<p></p>")


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        (None, "", "", None, "allow"),
        ("no-scheme.org/x", "", "", None, "allow"),
        ("http://A.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"),
        ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("http://example.org?a/b", "example.org", "", None, "allow"),
        ("http://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"),
        ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
        ("http://x.com/fr/casino", "x.com", "/fr/casino", "com/fr/", "allow"),
        ("http://x.net/casino", "x.net", "/casino", None, "block"),
        ("http://x.net/casinos", "x.net", "/casinos", None, "allow"),
        ("http://cheap-cheap.net/", "cheap-cheap.net", "/", None, "allow"),
        ("http://cheap-pills.net/", "cheap-pills.net", "/", None, "block"),
        ("http://a.net://b.org/es/", "a.net:", "//b.org/es/", None, "allow"),
    ],
)
def test_urls(url, host, path, rule, verdict):
    judge = url_filter.Judge(url_filter.RULES, url_filter.STRICT, url_filter.SOFT, url_filter.SOFT_LIMIT)
    assert judge(url)[:4] == (host, path, rule, verdict)


@pytest.mark.parametrize("which", ["odd", "table"])
def test_mixing(spark, odd, which):
    docs = odd if which == "odd" else documents(spark)
    got = sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    assert got == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    import re

    size = lambda t: len(re.findall(mixing.WORD, t or ""))
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += size(r.text)
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be"))))}
    target, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while True:
        each = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        if not (over := {s for s in open_ if each[s] > 3 * sizes[s]}):
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        open_ -= over
    target |= each
    source = {r.doc_id: r.source for r in docs.collect()}
    taken = defaultdict(int)
    for doc, n, s_size, t, k in got:
        s = source[doc]
        assert s_size == sizes[s] and t == pytest.approx(target[s]) and 0 <= k <= 3 * n
        taken[s] += k
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(3, 0.01 * target[s])


def dice(a, b):
    """Likeness of two texts' sets of paragraphs."""
    x, y = ({p for p in re.split(r"(?<=\n)|(?<=[.!?] )", t) if p} or {""} for t in (a, b))
    return 2 * len(x & y) / (len(x) + len(y))


@pytest.mark.parametrize("which", ["odd", "table"])
def test_fingerprints(spark, odd, which):
    docs = (odd if which == "odd" else documents(spark)).select("doc_id", "text")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = defaultdict(list)
    for r in merkle.fingerprints(docs).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0), reverse=True)
    by_text = defaultdict(set)
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        r = next(r for r in got[i] if r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest())
        assert r.n_chars == len(t) and r.near_next == pytest.approx(dice(t, nxt)) and r.near_edited == pytest.approx(dice(t, edited))
        assert (r.fingerprint == r.edited_fingerprint) == (t == edited)
        by_text[t].add(r.fingerprint)
        if t == nxt:
            assert r.near_next == 1
    assert all(len(f) == 1 for f in by_text.values())
    assert len({f for fs in by_text.values() for f in fs}) == len(by_text)


def test_differing_branches(spark):
    a = "".join(f"Paragraph number {k} of this text.\n" for k in range(200))
    b = a.replace("number 77 ", "number xx ")
    fp = lambda t: merkle.fingerprint(merkle.leaves(F.col(t)), F.col(t))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(fp("a").alias("x"), fp("b").alias("y"))
    at, n = df.select(merkle.differing(F.col("x"), F.col("y")), F.size(merkle.branches(F.col("x")))).first()
    assert 1 <= len(at) <= 2 and n > 10


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert packing.pack(docs, tokenizer_path()).count() == 0
    assert mixing.mix(docs).count() == 0
    assert merkle.fingerprints(docs).count() == 0
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    manifest = token_files.write_token_files(docs, common.new_path(spark, "t"), tokenizer_path())
    assert token_files.read_token_files(manifest).count() == 0
    store = media.store_payloads(docs.select(F.encode("text", "UTF-8").alias("payload")))
    seqs = media.parse_pages(media.documents_as_pages(docs), id_col="doc_id")
    assert media.resolve(media.references(seqs, id_col="doc_id"), media.read_features(store)).count() == 0
