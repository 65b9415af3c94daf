"""Ranked lexical search: WAND over document shards.

One pass over the texts builds the inverted index of each shard of documents, for the terms of a block
of queries, as one row a shard in the shared folder; document frequencies are sums over those rows.  A
second pass reads the shards.  A shard knows each term's maximum impact.  For a query, a document whose
terms' maximum impacts do not reach the query's current k-th score is no pivot and is skipped; pivots
are selected a window of documents at a time, from the lists of those terms alone without which no
document can reach the k-th score, and only pivots are scored.  The heaps go on from shard to shard of
a task and are merged at the end, over parts of the tasks first.

All sums are 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

TOP = 50
#: A shard ends at so many documents or occurrences of query terms.
SHARD_DOCS, SHARD_WORDS = 16_384, 4_000_000
#: Queries are taken in blocks of about so many (query, term) pairs; each block passes over the texts.
BLOCK_TERMS = 200_000
#: Bytes of a text that are split at once, and the first window of documents.
SLICE, WINDOW = 4 << 20, 1024
#: Parts that the tasks' heaps are merged in first.
MERGES = 64

#: Letters and digits of ASCII, lower-cased, and all bytes of other characters; the rest separates terms.
_FOLD = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))

INDEX = "n_docs long, n_words long, ids array<long>, named array<boolean>, lengths array<long>, terms array<int>, ends array<int>, docs array<int>, tf array<int>"
FOUND = "item_id long, doc_id long, score long"


def words(text: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, a slice after the other."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + size)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def query_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item_id, term); rows with one id are one query, one without terms has no row."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms = sorted({t for part in words(text) for t in part})
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(terms), pa.int64()), pa.array(terms, pa.binary())], names=["item_id", "term"])

    texts = items.where(F.col(text_col).isNotNull()).select(F.col(item_col).cast("long"), F.col(text_col).cast("binary"))
    return texts.mapInArrow(split, "item_id long, term binary").distinct()


class _Shard:
    """Occurrences of query terms in a shard's documents, as they are read."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.named: list[bool] = []
        self.lengths: list[int] = []
        self.terms: list[np.ndarray] = []
        self.words = 0

    def add(self, doc_id: int | None, text: bytes, numbers: dict[bytes, int]) -> None:
        n, get = 0, numbers.get
        found: list[int] = []
        for part in words(text):
            n += len(part)
            found += [v for t in part if (v := get(t)) is not None]
        if n:
            self.ids.append(doc_id or 0)
            self.named.append(doc_id is not None)
            self.lengths.append(n)
            self.terms.append(np.array(found, np.int64))
            self.words += len(found)

    def index(self) -> pa.RecordBatch:
        n = len(self.ids)
        doc = np.repeat(np.arange(n), [len(x) for x in self.terms])
        key, tf = np.unique(np.concatenate(self.terms) * n + doc, return_counts=True)
        term = key // n
        ends = np.flatnonzero(np.append(term[1:] != term[:-1], len(term) > 0)) + 1
        columns = (self.ids, self.named, self.lengths, term[ends - 1], ends, key % n, tf)
        types = (pa.int64(), pa.bool_(), pa.int64(), *[pa.int32()] * 4)
        lists = [pa.array([c], pa.list_(t)) for c, t in zip(columns, types, strict=True)]
        sizes = [pa.array([n], pa.int64()), pa.array([sum(self.lengths)], pa.int64())]
        return pa.RecordBatch.from_arrays(sizes + lists, names=[x.split()[0] for x in INDEX.split(", ")])


def build_index(docs: DataFrame, numbers: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row a shard: its documents with at least one term, and the lists of the numbered terms."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard.add(doc_id, text.as_py(), numbers)
                if len(shard.ids) >= shard_docs or shard.words >= SHARD_WORDS:
                    yield shard.index()
                    shard = _Shard()
        if shard.ids:
            yield shard.index()

    common.small_batches(docs.sparkSession)
    texts = docs.where(F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("binary"))
    return texts.mapInArrow(shards, INDEX)


@dataclass
class Queries:
    """A block of queries: ids, term numbers, and each term's weight."""

    ids: list[int | None]
    terms: list[np.ndarray]
    weights: np.ndarray
    n_docs: int
    n_words: int


class _Heap:
    """The best documents of a query so far: highest score first, equal scores by id, without id last."""

    def __init__(self, top: int) -> None:
        self.top, self.score, self.id, self.named = top, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def least(self) -> int:
        """What a document needs to get in; at an equal score its id may be smaller."""
        return max(1, int(self.score[-1])) if len(self.score) == self.top else 1

    def push(self, score: np.ndarray, ids: np.ndarray, named: np.ndarray) -> None:
        score, ids, named = (np.concatenate(x) for x in ((self.score, score), (self.id, ids), (self.named, named)))
        best = np.lexsort((ids, ~named, -score))[: self.top]
        self.score, self.id, self.named = score[best], ids[best], named[best]


def impacts(tf: np.ndarray, weight: np.ndarray, length: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """A term's share of a document's score."""
    m = 100 - 50 + (50 * length * n_docs) // n_words
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def wand(lists: list[tuple[np.ndarray, np.ndarray, int]], n_docs: int, heap: _Heap, ids: np.ndarray, named: np.ndarray, window: int = WINDOW) -> int:
    """Rank a shard's documents for one query; ``lists`` are (documents, impacts, maximum impact).  Returns how many were scored."""
    lists = sorted(lists, key=lambda x: -x[2])
    top = np.array([x[2] for x in lists], np.int64)
    rest = np.append(np.cumsum(top[::-1])[::-1], 0)  # most that the terms from here on can give
    low, width, scored = 0, window, 0
    while low < n_docs:
        need = heap.least()
        leading = int((rest[:-1] >= need).sum())  # a document with none of these cannot get in
        if not leading:
            break
        high = min(n_docs, low + width)
        bound = np.zeros(high - low, np.int64)
        for docs, _, most in lists[:leading]:
            a, b = np.searchsorted(docs, (low, high))
            bound[docs[a:b] - low] += most
        pivots = np.flatnonzero((bound > 0) & (bound + rest[leading] >= need)) + low
        score = np.zeros(len(pivots), np.int64)
        bound = bound[pivots - low] + rest[leading]
        for k, (docs, impact, most) in enumerate(lists):
            if not len(pivots):
                break
            at = np.minimum(np.searchsorted(docs, pivots), len(docs) - 1)
            hit = docs[at] == pivots
            gain = np.where(hit, impact[at], 0)
            score += gain
            bound += gain - (np.where(hit, most, 0) if k < leading else most)
            alive = bound >= need
            if not alive.all():
                pivots, score, bound = pivots[alive], score[alive], bound[alive]
        scored += len(pivots)
        good = score >= need
        if good.any():
            heap.push(score[good], ids[pivots[good]], named[pivots[good]])
        low, width = high, 2 * width
    return scored


def search(index: DataFrame, queries: Queries, top: int = TOP, window: int = WINDOW) -> DataFrame:
    """The best documents of each task's shards for every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [_Heap(top) for _ in queries.ids]
        for batch in batches:
            for row in range(batch.num_rows):
                _search_shard(batch, row, queries, heaps, window)
        for item, h in zip(queries.ids, heaps, strict=True):
            n = len(h.score)
            yield pa.RecordBatch.from_arrays(
                [pa.array([item] * n, pa.int64()), pa.array(h.id, pa.int64(), mask=~h.named), pa.array(h.score, pa.int64())], names=["item_id", "doc_id", "score"]
            )

    return index.mapInArrow(run, FOUND)


def _search_shard(batch: pa.RecordBatch, row: int, queries: Queries, heaps: list[_Heap], window: int) -> None:
    get = lambda name: batch.column(name)[row].values.to_numpy(zero_copy_only=False)
    ids, named, lengths, terms, ends = get("ids"), get("named"), get("lengths"), get("terms"), get("ends")
    docs, tf = get("docs").astype(np.int64), get("tf").astype(np.int64)
    if not len(terms):
        return
    starts = np.append(0, ends[:-1])
    weight = np.repeat(queries.weights[terms], ends - starts)
    impact = impacts(tf, weight, lengths[docs], queries.n_docs, queries.n_words)
    most = np.maximum.reduceat(impact, starts)
    place = np.full(len(queries.weights), -1, np.int64)
    place[terms] = np.arange(len(terms))
    for wanted, heap in zip(queries.terms, heaps, strict=True):
        here = place[wanted]
        here = here[(here >= 0) & (most[here] > 0)]
        if len(here):
            wand([(docs[starts[k] : ends[k]], impact[starts[k] : ends[k]], int(most[k])) for k in here.tolist()], len(ids), heap, ids, named, window)


def document_frequencies(index: DataFrame) -> DataFrame:
    """term number, df; a row a term and task is shuffled."""
    sizes = F.transform("ends", lambda e, k: e - F.coalesce(F.get(F.col("ends"), k - 1), F.lit(0)))
    pairs = index.select(F.explode(F.arrays_zip(F.col("terms").alias("term"), sizes.alias("df"))).alias("x"))
    return pairs.groupBy("x.term").agg(F.sum("x.df").alias("df"))


def _best(found: DataFrame, by: list[str | Column], top: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def _rank_block(docs: DataFrame, wanted: DataFrame, top: int, shard_docs: int, window: int) -> DataFrame:
    by_item: dict[int | None, list[bytes]] = {}
    for item, term in wanted.collect():
        by_item.setdefault(item, []).append(bytes(term))
    numbers = {t: k for k, t in enumerate(sorted({t for terms in by_item.values() for t in terms}))}
    index = common.written(build_index(docs, numbers, shard_docs=shard_docs), "lexical-index")
    n_docs, n_words = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    df = np.zeros(len(numbers), np.int64)
    for term, n in document_frequencies(index).collect():
        df[term] = n
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    terms = [np.array([numbers[t] for t in x], np.int64) for x in by_item.values()]
    found = search(index, Queries(list(by_item), terms, weights, n_docs, max(n_words, 1)), top, window)
    parts = _best(found.withColumn("part", F.spark_partition_id() % MERGES), ["item_id", "part"], top)
    return common.written(_best(parts, ["item_id"], top).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "lexical-ranks")


def rank_documents(docs: DataFrame, items: DataFrame, *, top: int = TOP, block_terms: int = BLOCK_TERMS, shard_docs: int = SHARD_DOCS, window: int = WINDOW) -> DataFrame:
    """The ``top`` documents with a score above 0 for every item, ranked from 1.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, of the whole text; only A-Z
    is lower-cased.  Null, empty and wordless texts count as no document; of repeated rows each is one.
    Equal scores stand by ascending id, null ids last.  Items with one id are one query with all their
    terms, items without terms have no row.  A term of every document weighs nothing, none weighs less.
    Other columns are ignored.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    with common.scratch(spark) as kept:
        pairs = common.written(query_terms(items), "query-terms")
        blocks = max(1, -(-pairs.count() // block_terms))
        block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
        ranked = [_rank_block(docs, pairs.where(block == b), top, shard_docs, window) for b in range(blocks)]
        kept += ranked
    out = ranked[0]
    for more in ranked[1:]:
        out = out.unionByName(more)
    return out
