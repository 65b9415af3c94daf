"""Near-duplicate components: banded signatures find candidates, full sets confirm links.

Candidates of a bucket are never all its pairs.  Members are first compared with the bucket's
smallest member, one bucket a member, then all buckets between still separate components.  What
stays separate goes through rounds.  In each the bucket's front, its largest component and a few
further members (``GROWTH`` times as many each round), meets the others: whether one belongs to that
component takes a semi-join, which gives a row a member and not a row a pair, and of the further
members only true links come out.  Both conditions hold the full sets, so nothing has to be confirmed
later.  The front has then met the whole bucket and leaves it; rounds end when no bucket has members
of two components.  So components are those of all links between members of a common bucket, while
the rows that are made follow the members, whatever the group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, few, scratch, written
from .components import components, extended

#: Further members of a bucket's front: so many at first, by this factor more each round, up to a number.
GROWTH, PIVOTS = 64, 4096
#: Set elements of a bucket's side that meet in one task; larger sides are dealt in blocks.
BLOCK_ITEMS = 1 << 20
#: Bands and rows whose values a sketch holds, and the slack of its comparison.
SKETCH, QUICK_WORDS, DEVIATIONS = (72, 7), 12, 4.5
_29, _32, _33 = np.uint64(29), np.uint64(32), np.uint64(33)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


class MinMax:
    """Min-max hashing: the least and the greatest value under each of ``perms`` permutations.

    ``x -> a * x + b (mod 2**32)`` with odd ``a`` permutes 32-bit values.  Both ends match with the
    sets' Jaccard similarity, so ``perms`` evaluations give ``2 * perms`` signature values.
    """

    def __init__(self, bands: int, rows: int, seed: int = 1):
        self.bands, self.rows = bands, rows
        perms = -(-bands * rows // 2)
        draw = np.random.default_rng(seed)
        self.a = draw.integers(0, 1 << 32, (perms, 1), dtype=np.uint32) | np.uint32(1)
        self.b = draw.integers(0, 1 << 32, (perms, 1), dtype=np.uint32)
        self.mix = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
        self.salt = draw.integers(0, 1 << 63, bands, dtype=np.uint64)

    def values(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Signatures (bands * rows x sets) of the sets that begin at ``starts`` in ``hashes`` (uint64)."""
        low, high = [], []
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        step = max(1, (1 << 20) // len(self.a))  # long texts: bounded pieces, cut between sets or within one
        edges = [0, *np.searchsorted(starts, np.arange(step, len(x), step)).tolist(), len(starts)]
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            if s == e:
                continue
            begin, stop = starts[s], starts[e] if e < len(starts) else len(x)
            lo = hi = None
            for at in range(begin, stop, max(step, 1)) if e - s == 1 else (begin,):
                part = x[at : min(at + step, stop)] if e - s == 1 else x[begin:stop]
                values = self.a * part + self.b
                cut = np.zeros(1, np.int64) if e - s == 1 else starts[s:e] - begin
                least, most = np.minimum.reduceat(values, cut, axis=1), np.maximum.reduceat(values, cut, axis=1)
                lo, hi = (least, most) if lo is None else (np.minimum(lo, least), np.maximum(hi, most))
            low.append(lo)
            high.append(hi)
        low, high = np.concatenate(low, axis=1), np.concatenate(high, axis=1)
        return np.stack([low, high], axis=1).reshape(-1, low.shape[1])[: self.bands * self.rows].astype(np.uint64)

    def keys(self, values: np.ndarray) -> np.ndarray:
        """Band keys (sets x bands, int64)."""
        mixed = finish((values + np.uint64(1)) * self.mix[:, None])
        keys = mixed.reshape(self.bands, self.rows, -1).sum(axis=1, dtype=np.uint64) + self.salt[:, None]
        return finish(keys).T.astype(np.int64)

    def sketches(self, values: np.ndarray) -> np.ndarray:
        """Four bits of every value, sixteen to a word (sets x words, int64)."""
        bits = finish((values + np.uint64(1)) * self.mix[:, None]) & np.uint64(15)
        bits = np.concatenate([bits, np.zeros((-len(bits) % 16, bits.shape[1]), np.uint64)]).reshape(-1, 16, bits.shape[1])
        return np.bitwise_or.reduce(bits << (np.arange(16, dtype=np.uint64) * np.uint64(4))[None, :, None], axis=1).T.astype(np.int64)


def sketch_table(sets: DataFrame) -> DataFrame:
    """(node, sketch) of the candidates' full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minmax = MinMax(*SKETCH, seed=2)
        for batch in batches:
            lists = batch.column(1)
            starts = np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()
            flat = lists.flatten().to_numpy().astype(np.uint64)
            out = minmax.sketches(minmax.values(flat, starts)) if len(flat) else np.empty((0, 0), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(out), pa.list_(pa.int64()))], ["node", "sketch"])

    return sets.select("node", "shingles").mapInArrow(run, "node long, sketch array<long>")


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether two sketches agree in as many values as a link would, less ``DEVIATIONS`` standard deviations.

    A pair at the very threshold fails with probability 3e-6, a closer one with less.
    """

    def fold(x: Column) -> Column:
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        return F.bit_count(x)

    def most(n: int) -> int:
        p = percent / 100 + (1 - percent / 100) / 16
        return int(n * (1 - p) + DEVIATIONS * (n * p * (1 - p)) ** 0.5) + 1

    first = F.lit(0)  # a part in generated code, which most pairs fail
    for k in range(QUICK_WORDS):
        first = first + fold(F.get(F.col(a), F.lit(k)).bitwiseXOR(F.get(F.col(b), F.lit(k))))
    whole = F.aggregate(F.zip_with(a, b, lambda x, y: fold(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (first <= most(16 * QUICK_WORDS)) & (whole <= most(SKETCH[0] * SKETCH[1]))


def finish(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64-bit word."""
    y = x >> _33
    y ^= x
    y *= _M1
    y ^= y >> _29
    y *= _M2
    y ^= y >> _32
    return y


def linked(a: Column, b: Column, percent: int) -> Column:
    """Whether two full sets have ``percent`` of their union in common."""
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def near_in_size(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= percent * F.greatest(a, b)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links, on the full sets."""
    pairs = written(pairs, "pairs")
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"_{c}"))
    sized = near_in_size(F.size("_a"), F.size("_b"), percent)
    return written(pairs.join(side("a"), "a").join(side("b"), "b").where(sized).where(linked(F.col("_a"), F.col("_b"), percent)).select("a", "b"), "links")


def near_components(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, *, repeated: bool = False) -> DataFrame:
    """(node, comp) for nodes linked with another.

    ``nodes``: (node bigint, bands array<bigint>); a row a set, or several if ``repeated``.
    ``sets_of`` takes the candidates (node) and returns (node, shingles array<bigint>) of them all.
    """
    with scratch(nodes.sparkSession) as kept:
        kept.append(_near_components(nodes, sets_of, percent, repeated))
    return kept[0]


def _near_components(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, repeated: bool) -> DataFrame:
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("other")).where("pivot < other").select("key", "pivot")
    members = keyed.join(written(shared, "buckets"), "key")
    members = written(members.distinct() if repeated else members, "members")
    n = members.count()
    wanted = written(few(members.select("node").distinct(), n), "candidates")
    sets = written(sets_of(bounded(wanted)), "sets")
    if sets.count() > wanted.count():  # repeated rows
        sets = written(sets.dropDuplicates(["node"]), "sets")
    sketches = written(sketch_table(sets), "sketches")

    def likely(pairs: DataFrame) -> DataFrame:
        side = lambda c: sketches.select(F.col("node").alias(c), F.col("sketch").alias(f"_{c}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").where(may_link("_a", "_b", percent)).select("a", "b")

    others = members.where("node <> pivot")
    links = confirm(likely(others.groupBy(F.col("node").alias("b")).agg(F.min("pivot").alias("a"))), sets, percent)
    comps = components(links)
    rest = others.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    more = confirm(likely(_apart(rest, comps)), sets, percent)
    if not more.isEmpty():
        comps = extended(comps, more)
    left = members.where("node <> pivot").select("key", "node")  # the smallest members have met their buckets
    full = written(sketches.join(sets, "node"), "full")
    comps, turn = bounded(comps), 0
    while True:
        turn += 1
        here = left.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        spread = here.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
        here = written(few(here.join(spread, "key"), n), f"open-{turn}")
        if here.isEmpty():
            return comps
        front, rest = _front(here, full, turn, n)
        fits = may_link("sa", "sb", percent) & near_in_size(F.size("xa"), F.size("xb"), percent) & linked(F.col("xa"), F.col("xb"), percent)
        one = front.select(F.col("key").alias("_key"), F.col("block").alias("_block"), F.col("comp").alias("ca"), F.col("node").alias("a"), "top", F.col("sketch").alias("sa"), F.col("shingles").alias("xa"))
        other = rest.withColumnsRenamed({"sketch": "sb", "shingles": "xb"})
        meet = (F.col("key") == F.col("_key")) & (F.col("block") == F.col("_block"))
        joins = other.join(one.where("top"), meet & fits, "left_semi").select(F.col("top_comp").alias("a"), F.col("node").alias("b"))
        once = ~F.col("pivot") | (F.col("a") < F.col("node"))  # of two members of the front one asks
        among = other.join(one.where("NOT top"), meet & (F.col("ca") != F.col("comp")) & once & fits).select("a", F.col("node").alias("b"))
        more = written(joins.unionByName(among).distinct(), f"links-{turn}")
        left = rest.where("NOT pivot").select("key", "node").distinct()
        if not more.isEmpty():
            comps = bounded(extended(comps, more))


def _front(here: DataFrame, full: DataFrame, turn: int, n: int) -> tuple[DataFrame, DataFrame]:
    """A round's front (key, block, node, comp, top, sketch, shingles), and what it meets, each block of a bucket once.

    ``here``: (node, key, comp), ``n`` rows at most; ``full``: (node, sketch, shingles).  The rest holds all members outside
    the largest component, those of the front among them (``pivot``), with ``top_comp``, the component
    to which a hit belongs.
    """
    pivots = min(GROWTH**turn, PIVOTS)
    parts = here.groupBy("key", "comp").agg(F.count("*").alias("n"))
    whole = parts.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("most"))
    rows = here.join(bounded(written(few(whole, n), "open-buckets")), "key").withColumn("top", F.col("comp") == F.col("most.comp"))
    chance = F.pmod(F.xxhash64("node", F.lit(turn)), F.col("all") - F.col("most.n"))
    rows = rows.withColumn("pivot", ~F.col("top") & (chance < pivots)).join(full, "node")
    rows = written(rows.select("key", "node", "comp", F.col("most.comp").alias("top_comp"), "top", "pivot", "sketch", "shingles"), "open-members")
    asked = rows.where("top OR pivot")
    blocks = asked.groupBy("key").agg(F.ceil(F.sum(F.size("shingles").cast("long")) / BLOCK_ITEMS).cast("int").alias("blocks"))
    blocks = bounded(written(few(blocks, n), "blocks"))
    front = asked.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rest = rows.where("NOT top").join(blocks, "key").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return front.select("key", "block", "node", "comp", "top", "sketch", "shingles"), rest.select("key", "block", "node", "comp", "pivot", "top_comp", "sketch", "shingles")


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components so far."""
    side = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"_{c}"))
    joined = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return joined.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")
