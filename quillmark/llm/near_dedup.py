"""Near-duplicate documents by min-max hashing over five-word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, free_name, scratch, small_batches, written
from .components import components
from .near import MinMax, near_components
from .shingles import WordHashes, shingle_hashes

#: At similarity 0.85 a link is missed by all 36 bands of 7 with probability 1e-6; 126 hash evaluations a shingle.
BANDS, ROWS, SIZE, PERCENT = 36, 7, 5, 85


def shingle_set(words: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Distinct sorted shingle hashes; fewer words than ``size``: all of them as one shingle."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(shingle_hashes(words, min(size, len(words))))


def signatures(docs: DataFrame, *, bands: int = BANDS, rows: int = ROWS, size: int = SIZE) -> DataFrame:
    """(doc_id, h, n_shingles, k1, k2, bands) of (doc_id, h, text): set size, 128-bit digest of the set, band keys (null for an empty set)."""
    import xxhash

    small_batches(docs.sparkSession)
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, minmax = WordHashes.shared(), MinMax(bands, rows)
        for batch in batches:
            out = []
            for i, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = shingle_set(hashes.of_text(t.as_py()), size)
                if not len(own):
                    out.append((i, h, 0, None, None, None))
                    continue
                digest = xxhash.xxh3_128_digest(own.tobytes())
                k1, k2 = np.frombuffer(digest, "<i8").tolist()
                out.append((i, h, len(own), k1, k2, minmax.keys(minmax.values(own, np.zeros(1, np.int64)))[0]))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "h", "n_shingles", "k1", "k2", "bands"])

    return docs.select("doc_id", "h", "text").mapInArrow(run, "doc_id long, h long, n_shingles long, k1 long, k2 long, bands array<long>")


def shingle_sets(texts: DataFrame, size: int = SIZE) -> DataFrame:
    """(node, shingles) of (node, text): the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes.shared()
        for batch in batches:
            sets = [shingle_set(hashes.of_text(t.as_py()), size).astype(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    size: int = SIZE,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per input row.

    Words are lower-cased in A-Z and split at ASCII white space.  Documents with equal sets form a
    class, represented by its smallest id; classes are linked if ``percent`` of the union is common.
    Empty or null texts, and rows with null id, are linked with nothing (component: their own id;
    kept).  Repeated rows belong to their document and share its row's values; of different texts
    under one id, each is its own set, and links of either are links of the id.  Other columns are
    ignored.  An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.withColumn("h", F.xxhash64("text"))
    with scratch(docs.sparkSession) as kept:
        kept.append(written(_classified(texts, percent, bands, rows, size), "near-duplicates"))
    return kept[0]


def _classified(texts: DataFrame, percent: int, bands: int, rows: int, size: int) -> DataFrame:
    """Classes have numbers of their own, as an id may have several texts; ids join their classes at the end."""
    signed = written(signatures(texts, bands=bands, rows=rows, size=size), "signatures")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "h")).alias("rep"), F.first("bands").alias("bands"))
    classes = written(classes.select("k1", "k2", "rep.doc_id", "rep.h", "bands", F.monotonically_increasing_id().alias("node")), "classes")

    def sets_of(candidates: DataFrame) -> DataFrame:
        chosen = written(classes.select("node", "doc_id", "h").join(candidates, "node", "left_semi"), "chosen")
        return shingle_sets(texts.join(bounded(chosen), ["doc_id", "h"]), size)

    comps = near_components(classes.select("node", "bands"), sets_of, percent)
    names = classes.select("node", "doc_id").join(comps, "node").groupBy("comp").agg(F.min("doc_id").alias("name"))
    reps = classes.select("k1", "k2", "node", "doc_id").join(comps, "node", "left").join(bounded(written(names, "names")), "comp", "left")
    reps = written(reps.select("k1", "k2", F.coalesce("name", "doc_id").alias("comp")), "class-components")
    joined = written(signed.select("doc_id", "n_shingles", "k1", "k2").join(reps, ["k1", "k2"], "left").drop("k1", "k2"), "document-components")
    joined = _united(joined)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return joined.select(
        "doc_id",
        "n_shingles",
        component.cast("long").alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def _united(joined: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, comp): the components that one id's several texts are in become one."""
    several = joined.where("doc_id IS NOT NULL AND comp IS NOT NULL").groupBy("doc_id").agg(F.min("comp").alias("a"), F.max("comp").alias("_most"))
    several = written(several.where("a < _most").select("doc_id", "a"), "several")
    if several.isEmpty():
        return joined
    roots = components(joined.join(several, "doc_id").select("a", F.col("comp").alias("b")).distinct())
    roots = bounded(written(roots.select(F.col("node").alias("comp"), F.col("comp").alias("root")), "roots"))
    return joined.join(roots, "comp", "left").withColumn("comp", F.coalesce("root", "comp"))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """The documents of ``docs`` that stay, with all their columns: one of each component.

    Of repeated rows of a document that stays, one stays.  Rows with null id and texts without words
    all stay.
    """
    gone, twice = free_name(docs, "gone"), free_name(docs, "twice")
    marked = written(near_duplicates(docs, **how).where("NOT kept").select(F.col("doc_id").alias(gone)).distinct(), "gone")
    left = docs.join(bounded(marked), F.col("doc_id") == F.col(gone), "left_anti")
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias(twice)).where(F.col(twice) > 1)
    repeated = written(repeated.select(F.col("doc_id").alias(twice)), "repeated-ids")
    if repeated.isEmpty():
        return left
    again = F.col("doc_id") == F.col(twice)
    once = left.join(repeated, again, "left_semi").dropDuplicates(["doc_id"])
    return left.join(repeated, again, "left_anti").unionByName(once)
