"""Mixing sources to target weights by capped water-filling, with seeded repetitions.

All words are shared among the sources by weight; a source stops at ``max_epochs`` times its own
size and its excess goes to the others by weight, until none is above.  That level is found with
sums over the per-source table only.  A source's rate (target / size) is met by whole repetitions of
every document plus a seeded fraction: documents fall into ``buckets`` by a seeded hash, buckets
below the fraction are taken once more, those above are not, and of the one bucket in which the
fraction ends each document gives its share of words.  So a source misses its target by at most one
word per document of one bucket, and nothing is sorted or gathered by source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``target`` for each row of a small written table with ``source_size`` and ``weight``.

    Sources in the order in which a rising level would cap them; of the levels that each would have
    as the first one not capped, the right one does not cap it.  One task over a row a source.
    """
    cap = F.col("source_size") * float(max_epochs)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    order = Window.orderBy(F.col("cap") / F.col("weight"), "weight").rowsBetween(Window.unboundedPreceding, -1)
    lined = sources.where("weight > 0").select("weight", cap.alias("cap"))
    lined = lined.withColumn("_caps", F.coalesce(F.sum("cap").over(order), F.lit(0.0))).withColumn("_open", F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(order), F.lit(0)))
    lined = lined.withColumn("level", (F.lit(float(total)) - F.col("_caps")) / F.col("_open"))
    level = lined.where("level * weight <= cap").agg(F.min_by("level", F.col("cap") / F.col("weight"))).first()[0]
    wanted = cap if level is None else F.least(cap, F.col("weight") * F.lit(float(level)))
    return sources.withColumn("target", wanted.cast("double"))


def _bucket(id_: Column, seed: int, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), id_), F.lit(buckets)).cast("int")


def _plan(sized: DataFrame, weights, max_epochs: int) -> DataFrame:
    """A row a source of (source, bucket, size): source_size, target, whole repetitions, the bucket where a
    part ends and its share."""
    by_bucket = common.written(sized.groupBy("source", "bucket").agg(F.sum("size").alias("b_size")), "bucket-sizes")
    by_source = by_bucket.groupBy("source").agg(F.sum("b_size").alias("source_size"))
    # one row per source: the order of sources needs one task, over that table alone
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    targets = water_fill(common.written(by_source.withColumn("weight", weight), "sources"), max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("whole", F.floor(rate + 1e-12).cast("long"))
    # words still wanted above the whole repetitions, met bucket by bucket in the seeded order
    targets = targets.withColumn("wanted", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    before = F.coalesce(F.sum("b_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    targets = common.written(targets.withColumnRenamed("source", "_s"), "targets")
    lined = by_bucket.withColumn("before", before).join(common.bounded(targets), F.col("source").eqNullSafe(F.col("_s")))
    share = F.when(F.col("b_size") > 0, F.least(F.lit(1.0), (F.col("wanted") - F.col("before")) / F.col("b_size"))).otherwise(0.0)
    ends = lined.where("before < wanted").groupBy("_s").agg(F.max(F.struct("bucket", share.alias("share"))).alias("end"))
    ends = ends.select(F.col("_s").alias("_e"), "end")
    plan = targets.join(ends, F.col("_s").eqNullSafe(F.col("_e")), "left")
    last, part = F.coalesce("end.bucket", F.lit(-1)), F.coalesce("end.share", F.lit(0.0))
    return common.bounded(common.written(plan.select("_s", "source_size", "target", "whole", last.alias("last"), part.alias("share")), "mix-plan"))


def _taken(id_: Column, size: Column, bucket: Column, plan, seed: int, max_epochs: int) -> Column:
    """Words that the mix takes of a document; ``plan`` gives the source's columns."""
    # the ended bucket's words: rounded by a seeded draw, so that short documents give their share too
    draw = F.pmod(F.xxhash64(F.lit(seed + 1), id_), F.lit(1 << 20)) / float(1 << 20)
    part = F.least(size, F.floor(size * plan("share") + draw).cast("long"))
    part = F.when(bucket < plan("last"), size).when(bucket > plan("last"), F.lit(0)).otherwise(F.when(plan("share") >= 1, size).otherwise(part))
    return F.least(plan("whole") * size + part, F.lit(max_epochs) * size).cast("long")


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 17,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Columns doc_id, size, source_size, target, taken: one row per input row.

    Sources weigh ``weights`` in turn, ordered by code point, null last (a source of its own).  Null
    text has size 0 and takes nothing.  Repeated rows are sized and taken each; equal ids fall into
    the same bucket.  Sources without words have target 0.  An empty table gives no rows.  Other
    columns are ignored.  Reruns agree: the draw depends on the seed and the id only.
    """
    id_ = F.col(id_col)
    sized = docs.select(id_.alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), _bucket(id_, seed, buckets).alias("bucket"))
    sized = common.written(sized, "sizes")
    joined = sized.join(_plan(sized, weights, max_epochs), F.col("source").eqNullSafe(F.col("_s")))
    taken = _taken(F.col("doc_id"), F.col("size"), F.col("bucket"), F.col, seed, max_epochs)
    return joined.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def repeat_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 17,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The mixed rows, with all columns of ``docs``: whole repetitions, then the first words of a part.

    A part keeps its text up to the end of its last taken word.  Rows are taken as ``mix`` does it,
    each by itself, also where ids repeat; a row of which nothing is taken goes, so do null and empty
    texts.  Texts are not shuffled: a row a source is broadcast.  An empty table gives no rows.  Other
    columns come along, whatever their names.
    """
    id_, text, source = F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.col(f"`{source_col}`")
    sized = common.written(docs.select(source.alias("source"), n_words(text).alias("size"), _bucket(id_, seed, buckets).alias("bucket")), "sizes")
    plan = _plan(sized, weights, max_epochs)
    names = {c: common.free_name(docs, f"mix_{c}") for c in (*plan.columns, "size", "taken", "turn")}
    plan = plan.withColumnsRenamed({c: names[c] for c in plan.columns})
    own = lambda c: F.col(names[c])
    joined = docs.withColumn(names["size"], n_words(text)).join(plan, source.eqNullSafe(own("_s")))
    joined = joined.withColumn(names["taken"], _taken(id_, own("size"), _bucket(id_, seed, buckets), own, seed, max_epochs)).where(own("taken") > 0)
    whole = F.floor(own("taken") / own("size")).cast("int")
    part = (own("taken") - whole * own("size")).cast("int")
    copies = joined.withColumn(names["turn"], F.explode(F.sequence(F.lit(0), F.when(part > 0, whole).otherwise(whole - 1))))
    words = F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    short = F.array_join(F.slice(words, F.lit(1), part), "")
    new = F.when(own("turn") < whole, text).otherwise(short)
    return copies.select(*[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
