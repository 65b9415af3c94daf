"""Connected components by hooking and contraction, on DataFrames only.

Every round each label hooks to its neighbour of least priority (a hash of the label, so that no
order of ids makes long chains), labels follow their hooks twice, and edges are rewritten to the
labels that remain.  Labels at least halve each round in expectation, rounds are written tables of as
many files as their rows want, and nothing but one count a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, few, scratch, written


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every end of ``edges`` (a, b: bigint); comp is the component's smallest node.

    Self-loops are ignored, repeated edges and either direction do no harm; without edges: no rows.
    """
    with scratch(edges.sparkSession) as kept:
        kept.append(_components(edges))
    return kept[0]


def extended(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` (node, comp) with further ``links`` (a, b) between any nodes: only the components that they join are contracted."""
    with scratch(comps.sparkSession) as kept:
        for end in ("a", "b"):
            links = links.join(comps.select(F.col("node").alias(end), F.col("comp").alias(f"_{end}")), end, "left")
        joined = bounded(_components(links.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))))
        to = joined.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
        both = comps.join(to, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        kept.append(written(both.unionByName(joined.join(comps, "node", "left_anti")), "components"))
    return kept[0]


def _components(edges: DataFrame) -> DataFrame:
    ranked = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    left = written(edges.where("a <> b").select(ranked("a").alias("a"), ranked("b").alias("b")), "edges")
    labels = None
    while n := left.count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        hooks = bounded(written(few(hooks.select("node", F.least("node", "m").alias("up")), 2 * n), "hooks"))
        jump = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
        hooks = bounded(written(hooks.join(jump, "up", "left").select("node", F.coalesce("top", "up").alias("up")), "hooks"))
        if labels is None:
            labels = hooks.select("node", F.col("up").alias("label"))
        else:
            step = hooks.select(F.col("node").alias("label"), F.col("up").alias("new"))
            labels = labels.join(step, "label", "left").select("node", F.coalesce("new", "label").alias("label"))
        labels = written(labels, "labels")
        to = lambda c: hooks.select(F.col("node").alias(c), F.col("up").alias(f"_{c}"))  # noqa: E731, B023
        left = left.join(to("a"), "a").join(to("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        left = written(few(left.where("a <> b").distinct(), n), "edges")
    if labels is None:
        return edges.sparkSession.createDataFrame([], "node long, comp long")
    least = labels.groupBy("label").agg(F.min("node.v").alias("comp"))
    least = bounded(written(few(least, labels.count()), "least"))
    return written(labels.join(least, "label").select(F.col("node.v").alias("node"), "comp"), "components")
