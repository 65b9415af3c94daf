"""Review slices: small subgraphs for many centres, communities, noisy edges and weak nodes at once.

Nodes of a slice are cut by (-degree, label) and edges by their id.  Tasks drop what cannot be among a
slice's first nodes or edges before the shuffle.  Edges inside a slice that touch the node after which
it is named are found by both of their ends.  All others need ends that some slice holds as further
members; of what is left they are found from the end of lower degree, so a hub that stands in every
slice does not bring its whole neighbourhood along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import bounded, settled
from .graph import endpoints

MAX_NODES, MAX_EDGES = 40, 60
#: Ids that are broadcast at most.
CENTERS = 1_000_000


def _first(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def _degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("source", "target")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    return nodes.join(ends, "node_id", "left").fillna(0, ["degree"])


def ego_members(edges: DataFrame, centers: DataFrame) -> DataFrame:
    """(slice_id, node_id): each center with all that it touches."""
    named = settled(centers.select(F.col("node_id").alias("slice_id")).distinct())
    ends = endpoints(edges.where("source <> target")).join(bounded(named, CENTERS), F.col("node_id") == F.col("slice_id"))
    near = ends.select("slice_id", F.col("other").alias("node_id")).distinct()
    return near.unionByName(named.select("slice_id", F.col("slice_id").alias("node_id")))


def _own(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """(slice_id, edge_id, source, target): edges between a slice's kept namesake and its other kept nodes, or itself."""
    own = kept.where("slice_id = node_id").select("slice_id")
    ends = edges.select(F.col("source").alias("slice_id"), F.col("target").alias("node_id"), "edge_id", "source", "target")
    back = edges.where("source <> target").select(F.col("target").alias("slice_id"), F.col("source").alias("node_id"), "edge_id", "source", "target")
    touching = ends.unionByName(back).join(bounded(own, CENTERS), "slice_id", "left_semi")
    return touching.join(kept, ["slice_id", "node_id"], "left_semi").select("slice_id", "edge_id", "source", "target")


def _between(edges: DataFrame, further: DataFrame) -> DataFrame:
    """Edges whose ends are both further members of slices, not always of the same one."""
    ids = settled(further.select("node_id").distinct())
    for end in ("source", "target"):
        edges = edges.join(bounded(ids.withColumnRenamed("node_id", end), CENTERS), end, "left_semi")
    return settled(edges.select("edge_id", "source", "target"))


def bounded_slices(members: DataFrame, nodes: DataFrame, edges: DataFrame, kind: str, *, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES) -> tuple[DataFrame, DataFrame]:
    """The subgraphs that members (slice_id, node_id) induce, cut to size: edges (kind, slice_id, edge_id), and a row a slice.

    The row: (kind, slice_id, n_nodes, n_edges, warnings); nodes are those that the edges left show.
    Members that are no nodes are left out; a slice without edges stays, with one node.  ``edges`` are
    read several times: an aggregate should be written before.
    """
    rated = settled(_degrees(nodes.select("node_id", "label"), edges))
    found = settled(members.distinct().join(rated, "node_id"))
    sizes = found.groupBy("slice_id").agg(F.count("*").alias("_all"))
    kept = settled(_first(found, ["slice_id"], [F.col("degree").desc(), F.col("label"), F.col("node_id")], max_nodes).select("slice_id", "node_id"))
    degree = lambda end: rated.select(F.col("node_id").alias(end), F.col("degree").alias(f"d_{end}"))
    rank = lambda end: F.struct(F.col(f"d_{end}"), F.col(end))
    further = kept.where("slice_id <> node_id")
    ends = _between(edges, further).join(degree("source"), "source").join(degree("target"), "target")
    swap = rank("source") <= rank("target")
    oriented = ends.select("edge_id", "source", "target", F.when(swap, F.col("source")).otherwise(F.col("target")).alias("low"), F.when(swap, F.col("target")).otherwise(F.col("source")).alias("high"))
    inside = oriented.join(further.withColumnRenamed("node_id", "low"), "low").join(further.withColumnRenamed("node_id", "high"), ["slice_id", "high"], "left_semi")
    inside = settled(inside.select("slice_id", "edge_id", "source", "target").unionByName(_own(edges, kept)))
    counts = inside.groupBy("slice_id").agg(F.count("*").alias("_edges"))
    shown = settled(_first(inside, ["slice_id"], [F.col("edge_id")], max_edges).select(F.lit(kind).alias("kind"), "slice_id", "edge_id", "source", "target"))
    visible = shown.select("slice_id", F.explode(F.array("source", "target")).alias("n")).distinct().groupBy("slice_id").agg(F.count("*").alias("_nodes"))
    edges_of = shown.groupBy("slice_id").agg(F.count("*").alias("n_edges"))
    rows = sizes.join(counts, "slice_id", "left").join(edges_of, "slice_id", "left").join(visible, "slice_id", "left").fillna(0)
    warnings = F.array(
        F.when(F.col("_all") > max_nodes, "visual_slice_truncated_by_degree"),
        F.when(F.col("_edges") > max_edges, "visual_slice_edges_truncated"),
        F.when(F.col("n_edges") == 0, f"{kind}_slice_has_no_visible_edges"),
    )
    rows = rows.select(F.lit(kind).alias("kind"), "slice_id", F.greatest(F.col("_nodes"), F.lit(1)).alias("n_nodes"), "n_edges", F.filter(warnings, lambda w: w.isNotNull()).alias("warnings"))
    return shown.select("kind", "slice_id", "edge_id"), rows


def noisy_edges(edges: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """(edge_id) of the first generic relations; a distributed top-n."""
    return edges.where("relation_type = 'related_to_generic'").select("edge_id").orderBy("edge_id").limit(max_edges)


def weak_nodes(nodes: DataFrame, edges: DataFrame, *, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES) -> tuple[DataFrame, DataFrame]:
    """The weak (column ``weak``) or isolated nodes of highest degree (node_id), and the first edges that touch them (edge_id)."""
    rated = _degrees(nodes.select("node_id", "label", "weak"), edges).where(F.col("weak") | (F.col("degree") == 0))
    chosen = settled(rated.orderBy(F.col("degree").desc(), "label", "node_id").limit(max_nodes).select("node_id"))
    touching = edges.join(F.broadcast(chosen.withColumnRenamed("node_id", "source")), "source", "left_semi").select("edge_id")
    touching = touching.unionByName(edges.join(F.broadcast(chosen.withColumnRenamed("node_id", "target")), "target", "left_semi").select("edge_id"))
    return chosen, touching.distinct().orderBy("edge_id").limit(max_edges)
