"""Answer items: classified context, and a mergeable fold of equal items that keeps the first item's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Reasons that a merged item keeps.
MOST_REASONS = 4


def classify_item(layer: Column, object_type: Column, source: Column, has_refs: Column, support: Column, strength: Column, item_status: Column, warnings: Column, relation: Column) -> Column:
    """struct(type, use_policy, evidence_support, query_support) of a context row; the first rule that fits.

    ``support`` and ``strength`` are the query's support status and strength, ``item_status`` the row's own
    status (null: not checked), ``relation`` whether the text spells a graph relation.
    """
    status = F.coalesce(item_status, F.lit("not_checked"))
    support = F.coalesce(support, F.lit("not_checked"))
    of_item = F.when(has_refs, support).otherwise("not_checked")
    is_a = lambda *names: layer.isin(*names) | object_type.isin(*names)
    row = lambda kind, policy, evidence, query: F.struct(F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"), policy.alias("use_policy"), evidence.alias("evidence_support"), query.alias("query_support"))
    bound = F.when(has_refs, "evidence_bound")
    memory, chosen = bound.otherwise("not_checked"), bound.otherwise(status)
    background, supporting = F.lit("background_only"), F.lit("supporting_context")
    policy = lambda evidence: F.when(evidence == "evidence_bound", supporting).otherwise(background)
    strange = F.arrays_overlap(warnings, F.array(F.lit("subject_other_participant"), F.lit("subject_mixed_participant")))
    return (
        F.when(is_a("raw_evidence"), row("direct_evidence", F.when(strength == "direct", "can_answer").otherwise(supporting), F.when(support == "checked", "checked").otherwise(status), support))
        .when(is_a("doc_level_summary") | (object_type == "summary_context"), row("context_only", background, F.lit("not_checked"), F.lit("not_checked")))
        .when(is_a("memory_unit"), row("context_only", policy(memory), memory, of_item))
        .when(source == "step2_selected_context", row(F.when(relation, "graph_relation").otherwise("s2_summary"), policy(chosen), chosen, of_item))
        .when(strange, row("context_only", F.lit("do_not_use_as_fact"), status, of_item))
        .otherwise(row("context_only", F.when(status == "not_checked", background).otherwise(supporting), status, of_item))
    )


def _first_seen(rows: DataFrame, keys: list[str], column: str, order: str) -> DataFrame:
    """Distinct values of an array column in the order in which they came, by first sight: (keys, column)."""
    seen = rows.select(*keys, order, F.posexplode(column).alias("_k", "_v")).groupBy(*keys, "_v").agg(F.min(F.struct(order, "_k")).alias("_at"))
    ordered = F.sort_array(F.collect_list(F.struct("_at", "_v")))
    return seen.groupBy(*keys).agg(F.transform(ordered, lambda x: x["_v"]).alias(column))


def merge_items(items: DataFrame, by: list[str], *, order: str = "position") -> DataFrame:
    """One row per (``by``, first 140 characters of the text, type, evidence support): the merged answer items.

    ``items``: ``order`` (unique within ``by``), text, type, evidence_support, use_policy, warnings,
    retrieved_by, reasons (arrays of text), evidence_refs.  The longest text wins (the first of equal
    length), ``can_answer`` sticks and else the first policy stays, arrays unite by first sight, reasons
    up to four; the group stands where its first item stood.  Items without text group by their sorted
    references.  Null arrays are empty.  Sums are partial before the shuffle: groups hold distinct values
    only, whatever the number of items.
    """
    squeezed = F.substring(F.lower(T.squeeze(F.coalesce("text", F.lit("")))), 1, 140)
    refs = F.concat(F.lit("refs:"), F.array_join(F.sort_array(F.coalesce("evidence_refs", F.array().cast("array<string>"))), "|"))
    key = F.when(squeezed == "", refs).otherwise(squeezed)
    rows = items.withColumn("text_key", key)
    keys = [*by, "text_key", "type", "evidence_support"]
    empty = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(c, empty) for c in ("warnings", "retrieved_by", "reasons")})
    merged = rows.groupBy(*keys).agg(
        F.min(order).alias(order),
        F.count("*").alias("n_items"),
        F.max_by("text", F.struct(F.length(F.coalesce("text", F.lit(""))), -F.col(order))).alias("text"),
        F.max((F.col("use_policy") == "can_answer").cast("int")).alias("_can"),
        F.min_by("use_policy", order).alias("_first"),
    )
    for column in ("warnings", "retrieved_by", "reasons"):
        merged = merged.join(_first_seen(rows, keys, column, order), keys, "left").withColumn(column, F.coalesce(column, empty))
    policy = F.when(F.col("_can") == 1, "can_answer").otherwise(F.col("_first"))
    return merged.withColumns({"use_policy": policy, "reasons": F.slice("reasons", 1, MOST_REASONS)}).drop("_can", "_first")
