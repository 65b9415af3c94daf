"""The evidence service: filters, reference resolution, retrieval modes, evidence and memory retrieval, support
checks, use policies and handoff packets.  Questions come as a batch; every operator is set-based.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Memory statuses that retrieval accepts by default.
DEFAULT_MEMORY_STATUSES = ("accepted_for_experiment", "accepted_by_user")
# Statuses that keep a unit out of queries.
NOT_ELIGIBLE = ("rejected", "archived", "superseded", "unresolved")
# Kinds of references by prefix, and the warning of the kinds that need an extension.
REF_PREFIXES = (("memory:", "memory_id"), ("source:", "source_ref"), ("report:", "report_ref"), ("audit:", "audit_ref"), ("cache:", "cache_ref"))
EXTENSION_WARNINGS = {"report_ref": "report_context_not_evidence", "audit_ref": "audit_context_not_evidence", "cache_ref": "cache_not_truth"}
# Requested retrieval modes.
MODES = ("direct_scan", "auto", "bm25_indexed", "embedding_indexed", "hybrid_indexed", "degraded_direct_scan")


def evidence_filter(rows: DataFrame, *, source_ids=(), subject_ids=(), participant_ids=()) -> DataFrame:
    """Rows of the named sources whose subjects and participants overlap the named ones; an empty filter passes all."""
    if source_ids:
        rows = rows.where(F.col("source_id").isin(*source_ids))
    for col, ids in (("subject_ids", subject_ids), ("participant_ids", participant_ids)):
        if ids:
            rows = rows.where(F.arrays_overlap(F.coalesce(F.col(col), F.array().cast("array<string>")), F.array(*[F.lit(i) for i in ids])))
    return rows


def memory_filter(rows: DataFrame, statuses=DEFAULT_MEMORY_STATUSES) -> DataFrame:
    return rows.where(F.coalesce("status", F.lit("unknown")).isin(*statuses))


def unit_status(*cols: Column) -> Column:
    """The first status that says something, else active."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit("active"))


def query_eligible(status: Column) -> Column:
    return ~status.isin(*NOT_ELIGIBLE)


def temporal_status(explicit: Column, validity: Column) -> Column:
    """An explicit status; else a known validity; else unknown."""
    known = F.when(validity.isin("current", "recurring", "historical", "temporary", "unknown"), validity)
    return F.coalesce(F.nullif(explicit, F.lit("")), known, F.lit("unknown"))


def alias_map(evidence: DataFrame) -> DataFrame:
    """(ref, evidence_ref): every name of every evidence row; of rows that share a name the first has it."""
    names = F.concat(F.array("evidence_ref", "display_ref", "source_specific_ref"), F.coalesce("ref_aliases", F.array().cast("array<string>")))
    flat = evidence.select(F.explode(F.array_distinct(names)).alias("ref"), "evidence_ref", "ordinal").where("ref <> ''")
    return flat.groupBy("ref").agg(F.min_by("evidence_ref", F.struct("ordinal", "evidence_ref")).alias("evidence_ref"))


def with_sources(evidence: DataFrame, sources: DataFrame, raw_sources: DataFrame) -> DataFrame:
    """Evidence with its source's path, its raw source (its own, else its source's) and alignment warnings."""
    src = sources.select("source_id", F.col("raw_source_id").alias("_via"), F.col("path_or_uri").alias("source_path"))
    raw = raw_sources.select(F.col("raw_source_id").alias("raw_id"), F.lit(True).alias("_there"))
    own = F.col("raw_source_id")
    rows = evidence.join(src, "source_id", "left").withColumn("raw_id", F.coalesce(own, "_via")).join(raw, "raw_id", "left")
    missing = F.when(own.isNull(), "missing_raw_source_id").when(F.col("_there").isNull(), "raw_source_manifest_missing")
    return rows.withColumn("raw_resolved", F.coalesce("_there", F.lit(False))).withColumn("alignment_warning", missing).drop("_via", "_there")


def ref_type(ref: Column, is_alias: Column) -> Column:
    """Kind of a reference: a name of evidence goes before any prefix but evidence's own."""
    kind = F.when(ref.startswith("evidence:") | is_alias, "evidence_ref")
    for prefix, name in REF_PREFIXES:
        kind = kind.when(ref.startswith(prefix), name)
    return kind.otherwise("unknown")


def resolve_refs(refs: DataFrame, evidence: DataFrame, memory: DataFrame, sources: DataFrame, *, extensions: bool = False) -> DataFrame:
    """(ref_id, ref_type, resolved, target, text, failure_reason, warning) of a batch of references (ref_id).

    Repeated references stay repeated.  Three lookups by hash joins; the kinds that need an extension
    store are never resolved here.
    """
    names = alias_map(evidence).select(F.col("ref").alias("ref_id"), F.col("evidence_ref").alias("_e"))
    texts = evidence.select(F.col("evidence_ref").alias("_e"), F.col("text").alias("_etext"))
    mem = memory.select(F.col("memory_id").alias("ref_id"), F.col("content").alias("_mtext"))
    src = sources.select(F.col("source_id").alias("ref_id"), F.col("path_or_uri").alias("_stext"))
    rows = refs.join(names, "ref_id", "left").join(texts, "_e", "left").join(mem, "ref_id", "left").join(src, "ref_id", "left")
    kind = ref_type(F.col("ref_id"), F.col("_e").isNotNull())
    rows = rows.withColumn("ref_type", kind)
    text = F.when(kind == "evidence_ref", F.col("_etext")).when(kind == "memory_id", F.col("_mtext")).when(kind == "source_ref", F.col("_stext"))
    extension = kind.isin(*EXTENSION_WARNINGS)
    reason = (
        F.when(text.isNotNull(), F.lit(None))
        .when(extension, F.lit("extension_store_not_configured" if extensions else "extension_route_not_enabled"))
        .when(kind == "unknown", "unsupported_ref_type")
        .otherwise("ref_not_found")
    )
    warning = F.when(text.isNotNull(), F.lit(None))
    for name, said in EXTENSION_WARNINGS.items():
        warning = warning.when(kind == name, F.lit(said if extensions else "extension_resolution_route"))
    target = F.when(kind == "evidence_ref", F.col("_e")).otherwise(F.col("ref_id"))
    return rows.select(
        "ref_id", "ref_type", text.isNotNull().alias("resolved"), F.when(text.isNotNull(), target).alias("target"), F.coalesce(text, F.lit("")).alias("text"), reason.alias("failure_reason"), warning.otherwise("unresolved_ref").alias("warning")
    )


def resolution_status(owners: DataFrame, names: DataFrame, key: str, refs: str) -> DataFrame:
    """(key, n_refs, n_resolved, status): how many of a row's references resolve by the alias map."""
    flat = owners.select(key, F.explode_outer(refs).alias("ref")).join(names, "ref", "left")
    each = flat.groupBy(key).agg(F.count("ref").alias("n_refs"), F.count(F.when(F.col("ref").isNotNull(), F.col("evidence_ref"))).alias("n_resolved"))
    n, k = F.col("n_refs"), F.col("n_resolved")
    status = F.when(n == 0, "unknown").when(n == k, "direct_refs_resolved").when(k > 0, "partial_refs_resolved").otherwise("unresolved_refs")
    return each.withColumn("status", status)


def gathered_text(owners: DataFrame, evidence: DataFrame, key: str, refs: str) -> DataFrame:
    """(key, text): texts of a row's references in order, repeats once, joined by line ends.

    A row has a bounded list of references.
    """
    flat = owners.select(key, F.posexplode(F.array_distinct(refs)).alias("pos", "evidence_ref"))
    texts = flat.join(evidence.select("evidence_ref", "text"), "evidence_ref").where("text <> ''")
    once = texts.groupBy(key, "text").agg(F.min("pos").alias("pos"))
    return once.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"))


def plan_mode(requested: Column, bm25_fresh: Column, embedding_fresh: Column, embedding_usable: Column) -> Column:
    """The retrieval mode that runs, for a request and the state of the indexes."""
    asked = F.when(requested.isin(*MODES), requested).otherwise("auto")
    vectors = embedding_fresh & embedding_usable
    return (
        F.when(asked == "direct_scan", "direct_scan")
        .when((asked == "auto") & bm25_fresh & vectors, "hybrid_indexed")
        .when((asked == "auto") & bm25_fresh, "bm25_indexed")
        .when((asked == "auto") & vectors, "embedding_indexed")
        .when((asked == "bm25_indexed") & bm25_fresh, "bm25_indexed")
        .when((asked == "embedding_indexed") & vectors, "embedding_indexed")
        .when((asked == "hybrid_indexed") & (bm25_fresh | vectors), "hybrid_indexed")
        .otherwise("degraded_direct_scan")
    )


def degraded_reason(requested: Column, mode: Column) -> Column:
    asked = F.when(requested.isin(*MODES), requested).otherwise("auto")
    return F.when(
        mode == "degraded_direct_scan",
        F.when(asked == "auto", "index_missing_or_stale")
        .when(asked == "bm25_indexed", "bm25_index_missing_or_stale")
        .when(asked == "embedding_indexed", "embedding_index_missing_stale_or_unusable")
        .when(asked == "hybrid_indexed", "hybrid_indexes_missing_or_stale")
        .otherwise("degraded_direct_scan_returned_no_hits"),
    )


def lexical_hits(questions: DataFrame, rows: DataFrame, key: str, text: str) -> DataFrame:
    """(query_id, key, score) of all pairs with a word in common: common words, plus their share of the question's."""
    q = questions.select("query_id", T.word_set(F.col("question")).alias("q")).withColumn("n_q", F.size("q"))
    a = q.select("query_id", "n_q", F.explode("q").alias("word"))
    b = rows.select(key, F.explode(T.word_set(F.col(text))).alias("word"))
    hits = b.join(a, "word").groupBy("query_id", key, "n_q").agg(F.count("*").alias("n"))
    return hits.select("query_id", key, F.round(F.col("n") + F.col("n") / F.col("n_q"), 6).alias("score"))


def retrieve(questions: DataFrame, evidence: DataFrame, memory: DataFrame | None, top_k: int = 5) -> DataFrame:
    """(query_id, result_id, item_layer, score, rank, warnings) by direct scan; memory only where it is asked for.

    Memory units of the default statuses take their own best ``top_k`` before both layers are ranked;
    ties go to evidence, then by id.
    """
    rows = lexical_hits(questions, evidence, "evidence_ref", "text")
    rows = rows.select("query_id", F.concat(F.lit("rr:"), F.col("evidence_ref")).alias("result_id"), F.lit("raw_evidence").alias("item_layer"), "score", F.lit("").alias("warnings"))
    if memory is not None:
        rows = rows.unionByName(retrieve_memory(questions, memory, top_k).drop("rank"))
    return _ranked(rows, top_k)


def memory_warnings(statuses=DEFAULT_MEMORY_STATUSES) -> Column:
    parts = F.array(
        F.lit("memory_unit_not_raw_evidence"),
        F.when(~F.col("status").isin(*DEFAULT_MEMORY_STATUSES), F.concat(F.lit("non_default_memory_status:"), "status")),
        F.when(F.size("backpointer_refs") == 0, F.lit("memory_summary_without_backpointer")),
        F.when(F.col("inference_level").isin("weak_signal", "strong_inference"), F.concat(F.lit("inference_level:"), "inference_level")),
    )
    return F.array_join(F.array_sort(F.array_compact(parts)), ",")


def retrieve_memory(questions: DataFrame, memory: DataFrame, top_k: int = 5, statuses=DEFAULT_MEMORY_STATUSES) -> DataFrame:
    """Memory units of the accepted statuses by direct scan, each with what speaks against it."""
    units = memory_filter(memory, statuses)
    hits = lexical_hits(questions, units, "memory_id", "content")
    rows = hits.join(units.select("memory_id", memory_warnings(statuses).alias("warnings")), "memory_id")
    return _ranked(rows.select("query_id", F.concat(F.lit("rr:"), F.col("memory_id")).alias("result_id"), F.lit("memory_unit").alias("item_layer"), "score", "warnings"), top_k)


def _ranked(rows: DataFrame, top_k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("item_layer").desc(), "result_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def use_policy(item_layer: Column, warnings: Column, support: Column) -> Column:
    """What a result may be used for."""
    stale = F.contains(F.coalesce(warnings, F.lit("")), F.lit("cache_not_truth")) | F.contains(F.coalesce(warnings, F.lit("")), F.lit("cache_stale_warning"))
    return (
        F.when(stale, "do_not_use")
        .when(support == "direct", "assert")
        .when(support == "partial", "cautious_assert")
        .when(support.isin("weak", "unknown", "contradicts"), "do_not_assert")
        .when(item_layer == "raw_evidence", "assert")
        .when(item_layer == "memory_unit", "background_only")
        .otherwise("do_not_assert")
    )


def summary(text: Column, limit: int = 160) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit - 3)), F.lit("...")))


def handoff(results: DataFrame, texts: DataFrame, by_value: bool = False) -> DataFrame:
    """Packet rows (query_id, result_id, use_policy, summary); by value they carry the text too."""
    rows = results.join(texts, "result_id").withColumn("use_policy", use_policy(F.col("item_layer"), F.col("warnings"), F.lit(None).cast("string")))
    rows = rows.withColumn("summary", summary(F.col("text")))
    return rows.select("query_id", "result_id", "rank", "use_policy", "summary", *(["text"] if by_value else []))


def question_support(questions: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, n_refs, support_status, warning): a question is no claim; a claim without evidence is not checked."""
    refs = results.where("item_layer = 'raw_evidence'").groupBy("query_id").agg(F.count_distinct("result_id").alias("n_refs"))
    rows = questions.join(refs, "query_id", "left").fillna(0, ["n_refs"])
    asked = T.is_question(F.col("question"))
    status = F.when(asked | (F.col("n_refs") == 0), "not_checked").otherwise("checked")
    warning = F.when(asked, "query_is_question_not_claim").when(F.col("n_refs") == 0, "no_raw_evidence_refs_from_step1_retrieval")
    return rows.select("query_id", "n_refs", status.alias("support_status"), warning.alias("warning"))


def align_vectors(units: DataFrame, entries: DataFrame) -> DataFrame:
    """Units with their best vector hit: by query unit, else by object, else by artifact.

    ``units``: (query_unit_id, artifact_ref); ``entries``: (vector_entry_id, query_unit_id, object_id,
    artifact_ref, raw).  Each key is first reduced to its best entry, so a key with many entries is
    no hot spot.
    """
    out = units
    ways = (("query_unit_id", "query_unit_id", "exact_query_unit_id"), ("object_id", "artifact_ref", "object_id_fallback"), ("artifact_ref", "artifact_ref", "artifact_ref_fallback"))
    picked = None
    for k, (field, own, name) in enumerate(ways):
        best = entries.where(F.col(field) != "").groupBy(F.col(field).alias(f"_k{k}"))
        best = best.agg(F.min_by(F.struct("raw", "vector_entry_id"), F.struct((-F.col("raw")).alias("r"), "vector_entry_id")).alias(f"_h{k}"), F.count("*").alias(f"_n{k}"))
        out = out.join(best, F.col(own) == F.col(f"_k{k}"), "left")
        hit = F.struct(F.lit(name).alias("method"), F.col(f"_h{k}.raw").alias("raw"), F.col(f"_h{k}.vector_entry_id").alias("entry"), F.col(f"_n{k}").alias("n"))
        picked = F.when(F.col(f"_k{k}").isNotNull(), hit) if picked is None else picked.when(F.col(f"_k{k}").isNotNull(), hit)
    out = out.withColumn("_p", picked)
    return out.select(*units.columns, F.col("_p.method").alias("alignment"), F.col("_p.entry").alias("vector_entry_id"), F.col("_p.raw").alias("embedding_raw"), F.coalesce("_p.n", F.lit(0)).alias("n_hits"))


def unit_scores(bm25: DataFrame, vectors: DataFrame, key: list[str], *, weights=(0.45, 0.55), least_bm25: float = 0.05) -> DataFrame:
    """(query_id, key, score, bm25_norm, embedding_norm): negative cosines count 0, and are not scaled up.

    BM25 is scaled by the question's best, and counts 0 if that is below ``least_bm25``.  A unit
    without a vector has its BM25 part alone.  Pairs are those with a hit on either side.
    """
    best = bm25.groupBy("query_id").agg(F.max("bm25").alias("_max"))
    rows = bm25.join(vectors, ["query_id", *key], "full_outer").join(best, "query_id", "left")
    norm = F.when((F.col("_max") >= least_bm25) & (F.col("_max") > 0), F.coalesce("bm25", F.lit(0.0)) / F.col("_max")).otherwise(0.0)
    emb = F.greatest(F.lit(0.0), F.col("embedding_raw"))
    score = F.when(emb.isNotNull(), weights[1] * emb + weights[0] * norm).otherwise((weights[0] if weights[1] > 0 else 1.0) * norm)
    return rows.select("query_id", *key, F.round(score, 6).alias("score"), F.round(norm, 6).alias("bm25_norm"), F.round(emb, 6).alias("embedding_norm"))


def pruned(candidates: DataFrame, selected: Column, bucket: Column) -> DataFrame:
    """Candidates with their fate: selected, excluded by score, or kept for audit only."""
    status = F.when(selected, "selected").when(bucket == "excluded", "excluded").otherwise("not_selected")
    policy = F.when(selected, "candidate_context").when(bucket == "excluded", "do_not_use").otherwise("audit_only")
    return candidates.withColumn("bucket", bucket).withColumn("prune_status", status).withColumn("use_policy", policy)


def packet_quality(questions: DataFrame, pruned_rows: DataFrame, checks: DataFrame) -> DataFrame:
    """(query_id, n_selected, evidence_status, retrieval_status): how far a packet can be trusted.

    ``checks``: (query_id, support_strength), one row per selected candidate that was checked.
    """
    chosen = pruned_rows.where("prune_status = 'selected'").groupBy("query_id").agg(F.count("*").alias("n_selected"), F.max("bm25_norm").alias("_best"))
    seen = checks.groupBy("query_id").agg(F.count("*").alias("n_checked"), F.count_if(F.col("support_strength").isin("direct", "partial", "contradicts")).alias("n_signal"))
    rows = questions.select("query_id").join(chosen, "query_id", "left").join(seen, "query_id", "left").fillna(0)
    none = F.col("n_selected") == 0
    evidence = F.when(none, "not_applicable").when(F.col("n_checked") < F.col("n_selected"), "degraded").when(F.col("n_signal") > 0, "pass").otherwise("degraded")
    retrieval = F.when(none, "fail").when(F.col("_best") <= 0, "degraded").otherwise("pass")
    return rows.select("query_id", "n_selected", "n_checked", "n_signal", evidence.alias("evidence_status"), retrieval.alias("retrieval_status"))
