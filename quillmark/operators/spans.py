"""Spans by rule: section classes and policies, lexicon features, the additive and the value / risk routers,
claim attribution, and memory classes.  All are expressions over one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.lexicon import GROUPS

# Markers of front matter, and section types whose doubtful cases ask for help.
FRONT_MATTER = (
    "front matter", "fixture front matter", "synthetic fixture", "workflow testing", "should not become ordinary evidence",
    "should not become a portrait unit", "not become ordinary evidence", "not a portrait unit",
)
HIGH_RISK = (
    "front_matter", "license", "copyright", "editorial_preface", "editorial_note", "footnote", "endnote", "appendix",
    "bibliography", "person_list", "metadata", "ocr_noise",
)
RAW_ONLY = ("front_matter", "license", "copyright", "metadata", "ocr_noise", "page_header_footer")
BACKGROUND = ("footnote", "endnote", "editorial_note", "editorial_preface", "appendix", "bibliography", "person_list", "list", "quote")
# Texts without use, and words of praise.
NO_USE = ("ok", "okay", "yes", "no", "thanks", "thank you", "好的", "好", "嗯", "行")
PRAISE = ("smart", "talented", "great", "excellent", "brilliant", "clever", "capable", "amazing", "聪明", "厉害", "优秀")
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"


def contains_any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def classify_section(text: Column, index: Column, book: Column) -> Column:
    """(section_type, confidence, perspective) of a section of plain text, the first rule that fits.

    ``index``: its number from 1 in the document; ``book``: whether the text is laid out like a book.
    """
    flat = T.squeeze(text)
    low = F.lower(flat)
    is_ = lambda kind, sure, who: F.struct(F.lit(kind).alias("section_type"), F.lit(sure).alias("confidence"), F.lit(who).alias("perspective"))
    has = lambda *words: contains_any(low, words)
    dated = flat.rlike(r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}\b") | flat.rlike(r"^[A-Z][a-z]{2,8}\. +\d{1,2},") | low.rlike(rf"^({MONTHS})[a-z]*\. +\d")
    upper = (flat == F.upper(flat)) & (flat != F.lower(flat))
    quoted = flat.rlike("^[\"'“]") | ((F.length(flat) <= 800) & low.rlike("\\bsaid\\b.*[\"'“]"))
    return (
        F.when(dated, is_("body", "high", "author"))
        .when(has("project gutenberg", "gutenberg license", "end of the project gutenberg"), is_("license", "high", "editor"))
        .when(has("copyright", "all rights reserved", "license"), is_("copyright", "medium", "editor"))
        .when(has("transcriber's note", "editor's note", "editorial note"), is_("editorial_note", "high", "editor"))
        .when(low.rlike(r"^(footnote|endnote)\b") | low.rlike(r"^\[[0-9ivxlcdm]+\]"), is_("footnote", "medium", "editor"))
        .when(low.rlike(r"^appendix\b"), is_("appendix", "high", "editor"))
        .when(low.rlike(r"^(bibliography|references)\b"), is_("bibliography", "high", "editor"))
        .when(low.rlike(r"^(persons?|dramatis personae|list of)\b"), is_("person_list", "medium", "editor"))
        .when(has(*FRONT_MATTER), is_("front_matter", "high", "editor"))
        .when(book & (F.length(flat) < 80) & upper & (index <= 3), is_("front_matter", "medium", "editor"))
        .when(book & (F.length(flat) < 80) & upper, is_("metadata", "medium", "editor"))
        .when(quoted, is_("quote", "medium", "quoted_speaker"))
        .when(book & (index <= 2) & (F.length(flat) < 200), is_("front_matter", "low", "unknown"))
        .otherwise(is_("body", "medium", "author"))
    )


def section_policies(kind: Column) -> Column:
    """(storage, retrieval, s2) policies of a section type."""
    of = lambda a, b, c: F.struct(F.lit(a).alias("storage_policy"), F.lit(b).alias("retrieval_policy"), F.lit(c).alias("s2_policy"))
    return (
        F.when(kind == "body", of("ordinary_evidence", "default_retrieval", "candidate_allowed"))
        .when(kind.isin(*RAW_ONLY), of("recoverable_raw_only", "excluded_from_default_retrieval", "blocked_from_portrait"))
        .when(kind.isin(*BACKGROUND), of("background_evidence", "explicit_query_only", "background_only"))
        .otherwise(of("needs_review", "needs_review", "needs_review"))
    )


def assist_triggers(kind: Column, confidence: Column, perspective: Column, s2_policy: Column, priority: Column) -> Column:
    """Why a section should be looked at by more than the script."""
    unsure = confidence != "high"
    return F.array_compact(
        F.array(
            F.when(confidence == "low", "low_script_confidence"),
            F.when(kind.isin(*HIGH_RISK) & unsure, "high_risk_section"),
            F.when(perspective.isin("mixed", "unknown") & (s2_policy == "candidate_allowed"), "perspective_ambiguity"),
            F.when(s2_policy.isin("candidate_allowed", "needs_review") & unsure, "high_downstream_impact"),
            F.when((priority == "high") & unsure, "high_value_source"),
        )
    )


def group_count(text: Column, group: str) -> Column:
    """Occurrences of a group's English terms with no word character beside them, and of its Chinese terms anywhere."""
    english, chinese = GROUPS[group]
    low = F.lower(F.coalesce(text, F.lit("")))
    latin = "|".join(t.replace(" ", r"\s+") for t in english)
    out = F.regexp_count(low, F.lit(rf"(?<![a-z0-9_])(?:{latin})(?![a-z0-9_])"))
    for term in chinese:
        out = out + F.regexp_count(low, F.lit(term))
    return out.cast("long")


def lexicon_features(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows with lengths, sentences, punctuation, and the count and density of every term group.

    Counts come in one projection, so that what follows does not evaluate the patterns again.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lengths = F.transform(F.filter(F.transform(F.split(t, "[.!?。！？]+"), lambda p: F.trim(p)), lambda p: p != ""), lambda p: F.length(p))
    rows = rows.select("*", F.length(t).cast("long").alias("chars"), T.rough_token_count(t).alias("tokens"), F.regexp_count(t, F.lit("[,;:，；：]")).cast("long").alias("punctuation"), lengths.alias("_lengths"), *[group_count(t, g).alias(f"{g}_count") for g in GROUPS])
    total = F.aggregate("_lengths", F.lit(0), lambda a, x: a + x)
    rows = rows.withColumns(
        {
            "sentences": F.greatest(F.size("_lengths"), F.lit(1)).cast("long"),
            "max_sentence": F.coalesce(F.array_max("_lengths"), F.col("chars")).cast("long"),
            "mean_sentence": F.when(F.size("_lengths") > 0, F.round(total / F.size("_lengths"), 4)).otherwise(F.col("chars").cast("double")),
            "clause_markers": F.col("punctuation") + F.col("logical_count"),
        }
    ).drop("_lengths")
    return rows.withColumns({f"{g}_per_100": T.per_100(F.col(f"{g}_count"), F.col("tokens")) for g in GROUPS})


def additive_route(task: str = "s1", *, background: Column, non_target: Column, fallback_span: Column, low_confidence: Column, mixed: Column) -> tuple[Column, Column]:
    """(score, route) of the first router over lexicon features, for one task.

    Background first, then portraits of others, then spans too coarse to score; else the capped score.
    """
    one = lambda cond, n=1: F.when(cond, n).otherwise(0)
    c, per = (lambda g: F.col(f"{g}_count")), (lambda g: F.col(f"{g}_per_100"))
    score = (
        one(F.col("chars") > 260) + one(F.col("tokens") > 65)
        + F.least(F.lit(2), F.floor(F.col("punctuation") / 2)) + F.least(F.lit(2), c("event"))
        + one(c("role") > 0, 2) + one(c("pronoun") >= 2) + one(c("logical") > 0) + one(c("importance") > 0, 2)
        + one(per("event") >= 2.0) + one(per("role") >= 1.0) + one(per("logical") >= 1.0) + one(per("importance") >= 1.0)
        + one(low_confidence) + one(mixed)
    )
    if task == "graph":
        score = score + F.when((c("role") > 0) | (c("logical") > 0), 2).otherwise(1)
    elif task in ("s2", "support"):
        score = score + 1
    elif task == "s0b":
        score = score + one(low_confidence)
    coarse = fallback_span & ((F.col("chars") > 900) | (F.col("tokens") > 180))
    skipped = background | (non_target if task == "s2" else F.lit(False))
    score = F.when(skipped | coarse, 0).otherwise(F.least(F.lit(12), score)).cast("long")
    route = F.when(skipped, "skip").when(coarse, "split_or_segment_first").when(score <= 1, "script").when(score <= 4, "weak").when(score <= 7, "strong").otherwise("human")
    return score, route


def value_risk_route() -> tuple[Column, Column, Column]:
    """(has_value, risk, route) of the second router's first-layer task.

    Over features tokens, chars, event_count, first_person_count, pronoun_count and the scores positive,
    low, keyphrase, risk, constraint, attribution, complexity, and flags fragment, quote_warning, mixed, low_confidence.
    """
    c = F.col
    one = lambda cond, n: F.when(cond, n).otherwise(0)
    value = (
        F.when((c("low") >= 5) & (c("positive") <= 3), False)
        .when(c("fragment") & (c("positive") <= 0) & (c("tokens") <= 3), False)
        .when((c("positive") > 0) | (c("event_count") > 0), True)
        .when((c("first_person_count") > 0) & (c("tokens") >= 4), True)
        .otherwise((c("keyphrase") >= 2) & (c("tokens") >= 4) & (c("chars") >= 20))
    )
    risk = (
        one(c("quote_warning"), 4) + one(c("risk") >= 5, 4) + one(c("constraint") >= 5, 2) + one(c("attribution") >= 4, 2)
        + F.when(c("complexity") >= 8, 4).when(c("complexity") >= 6, 2).otherwise(0)
        + one(c("pronoun_count") >= 2, 1) + F.when(c("mixed"), 3).when(c("low_confidence"), 2).otherwise(0)
    )
    route = F.when(~value, "skip").when(risk >= 6, "strong").when(risk >= 3, "weak").otherwise("script")
    return value, risk.cast("long"), route


def praises_another(text: Column) -> Column:
    """Whether a text speaks to somebody, or of a named one, with praise."""
    low = F.lower(text)
    name = F.lower(F.regexp_extract(text, r"\b([A-Z][A-Za-z]+)\s+is\s+(?:really\s+)?(?:smart|talented|great|excellent|brilliant|clever|capable)\b", 1))
    return (
        (low.rlike(r"\byou('?re| are)\b") & contains_any(low, PRAISE))
        | text.rlike(r"^[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)?,\s+you\b")
        | ((name != "") & ~name.isin("that", "this", "it"))
        | text.rlike("你.*(聪明|厉害|优秀)")
    )


def beside(words: str) -> str:
    """A pattern of words that no other word character touches."""
    return rf"(?<![\p{{L}}\p{{N}}_]){words}(?![\p{{L}}\p{{N}}_])"


def claim_attribution(text: Column, kind: Column) -> Column:
    """(claim_type, attribution, path, eligibility) of a proposal's text, the first rule that fits."""
    flat = T.squeeze(text)
    low = F.lower(flat)
    out = lambda claim, attr, path, fact: F.struct(F.lit(claim).alias("claim_type"), (F.lit(attr) if isinstance(attr, str) else attr).alias("attribution_status"), F.lit(path).alias("promotion_path"), F.lit(fact).alias("fact_eligibility"))
    relation = low.rlike(r"\bi should learn from\b|\blearn from you\b|\blet'?s\b.*\b(discuss|meet|work|collaborate|eat|dinner)\b|\bi use\b.*\b(tool|project|for this project)\b")
    relation = relation | low.rlike(beside("向你学习")) | low.rlike(beside("一起") + ".*" + beside("(讨论|吃饭|合作)"))
    first = low.rlike(r"\b(i prefer|i like|i need|i want|i cannot|i can't|i am|i'm|my|me too|same here|go-to|speaks to me)\b") | low.rlike(beside("(我喜欢|我需要|我想|我不能|我的)"))
    asks = F.contains(flat, F.lit("?")) & low.rlike(r"\b(you|your|do you|got any)\b")
    said = F.when(F.contains(low, F.lit("i ")) | F.contains(flat, F.lit("我")), "explicit").otherwise("inferred")
    none = F.when(low != "", "explicit").otherwise("unknown")
    return (
        F.when(kind == "model_failure", out("no_useful_modeling_value", "unknown", "no_promotion", "ineligible"))
        .when((low == "") | low.isin(*NO_USE), out("no_useful_modeling_value", none, "no_promotion", "ineligible"))
        .when(F.contains(low, F.lit("encourages")) & F.contains(low, F.lit("exchange")), out("interaction_hypothesis", "inferred", "hypothesis_pool_candidates", "ineligible"))
        .when(praises_another(flat), out("subject_belief_about_node", "inferred", "hypothesis_pool_candidates", "ineligible"))
        .when(relation, out("subject_relation_to_node", said, "future_relation_candidate", "ineligible"))
        .when(asks, out("subject_relation_to_node", "inferred", "hypothesis_pool_candidates", "ineligible"))
        .when(kind == "portrait_hypothesis_candidate", out("interaction_hypothesis", "inferred", "hypothesis_pool_candidates", "ineligible"))
        .when((kind == "portrait_fact_candidate") & first, out("subject_intrinsic_fact", "explicit", "fact_promotion_review_queue", "eligible"))
        .when(kind.isin("reject", "skipped"), out("no_useful_modeling_value", "unknown", "no_promotion", "ineligible"))
        .otherwise(out("unknown", "ambiguous", "uncertain_pool", "uncertain"))
    )


def memory_class(content: Column, own: Column) -> Column:
    """(type, memory_class, scope) of a unit by substrings of its text; a class of its own stays for observations."""
    low = F.lower(F.coalesce(content, F.lit("")))
    of = lambda a, b, c: F.struct(F.lit(a).alias("type"), (F.lit(b) if isinstance(b, str) else b).alias("memory_class"), F.lit(c).alias("scope"))
    return (
        F.when(contains_any(low, ("prefer", "favorite", "favourite", "love", "enjoy", "stress relief", "go-to")), of("preference", "semantic", "global"))
        .when(contains_any(low, ("job", "business", "store", "work", "career", "lost")), of("life_stage", "episodic", "temporary"))
        .when(contains_any(low, ("plan", "routine", "usually", "schedule", "practice")), of("routine", "procedural", "task"))
        .otherwise(of("observation", F.coalesce(own, F.lit("episodic")), "conversation"))
    )
