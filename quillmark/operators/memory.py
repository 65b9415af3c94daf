"""Evidence, sections, sentences, memory units, summaries and context windows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import spans


def context_envelope(rows: DataFrame, by: list[str], order: str, ref: str, text: str, width: int = 2) -> DataFrame:
    """References of the ``width`` rows before and after each row of its group; rows without text drop out first."""
    kept = rows.where((F.trim(F.coalesce(text, F.lit(""))) != "") & F.col(ref).isNotNull())
    w = Window.partitionBy(*by).orderBy(order)
    before = F.collect_list(ref).over(w.rowsBetween(-width, -1))
    after = F.collect_list(ref).over(w.rowsBetween(1, width))
    return kept.withColumn("context_before", F.array_join(before, ",")).withColumn("context_after", F.array_join(after, ","))


def neighbour_ids(rows: DataFrame, by: list[str], order: str, ref: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("prev_ref", F.lag(ref).over(w)).withColumn("next_ref", F.lead(ref).over(w)).withColumn("unit_no", F.concat(F.lit("S"), F.lpad(F.row_number().over(w).cast("string"), 4, "0")))


def session_summaries(evidence: DataFrame) -> DataFrame:
    """Per session: counts, participants, scope, first three events, and the target's first five commitments.

    Events are the target's turns, or all where the target has none.  The firsts are ranked before
    they are gathered, so a session of any length holds a few rows.
    """
    user = F.col("subject_role") == "target"
    item = F.struct("turn", F.col("evidence_ref").alias("ref"))
    sums = evidence.groupBy("source_id").agg(
        F.count("*").alias("n_turns"),
        F.count_if(user).alias("n_target_turns"),
        F.array_join(F.array_sort(F.collect_set("speaker")), ",").alias("participants"),
        F.when(F.count_if(~user) == 0, "target_only").otherwise("mixed_participant").alias("subject_scope"),
    )

    def firsts(rows: DataFrame, most: int, out: str) -> DataFrame:
        ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("source_id").orderBy("turn", "evidence_ref"))).where(F.col("_rn") <= most)
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["ref"]), ",")
        return ranked.groupBy("source_id").agg(listed.alias(out))

    both = sums
    for rows, most, out in ((evidence.where(user), 3, "_own"), (evidence, 3, "_any"), (evidence.where(user & T.is_commitment(F.col("text"))), 5, "commitments")):
        both = both.join(firsts(rows, most, out), "source_id", "left")
    return both.withColumn("main_events", F.coalesce("_own", "_any")).fillna("", ["commitments"]).drop("_own", "_any")


def memory_units(evidence: DataFrame) -> DataFrame:
    """Accepted target turns with a class by keywords and a stable id; the rest stay candidates with a reason."""
    kind = spans.memory_class(F.col("text"), F.lit("episodic"))
    status = F.when((F.col("subject_role") == "target") & (F.trim("text") != ""), "accepted_for_experiment").otherwise("context_only")
    return evidence.select(
        T.stable_id("memory", F.col("evidence_ref"), n=16).alias("memory_id"),
        "evidence_ref",
        "source_id",
        "turn",
        T.excerpt(F.col("text"), 220).alias("content"),
        kind["type"].alias("unit_type"),
        kind["memory_class"].alias("memory_class"),
        kind["scope"].alias("scope"),
        status.alias("status"),
        F.sha2("text", 256).alias("content_hash"),
    )



# Abbreviations whose stop ends no sentence.
ABBREVIATIONS = frozenset("mr mrs ms dr prof st sr jr vs etc inc ltd co corp no vol fig eq al e.g i.e approx dept est jan feb mar apr jun jul aug sep sept oct nov dec".split())
_TERMINATORS, _CLOSERS = ".!?。！？", "\"'”’)]）】」』"


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of sentences; closers stay with theirs, and a stop after an abbreviation, an initial or
    inside a number ends none."""
    out, begin, k, n = [], 0, 0, len(text)
    while k < n:
        c = text[k]
        if c in _TERMINATORS:
            stop = k + 1
            while stop < n and (text[stop] in _TERMINATORS or text[stop] in _CLOSERS):
                stop += 1
            ends = True
            if c == ".":
                word = text[begin:k].rsplit(None, 1)[-1].lower().lstrip("(\"'") if text[begin:k].strip() else ""
                inside = k + 1 < n and text[k + 1].isdigit() and k > 0 and text[k - 1].isdigit()
                ends = not (inside or word in ABBREVIATIONS or (len(word) == 1 and word.isalpha()) or (stop < n and not text[stop].isspace()))
            k = stop
            if ends:
                out.append((begin, stop))
                begin = stop
            continue
        if c == "\n" and text[begin:k].strip():
            out.append((begin, k))
            begin = k
        k += 1
    if text[begin:].strip():
        out.append((begin, n))
    trimmed = []
    for a, b in out:
        body = text[a:b]
        if body.strip():
            lead = len(body) - len(body.lstrip())
            trimmed.append((a + lead, a + lead + len(body.strip())))
    return trimmed


def sentence_units(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, unit_no, char_start, char_end, text): the one scanner with state, in Arrow batches."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = t.as_py() or ""
                rows += [(i, k, a, b, body[a:b]) for k, (a, b) in enumerate(sentence_spans(body), 1)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, kinds, strict=True)], [key, "unit_no", "char_start", "char_end", "text"])

    return docs.select(key, F.col(text)).mapInArrow(run, f"`{key}` {kind}, unit_no long, char_start long, char_end long, text string")


def paragraph_units(docs: DataFrame, key: str, text: str = "text", most: int = 1200) -> DataFrame:
    """Blank-line paragraphs packed in order into segments of at most ``most`` characters."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, p):
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p))
        fits = (F.length(joined) <= most) | (acc["open"] == "")
        return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"), F.when(fits, joined).otherwise(p).alias("open"))

    packed = F.aggregate(parts, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))
    each = docs.select(key, F.posexplode(packed).alias("n", "text"))
    return each.select(key, F.concat(F.lit("P"), F.lpad((F.col("n") + 1).cast("string"), 4, "0")).alias("unit_no"), "text", F.length("text").cast("long").alias("n_chars"))
