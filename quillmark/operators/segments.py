"""Texts as paragraphs and sentences with character spans and warnings, and the co-occurrence graph of what they name.

Spans come from one Arrow table function, as a sentence's end depends on what stands before it; everything
else is expressions.  ``text[start:end]`` is the unit as it stands, ``text`` the unit with plain spaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that end a sentence, that stay with the one they close, and abbreviations whose stop ends none.
ENDS, CLOSERS = ".!?。！？", "\"'”’)]}）】》"
NON_TERMINAL = frozenset(
    (
        "adm", "capt", "cf", "col", "dr", "e.g", "etc", "fig", "gen", "hon", "i.e", "jr", "lt", "mr", "mrs", "ms", "mt", "jan", "feb", "mar",
        "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec", "no", "p", "pp", "prof", "rev", "sr", "st", "vs",
    )
)
_BLANK = regex.compile(r"\n\s*\n")
_MARK = regex.compile(f"[{regex.escape(ENDS)}][{regex.escape(CLOSERS)}]*")
_TOKEN = regex.compile(r"(?r)[A-Za-z](?:[A-Za-z]|\.)*\Z")
_ACRONYM = regex.compile(r"(?:[A-Z]\.)+[A-Z]?")
_DATE = regex.compile(r"(?:^|\s)(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.\s+\d{1,2},\s+\d{4})\.\Z", regex.I)
_PAIRS = ("[]", "()", "{}", "（）", "【】")
#: Characters before a stop that decide whether it ends a sentence.
LOOK_BACK = 40


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without white space at its ends; an empty one if there is nothing else."""
    body = text[start:end]
    left = start + len(body) - len(body.lstrip())
    return left, max(left, start + len(body.rstrip()))


def paragraph_spans(text: str) -> list[tuple[int, int]]:
    """Spans between blank lines."""
    at, out = 0, []
    for cut in [*((m.start(), m.end()) for m in _BLANK.finditer(text)), (len(text), len(text))]:
        start, end = trimmed(text, at, cut[0])
        if start < end:
            out.append((start, end))
        at = cut[1]
    return out


def _last_token(text: str, at: int, begin: int) -> str:
    m = _TOKEN.search(text[max(begin, at - LOOK_BACK) : at])
    return m[0] if m else ""


def _ends(text: str, at: int, begin: int) -> bool:
    """Whether the mark at ``at`` ends a sentence of the paragraph that begins at ``begin``."""
    if text[at] != ".":
        return True
    before, after = text[at - 1] if at > begin else "", text[at + 1 : at + 2]
    token = _last_token(text, at, begin)
    initial = len(token) == 1 and token.isupper()
    dated = _DATE.search(text[max(begin, at - LOOK_BACK) : at + 1])
    return not (dated or (before.isdigit() and after.isdigit()) or initial or _ACRONYM.fullmatch(token) or token.lower().rstrip(".") in NON_TERMINAL)


def sentence_spans(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Spans of a paragraph's sentences: up to an end mark with its closers; marks in a row end one sentence."""
    out, begin, at = [], start, start
    while m := _MARK.search(text, at, end):
        if not _ends(text, m.start(), start):
            at = m.start() + 1
            continue
        rest = m.end()
        while rest < end and text[rest].isspace():
            rest += 1
        if rest < end and text[rest] in ENDS:
            at = rest
            continue
        a, b = trimmed(text, begin, m.end())
        if a < b:
            out.append((a, b))
        begin = at = rest
    a, b = trimmed(text, begin, end)
    return [*out, (a, b)] if a < b else out


def segmentation_warnings(text: Column) -> Column:
    """What makes a sentence look cut wrongly."""
    t = F.trim(text)
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    uneven = F.lit(False)
    for opening, closing in _PAIRS:
        uneven = uneven | (count(opening) != count(closing))
    token = F.lower(F.regexp_extract(t, r"([A-Za-z](?:[A-Za-z]|\.)*)\.$", 1))
    short = t.rlike(r"\b[A-Za-z]{1,4}\.$") & F.regexp_replace(token, r"\.+$", "").isin(*sorted(NON_TERMINAL))
    found = F.array(
        F.when(F.substring(t, 1, 1).isin("]", ")", "}", "）", "】"), "starts_with_closing_bracket"),
        F.when(uneven, "unbalanced_bracket_fragment"),
        F.when(short, "ends_with_non_terminal_abbreviation"),
    )
    return F.filter(found, lambda w: w.isNotNull())


def text_units(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, unit_id, paragraph, sentence, start, end, text, warnings): P0001 and its sentences P0001.S0001, ...

    A paragraph's own row has sentence 0 and no warnings.  Spans count characters of the whole text.
    Null, empty and blank texts have no units; repeated rows have theirs again.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "paragraph", "sentence", "start", "end", "_raw"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = t.as_py()
                for p, (a, b) in enumerate(paragraph_spans(body), 1):
                    rows.append((k, p, 0, a, b, body[a:b]))
                    rows += [(k, p, s, x, y, body[x:y]) for s, (x, y) in enumerate(sentence_spans(body, a, b), 1)]
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 4, pa.string()]
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, kinds, strict=True)], names)

    spelled = docs.where(F.col(text).isNotNull()).select(key, text)
    units = spelled.mapInArrow(run, f"`{key}` {kind}, paragraph long, sentence long, start long, end long, _raw string")
    pad = lambda c, letter: F.concat(F.lit(letter), F.lpad(F.col(c).cast("string"), 4, "0"))
    unit = F.when(F.col("sentence") == 0, pad("paragraph", "P")).otherwise(F.concat(pad("paragraph", "P"), F.lit("."), pad("sentence", "S")))
    none = F.array().cast("array<string>")
    warned = F.when(F.col("sentence") > 0, segmentation_warnings(F.col("_raw"))).otherwise(none)
    flat = F.trim(F.regexp_replace("_raw", r"(?U)\s+", " "))
    return units.select(key, unit.alias("unit_id"), "paragraph", "sentence", "start", "end", flat.alias("text"), warned.alias("warnings"))


# --- co-occurrence


#: Words whose pairs are counted at once.
CHUNK = 500_000


def _pair_counts(lists: pa.ListArray, window: int) -> pa.RecordBatch:
    """(a, b, n) of the pairs within the lists."""
    words = lists.flatten().dictionary_encode()
    order = pc.sort_indices(words.dictionary)  # by bytes, as Spark compares
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    place = rank[words.indices.to_numpy()] if len(words) else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    keys = []
    for k in range(1, window + 1):
        x, y = place[:-k], place[k:]
        at = (row[:-k] == row[k:]) & (x != y)
        keys.append(np.minimum(x[at], y[at]) * len(order) + np.maximum(x[at], y[at]))
    pairs, n = np.unique(np.concatenate(keys), return_counts=True)
    names = words.dictionary.take(order)
    size = max(len(order), 1)
    return pa.RecordBatch.from_arrays([names.take(pa.array(pairs // size)), names.take(pa.array(pairs % size)), pa.array(n, pa.int64())], ["a", "b", "n"])


def cooccurrences(rows: DataFrame, terms: str, window: int = 8) -> DataFrame:
    """(a, b, n): how often two different terms stand at most ``window`` places apart, a < b.

    ``terms`` is an array in the order of the text.  The pairs of a place are made in its own row, offset
    by offset, so the work is terms x window and no term's places meet; pairs are counted over some
    hundred thousand words at a time, and only these counts go on.  Null arrays and null terms give no pairs.
    """
    t = F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda x: x.isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            ends = np.cumsum(lists.value_lengths().to_numpy())
            at = 0
            while at < len(lists):
                before = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + CHUNK, "right")))
                yield _pair_counts(lists.slice(at, to - at), window)
                at = to

    counts = rows.select(t.alias("t")).mapInArrow(run, "a string, b string, n long")
    return counts.groupBy("a", "b").agg(F.sum("n").alias("n"))


def sample_graphs(mentions: DataFrame, sample: str, unit: str) -> DataFrame:
    """Each sample's annotation graph by numbers, (sample, nodes, edges, top_share, mesh_potential, score).

    ``mentions``: (sample, unit, name, kind 'entity' or 'event').  An edge joins an entity and an event that
    share a unit; of a unit's entities and events the first eight by name take part.  The score is edges +
    nodes - 100 x the highest degree's share of all ends; the best sample has the highest score, then the smallest name.
    """
    named = mentions.select(sample, unit, "kind", F.lower(F.trim("name")).alias("name")).where("name <> ''").distinct()
    nodes = named.select(sample, "kind", "name").distinct().groupBy(sample).agg(F.count("*").alias("nodes"))
    first = named.groupBy(sample, unit, "kind").agg(F.slice(F.sort_array(F.collect_set("name")), 1, 8).alias("names"))
    side = lambda kind, out: first.where(F.col("kind") == kind).select(sample, unit, F.col("names").alias(out))
    both = side("entity", "entities").join(side("event", "events"), [sample, unit])
    edges = both.select(sample, F.explode("entities").alias("a"), "events").select(sample, "a", F.explode("events").alias("b")).distinct()
    ends = edges.select(sample, F.concat(F.lit("entity:"), "a").alias("v")).unionByName(edges.select(sample, F.concat(F.lit("event:"), "b").alias("v")))
    degree = ends.groupBy(sample, "v").agg(F.count("*").alias("n")).groupBy(sample).agg(F.max("n").alias("_top"), F.sum("n").alias("_all"))
    counts = nodes.join(edges.groupBy(sample).agg(F.count("*").alias("edges")), sample, "left").join(degree, sample, "left").fillna(0, ["edges", "_top", "_all"])
    share = F.when(F.col("_all") > 0, F.col("_top") / F.col("_all")).otherwise(0.0)
    good = (F.col("nodes") >= 25) & (F.col("edges") >= 40) & (share <= 0.2)
    rows = counts.select(sample, "nodes", "edges", F.round(share + 1e-9, 4).alias("top_share"), F.when(good, "good").otherwise("limited").alias("mesh_potential"))
    return rows.withColumn("score", F.col("edges") + F.col("nodes") - F.floor(F.col("top_share") * 100 + 1e-9))
