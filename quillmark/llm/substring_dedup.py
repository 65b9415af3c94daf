"""Repeated passages: paragraphs by min-max banding, exact Jaccard, and components; one copy stays.

Paragraphs are lines of at least ``MIN_WORDS`` words.  Equal ones form a class; classes whose band
keys meet are compared on their full five-word shingle sets, and those with a similarity of 0.8 or
more are linked.  So that a passage is found wherever it stands, in a line or across short ones,
runs of ``WINDOW`` words are selected by winnowing: of any ``STEPS`` runs that follow each other the
one of least hash is taken, so two texts that share ``WINDOW + STEPS - 1`` = 50 words have a selected
run in common, and the selected runs of a longer passage leave no gap.  Runs take part by equality,
and what they cover is extended word by word as far as it agrees with the copy that stays.  Of each
component the occurrence with the smallest (document, place) stays, all others are removed.
Paragraphs are settled first; a run that touches a removed paragraph neither stays for others nor
goes itself, so whatever is removed has a copy (or, of paragraphs, a linked one) that stands.
Equality is that of 128 bits; of paragraphs or runs that share the first 64 of them and not the
rest, one class takes part and the others are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, few, free_name, scratch, small_batches, written
from .near import MinMax, finish, near_components
from .shingles import WordHashes, shingle_hashes

#: At similarity 0.8 a link is missed by all 12 bands of 3 with probability 2e-4, at 0.9 with 4e-7.
BANDS, ROWS, SIZE, PERCENT = 12, 3, 5, 80
MIN_WORDS = 12
#: Words of a run and runs of which one is selected; idx of a text's first selected run.
WINDOW, STEPS, FIRST_RUN = 26, 25, 1 << 30
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_K, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_REST = np.append(np.uint64(1), np.cumprod(np.full(WINDOW, _K2)))[::-1]  # weights of a run's length and words
#: Random values of bytes, and the bytes of texts that are taken together.
_BYTES = np.random.default_rng(3).integers(1, (1 << 64) - 1, 256, dtype=np.uint64, endpoint=True)
CHUNK_BYTES = 1 << 18


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``_K`` from the 0th on, and their inverses modulo 2**64."""
    up = lambda k: np.cumprod(np.append(np.uint64(1), np.full(n, np.uint64(k), np.uint64)))
    return up(int(_K)), up(pow(int(_K), -1, 1 << 64))


_POWERS = _powers(CHUNK_BYTES)
UNITS = "doc_id long, text_hash long, idx int, start int, length int, cls long, rest long, bands array<long>"
#: Rows with arrays that are broadcast at most.
WIDE_ROWS = 150_000


class Words:
    """The words of texts (split at ASCII white space), one text after the other: hashes of their lower case, places, lines."""

    def __init__(self, texts: list[bytes]):
        raw = b"\n".join(texts)
        self.raw = np.frombuffer(raw, np.uint8)
        edge = np.flatnonzero(np.diff(_SPACE[self.raw], prepend=True, append=True))
        self.first, self.last = edge[::2], edge[1::2]
        self.hash = word_hashes(np.frombuffer(raw.lower(), np.uint8), self.first, self.last)
        self.text = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])  # where each text begins, in bytes
        self.word = np.append(np.searchsorted(self.first, self.text), len(self.first))  # and in words
        self.chars = None if raw.isascii() else np.concatenate([[0], np.cumsum((self.raw & 0xC0) != 0x80)])

    def place(self, at: np.ndarray) -> np.ndarray:
        """Characters before bytes."""
        return at if self.chars is None else self.chars[at]

    def lines(self) -> tuple[np.ndarray, ...]:
        """(text, start, length, first word, word behind) of lines of MIN_WORDS at least."""
        ends = np.append(np.flatnonzero(self.raw == 10), len(self.raw))
        begins = np.append(0, ends[:-1] + 1)
        words = np.searchsorted(self.first, ends)
        before = np.append(0, words[:-1])
        keep = words - before >= MIN_WORDS
        text = np.searchsorted(self.text, begins[keep], "right") - 1
        start, stop = self.place(begins[keep]), self.place(ends[keep])
        return text, start - self.place(self.text[text]), stop - start, before[keep], words[keep]

    def runs(self) -> tuple[np.ndarray, ...]:
        """Selected runs: their text, the number of their first word, and their hashes."""
        none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        if len(self.hash) < WINDOW + STEPS - 1:
            return none
        key = _spread(self.hash, WINDOW, lambda a, b: finish(a * _K + b))
        whole = np.diff(self.word) >= WINDOW + STEPS - 1
        text = np.repeat(np.arange(len(whole)), np.diff(self.word))[: len(key)]
        left = self.word[1:][text] - np.arange(len(key))  # words up to the text's end
        least = np.where(left[: len(key) - STEPS + 1] >= WINDOW + STEPS - 1, _spread(key, STEPS, np.minimum), 0)
        pad = np.zeros(STEPS - 1, np.uint64)
        at = np.flatnonzero((key == _spread(np.concatenate([pad, least, pad]), STEPS, np.maximum)) & (left >= WINDOW) & whole[text])
        same = np.flatnonzero((np.diff(key[at]) == 0) & (np.diff(text[at]) == 0))
        if len(same):  # ties, as in texts that repeat themselves: as few as leave no gap
            parts = np.split(at, np.flatnonzero(np.diff(text[at])) + 1)
            tied = set(text[at[same]].tolist())
            at = np.concatenate([self._thinned(key, p) if int(text[p[0]]) in tied else p for p in parts])
        return text[at], at, key[at]

    @staticmethod
    def _thinned(key: np.ndarray, at: np.ndarray) -> np.ndarray:
        kept, k = [], at.tolist()
        for j, x in enumerate(k):
            if not kept or key[x] != key[kept[-1]] or j + 1 == len(k) or key[k[j + 1]] != key[x] or k[j + 1] - kept[-1] > STEPS:
                kept.append(x)
        return np.array(kept)

    def rest(self, at: np.ndarray) -> np.ndarray:
        """Further 64 bits of the runs that begin at words ``at``."""
        words = self.hash[at[:, None] + np.arange(WINDOW)]
        return finish((np.insert(words, 0, WINDOW, axis=1) * _REST).sum(axis=1, dtype=np.uint64))

    def spans(self, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of the runs that begin at words ``at`` of their texts."""
        start = self.place(self.first[at])
        return start - self.place(self.text[text]), self.place(self.last[at + WINDOW - 1]) - start


def word_hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64 bits of each word (bytes from ``first`` up to ``last``): a polynomial over random values of its bytes."""
    out, at = np.empty(len(first), np.uint64), 0
    while at < len(first):  # blocks of bytes, or one long word
        to = max(at + 1, int(np.searchsorted(last, first[at] + CHUNK_BYTES, "right")))
        begin, n = int(first[at]), int(last[to - 1] - first[at])
        power, inverse = _POWERS if n <= CHUNK_BYTES else _powers(n)
        total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[raw[begin : begin + n]] * power[:n])])
        head, tail = first[at:to] - begin, last[at:to] - begin
        out[at:to] = (total[tail] - total[head]) * inverse[head] + (tail - head).astype(np.uint64)
        at = to
    return finish(out)


def _spread(x: np.ndarray, n: int, join: Callable) -> np.ndarray:
    """``join`` over every ``n`` neighbours, by doubling."""
    size = 1
    while size < n:
        step = min(size, n - size)
        x, size = join(x[:-step], x[step:]), size + step
    return x


def line_sets(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all paragraphs (their words' hashes), one after the other, and where each begins."""
    runs = shingle_hashes(np.concatenate(words), SIZE)
    counts = np.array([len(w) for w in words])
    begins = np.cumsum(counts) - counts
    own = np.ones(len(runs), bool)
    own[begins[1:, None] + np.arange(1 - SIZE, 0)] = False  # runs that cross from one paragraph to the next
    return runs[own], np.cumsum(counts - SIZE + 1) - (counts - SIZE + 1)


def _numbered(text: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... within each text; ``text`` is in order."""
    return np.arange(len(text)) - np.searchsorted(text, text)


def _line_units(words: Words, minmax: MinMax) -> tuple[np.ndarray, ...]:
    """(text, idx, start, length, cls, rest, bands) of all paragraphs."""
    text, start, length, begins, ends = words.lines()
    own = [words.hash[b:e] for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
    keys = minmax.keys(minmax.values(*line_sets(own))) if own else np.empty((0, BANDS), np.int64)
    digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b"L" + w.tobytes()) for w in own), "<i8").reshape(-1, 2)
    return text, _numbered(text), start, length, digest[:, 0], digest[:, 1], keys


def _run_units(words: Words) -> tuple[np.ndarray, ...]:
    """(text, idx, start, length, cls, rest) of all selected runs."""
    text, at, key = words.runs()
    return text, FIRST_RUN + _numbered(text), *words.spans(text, at), key.view(np.int64), words.rest(at).view(np.int64)


def units(texts: DataFrame) -> DataFrame:
    """All paragraphs and selected runs of (doc_id, text_hash, text); band keys for paragraphs only."""
    small_batches(texts.sparkSession)
    names = ["doc_id", "text_hash", "idx", "start", "length", "cls", "rest", "bands"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minmax = MinMax(BANDS, ROWS)
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts, at = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()], 0
            while at < len(texts):
                to, size = at + 1, len(texts[at])
                while to < len(texts) and size + len(texts[to]) <= CHUNK_BYTES:
                    to, size = to + 1, size + len(texts[to])
                words = Words(texts[at:to])
                lines, runs = _line_units(words, minmax), _run_units(words)
                text, *cols = [np.concatenate(pair) for pair in zip(lines[:6], runs, strict=True)]
                cols = [ids[at:to][text], marks[at:to][text], *cols]
                ends = np.minimum(np.arange(len(text) + 1), len(lines[0])) * BANDS
                bare = np.append(np.arange(len(text)) >= len(lines[0]), False)
                bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=bare), pa.array(lines[6].ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], bands], names)
                at = to

    return texts.mapInArrow(run, UNITS)


def _spans(rows: DataFrame, *cols: str) -> DataFrame:
    """(doc_id, text_hash, spans): the spans of each text in order; as many as a text has at most."""
    return rows.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("spans"))


def _sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of wanted paragraphs (doc_id, text_hash, start, length, node)."""
    places = bounded(written(_spans(wanted, "start", "length", "node"), "wanted-spans"), WIDE_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes.shared()
        for batch in batches:
            nodes, sets = [], []
            for t, spans in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                text = t.as_py()
                for s in spans:
                    words = hashes.of_text(text[s["start"] : s["start"] + s["length"]])
                    nodes.append(s["node"])
                    sets.append(np.unique(shingle_hashes(words, SIZE)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.join(places, ["doc_id", "text_hash"]).select("text", "spans").mapInArrow(run, "node long, shingles array<long>")


def removals(texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_hash, spans) of what goes; spans: (start, length, group), group the component's class."""
    with scratch(texts.sparkSession) as kept:
        found = written(units(texts.where("doc_id IS NOT NULL")), "units")
        n = found.count()  # no table of what repeats or goes has more rows
        lines = _gone_lines(texts, found.where(F.col("idx") < FIRST_RUN), percent, n)
        runs = _gone_runs(found.where(F.col("idx") >= FIRST_RUN).drop("bands"), lines, n)
        both = lines.select("doc_id", "text_hash", "start", "length", "group").unionByName(_stretches(texts, runs))
        kept.append(written(few(_spans(both, "start", "length", "group"), n), "removals"))
    return kept[0]


def _repeated(rows: DataFrame) -> DataFrame:
    """(cls, rest, n) of all classes; numbers only, so that counting needs no sort."""
    return rows.groupBy("cls").agg(F.min("rest").alias("rest"), F.count("*").alias("n"))


def _others(rows: DataFrame, n: int) -> DataFrame:
    """Occurrences (cls, group, place) but the first of each group, with the place of that ``first``."""
    place = F.struct(*UNIT_PLACE)
    firsts = rows.groupBy("group").agg(F.min(place).alias("first"))
    return rows.join(bounded(written(few(firsts, n), "keepers"), 300_000), "group").where(place != F.col("first"))


def _gone_lines(texts: DataFrame, lines: DataFrame, percent: int, n: int) -> DataFrame:
    """Paragraphs that go: all but the first of each component of equal or linked ones."""

    def sets_of(candidates: DataFrame) -> DataFrame:
        at = lines.join(candidates, lines["cls"] == candidates["node"]).groupBy("node").agg(F.min(F.struct("rest", *UNIT_PLACE)).alias("at"))
        return _sets(texts, at.select("node", "at.doc_id", "at.text_hash", "at.start", "at.length"))

    comps = near_components(lines.select(F.col("cls").alias("node"), "bands"), sets_of, percent, repeated=True)
    chosen = _repeated(lines).join(comps.withColumnRenamed("node", "cls"), "cls", "left").where("n > 1 OR comp IS NOT NULL")
    chosen = bounded(written(few(chosen.select("cls", "rest", F.coalesce("comp", "cls").alias("group")), n), "line-classes"))
    rows = written(lines.drop("bands").join(chosen, ["cls", "rest"]).select("group", *UNIT_PLACE), "repeated-lines")
    return written(_others(rows, n), "gone-lines")


def _gone_runs(runs: DataFrame, lines: DataFrame, n: int) -> DataFrame:
    """Runs that go: all but the first of each class, of those that touch no paragraph that goes."""
    chosen = bounded(written(few(_repeated(runs).where("n > 1").select("cls", "rest"), n), "run-classes"))
    rows = written(runs.join(chosen, ["cls", "rest"]).select(F.col("cls").alias("group"), *UNIT_PLACE), "repeated-runs")
    spans = _spans(lines, "start", "length").withColumnRenamed("spans", "gone")
    rows = rows.join(bounded(written(few(spans, n), "gone-places"), WIDE_ROWS), ["doc_id", "text_hash"], "left")
    end = F.col("start") + F.col("length")
    touched = F.exists("gone", lambda g: (g["start"] < end) & (g["start"] + g["length"] > F.col("start")))
    rows = written(rows.where(~F.coalesce(touched, F.lit(False))).drop("gone"), "standing-runs")
    return written(_others(rows, n), "gone-runs")


def _stretches(texts: DataFrame, gone: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, length, group): what runs that go cover, extended while the copy that stays agrees."""
    columns = "doc_id long, text_hash long, start int, stop int, group long, before array<long>, before_at array<int>, behind array<long>, behind_at array<int>"
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.int64()), pa.list_(pa.int32())] * 2]
    none = np.empty(0, np.int64), np.empty(0, np.int32)

    def sides(words: Words, begin: np.ndarray, end: np.ndarray, edges: np.ndarray, b: int) -> tuple[np.ndarray, ...]:
        """Up to STEPS words before and behind a run, nearest first, and where they begin or end; a paragraph is not left."""
        e, key = b + WINDOW, words.hash.view(np.int64)
        low = max(edges[edges[:, 0] <= b, 0], default=0)
        high = min(edges[edges[:, 1] >= e, 1], default=len(begin))
        left, right = slice(max(low, b - STEPS), b), slice(e, min(high, e + STEPS))
        return key[left][::-1], begin[left][::-1].astype(np.int32), key[right], end[right].astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, h, t, spans, whole in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words, at = Words([t.encode()]), []
                begin, end = words.place(words.first), words.place(words.last)
                edges = np.stack(words.lines()[3:], axis=1)
                for s in spans:
                    if whole and at and s["start"] <= at[-1][-1]["start"] + at[-1][-1]["length"] + 1:
                        at[-1].append(s)
                    else:
                        at.append([s])
                for one in at:
                    start, stop = one[0]["start"], one[-1]["start"] + one[-1]["length"]
                    first = np.searchsorted(begin, [s["start"] for s in one])
                    if len(one) > 1:
                        out.append((i, h, start, stop, one[0]["group"], *none, *none))
                    for s, k in zip(one, first, strict=True):  # the runs at the edges: their kept copies may differ
                        if k - first[0] < STEPS or first[-1] - k < STEPS:
                            out.append((i, h, s["start"], s["start"] + s["length"], s["group"], *sides(words, begin, end, edges, k)))
            cols = list(zip(*out, strict=True)) or [()] * len(kinds)
            names = ["doc_id", "text_hash", "start", "stop", "group", "before", "before_at", "behind", "behind_at"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    def around(places: DataFrame, whole: bool, name: str) -> DataFrame:
        spans = bounded(written(_spans(places, "start", "length", "group"), f"{name}-spans"), WIDE_ROWS)
        rows = texts.join(spans, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "spans", F.lit(whole).alias("whole"))
        return written(rows.mapInArrow(run, columns), name)

    found = around(gone.select("doc_id", "text_hash", "start", "length", "group"), True, "stretches").dropDuplicates(["doc_id", "text_hash", "start", "stop"])
    ends = found.where("size(before) + size(behind) > 0").select("group").distinct()
    firsts = gone.groupBy("group").agg(F.first("first").alias("first")).join(ends, "group").select("group", "first.doc_id", "first.text_hash", "first.start", "first.length")
    kept = around(firsts, False, "kept-runs").select("group", F.col("before").alias("_before"), F.col("behind").alias("_behind")).dropDuplicates(["group"])
    found = found.join(bounded(written(kept, "kept-contexts"), WIDE_ROWS), "group", "left")
    for side, edge in (("before", "start"), ("behind", "stop")):  # as far as words agree one after the other
        same = F.zip_with(side, f"_{side}", lambda a, b: F.coalesce(a == b, F.lit(False)))
        apart = F.coalesce(F.array_position(same, False), F.lit(1))
        n = F.when(apart > 0, apart - 1).otherwise(F.size(side)).cast("int")
        found = found.withColumn(edge, F.when(n > 0, F.get(F.col(f"{side}_at"), n - 1)).otherwise(F.col(edge)))
    return found.select("doc_id", "text_hash", "start", (F.col("stop") - F.col("start")).alias("length"), "group")


UNIT_PLACE = ("doc_id", "text_hash", "idx", "start", "length")


def merged(spans: list[dict]) -> list[dict]:
    """The spans in order, those that overlap as one."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if out and s["start"] <= (last := out[-1])["start"] + last["length"]:
            last["length"] = max(last["length"], s["start"] + s["length"] - last["start"])
        else:
            out.append(dict(s))
    return out


def cut_spans(text: str, spans: list[dict]) -> str:
    """The text without the spans; a line that goes whole takes its line end along."""
    out, at = [], 0
    for s in merged(spans):
        start, stop = s["start"], s["start"] + s["length"]
        out.append(text[at:start])
        whole = (start == 0 or text[start - 1] == "\n") and (stop == len(text) or text[stop] == "\n")
        at = stop + 1 if whole and stop < len(text) else stop
    return "".join(out) + text[at:]


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_removed, removed_chars, spans, text): one row per input row, text without repeats.

    Null texts stay null, empty ones empty; rows with null id are left alone.  Passages repeated
    inside one document count as repeats too.  Repeated rows (same id and text) are one document and
    get the same spans.  Texts without repeats come back unchanged; a text that only repeats becomes
    empty.  Other columns are ignored.  An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    texts = texts.select("doc_id", "text_hash", "text")
    gone = bounded(removals(texts, percent), WIDE_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean, chars = [], []
            gone = [s and merged(s) for s in batch.column(2).to_pylist()]
            for t, spans in zip(batch.column(1), gone, strict=True):
                text = t.as_py()
                new = cut_spans(text, spans) if spans else text
                clean.append(new)
                chars.append(len(text or "") - len(new or ""))
            n = [len(s or ()) for s in gone]
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(chars, pa.int64()), pa.array(gone, batch.column(2).type), pa.array(clean, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_removed", "removed_chars", "spans", "text"])

    kind = "array<struct<start:int,length:int,group:bigint>>"
    joined = texts.join(gone, ["doc_id", "text_hash"], "left").select("doc_id", "text", "spans")
    small_batches(docs.sparkSession)
    return joined.mapInArrow(run, f"doc_id long, n_removed long, removed_chars long, spans {kind}, text string")


def rewrite_documents(docs: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """All rows and columns of ``docs`` (doc_id, text, ...), with repeats cut from the texts.

    Null, empty and repeated rows as in ``dedup_substrings``; other columns come along, whatever
    their names.  An empty table stays empty.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    names = [free_name(docs, f"cut_{c}") for c in ("id", "hash", "spans")]
    gone = bounded(removals(texts, percent), WIDE_ROWS).toDF(*names)
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.columns[:-1]
            spans = batch.column(batch.num_columns - 1)
            cols[at] = pa.array([cut_spans(t, s) if s else t for t, s in zip(cols[at].to_pylist(), spans.to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names[:-1])

    joined = docs.join(gone, (F.col("doc_id") == F.col(names[0])) & (F.xxhash64("text") == F.col(names[1])), "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], names[2]).mapInArrow(run, docs.schema)
