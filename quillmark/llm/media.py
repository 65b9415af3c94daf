"""Interleaved documents: ordered text and media references from HTML, payloads by digest.

A page's HTML gives a sequence of items in reading order, each a text run or a media reference
with its position and caption.  Payloads are stored once per writing task as lossless 8-bit
grayscale images (binary PGM, 64 samples a row) under the SHA-256 of their bytes.  References meet
payloads by digest alone, so only digests and features are shuffled, never payloads.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ROW = 64
ITEM = "pos:int,kind:string,text:string,digest:string,caption:string"
FEATURES = (
    "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)
_BLOCKS = {"p", "div", "article", "section", "li", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "td", "ul", "ol", "table", "blockquote"}
_SKIP = {"script", "style", "nav", "noscript", "title"}
_DIGEST = re.compile("sha256:([0-9a-f]{64})")
_SPACE = re.compile(r"\s+")
_HEADER = re.compile(rb"P5\n(\d+) (\d+)\n255\n")


class Interleaver(HTMLParser):
    """Items of one page.  Tolerates unclosed and stray tags; an image's caption is its figcaption, else its alt text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.skip = 0
        self.figure: list[int] | None = None
        self.caption: list[str] | None = None

    def _item(self, kind, text=None, digest=None, caption=None) -> None:
        self.items.append({"pos": len(self.items), "kind": kind, "text": text, "digest": digest, "caption": caption})

    def _end_run(self) -> None:
        text = _SPACE.sub(" ", "".join(self.run)).strip()
        self.run = []
        if text:
            self._item("text", text=text)

    def _end_caption(self) -> None:
        if self.caption is not None:
            text = _SPACE.sub(" ", "".join(self.caption)).strip()
            for k in self.figure or ():
                self.items[k]["caption"] = text
            self.caption = None

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
        elif tag == "figure":
            self._end_run()
            self.figure = []
        elif tag == "figcaption":
            self._end_run()
            self.caption = []
        elif tag in {"img", "audio", "video", "source"}:
            self._end_run()
            given = dict(attrs)
            found = _DIGEST.search(given.get("src") or "")
            self._item("media", digest=found and found[1], caption=given.get("alt"))
            if self.figure is not None:
                self.figure.append(len(self.items) - 1)
        elif tag in _BLOCKS and self.caption is None:
            self._end_run()

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption":
            self._end_caption()
        elif tag == "figure":
            self._end_caption()
            self._end_run()
            self.figure = None
        elif tag in _BLOCKS and self.caption is None:
            self._end_run()

    def handle_data(self, data):
        if not self.skip:
            (self.run if self.caption is None else self.caption).append(data)

    def parsed(self, html: str | None) -> list[dict]:
        self.feed(html or "")
        self.close()
        self._end_caption()
        self._end_run()
        return self.items


def parse_pages(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id_col`` and ``items``, an array of (pos, kind, text, digest, caption) in reading order.

    Null or empty HTML: no items.  References without a ``sha256:`` source keep a null digest.
    """
    common.small_batches(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    arrow = pa.list_(
        pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [Interleaver().parsed(h.as_py()) for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, arrow)], [id_col, "items"])

    source = pages.select(F.col(id_col), F.col(html_col).alias("_html"))
    return source.mapInArrow(run, f"`{id_col}` {kind}, items array<struct<{ITEM}>>")


def padded(payload: Column) -> Column:
    """The payload with zero bytes up to a positive multiple of 64."""
    n = F.octet_length(payload)
    fill = F.when(n == 0, F.lit(ROW)).otherwise(F.pmod(-n, F.lit(ROW)))
    return F.concat(payload, F.substring(F.lit(bytes(ROW)), F.lit(1), fill))


def as_image(payload: Column) -> Column:
    """A binary PGM of the padded payload; the samples are its bytes, unchanged."""
    head = F.concat(F.lit(f"P5\n{ROW} "), (F.octet_length(payload) / ROW).cast("long").cast("string"), F.lit("\n255\n"))
    return F.concat(F.encode(head, "US-ASCII"), payload)


def store_payloads(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Write (digest, media) to the shared folder and return the written table.

    Payloads are content-addressed: one that stands in several rows is stored by each under the same
    digest, which spares a shuffle of all payloads; readers take any one of them.  Null counts as
    empty, other columns are ignored, an empty table stores nothing.
    """
    whole = F.coalesce(F.col(payload_col), F.lit(b""))
    rows = payloads.select(padded(whole).alias("payload"))
    return common.written(rows.select(F.sha2("payload", 256).alias("digest"), as_image(F.col("payload")).alias("media")), "media")


def image_features(samples: np.ndarray) -> str:
    """Mean, spread, an 8-bin histogram and a 64-bit average hash of 8 x 8 areas."""
    mean, bins = samples.mean(), np.bincount(samples.ravel() >> 5, minlength=8)
    rows = np.linspace(0, len(samples), 9).astype(int)
    areas = np.array(
        [samples[a : max(b, a + 1)].reshape(-1, 8, ROW // 8).mean(axis=(0, 2)) for a, b in zip(np.minimum(rows[:-1], len(samples) - 1), rows[1:], strict=True)]
    )
    bits = int("".join("1" if x else "0" for x in (areas > areas.mean()).ravel()), 2)
    return f"m{mean:.4f};s{samples.std():.4f};h{'.'.join(map(str, bins))};a{bits:016x}"


def read_features(store: DataFrame) -> DataFrame:
    """Read the stored images back and describe each distinct payload once, keyed by its digest."""
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for digest, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = media.as_py()
                head = _HEADER.match(raw)
                width, height = int(head[1]), int(head[2])
                payload = memoryview(raw)[head.end() :]
                if len(payload) != width * height:
                    raise ValueError(f"media {digest} is cut short")
                samples = np.frombuffer(payload, np.uint8).reshape(height, width)
                out.append(
                    (
                        digest,
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-ROW:]),
                        len(raw),
                        hashlib.sha256(raw).hexdigest(),
                        image_features(samples),
                    )
                )
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    common.small_batches(store.sparkSession)
    each = store.select("digest", "media").mapInArrow(run, FEATURES)
    return each.groupBy("digest").agg(*[F.max(n).alias(n) for n in names[1:]])


def references(sequences: DataFrame, *, id_col: str) -> DataFrame:
    """Media references of the sequences: id, position, caption, digest."""
    media = F.filter("items", lambda x: x["kind"] == "media")
    each = sequences.select(F.col(id_col), F.explode(media).alias("m"))
    return each.select(id_col, F.col("m.pos").alias("pos"), F.col("m.caption").alias("caption"), F.col("m.digest").alias("digest"))


def resolve(refs: DataFrame, features: DataFrame) -> DataFrame:
    """References with what their payloads' digests resolve to; unknown digests keep nulls.

    The features are a written table, so that both sides are plain shuffles and a digest that a
    third of all references share is split by the adaptive skew join.
    """
    return refs.join(common.written(features, "media-features"), "digest", "left")


def documents_as_pages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a page: its first line, its payload's reference with a caption, its other lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    escaped = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    first = F.substring_index(escaped, "\n", 1)
    rest = F.expr("substring(_e, length(_f) + 2)")
    payload = F.encode(text, "UTF-8")
    return (
        docs.select(F.col(id_col), escaped.alias("_e"), first.alias("_f"), payload.alias("_p"))
        .withColumn("_d", F.sha2(padded(F.col("_p")), 256))
        .select(
            id_col,
            F.octet_length("_p").cast("long").alias("n_bytes"),
            F.concat(
                F.lit("<article><p>"),
                F.col("_f"),
                F.lit('</p><figure><img src="sha256:'),
                F.col("_d"),
                F.lit('"><figcaption>payload of '),
                F.octet_length("_p").cast("string"),
                F.lit(" bytes</figcaption></figure><p>"),
                F.replace(rest, F.lit("\n"), F.lit("</p><p>")),
                F.lit("</p></article>"),
            ).alias("html"),
        )
    )
