"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

A model of character n-grams (order 6, so that it knows words) is trained per language on every document labelled as good: counts,
continuation counts, discounts and interpolation weights are grouped and joined as tables keyed by
n-gram.  The finished table is written in shards by key.  A batch of documents meets it by a merge
join: its distinct n-grams, of all orders, are looked up shard by shard, so a task holds one batch
and a bounded number of shards, and neither texts nor n-gram occurrences are shuffled.  A document
goes if its perplexity is beyond a fence set by quantiles of its own language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, free_name, new_path, scratch, small_batches, worker_state, written
from .near import finish

ORDER, BITS = 6, 10
#: Rows of one shard of the model, and shards that a worker keeps in memory.
SHARD_ROWS, KEPT_SHARDS = 1 << 19, 6
#: The fence: median + SPREAD * (median - lower quantile) of log perplexity, within a language.  A text of n
#: n-grams gets SLACK / sqrt(n) more, as its mean varies that much more.
LOWER, SPREAD, SLACK = 0.25, 3.0, 1.5
START, STOP, PLAIN = 2, 3, 900
#: Distinct n-grams that a counting task gathers, and bytes of text that meet the shards together.
GATHER, BLOCK_BYTES = 1 << 21, 4 << 20


def points(text: str) -> np.ndarray:
    """Classes of code points with start and stop marks: each of the first 900 is its own, the others share 124."""
    body = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    if len(body) and body.max() >= PLAIN:
        body = np.where(body < PLAIN, body, PLAIN + body % ((1 << BITS) - PLAIN))
    return np.concatenate([np.full(ORDER - 1, START), body, [STOP]]).astype(np.uint64)


def grams_of(context: str, last: str) -> int:
    """The n-gram of the last symbols of ``context`` and ``last``."""
    p = points(context)[ORDER - 1 : -1].tolist()
    p = ([START] * ORDER + p)[1 - ORDER :] + [int(points(last)[ORDER - 1])]
    return sum(x << BITS * (ORDER - 1 - k) for k, x in enumerate(p))


def grams(text: str) -> np.ndarray:
    """The text's n-grams of highest order, one per character and one for the stop mark."""
    p = points(text)
    n = len(p) - ORDER + 1
    code = np.zeros(n, np.uint64)
    for k in range(ORDER):
        code = code << np.uint64(BITS) | p[k : k + n]
    return code


def table_key(code: np.ndarray, lang: str, kind: int) -> np.ndarray:
    """64-bit key of an n-gram (kind: its order) or a context (kind: order it precedes, plus 8) of a language."""
    import xxhash

    salt = np.uint64(xxhash.xxh3_64_intdigest(f"{kind}:{lang}".encode()))
    return finish(code * np.uint64(0x9E3779B97F4A7C15) + salt)


def count_grams(texts: DataFrame) -> DataFrame:
    """(lang, gram, n) over all texts (lang, text); partial counts are merged in the workers first."""

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            code, n = _merge(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for lang, rows in _by_lang(batch.column(0)).items():
                text = batch.column(1)
                code, n = np.unique(np.concatenate([grams(text[k].as_py() or "") for k in rows]), return_counts=True)
                held.setdefault(lang, []).append((code, n))
                if len(held[lang]) > 8:
                    held[lang] = [_merge(held[lang])]
            if sum(len(p[0]) for ps in held.values() for p in ps) > GATHER:
                yield from flush(held)
        yield from flush(held)

    each = texts.mapInArrow(run, "lang string, gram long, n long")
    return each.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return code, np.bincount(at, np.concatenate([n for _, n in parts]).astype(float), len(code)).astype(np.int64)


def _by_lang(column: pa.Array) -> dict[str, list[int]]:
    found: dict[str, list[int]] = {}
    for k, lang in enumerate(column.to_pylist()):
        found.setdefault(lang or "", []).append(k)
    return found


def _context(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, BITS)


def _suffix(gram: Column, order: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, kind, code, value): log probabilities of n-grams (kind: order) and log weights of contexts (order + 8)."""
    levels = {ORDER: written(counts, "grams")}
    for order in range(ORDER - 1, 0, -1):  # how many symbols an n-gram follows
        above = levels[order + 1]
        levels[order] = written(above.groupBy("lang", _suffix(F.col("gram"), order + 1).alias("gram")).agg(F.count("*").alias("n")), "grams")
    out, lower = [], None
    for order in range(1, ORDER + 1):
        level = levels[order].withColumn("context", _context(F.col("gram")) if order > 1 else F.lit(0).cast("long"))
        of = lambda k: F.sum(F.when(F.col("n") == k, 1).otherwise(0))
        tally = level.groupBy("lang").agg(*[of(k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)], F.count("*").alias("kinds"))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        cut = lambda k: F.when((F.col(f"n{k}") > 0) & (F.col(f"n{k + 1}") > 0), F.greatest(F.lit(0.05), F.lit(k) - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"))).otherwise(0.5 * k)
        cuts = bounded(written(tally.select("lang", "kinds", *[cut(k).alias(f"d{k}") for k in (1, 2, 3)]), "discounts"))  # one row a language
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        contexts = level.join(cuts, "lang").groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum(d).alias("held"), F.max("kinds").alias("kinds"))
        contexts = written(contexts.withColumn("back", F.col("held") / F.col("total")), "contexts")
        joined = level.join(cuts.drop("kinds"), "lang").join(contexts, ["lang", "context"])
        own = F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("total")
        if order == 1:
            level = joined.select("lang", "gram", (own + F.col("back") / (F.col("kinds") + 1)).alias("p"))
            out.append(contexts.select("lang", F.lit(8).alias("kind"), F.lit(0).cast("long").alias("code"), F.log(F.col("back") / (F.col("kinds") + 1)).alias("value")))
        else:
            below = lower.select("lang", F.col("gram").alias("rest"), F.col("p").alias("q"))
            level = joined.withColumn("rest", _suffix(F.col("gram"), order)).join(below, ["lang", "rest"], "left")
            level = level.select("lang", "gram", (own + F.col("back") * F.coalesce("q", F.lit(1e-9))).alias("p"))
            out.append(contexts.select("lang", F.lit(order + 8).alias("kind"), F.col("context").alias("code"), F.log("back").alias("value")))
        lower = written(level, "probabilities")
        out.append(lower.select("lang", F.lit(order).alias("kind"), F.col("gram").alias("code"), F.log("p").alias("value")))
    both = out[0]
    for part in out[1:]:
        both = both.unionByName(part)
    return written(both, "model")


def sharded(model: DataFrame) -> tuple[str, int]:
    """Write the model in shards by key; returns their folder and number."""
    shards = max(1, -(-model.count() // SHARD_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, kind = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
            code, key = batch.column(2).to_numpy().astype(np.uint64), np.zeros(len(batch), np.uint64)
            for one, k in {*zip(lang, kind, strict=True)}:
                at = (lang == one) & (kind == k)
                key[at] = table_key(code[at], one, int(k))
            shard = (key % np.uint64(shards)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(key.astype(np.int64)), batch.column(3)], ["shard", "key", "value"])

    path = new_path(model.sparkSession, "model-shards")
    keyed = model.mapInArrow(run, "shard int, key long, value double")
    keyed.repartition(shards, "shard").sortWithinPartitions("shard", "key").write.partitionBy("shard").parquet(path)
    return path, shards


class Shards:
    """A worker's view of the model: a bounded number of shards as sorted arrays."""

    def __init__(self, path: str, n: int):
        self.path, self.n, self.kept = path, n, {}

    @classmethod
    def of(cls, path: str, n: int) -> Shards:
        return worker_state(("model-shards", path), lambda: cls(path, n))

    def _load(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k in self.kept:
            self.kept[k] = self.kept.pop(k)  # used last
        else:
            import pyarrow.dataset as ds

            from .files import open_fs

            fs, path = open_fs(f"{self.path}/shard={k}")
            if fs.get_file_info(path).type.name == "NotFound":
                found = np.empty(0, np.int64), np.empty(0)
            else:
                rows = ds.dataset(path, filesystem=fs, format="parquet").to_table(columns=["key", "value"])
                key, value = rows["key"].to_numpy(), rows["value"].to_numpy()
                if (key[1:] < key[:-1]).any():  # several files
                    order = np.argsort(key)
                    key, value = key[order], value[order]
                found = key, value
            if len(self.kept) >= KEPT_SHARDS:
                self.kept.pop(next(iter(self.kept)))
            self.kept[k] = found
        return self.kept[k]

    def join(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, NaN where the model has none; every shard that they need is read once."""
        out = np.full(len(keys), np.nan)
        shard = (keys % np.uint64(self.n)).astype(np.int32)
        keys = keys.view(np.int64)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(self.n + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            at = order[edges[k] : edges[k + 1]]
            key, value = self._load(k)
            if len(key):
                place = np.minimum(np.searchsorted(key, keys[at]), len(key) - 1)
                out[at] = np.where(key[place] == keys[at], value[place], np.nan)
        return out

    def log_probability(self, code: np.ndarray, lang: str) -> np.ndarray | None:
        """Of distinct n-grams of highest order, backing off where unseen; None for a language without a model.

        The n-grams' shorter endings are taken once each, and all that is asked of the model at once.
        """
        import pandas as pd

        tails, places = [code], []
        for order in range(ORDER - 1, 0, -1):
            place, tail = pd.factorize(tails[-1] & np.uint64((1 << BITS * order) - 1))
            places.append(place)
            tails.append(tail)
        keys = [table_key(np.zeros(1, np.uint64), lang, 8)]
        for order, tail in zip(range(ORDER, 0, -1), tails, strict=True):
            keys.append(table_key(tail, lang, order))
            keys.append(table_key(tail >> np.uint64(BITS), lang, order + 8) if order > 1 else keys[0])
        values = np.split(self.join(np.concatenate(keys)), np.cumsum([len(k) for k in keys])[:-1])
        floor = values[0][0]
        if np.isnan(floor):
            return None
        below = np.full(len(tails[-1]), floor)
        for k in range(ORDER - 1, -1, -1):  # from single symbols up
            own, back = values[1 + 2 * k], values[2 + 2 * k]
            if k < ORDER - 1:
                below = np.nan_to_num(back) + below[places[k]]
            below = np.where(np.isnan(own), below, own)
        return below


def perplexities(docs: DataFrame, path: str, n: int) -> DataFrame:
    """(doc_id, lang, n_grams, log_perplexity) of all rows; null for empty texts and languages without trusted text."""
    small_batches(docs.sparkSession)

    def score(batch: pa.RecordBatch, shards: Shards) -> pa.RecordBatch:
        import pandas as pd

        size, value = np.zeros(len(batch), np.int64), np.full(len(batch), np.nan)
        for lang, rows in _by_lang(batch.column(1)).items():
            each = [grams(t) if (t := batch.column(2)[k].as_py()) else np.empty(0, np.uint64) for k in rows]
            counts = np.array([len(g) for g in each])
            if not counts.sum():
                continue
            place, distinct = pd.factorize(np.concatenate(each))
            del each
            logs = shards.log_probability(distinct, lang)
            rows = np.array(rows)[counts > 0]
            counts = counts[counts > 0]
            size[rows] = counts
            if logs is not None:
                value[rows] = -np.add.reduceat(logs[place], np.cumsum(counts) - counts) / counts
        cols = [batch.column(0), batch.column(1), pa.array(size), pa.array(value, mask=np.isnan(value))]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "lang", "n_grams", "log_perplexity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, held, size = Shards.of(path, n), [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BLOCK_BYTES:
                yield score(pa.concat_batches(held), shards)
                held, size = [], 0
        if held:
            yield score(pa.concat_batches(held), shards)

    texts = docs.select("doc_id", "lang", "text")
    return texts.mapInArrow(run, "doc_id long, lang string, n_grams long, log_perplexity double")


def fences(scored: DataFrame, lower: float = LOWER, spread: float = SPREAD) -> DataFrame:
    """(_lang, fence): one row a language, null being a language too."""
    q = F.percentile_approx("log_perplexity", [lower, 0.5], 5000)
    stats = scored.groupBy(F.col("lang").alias("_lang")).agg(q.alias("q"))
    return stats.select("_lang", (F.col("q")[1] + spread * (F.col("q")[1] - F.col("q")[0])).alias("fence"))


def judge_quality(docs: DataFrame, labels: DataFrame, *, lower: float = LOWER, spread: float = SPREAD, slack: float = SLACK) -> DataFrame:
    """(doc_id, lang, n_grams, perplexity, fence, kept): one row per input row.

    ``labels`` (doc_id, quality): documents with quality 1 are trusted, all of them train the model.
    Null and empty texts have no perplexity and are kept, as are languages without trusted text; null
    is a language of its own.  Rows with null ids are scored like others and never trusted.  Repeated
    rows are scored each.  Other columns are ignored.  An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    with scratch(docs.sparkSession) as kept:
        kept.append(written(_judged(texts, labels, lower, spread, slack), "quality"))
    return kept[0]


def _judged(texts: DataFrame, labels: DataFrame, lower: float, spread: float, slack: float) -> DataFrame:
    trusted = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    trusted = bounded(written(trusted, "trusted"))
    counts = count_grams(texts.where("text <> ''").join(trusted, "doc_id", "left_semi").select(F.coalesce("lang", F.lit("")).alias("lang"), "text"))
    scored = written(perplexities(texts, *sharded(kneser_ney(counts))), "perplexities")
    joined = scored.join(bounded(written(fences(scored, lower, spread), "fences")), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    limit = F.col("fence") + F.when(F.col("n_grams") > 0, slack / F.sqrt("n_grams"))
    return joined.select(
        "doc_id",
        "lang",
        "n_grams",
        F.exp("log_perplexity").alias("perplexity"),
        F.exp(limit).alias("fence"),
        F.coalesce(F.col("log_perplexity") <= limit, F.lit(True)).alias("kept"),
    )


def filter_documents(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents that are kept, with all their columns; an id goes if its row's text is rejected.

    Of rows that share an id, all go if one is rejected.
    """
    name = free_name(docs, "gone")
    gone = written(judge_quality(docs, labels, **how).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(name)).distinct(), "rejected")
    return docs.join(bounded(gone), F.col("doc_id") == F.col(name), "left_anti")
