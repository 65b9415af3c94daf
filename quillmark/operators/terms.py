"""Corpus vocabularies: TF-IDF rows over the commonest terms, and a term dictionary learned from the texts and matched with spans.

Texts are never multiplied by terms: a vocabulary is counted with partial sums, cut by a distributed
top-n, and joined by key.  Matching is an equi-join of the texts' word sequences with the dictionary's,
so the dictionary may grow with the corpus; only what starts with a dictionary's first word is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.session import settled

# Stop words of the salience tokenizer.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "has", "have", "he", "her", "him", "his",
    "i", "in", "is", "it", "my", "of", "on", "or", "our", "she", "that", "the", "their", "them", "they", "this", "to",
    "was", "we", "were", "with", "you", "your",
)
CHINESE_STOPWORDS = (
    "了", "的", "地", "得", "和", "与", "或", "是", "在", "我", "我们", "你", "你们", "他", "她", "它", "他们", "她们", "这", "这个",
    "那", "那个", "一个", "一家", "正在",
)
#: Words of the longest dictionary term.
MOST_WORDS = 4


def content_tokens(text: Column) -> Column:
    """Latin words, then CJK runs, normalized; those that carry content (salience tokenizer)."""
    latin = F.transform(T.found(text, r"[A-Za-z][A-Za-z'\-]*"), lambda w: F.lower(F.btrim(w, F.lit("'_-"))))
    cjk = T.found(text, r"[\x{4e00}-\x{9fff}]+")
    return F.concat(
        F.filter(latin, lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS)),
        F.filter(cjk, lambda w: (F.length(w) >= 2) & ~w.isin(*CHINESE_STOPWORDS)),
    )


def with_bigrams(tokens: Column) -> Column:
    """Tokens, then pairs of neighbours."""
    pairs = F.zip_with(tokens, F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(tokens, F.filter(pairs, lambda p: p.isNotNull()))


def tfidf(rows: DataFrame, key: str, text: str = "text", *, max_features: int = 2000, top: int = 8) -> DataFrame:
    """(key, n_terms, max_tfidf, sum_tfidf, score, top_terms) over the ``max_features`` commonest uni- and bigrams.

    Weights are count * (ln((1 + rows) / (1 + df)) + 1), rows have length 1.  Equal counts keep the
    smaller term, equal weights rank by term.  Rows without a term of the vocabulary have zeros.
    Keys are unique; null texts are empty.
    """
    tokens = settled(rows.select(key, content_tokens(F.col(text)).alias("_t")))  # texts are split once
    split = tokens.select(key, with_bigrams(F.col("_t")).alias("_terms"))
    counted = split.select(F.explode("_terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    chosen = settled(counted.orderBy(F.col("n").desc(), "term").limit(max_features).select("term"))
    hits = split.select(key, F.explode("_terms").alias("term")).join(F.broadcast(chosen), "term")  # max_features rows
    tf = settled(hits.groupBy(key, "term").agg(F.count("*").alias("tf")))
    total = tokens.count()
    idf = tf.groupBy("term").agg((F.log((1.0 + total) / (1.0 + F.count("*"))) + 1.0).alias("idf"))
    weighed = tf.join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("w"), "term"))), 1, top)  # at most max_features terms a row
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")))
    each = weighed.groupBy(key).agg(F.count("*").alias("n_terms"), (F.max("w") / norm).alias("m"), (F.sum("w") / norm).alias("s"), F.array_join(F.transform(best, lambda x: x["term"]), ",").alias("top_terms"))
    out = tokens.select(key).join(each, key, "left").fillna(0, ["n_terms"]).fillna(0.0, ["m", "s"]).fillna("", ["top_terms"])
    half = 1e-9  # so that engines that round a half differently agree
    score = F.round(F.least(F.lit(10.0), F.col("s") / 3.0 * 10.0) + half, 3)
    return out.select(key, "n_terms", F.round(F.col("m") + half, 4).alias("max_tfidf"), F.round(F.col("s") + half, 4).alias("sum_tfidf"), score.alias("score"), "top_terms")


def learned_terms(rows: DataFrame, text: str = "text", names: tuple[str, ...] = ("speaker",), name_lists: tuple[str, ...] = ()) -> DataFrame:
    """The dictionary of a corpus: (term, n, confidence, weight, names).

    Names that metadata give count 3 a row and are sure; phrases of one to four capitalized words count
    1 each and need two.  Terms that differ in case stay apart, as they stand in the texts.
    """
    given = [F.when(F.trim(F.col(c)) != "", F.trim(F.col(c))) for c in names]
    lists = [F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(x) != "") for c in name_lists]
    sure = F.concat(F.filter(F.array(*given), lambda x: x.isNotNull()), *[F.transform(x, lambda y: F.trim(y)) for x in lists])
    phrases = T.found(F.col(text), r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}\b")
    phrases = F.filter(phrases, lambda p: ~F.lower(p).isin(*STOPWORDS))
    item = lambda x, n, s: F.transform(x, lambda t: F.struct(t.alias("term"), F.lit(n).alias("n"), F.lit(s).alias("sure")))
    each = rows.select(F.explode(F.concat(item(sure, 3, 1), item(phrases, 1, 0))).alias("x"))
    counted = each.groupBy("x.term").agg(F.sum("x.n").alias("n"), F.max("x.sure").alias("sure"))
    kept = counted.where((F.length("term") >= 2) & ((F.col("sure") == 1) | (F.col("n") >= 2)))
    return kept.select("term", "n", F.when(F.col("sure") == 1, "high").otherwise("medium").alias("confidence"), F.when(F.col("sure") == 1, 4).otherwise(3).alias("weight"))


_WORD = regex.compile(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]")


def word_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, start, end, first, key) of all sequences of up to MOST_WORDS words of (id, text).

    A word is a run of ASCII word characters, or any other single character; a key is the lower-case
    words with a space wherever white space stands between them.
    """
    for batch in batches:
        ids, starts, ends, firsts, keys = [], [], [], [], []
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            places = [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(text)]
            for k, (start, _, first) in enumerate(places):
                key, last = "", start
                for begin, end, word in places[k : k + MOST_WORDS]:
                    key += (" " if begin > last and key else "") + word
                    last = end
                    ids.append(row), starts.append(start), ends.append(end), firsts.append(first), keys.append(key)
                if len(keys) >= 200_000:
                    yield _places(ids, starts, ends, firsts, keys)
                    ids, starts, ends, firsts, keys = [], [], [], [], []
        yield _places(ids, starts, ends, firsts, keys)


def _places(*columns: list) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "start", "end", "first", "key"])


def term_spans(rows: DataFrame, terms: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(id, term, start, end) of every place where a term stands with no word character beside it, in any case.

    White space inside a term fits any white space.  Places may overlap across terms; a term's own
    places do not overlap as its words are whole.  Terms of more than MOST_WORDS words or without a
    word do not match.  Ids are texts; null texts have no places.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for term in batch.column(0).to_pylist():
                words = [m for m in _WORD.finditer(term.strip())]
                key = "".join((" " if k and m.start() > words[k - 1].end() else "") + m[0].lower() for k, m in enumerate(words))
                if 0 < len(words) <= MOST_WORDS:
                    out.append((term, words[0][0].lower(), key))
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["term", "first", "key"])

    wanted = settled(terms.select("term").distinct().mapInArrow(keyed, "term string, first string, key string"))
    firsts = wanted.select("first").distinct()
    texts = rows.where(F.col(text).isNotNull()).select(F.col(id_col).cast("string"), F.col(text))
    places = texts.mapInArrow(word_places, "id string, start long, end long, first string, key string")
    return places.join(firsts, "first", "left_semi").join(wanted.drop("first"), "key").select("id", "term", "start", "end")


def term_salience(rows: DataFrame, terms: DataFrame, id_col: str, text: str = "text", *, top: int = 5) -> DataFrame:
    """(id, n_hits, n_terms, weight, top_terms): a text's dictionary hits, the ``top`` by (hits x weight, term)."""
    spans = term_spans(rows, terms, id_col, text)
    each = spans.groupBy("id", "term").agg(F.count("*").alias("n")).join(terms.select("term", "weight"), "term")
    rank = Window.partitionBy("id").orderBy((F.col("n") * F.col("weight")).desc(), "term")
    ranked = each.withColumn("r", F.row_number().over(rank))
    best = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("r") <= top, F.struct("r", "term")))), lambda x: x["term"]), ",")
    return ranked.groupBy("id").agg(F.sum("n").alias("n_hits"), F.count("*").alias("n_terms"), F.sum(F.col("n") * F.col("weight")).alias("weight"), best.alias("top_terms"))
