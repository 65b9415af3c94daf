"""Dense vectors as array columns: cosine, normalization, hash embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    both = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if the lengths differ or a norm is 0."""
    fits = (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(fits, dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def normalized(a: Column, digits: int = 8) -> Column:
    """Unit length, zero vectors unchanged."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, F.round(x / n, digits)).otherwise(x.cast("double")))


def _hex(digest: Column, start: Column | int, n: int) -> Column:
    return F.conv(F.substr(digest, F.lit(start) if isinstance(start, int) else start, F.lit(n)), 16, 10).cast("long")


def hash_embedding(rows: DataFrame, key: str, tokens: Column, dims: int, *, wide: bool) -> DataFrame:
    """(key, dim, value): signed hash counts of the tokens, scaled to unit length.

    ``wide``: sixteen buckets a token, from the 16-bit pairs of its SHA-256, plus if a pair's first byte
    is even.  Else one bucket, from its first four bytes, plus if the fifth byte is even.
    """
    words = rows.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias("c"))
    words = words.select(key, "c", F.sha2("token", 256).alias("h"))
    if wide:
        words = words.select(key, "c", "h", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"))
        bucket, mark = _hex(F.col("h"), F.col("i") * 4 + 1, 4), _hex(F.col("h"), F.col("i") * 4 + 1, 2)
    else:
        bucket, mark = _hex(F.col("h"), 1, 8), _hex(F.col("h"), 9, 2)
    sign = F.when(F.pmod(mark, F.lit(2)) == 0, F.col("c")).otherwise(-F.col("c"))
    sums = words.groupBy(key, F.pmod(bucket, F.lit(dims)).alias("dim")).agg(F.sum(sign).cast("double").alias("v"))
    # at most ``dims`` entries a key
    whole = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("dim", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    each = whole.select(key, "m", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(dims - 1).cast("long"))).alias("dim"))
    value = F.coalesce(F.element_at("m", F.col("dim")), F.lit(0.0))
    return each.select(key, "dim", F.round(F.when(F.col("n") > 0, value / F.col("n")).otherwise(value), 8).alias("value"))


def sparse_hash_embedding(rows: DataFrame, key: str, text: str, dims: int) -> DataFrame:
    """(key, dim, value): the entries other than 0 of the one-bucket hash embedding of a text's words.

    Words are split at spaces and line ends; a text without any counts as one word.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(F.regexp_replace(F.lower(t), "\n", " "), " "), lambda w: w != "")
    tokens = F.when(F.size(words) > 0, words).otherwise(F.array(t))
    each = rows.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias("c")).withColumn("h", F.sha2("token", 256))
    sign = F.when(F.pmod(_hex(F.col("h"), 9, 2), F.lit(2)) == 0, F.col("c")).otherwise(-F.col("c"))
    sums = each.groupBy(key, F.pmod(_hex(F.col("h"), 1, 8), F.lit(dims)).alias("dim")).agg(F.sum(sign).cast("double").alias("v")).where("v <> 0")
    norms = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    return sums.join(norms, key).select(key, "dim", F.round(F.col("v") / F.col("n"), 8).alias("value"))
