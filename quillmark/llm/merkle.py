"""Document fingerprints: a Merkle tree over sections and paragraphs.  DataFrame functions only.

A text is cut into paragraphs at line ends and after sentence ends, losing no character.  A leaf is
a paragraph's 64-bit hash.  A section ends after a paragraph whose hash is 0 modulo ``fanout`` (so an
edit moves no distant boundary); its node hashes its leaves, and the root hashes the sections.  The
fingerprint spells all three levels, ``root:section(leaf leaf),section(...)``: equal roots mean equal
texts, and where roots differ the differing branches say where the edit is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

FANOUT = 8
#: A paragraph ends after a line end, or after the white space that follows a sentence end.
CUT = r"(?<=\n)|(?<=[.!?] )"
#: Text bytes of a block of neighbouring ids, and fewest rows of one.
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 16
#: Quantiles that blocks start from, and most blocks (larger tables have larger blocks, which sort on disk).
CUTS, MOST_BLOCKS = 64, 200_000


def _hex(hash_: Column) -> Column:
    return F.lpad(F.lower(F.hex(hash_)), 16, "0")


def leaves(text: Column) -> Column:
    """Leaf hashes in order; an empty text has the one leaf of the empty paragraph."""
    hashes = F.transform(F.filter(F.split(text, CUT), lambda p: p != ""), lambda p: F.xxhash64(p))
    return F.when(text == "", F.array(F.xxhash64(F.lit("")))).otherwise(hashes)


def fingerprint(leaf: Column, text: Column, fanout: int = FANOUT) -> Column:
    """The tree's string.  The root covers the text's SHA-256 too, so equality is exact."""
    ends = lambda x: F.pmod(x, F.lit(fanout)) == 0
    spelled = F.transform(leaf, lambda x: F.concat(_hex(x), F.when(ends(x), F.lit("|")).otherwise(F.lit(" "))))
    sections = F.filter(F.split(F.array_join(spelled, ""), r"\|"), lambda s: s != "")
    nodes = F.transform(sections, lambda s: F.concat(_hex(F.xxhash64(s)), F.lit("("), F.rtrim(s), F.lit(")")))
    body = F.array_join(nodes, ",")
    root = F.sha2(F.encode(F.concat(F.sha2(F.encode(text, "UTF-8"), 256), body), "UTF-8"), 256)
    return F.concat(F.substring(root, 1, 32), F.lit(":"), body)


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of the two trees' distinct leaves: 1 for equal texts, 0 without a common paragraph."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))


def branches(fp: Column) -> Column:
    """Section nodes of a fingerprint, in order."""
    return F.split(F.substring_index(fp, ":", -1), ",")


def differing(a: Column, b: Column) -> Column:
    """Positions (from 0) of the sections of ``a`` that ``b`` does not have: where edits are."""
    mine = F.transform(branches(a), lambda s, k: F.struct(k.alias("k"), F.substring_index(s, "(", 1).alias("h")))
    theirs = F.transform(branches(b), lambda s: F.substring_index(s, "(", 1))
    return F.transform(F.filter(mine, lambda m: ~F.array_contains(theirs, m["h"])), lambda m: m["k"])


def with_next(rows: DataFrame, key: list[str], text: str, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add ``next_text``: the text of the next row in descending key order, after the last the first.

    Rows fall into blocks of neighbouring keys; a window orders each block, and every block also gets
    the first row of the block below, so texts are shuffled once and no task orders the whole table.
    ``key`` is a bigint and a hash; null keys come last.
    """
    first = key[0]
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    if not n:
        return rows.withColumn("next_text", F.lit(None).cast("string"))
    shuffle = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = int(max(1, min(n // BLOCK_ROWS, max(4 * shuffle, (size or 0) // block_bytes), MOST_BLOCKS)))
    cuts = rows.agg(F.percentile_approx(first, [k / CUTS for k in range(CUTS + 1)], 20 * CUTS)).first()[0] if blocks > 1 else []
    placed = rows.withColumn("_block", F.coalesce(_block(F.col(first), sorted(set(cuts or [])), -(-blocks // CUTS)), F.lit(-1)))
    tops = common.written(placed.groupBy("_block").agg(F.max(F.struct(*key)).alias("_top")), "block-tops")
    # one row a block, MOST_BLOCKS at most: each top row goes to the block above, the highest one's to the lowest
    up = F.coalesce(F.lead("_block").over(Window.orderBy("_block")), F.min("_block").over(Window.partitionBy()))
    ends = tops.select(up.alias("_block"), *[F.col("_top")[k].alias(f"_top{j}") for j, k in enumerate(key)])
    same = [F.col(k).eqNullSafe(F.col(f"_top{j}")) for j, k in enumerate(key)]
    ends = rows.join(F.broadcast(ends), same[0] & same[1]).dropDuplicates(["_block"]).drop(*[f"_top{j}" for j in range(len(key))])
    both = placed.withColumn("_end", F.lit(False)).unionByName(ends.withColumn("_end", F.lit(True)))
    w = Window.partitionBy("_block").orderBy(F.col("_end").asc(), *[F.col(k).desc_nulls_last() for k in key])
    return both.withColumn("next_text", F.lead(text).over(w)).where(~F.col("_end")).drop("_end", "_block")


def _block(value: Column, cuts: list[int], parts: int) -> Column:
    """A number that grows with the value: its interval between quantiles, cut into equal parts."""
    if len(cuts) < 2:
        return F.when(value.isNotNull(), F.lit(0))
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
    at = F.least(F.greatest(F.size(F.filter(bounds, lambda b: b <= value)), F.lit(1)), F.lit(len(cuts) - 1))
    low, high = F.element_at(bounds, at), F.element_at(bounds, at + 1)
    inside = F.floor((value - low).cast("double") / (high - low).cast("double") * parts)
    inside = F.greatest(F.lit(0), F.least(F.lit(parts - 1), inside))
    return F.when(value.isNotNull(), (at * parts + inside).cast("int"))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fanout: int = FANOUT) -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likeness.

    The edited text has its last third replaced by as many first characters of the next document,
    in descending id order (after the last: the first).  Null text counts as empty; a single row is
    its own next.  Equal ids follow each other by text hash, repeated rows are each other's next.
    Null ids come last.  Other columns are ignored.  An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_text")).withColumn("_h", F.xxhash64("_text"))
    both = with_next(rows, ["doc_id", "_h"], "_text")
    n = F.length("_text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    both = both.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        "_text",
        edited.alias("_edited"),
        leaves(F.col("_text")).alias("_a"),
        leaves(edited).alias("_b"),
        leaves(F.col("next_text")).alias("_c"),
    )
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("_edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint(F.col("_a"), F.col("_text"), fanout).alias("fingerprint"),
        fingerprint(F.col("_b"), F.col("_edited"), fanout).alias("edited_fingerprint"),
        likeness(F.col("_a"), F.col("_b")).alias("near_edited"),
        likeness(F.col("_a"), F.col("_c")).alias("near_next"),
    )
