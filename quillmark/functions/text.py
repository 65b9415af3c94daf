"""Tokenizers, keys and text measures.  All are built-in expressions, so they stay in generated code.

The tokenizers differ on purpose: each scoring path has its own, and mixing them changes scores.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the graph query tokenizer.
GRAPH_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "for", "from", "has", "have", "in", "is", "it", "of", "or", "the", "to",
    "with", "what", "which", "who", "how", "s", "about", "关系", "什么", "哪些", "怎么", "如何", "这个", "目前",
)
# English stop words of the relation schema and quote tokenizers.
SCHEMA_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "for", "from", "had", "has", "have", "he", "her",
    "hers", "him", "his", "i", "in", "is", "it", "its", "of", "on", "or", "our", "she", "that", "the", "their", "them",
    "there", "they", "this", "to", "was", "were", "which", "who", "with", "unknown",
)
LATIN, CJK = r"[A-Za-z0-9_]+", r"[\x{4e00}-\x{9fff}]"
# Markers of a commitment.
COMMITMENT = (
    "i will", "i'll", "going to", "gonna", "plan", "want to", "wanna", "need to", "should", "let's", "we should", "can't wait",
)
# Openings of a question.
QUESTION = (
    "what", "when", "where", "who", "whom", "whose", "why", "how", "which", "does", "do", "did", "is", "are", "was", "were",
    "can", "could", "would", "should",
)


def found(text: Column, pattern: str) -> Column:
    """All matches in order; null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def lowered(words: Column) -> Column:
    return F.transform(words, lambda w: F.lower(w))


def word_set(text: Column) -> Column:
    """Distinct lower-case ASCII words, first occurrence first (direct scan and support checks)."""
    return F.array_distinct(lowered(found(text, LATIN)))


def bm25_bag(text: Column) -> Column:
    """Latin words, then CJK characters, then bigrams of neighbouring CJK characters of the whole text."""
    cjk = found(text, CJK)
    pairs = F.zip_with(cjk, F.slice(cjk, 2, F.greatest(F.size(cjk) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    pairs = F.filter(pairs, lambda p: p.isNotNull())
    return F.concat(lowered(found(text, LATIN)), cjk, pairs)


def _without(words: Column, stop: tuple[str, ...]) -> Column:
    return F.filter(words, lambda w: ~w.isin(*stop))


def graph_tokens(text: Column) -> Column:
    """Trimmed lower-case words or single CJK characters, stop words removed."""
    return _without(found(F.lower(F.trim(text)), r"[a-z0-9_]+|[\x{4e00}-\x{9fff}]"), GRAPH_STOPWORDS)


def schema_tokens(text: Column) -> Column:
    """Words of letters, digits or CJK runs; no bare numbers, no Latin word under 3 letters, no stop words."""
    words = lowered(found(text, r"[0-9a-zA-Z\x{4e00}-\x{9fff}]+"))
    keep = F.filter(words, lambda w: ~w.rlike("^[0-9]+$") & (w.rlike(r"[\x{4e00}-\x{9fff}]") | (F.length(w) >= 3)))
    return _without(keep, SCHEMA_STOPWORDS)


def delta_tokens(text: Column) -> Column:
    """Unicode words in lower case (comparison of versions)."""
    return lowered(found(text, r"[\p{L}\p{N}_]+"))


def smoke_tokens(text: Column) -> Column:
    """Lower-case words without underscore, or whole CJK runs; stop words removed."""
    return _without(found(F.lower(text), r"[a-z0-9]+|[\x{4e00}-\x{9fff}]+"), GRAPH_STOPWORDS)


def rough_token_count(text: Column) -> Column:
    return (F.size(found(text, LATIN)) + F.size(found(text, CJK))).cast("long")


def sentence_count(text: Column) -> Column:
    """Non-blank parts between sentence terminators, at least 1."""
    parts = F.split(F.coalesce(text, F.lit("")), "[.!?。！？]+")
    return F.greatest(F.size(F.filter(parts, lambda p: F.trim(p) != "")), F.lit(1)).cast("long")


def term_count(text: Column, terms: tuple[str, ...]) -> Column:
    """Occurrences of English terms with no word character beside them, summed over the terms."""
    low = F.lower(F.coalesce(text, F.lit("")))
    counts = [F.regexp_count(low, F.lit(rf"(?<![a-z0-9_]){t.replace(' ', r'\s+')}(?![a-z0-9_])")) for t in terms]
    return sum(counts[1:], counts[0]).cast("long")


def per_100(count: Column, tokens: Column) -> Column:
    return F.when(tokens > 0, F.round(count / tokens * 100, 4)).otherwise(F.lit(0.0))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def entity_key(text: Column) -> Column:
    low = F.regexp_replace(F.lower(squeeze(text)), "['’]", "")
    return F.regexp_replace(F.regexp_replace(low, r"[^0-9a-z\x{4e00}-\x{9fff}]+", "-"), "^-+|-+$", "")


def relation_key(text: Column) -> Column:
    low = F.lower(squeeze(text))
    return F.regexp_replace(F.regexp_replace(low, r"[^0-9a-z\x{4e00}-\x{9fff}]+", "_"), "^_+|_+$", "")


def excerpt(text: Column, n: int) -> Column:
    """At most ``n`` characters, the last three being an ellipsis where the text is longer."""
    flat = squeeze(text)
    return F.when(F.length(flat) > n, F.concat(F.rtrim(F.substring(flat, 1, n - 3)), F.lit("..."))).otherwise(flat)


def stable_id(prefix: str, *parts: Column, n: int = 12) -> Column:
    digest = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    return F.concat(F.lit(f"{prefix}:"), F.substring(digest, 1, n))


def syllables(word: Column) -> Column:
    """Vowel groups of a lower-case word, less one for a silent e, at least 1."""
    groups = F.regexp_count(word, F.lit("[aeiouy]+"))
    silent = F.when(word.rlike("e$") & (groups > 1), 1).otherwise(0)
    return F.greatest(groups - silent, F.lit(1))


def readability(text: Column) -> dict[str, Column]:
    """Six readability grades of English text; 0 without words."""
    words = lowered(found(text, r"[A-Za-z]+"))
    n, sentences = F.size(words).cast("double"), sentence_count(text).cast("double")
    counts = F.transform(words, syllables)
    total = F.aggregate(counts, F.lit(0), lambda a, x: a + x).cast("double")
    hard = F.size(F.filter(counts, lambda c: c >= 3)).cast("double")
    letters = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)).cast("double")
    per = n / sentences
    grades = {
        "flesch": 206.835 - 1.015 * per - 84.6 * total / n,
        "kincaid": 0.39 * per + 11.8 * total / n - 15.59,
        "ari": 4.71 * letters / n + 0.5 * per - 21.43,
        "coleman_liau": 0.0588 * (letters / n * 100) - 0.296 * (sentences / n * 100) - 15.8,
        "fog": 0.4 * (per + 100 * hard / n),
        "smog": 1.043 * F.sqrt(hard * 30 / sentences) + 3.1291,
    }
    # a touch above the half, so that engines that round a half differently agree
    return {k: F.when(n > 0, F.round(v + 1e-9, 4)).otherwise(F.lit(0.0)) for k, v in grades.items()}


def language_scores(text: Column) -> tuple[Column, Column]:
    """Shares of CJK characters and of Latin words' letters among all non-blank characters, 0 to 10."""
    solid = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")).cast("double")
    share = lambda p: F.when(solid > 0, F.round(F.regexp_count(text, F.lit(p)) / solid * 10, 3)).otherwise(F.lit(0.0))
    return share(CJK), share("[A-Za-z]")


def capitalized(text: Column, most: int = 20) -> Column:
    """Distinct runs of up to four capitalized words, sorted, ``most`` at most."""
    return F.slice(F.array_sort(F.array_distinct(found(text, r"[A-Z][a-z]+(?: [A-Z][a-z]+){0,3}"))), 1, most)


def is_question(text: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return low.rlike(r"\?$") | low.rlike(rf"^({'|'.join(QUESTION)}) ")


def is_commitment(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(COMMITMENT))


def quote_covered(quote: Column, text: Column) -> Column:
    """Approximate quote match: at least 4 quote words, 0.82 of them in the text (0.9 up to 8 words)."""
    own = F.array_distinct(schema_tokens(quote))
    share = F.size(F.array_intersect(own, schema_tokens(text))) / F.size(own)
    return (F.size(own) >= 4) & (share >= F.when(F.size(own) <= 8, 0.9).otherwise(0.82))


def strip_fence(text: Column) -> Column:
    """Model output without its code fence."""
    return F.trim(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", ""))


def first_text(*cols: Column) -> Column:
    """The first that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])


def clauses(text: Column) -> Column:
    """Clauses between punctuation or a joining word; abbreviations keep their stop."""
    safe = F.regexp_replace(F.coalesce(text, F.lit("")), r"\b(Mr|Mrs|Ms|Dr|St|e\.g|i\.e|etc)\.", "$1\u0001")
    parts = F.split(safe, r"[.!?;。！？；]+|,?\s+(?:and|but|then|so)\s+")
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, "\u0001", "."))), lambda p: p != "")
