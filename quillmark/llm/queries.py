"""The registered queries of this subpackage: operators with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, cohort, common, lexical, media, merkle, mixing, near_dedup, packing, quality, substring_dedup, token_files, toxicity, url_filter


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(common.table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2, capacity=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(common.table(spark, sf_dir, "documents"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    store = media.store_payloads(docs.select(F.encode(text, "UTF-8").alias("payload")))
    sequences = media.parse_pages(media.documents_as_pages(docs), id_col="doc_id")
    found = media.resolve(media.references(sequences, id_col="doc_id"), media.read_features(store))
    n_bytes = F.regexp_extract("caption", r"(\d+) bytes", 1).cast("long")
    return found.select(
        "doc_id", n_bytes.alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption"
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(common.table(spark, sf_dir, "pages"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(common.table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_path(spark, "token-files")
    manifest = token_files.write_token_files(common.table(spark, sf_dir, "documents"), folder, tokenizer_path(), end_id=1)
    return token_files.read_token_files(manifest)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate_toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.table(spark, sf_dir, "documents"))


def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(common.table(spark, sf_dir, "documents"))


def op11_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.retention(common.table(spark, sf_dir, "clicks"), common.table(spark, sf_dir, "clients"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    marks = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") + 1).cast("int")).alias("role"), said.alias("text"))
    with common.scratch(spark) as kept:
        formatted = common.written(chat.format_conversations(table.unionByName(marks)), "chat")
        kept.append(common.written(chat.digests(formatted), "chat-digests"))
    return kept[0]


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), top=50)


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_substring_dedup,
        op3_media,
        op4_url_filter,
        op5_near_dedup,
        op6_token_files,
        op7_toxicity,
        op8_quality,
        op9_mixing,
        op10_merkle,
        op11_retention,
        op12_chat,
        op13_lexical_search,
    )
}
