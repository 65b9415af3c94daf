"""Sources: strict JSON lines, questions, conversations, annotations, lexicons, and layered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    """Asked of the file system that the path names, local or not."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    return next((p for p in paths if exists(spark, p)), None)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a JSON-lines file: blank lines are skipped, a bad line fails, a missing file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def latest_or_canonical(spark: SparkSession, folder: str, name: str, schema: T.StructType | str) -> DataFrame:
    """A table by precedence: latest_views/, then the latest file, then the canonical one."""
    found = first_existing(spark, [f"{folder}/latest_views/{name}.jsonl", f"{folder}/{name}_latest.jsonl", f"{folder}/{name}.jsonl"])
    return read_jsonl(spark, found or f"{folder}/{name}.jsonl", schema)


def questions(raw: DataFrame) -> DataFrame:
    """(query_id, question, route) from rows with question, query or text; ids default to q001, q002, ...

    ``raw`` needs an ``ordinal``; rows without any text are dropped.
    """
    text = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in raw.columns], F.lit(None).cast("string"))
    named = F.nullif(F.trim(F.col("query_id")), F.lit("")) if "query_id" in raw.columns else F.lit(None).cast("string")
    number = F.concat(F.lit("q"), F.lpad(F.col("ordinal").cast("string"), 3, "0"))
    route = F.col("route") if "route" in raw.columns else F.lit(None).cast("string")
    return raw.select(F.coalesce(named, number).alias("query_id"), text("question", "query", "text").alias("question"), route.alias("route")).where("question IS NOT NULL")


def conversation_sessions(raw: DataFrame, target: str) -> DataFrame:
    """Turns of nested sessions (sample_id, sessions: array<struct<session, time, turns: array<struct<dia_id, speaker, text>>>>).

    ``dia_id`` D<day>:<turn> gives the locator; the target speaker's turns have role target, others medium risk.
    """
    s = raw.select("sample_id", F.explode("sessions").alias("s")).select("sample_id", "s.session", "s.time", F.explode("s.turns").alias("t"))
    mine = F.lower("t.speaker") == target.lower()
    return s.select(
        F.concat_ws(":", F.lit("evidence"), "sample_id", "t.dia_id").alias("evidence_ref"),
        "sample_id",
        "session",
        "time",
        F.regexp_extract("t.dia_id", r"^D(\d+):(\d+)$", 1).cast("int").alias("day"),
        F.regexp_extract("t.dia_id", r"^D(\d+):(\d+)$", 2).cast("int").alias("turn"),
        F.col("t.speaker").alias("speaker"),
        F.col("t.text").alias("text"),
        F.when(mine, "target").otherwise("other_participant").alias("subject_role"),
        F.when(mine, "low").otherwise("medium").alias("contamination_risk"),
    )


def annotations(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of stand-off annotation lines (doc, value); discontinuous spans are skipped."""
    parts = lines.select("doc", F.split("value", "\t").alias("p")).where(F.size("p") >= 2)
    span = F.split(F.col("p")[1], " ")
    ents = parts.where(F.col("p")[0].startswith("T") & ~F.contains(F.col("p")[1], F.lit(";")))
    ents = ents.select("doc", F.col("p")[0].alias("id"), span[0].alias("type"), span[1].cast("int").alias("start"), span[2].cast("int").alias("end"), F.get("p", F.lit(2)).alias("text"))
    arg = lambda n: F.regexp_extract(F.col("p")[1], rf"Arg{n}:(\S+)", 1)
    rels = parts.where(F.col("p")[0].startswith("R")).select("doc", F.col("p")[0].alias("id"), span[0].alias("type"), arg(1).alias("arg1"), arg(2).alias("arg2"))
    return ents, rels


def replay(inputs: DataFrame, outputs: DataFrame, key: str = "proposal_input_id") -> DataFrame:
    """Recorded model outputs by input; a repeated key is an error."""
    twice = outputs.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"repeated {key}: {twice[0][0]}")
    return inputs.join(outputs, key, "left").withColumn("replay_status", F.when(F.col("output").isNull(), "missing").otherwise("replayed"))


def payloads(rows: DataFrame, schema: str, text: str = "output") -> DataFrame:
    """Fenced or bare JSON parsed to ``payload``; ``payload_status`` names what is wrong."""
    from ..functions.text import strip_fence

    parsed = F.from_json(strip_fence(F.col(text)), schema, {"mode": "PERMISSIVE"})
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    empty = F.to_json(parsed) == "{}"
    status = F.when(blank, "empty_output").when(parsed.isNull() | empty, "schema_validation_failed").otherwise("ok")
    return rows.withColumn("payload", parsed).withColumn("payload_status", status)
