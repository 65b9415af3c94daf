"""Results that are read more than once are computed once."""

from quillmark.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_packets_are_scored_once(spark):
    got = QUERIES["packet_quality"](spark, "/root/testdata/sf0.001")
    assert "embedding#" not in plan(got)  # the vectors are not met again for the checks
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").count()
