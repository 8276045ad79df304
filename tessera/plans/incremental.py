"""Queries of incremental runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.core import query
from tessera.session import scratch
from tessera.streaming.incremental import append_first_seen, append_once, stream_table


@query("SELECT judge, count(*) AS n FROM votes GROUP BY judge")
def stream_resume(spark: SparkSession, d: str) -> DataFrame:
    """Votes appended in two runs: the second finds nothing new."""
    path = scratch(spark, "stream")
    for _ in range(2):
        append_once(stream_table(spark, d, "votes"), f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out").groupBy("judge").count().withColumnRenamed("count", "n")


@query("SELECT DISTINCT lower(name) AS name FROM repos_test WHERE name IS NOT NULL")
def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Names seen for the first time, over a stream of the manifest's files."""
    path = scratch(spark, "stream")
    append_first_seen(stream_table(spark, d, "repos_test").where("name is not null").selectExpr("lower(name) AS name"), ["name"], f"{path}/out", f"{path}/state")
    return spark.read.schema("name string, run_part bigint").parquet(f"{path}/out").select("name")
