"""Incremental runs with Structured Streaming: resumed appends, deduplication across runs, and counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_table(spark: SparkSession, folder: str, name: str, **options: str) -> DataFrame:
    """A parquet table of the data folder as a stream of its files."""
    schema = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet").schema
    return spark.readStream.schema(schema).options(**options).parquet(f"{folder.rstrip('/')}/{name}.parquet*")


def append_once(rows: DataFrame, target: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Appends what the stream brings beyond the last run, then stops. A run that broke off goes on from its checkpoint; the file sink's log
    keeps rows of a repeated micro-batch from being read twice."""
    out = step(rows) if step else rows
    out.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start().awaitTermination()


def append_first_seen(rows: DataFrame, keys: list[str], target: str, checkpoint: str) -> None:
    """Appends the first row of each key over all runs to ``target``. What was seen is the target itself: each micro-batch is joined against its earlier
    parts, so that no state grows in the executors. A micro-batch that is repeated after a failure writes its part again."""
    schema = rows.schema

    def step(batch: DataFrame, number: int) -> None:
        seen = batch.sparkSession.read.schema(T.StructType([*schema.fields, T.StructField("run_part", T.LongType())])).parquet(target).where(F.col("run_part") < number)
        fresh = batch.dropDuplicates(keys).join(seen.select(*keys), keys, "left_anti").select(*schema.names)
        fresh.write.mode("overwrite").parquet(f"{target}/run_part={number}")

    path = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).mkdirs(path)
    rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_until(rows: DataFrame, passes: Column, target: str, checkpoint: str, most: int) -> int:
    """Appends rows that pass, micro-batch by micro-batch, until ``most`` have passed in all runs; returns how many have. The micro-batch that reaches the number is
    cut to it; how much a micro-batch brings is the stream's ``maxFilesPerTrigger``."""
    spark, schema = rows.sparkSession, T.StructType([*rows.schema.fields, T.StructField("run_part", T.LongType())])
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)

    def step(batch: DataFrame, number: int) -> None:
        have = batch.sparkSession.read.schema(schema).parquet(target).where(F.col("run_part") < number).count()
        batch.where(passes).limit(max(0, most - have)).write.mode("overwrite").parquet(f"{target}/run_part={number}")

    rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(target).count()


def count_session(spark: SparkSession, state: str, **counters: int) -> dict[str, int]:
    """Adds a run's counters to the small table under ``state`` and returns the sums of all runs, with their number as ``sessions``."""
    rows = [(name, int(n)) for name, n in {"sessions": 1, **counters}.items()]
    spark.createDataFrame(rows, "name string, n bigint").coalesce(1).write.mode("append").parquet(state)
    return {r.name: r.n for r in spark.read.schema("name string, n bigint").parquet(state).groupBy("name").agg(F.sum("n").alias("n")).collect()}


def windowed_counts(rows: DataFrame, at: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Counts by event-time window and ``by``; rows later than ``late`` behind the newest are left to the watermark."""
    return rows.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")
