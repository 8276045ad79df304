"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.consensus import consensus
from tessera.llm.handwritten import handwritten_findings, not_handwritten
from tessera.llm.leakage import leaked_items
from tessera.llm.linkage import linked_batches
from tessera.llm.packing import fill_report, packed
from tessera.llm.stuffing import stuffed_documents
from tessera.llm.syntax import first_errors, invalid_files, invalid_rates
from tessera.session import ship
from tessera.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def shipped(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return run(spark, folder)

    QUERIES[run.__name__] = shipped
    return shipped


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return not_handwritten(table(spark, d, "source_files"), table(spark, d, "file_results"))


@query
def p1_findings(spark: SparkSession, d: str) -> DataFrame:
    return handwritten_findings(table(spark, d, "findings"), table(spark, d, "source_files"), table(spark, d, "file_results"))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return invalid_files(table(spark, d, "source_files"))


@query
def p2_errors(spark: SparkSession, d: str) -> DataFrame:
    return first_errors(table(spark, d, "source_files"))


@query
def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return invalid_rates(table(spark, d, "source_files"), table(spark, d, "file_results"))


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus(table(spark, d, "votes")).items.select("url", "classification")


@query
def p3_judges(spark: SparkSession, d: str) -> DataFrame:
    return consensus(table(spark, d, "votes")).judges


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return linked_batches(table(spark, d, "repos_test"))


@query
def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return packed(table(spark, d, "documents"))


@query
def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(packed(table(spark, d, "documents")))


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffed_documents(table(spark, d, "documents"))
