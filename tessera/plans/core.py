"""Queries of the core operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.nested import inlined_children
from tessera.session import ship
from tessera.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def shipped(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return run(spark, folder)

        QUERIES[run.__name__] = shipped
        if sql:
            SQL[run.__name__] = sql
        return shipped

    return register


@query()
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return inlined_children(table(spark, d, "repos_test"), table(spark, d, "file_results"))


@query(
    """
    SELECT 'language' AS child, row_id AS parent_id, CAST(i - 1 AS VARCHAR) AS pos, coalesce(languages[i].name, '') AS name
    FROM repos_test, unnest(generate_series(1, len(languages))) AS g(i) WHERE languages[i] IS NOT NULL
    UNION ALL
    SELECT 'framework', row_id, CAST(i - 1 AS VARCHAR), coalesce(frameworks[i].name, '')
    FROM repos_test, unnest(generate_series(1, len(frameworks))) AS g(i) WHERE frameworks[i] IS NOT NULL
    """
)
def p5_repo_children(spark: SparkSession, d: str) -> DataFrame:
    repos = table(spark, d, "repos_test")
    return inlined_children(repos, table(spark, d, "file_results")).where("source = 'repos_test'").select("child", "parent_id", "pos", "name")
