"""Queries of the repository records: stores, the summary of each repository, corpus totals, histograms and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import manifest as M
from tessera.operators import scanning as S
from tessera.plans.core import query
from tessera.plans.reference import _FINDINGS, findings
from tessera.sources.tables import table

_USAGE = rf"""
st AS (SELECT repo, file, line, min(framework) AS framework FROM f WHERE type = 'store' AND line IS NOT NULL GROUP BY ALL),
si AS (SELECT repo, nullif(regexp_extract(store, '{S.STORE_PLACE}', 1), '') AS file, TRY_CAST(nullif(regexp_extract(store, '{S.STORE_PLACE}', 2), '') AS INTEGER) AS line, store,
 count(*) FILTER (type = 'write') AS n_writes, count(*) FILTER (type = 'read') AS n_reads FROM f WHERE store IS NOT NULL AND type IN ('read', 'write') GROUP BY repo, store),
us AS (SELECT coalesce(st.repo, si.repo) AS repo, coalesce(st.file, si.file) AS file, coalesce(st.line, si.line) AS line, store, framework, coalesce(n_writes, 0) AS n_writes, coalesce(n_reads, 0) AS n_reads, st.repo IS NOT NULL AS known
 FROM st FULL JOIN si ON st.repo = si.repo AND st.file = si.file AND st.line = si.line)"""
_ROLE = "CASE WHEN n_writes > 0 AND n_reads > 0 THEN 'read_write' WHEN n_writes > 0 THEN 'write_only' WHEN n_reads > 0 THEN 'read_only' ELSE 'unused' END AS role"


@query(f"WITH {_FINDINGS}, {_USAGE} SELECT *, {_ROLE} FROM us")
def store_roles(spark: SparkSession, d: str) -> DataFrame:
    """Stores with their sites, and sites of stores that are made nowhere."""
    return S.store_usage(findings(spark, d))


_SKILLS = "k AS (SELECT DISTINCT lower(repo) AS repo, path FROM source_files WHERE (path = 'SKILL.md' OR path LIKE '%/SKILL.md') AND size <= 2097152)"
_SUMMARY = f"""WITH {_FINDINGS}, {_SKILLS},
c AS (SELECT repo, count(*) FILTER (type = 'agent') AS n_agents, count(*) FILTER (type = 'store') AS n_stores, count(*) FILTER (type = 'write') AS n_writes, count(*) FILTER (type = 'read') AS n_reads,
 count(*) FILTER (type = 'tool_definition') AS n_tool_markers, count(*) FILTER (type = 'confirmed_tool_definition' AND name IS NOT NULL) AS n_confirmed_tool_definitions, coalesce(bool_or(type = 'write' AND coalesce(unsanitized, false)), false) AS unsanitized_writes,
 coalesce(string_agg(DISTINCT framework, ',' ORDER BY framework) FILTER (type = 'store'), '') AS store_frameworks, coalesce(string_agg(DISTINCT framework, ',' ORDER BY framework) FILTER (type = 'write'), '') AS rag_write_frameworks,
 coalesce(string_agg(DISTINCT framework, ',' ORDER BY framework) FILTER (type = 'read'), '') AS rag_read_frameworks FROM f GROUP BY repo),
t AS (SELECT repo, count(DISTINCT tool) AS n_tools, coalesce(string_agg(DISTINCT tool, ',' ORDER BY tool) FILTER (type = 'custom_agent'), '') AS llm_tool_names FROM (SELECT repo, type, unnest(CASE WHEN type = 'agent' THEN tools_bound WHEN type = 'custom_agent' THEN tool_names WHEN type = 'confirmed_tool_definition' AND name IS NOT NULL THEN [name] END) AS tool FROM f) WHERE tool IS NOT NULL GROUP BY repo),
a AS (SELECT repo, count(*) AS n_custom_agents FROM (SELECT DISTINCT repo, file, name FROM f WHERE type = 'custom_agent') GROUP BY repo),
sp AS (SELECT repo, count(*) FILTER (w) AS n_stores_written, count(*) FILTER (r) AS n_stores_read FROM (SELECT st.repo, st.file, st.line, bool_or(f2.type = 'write') AS w, bool_or(f2.type = 'read') AS r FROM (SELECT DISTINCT repo, file, line FROM f WHERE type = 'store' AND line IS NOT NULL) st
 JOIN (SELECT repo, type, regexp_extract(store, '{S.STORE_PLACE}', 1) || ':' || regexp_extract(store, '{S.STORE_PLACE}', 2) AS place FROM f WHERE store IS NOT NULL AND type IN ('read', 'write')) f2 ON f2.repo = st.repo AND f2.place = st.file || ':' || st.line GROUP BY ALL) GROUP BY repo),
n AS (SELECT repo, count(*) AS n_skills FROM k GROUP BY repo),
r AS (SELECT b.repo, coalesce(n_agents, 0) AS n_agents, coalesce(n_custom_agents, 0) AS n_custom_agents, coalesce(n_tools, 0) AS n_tools, coalesce(n_skills, 0) AS n_skills, coalesce(n_stores, 0) AS n_stores, coalesce(n_writes, 0) AS n_writes, coalesce(n_reads, 0) AS n_reads,
 coalesce(n_tool_markers, 0) AS n_tool_markers, coalesce(n_confirmed_tool_definitions, 0) AS n_confirmed_tool_definitions, coalesce(unsanitized_writes, false) AS unsanitized_writes, coalesce(n_stores_written, 0) AS n_stores_written, coalesce(n_stores_read, 0) AS n_stores_read,
 coalesce(llm_tool_names, '') AS llm_tool_names, coalesce(store_frameworks, '') AS store_frameworks, coalesce(rag_write_frameworks, '') AS rag_write_frameworks, coalesce(rag_read_frameworks, '') AS rag_read_frameworks, coalesce(n_stores, 0) > 0 AS has_rag, coalesce(n_custom_agents, 0) > 0 AS has_confirmed_llm_tool_calling
 FROM (SELECT repo FROM c UNION SELECT repo FROM k) b LEFT JOIN c USING (repo) LEFT JOIN t USING (repo) LEFT JOIN a USING (repo) LEFT JOIN sp USING (repo) LEFT JOIN n USING (repo))"""


def summary(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "source_files").select(F.lower("repo").alias("repo"), "path", "size")
    return S.repository_summary(findings(spark, d), files.where((F.substring_index("path", "/", -1) == "SKILL.md") & (F.col("size") <= 2 * 1024 * 1024)).select("repo", "path").distinct())


@query(_SUMMARY + " SELECT * FROM r")
def repository_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary(spark, d)


#: A repository is scanned if one of its files has a result without an error of its own, and failed otherwise.
_STATUS = """s AS (SELECT lower(s.repo) AS repo, CASE WHEN bool_or(r.file_id IS NOT NULL) THEN 'scanned' ELSE 'failed' END AS status FROM source_files s LEFT JOIN (SELECT DISTINCT file_id FROM file_results WHERE parse_error IS NULL) r ON s.file_id = r.file_id GROUP BY 1),
u AS (SELECT repo, bool_or(type IN ('agent', 'store') AND framework IS NOT NULL) AS passes FROM f GROUP BY repo)"""


def statuses(spark: SparkSession, d: str) -> DataFrame:
    """``repo, status, has_usage, passes`` of the repositories of the source files."""
    read = table(spark, d, "file_results").where("parse_error is null").select("file_id").distinct().withColumn("read", F.lit(True))
    files = table(spark, d, "source_files").select("file_id", F.lower("repo").alias("repo")).join(read, "file_id", "left")
    status = files.groupBy("repo").agg(F.when(F.bool_or(F.col("read").isNotNull()), "scanned").otherwise("failed").alias("status"))
    usage = findings(spark, d).groupBy("repo").agg(F.coalesce(F.bool_or(F.col("type").isin("agent", "store") & F.col("framework").isNotNull()), F.lit(False)).alias("passes"))
    return status.join(usage, "repo", "left").withColumn("has_usage", F.lit(True)).withColumn("passes", F.coalesce("passes", F.lit(False)))


@query(_SUMMARY + f", {_STATUS}" + """, q AS (SELECT s.repo, CASE WHEN s.status <> 'scanned' THEN 'failed' WHEN r.repo IS NULL THEN 'empty' ELSE 'scanned' END AS counted, coalesce(u.passes, false) AS passes, s.status <> 'scanned' OR coalesce(u.passes, false) AS stays FROM s LEFT JOIN u USING (repo) LEFT JOIN r USING (repo))
SELECT * FROM q""")
def record_statuses(spark: SparkSession, d: str) -> DataFrame:
    """What is counted as scanned, failed or without a summary, and whether the instantiation filter keeps it."""
    rows = statuses(spark, d)
    told = M.with_status(rows.join(summary(spark, d).select("repo", F.lit(True).alias("summed")), "repo", "left"), F.col("status"), F.col("summed").isNotNull())
    kept = M.instantiating(rows, "has_usage", "passes").select("repo", F.lit(True).alias("kept"))
    return told.join(kept, "repo", "left").select("repo", "counted", "passes", F.col("kept").isNotNull().alias("stays"))


_SUMS = ("n_agents", "n_custom_agents", "n_tools", "n_skills", "n_stores")


@query(_SUMMARY + f", {_STATUS}, x AS (SELECT r.* FROM r JOIN s USING (repo) JOIN u USING (repo) WHERE s.status = 'scanned' AND u.passes) SELECT " + ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in _SUMS) + """,
count(*) AS repos_scanned, count(*) FILTER (n_agents > 0) AS with_agent, count(*) FILTER (n_tools > 0) AS with_tool, count(*) FILTER (n_skills > 0) AS with_skill, count(*) FILTER (has_rag) AS with_rag,
(SELECT count(*) FROM s) AS repos_in_file, (SELECT count(*) FROM s WHERE status <> 'scanned') AS repos_failed, (SELECT count(*) FROM s LEFT JOIN u USING (repo) WHERE status = 'scanned' AND NOT coalesce(passes, false)) AS repos_dropped FROM x""")
def corpus_totals(spark: SparkSession, d: str) -> DataFrame:
    """A1, A2: totals over the scanned repositories that instantiate a framework, beside what failed and what was dropped."""
    rows = statuses(spark, d)
    kept = rows.where("status = 'scanned' and passes").select("repo")
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in _SUMS]
    over = [F.count("*").alias("repos_scanned"), *[F.count_if(F.col(c) > 0).alias(n) for c, n in (("n_agents", "with_agent"), ("n_tools", "with_tool"), ("n_skills", "with_skill"))], F.count_if("has_rag").alias("with_rag")]
    states = rows.agg(F.count("*").alias("repos_in_file"), F.count_if(F.col("status") != "scanned").alias("repos_failed"), F.count_if((F.col("status") == "scanned") & ~F.col("passes")).alias("repos_dropped"))
    return summary(spark, d).join(kept, "repo", "left_semi").agg(*sums, *over).crossJoin(states)  # one row each


@query(_SUMMARY + " " + " UNION ALL ".join(f"SELECT '{c}' AS field, CAST({c} AS BIGINT) AS value, count(*) AS n_repos FROM r GROUP BY {c}" for c in S.COUNT_FIELDS))
def histograms(spark: SparkSession, d: str) -> DataFrame:
    return S.histograms(summary(spark, d), list(S.COUNT_FIELDS))


@query(_SUMMARY + " SELECT repo, n_agents FROM r ORDER BY n_agents DESC, repo LIMIT 20")
def top_repos(spark: SparkSession, d: str) -> DataFrame:
    return summary(spark, d).select("repo", "n_agents").orderBy(F.desc("n_agents"), "repo").limit(20)


_EVIDENCE = ("agent", "custom_agent", "tool_definition", "confirmed_tool_definition", "store")


@query(f"WITH {_FINDINGS} SELECT type, repo, file, line, name, framework, matched FROM f WHERE type IN ({', '.join(repr(t) for t in _EVIDENCE)}) UNION ALL SELECT 'skill', lower(repo), path, 1, CASE WHEN path LIKE '%/%' THEN string_split(path, '/')[-2] END, NULL, 'SKILL.md' FROM (SELECT DISTINCT repo, path, size FROM source_files) WHERE (path = 'SKILL.md' OR path LIKE '%/SKILL.md') AND size <= 2097152")
def evidence_rows(spark: SparkSession, d: str) -> DataFrame:
    """P20: the evidence of the summaries as one long table."""
    rows = findings(spark, d).where(F.col("type").isin(*_EVIDENCE)).select("type", "repo", "file", "line", "name", "framework", "matched")
    found = table(spark, d, "source_files").where((F.substring_index("path", "/", -1) == "SKILL.md") & (F.col("size") <= 2 * 1024 * 1024)).select("repo", "path").distinct()
    name = F.when(F.contains("path", F.lit("/")), F.element_at(F.split("path", "/"), -2))
    return rows.unionByName(found.select(F.lit("skill").alias("type"), F.lower("repo").alias("repo"), F.col("path").alias("file"), F.lit(1).alias("line"), name.alias("name"), F.lit(None).cast("string").alias("framework"), F.lit("SKILL.md").alias("matched")))


@query("""SELECT lower(s.repo) AS repo, count(DISTINCT s.file_id) AS total_files, count(DISTINCT r.file_id) FILTER (r.skipped_reason IS NULL) AS files_scanned, count(DISTINCT r.file_id) FILTER (r.skipped_reason IS NULL AND r.parse_error IS NOT NULL) AS files_with_parse_errors
FROM source_files s LEFT JOIN file_results r ON s.file_id = r.file_id GROUP BY 1""")
def file_counts(spark: SparkSession, d: str) -> DataFrame:
    """Files of each repository; files with parse errors are scanned too."""
    read = table(spark, d, "file_results").where("skipped_reason is null").groupBy("file_id").agg(F.bool_or(F.col("parse_error").isNotNull()).alias("failed"))
    files = table(spark, d, "source_files").select("file_id", F.lower("repo").alias("repo")).join(read, "file_id", "left")
    return files.groupBy("repo").agg(F.count("*").alias("total_files"), F.count("failed").alias("files_scanned"), F.count_if("failed").alias("files_with_parse_errors"))
