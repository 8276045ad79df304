"""Queries that re-express a corpus study's steps on the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import manifest as M
from tessera.operators import scanning as S
from tessera.operators import screening as J
from tessera.operators.components import components
from tessera.plans.core import query
from tessera.sources.tables import table

_PLAIN_FILE = r"regexp_replace(regexp_replace(trim(file), '\\', '/', 'g'), '^(\./|/)+', '')"
_FINDINGS = f"""
f AS (SELECT DISTINCT lower(repo_name) AS repo, {_PLAIN_FILE} AS file, line, type, name, framework, matched, unsanitized, store, source, tools_bound, tool_names FROM findings)"""
_URL = r"lower(regexp_replace(regexp_replace(trim(url), '/+$', ''), '\.git$', ''))"
_KEY = rf"""CASE WHEN len(string_split({_URL}, '/')) >= 2 THEN string_split({_URL}, '/')[-2] || '/' || string_split({_URL}, '/')[-1] ELSE {_URL} END"""
_LABEL = "CASE WHEN error IS NOT NULL OR classification IS NULL OR trim(classification) = '' THEN 'error' ELSE trim(classification) END"
_LATEST = f"""
v AS (SELECT {_KEY} AS url, judge, processed_at, {_LABEL} AS label FROM votes WHERE url IS NOT NULL AND judge IS NOT NULL),
l AS (SELECT url, judge, label FROM (SELECT *, row_number() OVER (PARTITION BY url, judge ORDER BY processed_at DESC NULLS LAST, label DESC) AS n FROM v) WHERE n = 1)"""
_SHARE = """CASE WHEN coalesce(list_sum(list_transform(languages, lambda x: coalesce(x.percentage, 0.0))), 0) > 0
 THEN coalesce(list_sum(list_transform(languages, lambda x: CASE WHEN x.name IN ('Python', 'JavaScript', 'TypeScript') THEN coalesce(x.percentage, 0.0) ELSE 0.0 END)), 0) / list_sum(list_transform(languages, lambda x: coalesce(x.percentage, 0.0))) * 100 ELSE 0 END"""
_VERDICT = f"""CASE WHEN {_SHARE} < 70 THEN 'failed_language' WHEN len(list_filter(coalesce(frameworks, []), lambda x: x.name IS NOT NULL)) = 0 THEN 'failed_framework' ELSE 'passed' END"""


def latest(spark: SparkSession, d: str) -> DataFrame:
    return J.latest_votes(table(spark, d, "votes"), T.repo_key(F.col("url")))


def findings(spark: SparkSession, d: str) -> DataFrame:
    return S.distinct_findings(table(spark, d, "findings"))


@query(f"SELECT row_id, {_VERDICT} AS verdict FROM repos_test")
def verdict_routing(spark: SparkSession, d: str) -> DataFrame:
    return M.verdicts(table(spark, d, "repos_test")).select("row_id", "verdict")


@query(f"SELECT verdict, count(*) AS n FROM (SELECT {_VERDICT} AS verdict FROM repos_test) GROUP BY verdict")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    return M.verdicts(table(spark, d, "repos_test")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("""
SELECT row_id, CAST(rank AS INTEGER) AS rank, name FROM (
  SELECT row_id, languages[i].name AS name, row_number() OVER (PARTITION BY row_id ORDER BY languages[i].percentage DESC, i) AS rank
  FROM repos_test, unnest(generate_series(1, len(languages))) AS g(i) WHERE languages[i] IS NOT NULL AND languages[i].percentage IS NOT NULL)
WHERE rank <= 5""")
def top_languages(spark: SparkSession, d: str) -> DataFrame:
    return M.top_in_array(table(spark, d, "repos_test"), "row_id", "languages", "percentage", 5)


@query("""
SELECT row_id FROM repos_test r
WHERE (url IS NULL OR row_id = (SELECT min(row_id) FROM repos_test x WHERE x.url = r.url)) AND row_id IN (
  SELECT row_id FROM (SELECT row_id, name, min(row_id) OVER (PARTITION BY name) AS m FROM (
    SELECT row_id, name FROM (SELECT row_id, name, url, min(row_id) OVER (PARTITION BY url) AS u FROM repos_test) WHERE url IS NULL OR row_id = u))
  WHERE name IS NULL OR row_id = m)""")
def seen_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return M.first_by_any_key(table(spark, d, "repos_test"), ["url", "name"], "row_id").select("row_id")


@query("""
SELECT s.file_id FROM source_files s ANTI JOIN file_results r ON s.file_id = r.file_id
UNION ALL SELECT s.file_id FROM source_files s SEMI JOIN file_results r ON s.file_id = r.file_id AND r.parse_error IS NOT NULL""")
def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    files, results = table(spark, d, "source_files").select("file_id"), table(spark, d, "file_results")
    failed = results.where("parse_error is not null").select("file_id").distinct()
    return files.join(results.select("file_id").distinct(), "file_id", "left_anti").unionByName(files.join(failed, "file_id", "left_semi"))


@query("""
SELECT DISTINCT doc_id, r.name AS framework FROM documents d JOIN (SELECT name, lower(unnest(keywords)) AS keyword FROM framework_registry) r
ON contains(lower(d.text), r.keyword) WHERE r.keyword <> ''""")
def keyword_detect(spark: SparkSession, d: str) -> DataFrame:
    return M.keyword_hits(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "framework_registry"))


@query(r"""
WITH m AS (SELECT DISTINCT file_id, regexp_extract(unnest(regexp_extract_all(text, '(?m)^\s*(?:from|import)\s+(?:.*\bfrom\s+)?[''"]?([@A-Za-z][\w./@-]*)', 1)), '^(@[^/]+/[^/]+|[^/.]+)', 1) AS dependency FROM source_files WHERE text IS NOT NULL),
d AS (SELECT DISTINCT name AS framework, unnest(dependencies) AS dependency FROM framework_registry)
SELECT DISTINCT file_id, framework FROM m JOIN d USING (dependency)""")
def dependency_detect(spark: SparkSession, d: str) -> DataFrame:
    return M.imported_frameworks(table(spark, d, "source_files"), table(spark, d, "framework_registry"))


@query("SELECT category, category_display, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM framework_registry GROUP BY category, category_display")
def registry_by_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "framework_registry").groupBy("category", "category_display").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


@query(f"SELECT {_KEY} AS repo_key, count(*) AS n_votes, count(DISTINCT judge) AS n_judges FROM votes GROUP BY 1")
def votes_by_repo_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "votes").groupBy(T.repo_key(F.col("url")).alias("repo_key")).agg(F.count("*").alias("n_votes"), F.countDistinct("judge").alias("n_judges"))


@query(f"SELECT judge, label, count(*) AS n FROM (SELECT judge, {_LABEL} AS label FROM votes) GROUP BY judge, label")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "votes").groupBy("judge", J.vote_label(F.col("classification"), F.col("error")).alias("label")).agg(F.count("*").alias("n"))


@query(f"""WITH {_LATEST}
SELECT url, count(*) AS n_judges, CASE WHEN min(lower(label)) = max(lower(label)) AND min(lower(label)) NOT IN ('', 'error', 'needs_review', 'needs review') THEN min(lower(label)) END AS decision,
CASE WHEN min(lower(label)) = max(lower(label)) AND min(lower(label)) NOT IN ('', 'error', 'needs_review', 'needs review') THEN 'judges' ELSE 'none' END AS source FROM l GROUP BY url""")
def judge_merge(spark: SparkSession, d: str) -> DataFrame:
    return J.merged_votes(latest(spark, d))


_ANSWERS = f"""{_LATEST}, p AS (SELECT url, judge, CASE WHEN lower(label) NOT IN ('', 'error', 'needs_review', 'needs review') THEN lower(label) END AS label FROM l),
answers AS (SELECT u.url, j.judge, coalesce(p.label, '') AS label FROM (SELECT DISTINCT url FROM l) u CROSS JOIN (SELECT DISTINCT judge FROM l) j LEFT JOIN p ON p.url = u.url AND p.judge = j.judge)"""


@query(f"""WITH {_ANSWERS} PIVOT answers ON judge USING max(label) GROUP BY url""")
def judge_pivot(spark: SparkSession, d: str) -> DataFrame:
    """One column for each judge there is."""
    rows = latest(spark, d)
    judges = [r.judge for r in rows.select("judge").distinct().orderBy("judge").limit(10_000).collect()]  # columns of one row
    return J.judge_columns(rows.withColumn("label", F.when(J.is_label(F.col("label")), F.lower("label"))), judges)


@query(f"WITH {_ANSWERS} SELECT * FROM answers")
def judge_answers(spark: SparkSession, d: str) -> DataFrame:
    """J4 for all judges, as long rows: each repository x each judge, '' where there is no answer."""
    return J.all_answers(latest(spark, d))


@query(f"""WITH {_LATEST}, w AS (SELECT url, judge, lower(label) AS label FROM l WHERE lower(label) NOT IN ('', 'error', 'needs_review', 'needs review'))
SELECT a.judge AS judge_a, b.judge AS judge_b, count(*) AS n_both, count(*) FILTER (a.label = b.label) AS n_same, count(*) FILTER (a.label = b.label) / count(*) AS agreement FROM w a JOIN w b ON a.url = b.url AND a.judge < b.judge GROUP BY 1, 2""")
def pairwise_agreement(spark: SparkSession, d: str) -> DataFrame:
    return J.pairwise_agreement(latest(spark, d))


@query("""
WITH c AS (SELECT CASE WHEN stars >= 10000 THEN '10k+' WHEN stars >= 1000 THEN '1k - 9.9k' WHEN stars >= 100 THEN '100 - 999' WHEN stars >= 10 THEN '10 - 99' WHEN stars >= 0 THEN '< 10' END AS class, count(*) AS n FROM repos_test GROUP BY 1),
k(class) AS (VALUES ('< 10'), ('10 - 99'), ('100 - 999'), ('1k - 9.9k'), ('10k+'))
SELECT k.class, coalesce(c.n, 0) AS n, coalesce(c.n, 0) / (SELECT count(*) FROM repos_test) AS share FROM k LEFT JOIN c ON k.class = c.class""")
def star_classes(spark: SparkSession, d: str) -> DataFrame:
    """All classes, also empty ones, with their share of all rows; rows without a class count in the whole only."""
    rows = table(spark, d, "repos_test")
    counts = rows.select(T.star_class(F.col("stars")).alias("class")).unionByName(spark.createDataFrame([(name,) for _, name in T.STAR_CLASSES], "class string").withColumn("extra", F.lit(True)), allowMissingColumns=True)
    by = counts.groupBy("class").agg(F.count_if(F.col("extra").isNull()).alias("n"))
    return M.with_share(by, "n").where("class is not null")


@query("SELECT coalesce(languages[1].name, 'Unknown') AS value, count(*) AS n, count(*) / (SELECT count(*) FROM repos_test) AS share FROM repos_test GROUP BY 1 ORDER BY n DESC, min(row_id) LIMIT 10")
def primary_language_top10(spark: SparkSession, d: str) -> DataFrame:
    return M.most_common(table(spark, d, "repos_test"), F.coalesce(F.get("languages", 0)["name"], F.lit("Unknown")), "row_id", 10, table(spark, d, "repos_test"))


@query("""
SELECT name AS value, count(*) AS n, count(*) / (SELECT count(*) FROM repos_test) AS share FROM (SELECT DISTINCT row_id, x.name AS name FROM (SELECT row_id, unnest(frameworks) AS x FROM repos_test) WHERE x.name IS NOT NULL)
GROUP BY 1 ORDER BY n DESC, min(row_id), name LIMIT 15""")
def frameworks_top15(spark: SparkSession, d: str) -> DataFrame:
    names = F.filter(F.array_distinct(F.transform("frameworks", lambda x: x["name"])), lambda x: x.isNotNull())
    rows = table(spark, d, "repos_test").select("row_id", F.explode(names).alias("value"))
    top = rows.groupBy("value").agg(F.count("*").alias("n"), F.min("row_id").alias("o")).orderBy(F.desc("n"), "o", "value").limit(15)
    return top.crossJoin(F.broadcast(table(spark, d, "repos_test").agg(F.count("*").alias("_all")))).select("value", "n", (F.col("n") / F.col("_all")).alias("share"))


@query("SELECT found_via AS value, count(*) AS n, count(*) / (SELECT count(*) FROM repos_test) AS share FROM repos_test WHERE found_via IS NOT NULL GROUP BY 1 ORDER BY n DESC, min(row_id) LIMIT 10")
def found_via_top10(spark: SparkSession, d: str) -> DataFrame:
    return M.most_common(table(spark, d, "repos_test").where("found_via is not null"), F.col("found_via"), "row_id", 10, table(spark, d, "repos_test"))


_FLAGS = f"""WITH {_FINDINGS}, g AS (SELECT repo, bool_or(type = 'agent') AS agent, bool_or(type = 'write') AS write, bool_or(type = 'custom_agent') AS custom FROM f GROUP BY repo)"""


def _flags(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).groupBy("repo").agg(*[F.bool_or(F.col("type") == t).alias(n) for n, t in (("agent", "agent"), ("write", "write"), ("custom", "custom_agent"))])


@query(_FLAGS + " SELECT concat(CASE WHEN agent THEN '1' ELSE '0' END, CASE WHEN write THEN '1' ELSE '0' END, CASE WHEN custom THEN '1' ELSE '0' END) AS region_key, count(*) AS n FROM g WHERE agent OR write OR custom GROUP BY 1")
def venn_regions(spark: SparkSession, d: str) -> DataFrame:
    return J.regions(_flags(spark, d), ["agent", "write", "custom"])


@query(_FLAGS + """ SELECT 'agent' AS a, 'write' AS b, count(*) FILTER (agent AND write) AS both, count(*) FILTER (agent OR write) AS either, coalesce(count(*) FILTER (agent AND write) / nullif(count(*) FILTER (agent OR write), 0), 0.0) AS jaccard FROM g
UNION ALL SELECT 'agent', 'custom', count(*) FILTER (agent AND custom), count(*) FILTER (agent OR custom), coalesce(count(*) FILTER (agent AND custom) / nullif(count(*) FILTER (agent OR custom), 0), 0.0) FROM g
UNION ALL SELECT 'write', 'custom', count(*) FILTER (write AND custom), count(*) FILTER (write OR custom), coalesce(count(*) FILTER (write AND custom) / nullif(count(*) FILTER (write OR custom), 0), 0.0) FROM g""")
def jaccard(spark: SparkSession, d: str) -> DataFrame:
    return J.jaccard(_flags(spark, d), ["agent", "write", "custom"])


#: Marks of agents, of tool use and of tool definitions in source lines.
AGENT_MARK = r"(?i)\bclass\s+\w*Agent\w*\b|\bdef\s+\w*agent\w*\s*\(|(?:^|[^\w.])agents?\s*=|\bself\.agents?\s*=|\bagent_loop\b|\brun_conversation\s*\("
TOOL_USE_MARK = r"tool_registry|ToolRegistry\(|register_tool\(|get_tool_definitions\(|handle_function_call\(|discover_builtin_tools\("
TOOL_DEFINITION_MARK = (
    r"@tool\b|@function_tool\b|@agent\.tool\b|@agent\.tool_plain\b|@mcp\.tool\b|@server\.call_tool\b|@server\.list_tools\b|@controller\.action\b|\bBaseTool\b|\bFunctionTool\s*\(|"
    r"\bQueryEngineTool\s*\(|\bStructuredTool\.from_function\s*\(|\bnew\s+DynamicStructuredTool\s*\(|\bnew\s+DynamicTool\s*\(|\bcreateTool\s*\(|\buseCopilotAction\s*\(|\bregisterTool\s*\(|"
    r"\bserver\.tool\s*\(|\bserver\.setRequestHandler\s*\(\s*ListToolsRequestSchema|\bserver\.setRequestHandler\s*\(\s*CallToolRequestSchema"
)
MARKS = {"agent_marker": AGENT_MARK, "tool_use": TOOL_USE_MARK, "tool_definition": TOOL_DEFINITION_MARK}


@query(" UNION ALL ".join(f"""
SELECT file_id, '{kind}' AS kind, CAST(i AS INTEGER) AS line, regexp_extract(l[i], '{mark}', 0) AS matched FROM (SELECT file_id, string_split(text, chr(10)) AS l FROM source_files WHERE text IS NOT NULL), unnest(generate_series(1, len(l))) AS g(i)
WHERE regexp_matches(l[i], '{mark}')""" for kind, mark in MARKS.items()))
def line_markers(spark: SparkSession, d: str) -> DataFrame:
    """The first mark of each family in a line."""
    out = None
    for kind, mark in MARKS.items():
        rows = S.line_markers(table(spark, d, "source_files"), mark).select("file_id", F.lit(kind).alias("kind"), "line", "matched")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(r"""
SELECT file_id, CAST(i AS INTEGER) AS line, len(list_filter(list_slice(l, greatest(1, i - 4), i), lambda y: regexp_matches(lower(y), 'validate|sanitize|clean|escape|schema|pydantic'))) > 0 AS checked
FROM (SELECT file_id, string_split(text, chr(10)) AS l FROM source_files WHERE text IS NOT NULL), unnest(generate_series(1, len(l))) AS g(i) WHERE regexp_matches(l[i], '\.get\(|\.filter\(')""")
def sanitizer_window(spark: SparkSession, d: str) -> DataFrame:
    return S.near_check(table(spark, d, "source_files"), r"\.get\(|\.filter\(")


_MARKERS = " ".join(f"WHEN contains(lower(line_content), '{m}') THEN '{m}'" for m in T.TAINT_MARKERS)


@query(f"SELECT marker, count(*) AS n FROM (SELECT CASE {_MARKERS} END AS marker FROM findings) GROUP BY marker")
def taint_markers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "findings").groupBy(T.first_marker(F.col("line_content")).alias("marker")).agg(F.count("*").alias("n"))


@query(f"""WITH {_FINDINGS},
u AS (SELECT DISTINCT repo, file, line, type FROM f WHERE type IN ('read', 'write') AND line IS NOT NULL), s AS (SELECT repo, file, line, min(coalesce(framework, '')) AS framework FROM f WHERE type = 'store' AND line IS NOT NULL GROUP BY ALL),
b AS (SELECT u.repo, u.file, u.line, u.type, max(s.line) FILTER (s.line <= u.line) AS before, min(s.line) AS first FROM u LEFT JOIN s ON u.repo = s.repo AND u.file = s.file GROUP BY ALL)
SELECT b.repo, b.file, b.line, b.type, s.line AS made_at, s.framework FROM b LEFT JOIN s ON b.repo = s.repo AND b.file = s.file AND s.line = coalesce(b.before, b.first)""")
def asof_store(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d).where("line is not null")
    uses = f.where("type in ('read', 'write')").select("repo", "file", "line", "type").distinct()
    stores = f.where("type = 'store'").groupBy("repo", "file", "line").agg(F.min(F.coalesce("framework", F.lit(""))).alias("framework"))
    return S.as_of(uses, stores, ["repo", "file"], "line", ["framework"])


@query(f"""WITH {_FINDINGS} SELECT repo, file, name, min(line) AS first_line, min(struct_pack(l := coalesce(line, -1), f := coalesce(framework, ''), m := coalesce(matched, ''))).f AS framework, min(struct_pack(l := coalesce(line, -1), f := coalesce(framework, ''), m := coalesce(matched, ''))).m AS matched, nullif(array_to_string(list_sort(list_distinct(flatten(list(coalesce(tool_names, []))))), ','), '') AS tool_names
FROM f WHERE type = 'custom_agent' GROUP BY repo, file, name""")
def custom_agent_groups(spark: SparkSession, d: str) -> DataFrame:
    return S.custom_agents(findings(spark, d))


@query(f"""WITH {_FINDINGS}, d AS (SELECT DISTINCT lower(name) AS repo, x.name AS framework FROM (SELECT name, unnest(frameworks) AS x FROM repos_test WHERE name IS NOT NULL) WHERE x.name IS NOT NULL),
e AS (SELECT DISTINCT repo, framework FROM f WHERE framework IS NOT NULL), j AS (SELECT coalesce(d.repo, e.repo) AS repo, coalesce(d.framework, e.framework) AS framework, d.repo IS NOT NULL AS x, e.repo IS NOT NULL AS y FROM d FULL JOIN e ON d.repo = e.repo AND d.framework = e.framework)
SELECT repo, coalesce(string_agg(framework, ',' ORDER BY framework) FILTER (x AND y), '') AS agrees, coalesce(string_agg(framework, ',' ORDER BY framework) FILTER (x AND NOT y), '') AS declared_only, coalesce(string_agg(framework, ',' ORDER BY framework) FILTER (y AND NOT x), '') AS detected_only FROM j GROUP BY repo""")
def framework_comparison(spark: SparkSession, d: str) -> DataFrame:
    declared = table(spark, d, "repos_test").where("name is not null").select(F.lower("name").alias("repo"), F.explode("frameworks").alias("x")).select("repo", F.col("x.name").alias("framework")).where("framework is not null").distinct()
    detected = findings(spark, d).select("repo", "framework").where("framework is not null").distinct()
    return S.framework_comparison(declared, detected)


@query(f"""WITH {_FINDINGS} SELECT coalesce(framework, 'unattributed') AS framework, type, count(*) AS n FROM f GROUP BY ALL""")
def framework_site_counts(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).groupBy(F.coalesce("framework", F.lit("unattributed")).alias("framework"), "type").agg(F.count("*").alias("n"))


@query("""
WITH n AS (SELECT DISTINCT lower(name) AS name FROM repos_test WHERE name IS NOT NULL AND name <> ''), p AS (SELECT DISTINCT split_part(lower(name), '/', 1) AS prefix, 'owner' AS label FROM repos_test WHERE name IS NOT NULL)
SELECT n.name, max(p.prefix) AS prefix, 'owner' AS label FROM n JOIN p ON n.name = p.prefix OR (starts_with(n.name, p.prefix) AND substr(n.name, length(p.prefix) + 1, 1) IN ('/', '-', '_', '.')) GROUP BY n.name""")
def longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "repos_test").where("name is not null").select(F.lower("name").alias("name"))
    owners = names.select(F.substring_index("name", "/", 1).alias("owner"), F.lit("owner").alias("label"))
    return M.longest_prefix(names, "name", owners, "owner", "label")


@query(r"""
WITH k AS (SELECT file_id, lower(repo) AS repo, list_filter(string_split(regexp_replace(path, '\.py$', ''), '/'), lambda x: x NOT IN ('', '.', '__init__')) AS p FROM source_files WHERE path LIKE '%.py'),
m AS (SELECT repo, file_id, array_to_string(list_slice(p, i, len(p)), '.') AS module FROM k, unnest(generate_series(1, len(p))) AS g(i))
SELECT repo, module, min(file_id) AS file_id FROM m GROUP BY repo, module HAVING count(DISTINCT file_id) = 1""")
def unambiguous_modules(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "source_files").where("path like '%.py'").select(F.lower("repo").alias("repo"), "file_id", F.explode(T.module_keys(F.col("path"))).alias("module"))
    return files.groupBy("repo", "module").agg(F.min("file_id").alias("file_id"), F.max("file_id").alias("m")).where("file_id = m").drop("m")


@query(f"""
SELECT lower(repo) AS repo, count(*) AS total_files, count(*) FILTER (ok AND language IS NOT NULL AND size <= 2097152) AS scanned, count(*) FILTER (NOT ok) AS excluded FROM (
  SELECT repo, size, NOT list_has_any(string_split(path, '/'), [{", ".join(f"'{x}'" for x in T.EXCLUDED_FOLDERS)}]) AND NOT regexp_matches(path, '{T.TEST_NAMES}') AS ok,
  CASE WHEN lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ({", ".join(f"'{x}'" for x in T.SUFFIX_LANGUAGES)}) THEN 1 END AS language FROM source_files) GROUP BY 1""")
def path_filters(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "source_files").withColumn("ok", T.scanned_path(F.col("path"))).withColumn("language", T.suffix_language(F.col("path")))
    return files.groupBy(F.lower("repo").alias("repo")).agg(F.count("*").alias("total_files"), F.count_if(F.col("ok") & F.col("language").isNotNull() & (F.col("size") <= 2 * 1024 * 1024)).alias("scanned"), F.count_if(~F.col("ok")).alias("excluded"))


@query(r"""SELECT lower(repo) AS repo, lower(regexp_extract(path, '(\.[^./]+)$', 1)) AS suffix, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM source_files GROUP BY 1, 2""")
def suffix_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").groupBy(F.lower("repo").alias("repo"), T.suffix(F.col("path")).alias("suffix")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("""SELECT doc_id, CASE WHEN length(text) > 3000 THEN substr(text, 1, 3000) || chr(10) || '... [truncated]' ELSE text END AS text FROM documents""")
def truncated_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.truncated(F.col("text"), 3000).alias("text"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT doc_id AS a, b FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS b FROM documents WHERE text <> '') WHERE doc_id <> b)
SELECT a AS node, b AS root FROM e UNION SELECT b, b FROM e""")
def copy_components(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text <> ''").select("doc_id", F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("t"))
    first = docs.groupBy("t").agg(F.min("doc_id").alias("b"))
    return components(docs.join(first, "t").select(F.col("doc_id").alias("a"), "b"))


@query(f"""WITH {_FINDINGS} SELECT repo, file, line, type, CAST(row_number() OVER (PARTITION BY repo, file ORDER BY line NULLS LAST, list_position(['skill', 'agent', 'store', 'call', 'write', 'read', 'tool_use', 'agent_marker', 'tool_definition', 'confirmed_tool_definition', 'custom_agent'], type) NULLS LAST, name NULLS LAST, framework NULLS LAST, matched NULLS LAST) AS INTEGER) AS place
FROM (SELECT DISTINCT repo, file, line, type, name, framework, matched FROM f)""")
def ordered_findings(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    kind = F.nullif(F.array_position(F.array(*[F.lit(t) for t in S.TYPES]), F.col("type")), F.lit(0))
    last = [F.asc_nulls_last(c) for c in ("line", kind, "name", "framework", "matched")]
    rows = findings(spark, d).select("repo", "file", "line", "type", "name", "framework", "matched").distinct()
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("repo", "file").orderBy(*last))).select("repo", "file", "line", "type", "place")


@query(f"SELECT row_id FROM repos_test r WHERE name IS NOT NULL AND EXISTS (SELECT 1 FROM findings f WHERE lower(f.repo_name) = lower(r.name))")
def scanned_repos(spark: SparkSession, d: str) -> DataFrame:
    keep = table(spark, d, "findings").select(F.lower("repo_name").alias("k")).distinct()
    repos = table(spark, d, "repos_test").where("name is not null")
    return repos.join(keep, F.lower("name") == F.col("k"), "left_semi").select("row_id")


@query("""
WITH n AS (SELECT judge, processed_at, url, error IS NOT NULL AS f, row_number() OVER (PARTITION BY judge ORDER BY processed_at, url) AS i FROM votes),
g AS (SELECT judge, processed_at, i - row_number() OVER (PARTITION BY judge ORDER BY i) AS g FROM n WHERE f)
SELECT judge, min(processed_at) AS started, count(*) AS n FROM g GROUP BY judge, g HAVING count(*) >= 3""")
def failure_runs(spark: SparkSession, d: str) -> DataFrame:
    return S.failure_runs(table(spark, d, "votes"), "judge", ["processed_at", "url"], F.col("error").isNotNull(), 3)


@query(f"""WITH {_FINDINGS} SELECT repo, 'agent' AS source, tool, count(*) AS n FROM (SELECT repo, unnest(tools_bound) AS tool FROM f WHERE type = 'agent') WHERE tool IS NOT NULL GROUP BY ALL
UNION ALL SELECT repo, 'custom_agent', tool, count(*) FROM (SELECT repo, unnest(tool_names) AS tool FROM f WHERE type = 'custom_agent') WHERE tool IS NOT NULL GROUP BY ALL
UNION ALL SELECT repo, 'definition', name, count(*) FROM f WHERE type = 'confirmed_tool_definition' AND name IS NOT NULL GROUP BY ALL""")
def tools_evidence(spark: SparkSession, d: str) -> DataFrame:
    return S.tools_evidence(findings(spark, d)).groupBy("repo", "source", "tool").agg(F.count("*").alias("n"))


@query(f"""WITH {_FINDINGS} SELECT repo, file, name, arg_max(framework, line) AS framework, max(line) AS line FROM
(SELECT repo, file, name, line, max(framework) AS framework FROM f WHERE type IN ('agent', 'store') AND name IS NOT NULL AND framework IS NOT NULL GROUP BY ALL) GROUP BY repo, file, name""")
def last_creation(spark: SparkSession, d: str) -> DataFrame:
    rows = findings(spark, d).where("type in ('agent', 'store') and name is not null and framework is not null").groupBy("repo", "file", "name", "line").agg(F.max("framework").alias("framework"))
    return rows.groupBy("repo", "file", "name").agg(F.max_by("framework", "line").alias("framework"), F.max("line").alias("line"))


@query(f"""WITH {_FINDINGS}, made AS (SELECT DISTINCT repo, framework FROM f WHERE type IN ('agent', 'store') AND framework IS NOT NULL), named AS (SELECT DISTINCT repo, framework FROM f WHERE framework IS NOT NULL)
SELECT n.repo, n.framework, m.framework IS NOT NULL AS instantiated FROM named n LEFT JOIN made m ON n.repo = m.repo AND n.framework = m.framework""")
def framework_usage(spark: SparkSession, d: str) -> DataFrame:
    rows = findings(spark, d).where("framework is not null")
    return rows.groupBy("repo", "framework").agg(F.bool_or(F.col("type").isin("agent", "store")).alias("instantiated"))


@query(rf"""WITH {_FINDINGS}, m AS (SELECT DISTINCT lower(repo) AS repo, regexp_extract(unnest(regexp_extract_all(text, '(?m)^\s*(?:from|import)\s+(?:.*\bfrom\s+)?[''"]?([@A-Za-z][\w./@-]*)', 1)), '^(@[^/]+/[^/]+|[^/.]+)', 1) AS dependency FROM source_files WHERE text IS NOT NULL),
x AS (SELECT repo, framework, 3 AS n FROM f WHERE type IN ('agent', 'store')
UNION ALL SELECT m.repo, r.name, 2 FROM m JOIN (SELECT name, unnest(dependencies) AS dependency FROM framework_registry) r USING (dependency)
UNION ALL SELECT lower(name), x.name, 1 FROM (SELECT name, unnest(frameworks) AS x FROM repos_test))
SELECT repo, framework, CASE max(n) WHEN 3 THEN 'instantiated' WHEN 2 THEN 'imported' ELSE 'declared' END AS stage FROM x WHERE repo IS NOT NULL AND framework IS NOT NULL GROUP BY repo, framework""")
def framework_stages(spark: SparkSession, d: str) -> DataFrame:
    """Instantiated; imported but not instantiated; declared but neither."""
    made = findings(spark, d).where("type in ('agent', 'store')").select("repo", "framework")
    files = table(spark, d, "source_files")
    imported = M.imported_frameworks(files, table(spark, d, "framework_registry")).join(files.select("file_id", F.lower("repo").alias("repo")), "file_id").select("repo", "framework")
    declared = table(spark, d, "repos_test").select(F.lower("name").alias("repo"), F.explode("frameworks").alias("x")).select("repo", F.col("x.name").alias("framework"))
    return S.framework_stages(made, imported, declared)


@query("SELECT lower(keyword) AS keyword, string_agg(name, ',' ORDER BY name) AS frameworks FROM (SELECT DISTINCT name, unnest(keywords) AS keyword FROM framework_registry) GROUP BY 1")
def keyword_index(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "framework_registry").select("name", F.explode("keywords").alias("keyword")).distinct()
    return rows.groupBy(F.lower("keyword").alias("keyword")).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("frameworks"))


@query("SELECT lower(name) AS name, count(*) AS n, count(DISTINCT url) AS n_urls FROM repos_test WHERE name IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "repos_test").where("name is not null").groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n"), F.countDistinct("url").alias("n_urls")).where("n > 1")


@query(r"""
WITH s AS (SELECT lower(repo) AS repo, lower(regexp_extract(path, '(\.[^./]+)$', 1)) AS suffix, CAST(sum(size) AS BIGINT) AS bytes FROM source_files GROUP BY 1, 2)
SELECT repo, suffix, bytes, bytes * 100.0::DOUBLE / sum(bytes) OVER (PARTITION BY repo) AS percentage FROM s""")
def byte_shares(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    by = table(spark, d, "source_files").groupBy(F.lower("repo").alias("repo"), T.suffix(F.col("path")).alias("suffix")).agg(F.sum("size").alias("bytes"))
    return by.withColumn("percentage", F.col("bytes") * F.lit(100.0) / F.sum("bytes").over(Window.partitionBy("repo")))


@query(f"SELECT judge, count(*) AS total, count(*) FILTER (error IS NULL) AS successful, count(*) FILTER (error IS NOT NULL) AS failed FROM votes GROUP BY judge")
def judge_counters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "votes").groupBy("judge").agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("successful"), F.count_if(F.col("error").isNotNull()).alias("failed"))
