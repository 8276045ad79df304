"""Queries with rule tables, imports and exports, answers and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import manifest as M
from tessera.operators import rules as R
from tessera.operators import scanning as S
from tessera.operators import screening as J
from tessera.plans.core import query
from tessera.plans.reference import _ANSWERS, _FINDINGS, _KEY, findings, latest
from tessera.sources.tables import table

#: A rule that names no framework, beside those of the registry.
GENERIC = ("an import", "from ")
_RULES = f"""g AS (SELECT DISTINCT name AS label, unnest(keywords) AS pattern, false AS is_generic FROM framework_registry UNION ALL SELECT '{GENERIC[0]}', '{GENERIC[1]}', true),
rules AS (SELECT *, row_number() OVER (ORDER BY is_generic, -length(pattern), label) AS rank FROM g WHERE pattern IS NOT NULL AND pattern <> '')"""


def rule_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "framework_registry").select(F.col("name").alias("label"), F.explode("keywords").alias("pattern"), F.lit(False).alias("is_generic"))
    return rows.unionByName(spark.createDataFrame([(*GENERIC, True)], "label string, pattern string, is_generic boolean")).where("pattern is not null and pattern <> ''").distinct()


def rule_list(spark: SparkSession, d: str) -> list[dict]:
    return [r.asDict() for r in rule_rows(spark, d).orderBy("label").collect()]  # a hand-made dimension


@query(f"WITH {_RULES} SELECT label, pattern, is_generic, CAST(rank AS INTEGER) AS rank FROM rules")
def rule_dimension(spark: SparkSession, d: str) -> DataFrame:
    """The rules in the order in which they are tried."""
    ordered = R.ranked(rule_list(spark, d))
    return spark.createDataFrame([(r["label"], r["pattern"], r["is_generic"], i) for i, r in enumerate(ordered, 1)], "label string, pattern string, is_generic boolean, rank int")


_IMPORTED = r"""
im AS (SELECT DISTINCT file_id, regexp_extract(unnest(regexp_extract_all(text, '(?m)^\s*(?:from|import)\s+(?:.*\bfrom\s+)?[''"]?([@A-Za-z][\w./@-]*)', 1)), '^(@[^/]+/[^/]+|[^/.]+)', 1) AS dependency FROM source_files WHERE text IS NOT NULL),
imported AS (SELECT DISTINCT file_id, framework FROM im JOIN (SELECT DISTINCT name AS framework, unnest(dependencies) AS dependency FROM framework_registry) USING (dependency))"""


@query(rf"""WITH {_RULES}, {_IMPORTED},
l AS (SELECT file_id, CAST(i AS INTEGER) AS line, x[i] AS content FROM (SELECT file_id, string_split(text, chr(10)) AS x FROM source_files WHERE text IS NOT NULL), unnest(generate_series(1, len(x))) AS g(i) WHERE regexp_matches(x[i], '^\s*(?:from|import)\b')),
m AS (SELECT l.file_id, l.line, r.label, r.rank, r.is_generic, r.is_generic OR i.file_id IS NOT NULL AS told FROM l LEFT JOIN rules r ON contains(l.content, r.pattern) LEFT JOIN imported i ON i.file_id = l.file_id AND i.framework = r.label)
SELECT file_id, line, arg_min(label, rank) AS role, arg_min(label, rank) FILTER (told) AS confirmed FROM m GROUP BY file_id, line""")
def ranked_match(spark: SparkSession, d: str) -> DataFrame:
    """For each import line, the first rule by rank, and the first one that the file's imports confirm."""
    files, rules = table(spark, d, "source_files"), rule_list(spark, d)
    rows = S.lines(files).where(F.col("content").rlike(r"^\s*(?:from|import)\b"))
    imported = M.imported_frameworks(files, table(spark, d, "framework_registry")).groupBy("file_id").agg(F.collect_set("framework").alias("imported"))
    told = rows.join(imported, "file_id", "left")
    return told.select("file_id", "line", R.first_label(F.col("content"), rules).alias("role"), R.first_label(F.col("content"), rules, F.col("imported")).alias("confirmed"))


@query(f"""WITH {_RULES} SELECT file_id, label, n FROM (SELECT s.file_id, r.label, CAST(sum((length(s.text) - length(replace(s.text, r.pattern, ''))) / length(r.pattern)) AS BIGINT) AS n FROM source_files s JOIN rules r ON contains(s.text, r.pattern) GROUP BY ALL) WHERE n > 0""")
def pattern_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The hits of each label's patterns in each text."""
    return R.sweep(table(spark, d, "source_files"), "file_id", "text", rule_list(spark, d))


@query(f"""WITH {_FINDINGS} SELECT repo, coalesce(framework, 'unattributed') AS framework, count(*) AS n, count(DISTINCT type) AS n_types FROM f GROUP BY ALL""")
def flat_frameworks(spark: SparkSession, d: str) -> DataFrame:
    """Each framework's findings over all categories."""
    by = findings(spark, d).groupBy("repo", F.coalesce("framework", F.lit("unattributed")).alias("framework"), "type").agg(F.count("*").alias("n"))
    return by.groupBy("repo", "framework").agg(F.sum("n").alias("n"), F.count("*").alias("n_types"))


_PY_MODULES = r"""pm AS (SELECT lower(repo) AS repo, unnest(regexp_extract_all(text, '(?m)^[ \t]*(?:from|import)[ \t]+([A-Za-z_][\w.]*)', 1)) AS module FROM source_files WHERE text IS NOT NULL AND regexp_matches(path, '(?i)\.py$'))"""


def python_modules(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "source_files").where("text is not null").where(F.col("path").rlike(r"(?i)\.py$"))
    return files.select(F.lower("repo").alias("repo"), F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^[ \t]*(?:from|import)[ \t]+([A-Za-z_][\w.]*)"), 1)).alias("module"))


_ROOTS = "ro AS (SELECT dep AS module, min(name) AS framework FROM (SELECT name, replace(unnest(dependencies), '-', '_') AS dep FROM framework_registry) WHERE dep NOT LIKE '%/%' GROUP BY 1)"


def python_roots(spark: SparkSession, d: str) -> DataFrame:
    deps = table(spark, d, "framework_registry").select("name", F.explode("dependencies").alias("dep")).where("dep not like '%/%'")
    return deps.groupBy(F.replace(F.col("dep"), F.lit("-"), F.lit("_")).alias("module")).agg(F.min("name").alias("framework"))


_MODULE_FRAMEWORK = "mf AS (SELECT DISTINCT pm.module, coalesce(ro.framework, CASE WHEN starts_with(split_part(pm.module, '.', 1), 'langchain_') THEN 'LangChain' END) AS framework FROM pm LEFT JOIN ro ON ro.module = split_part(pm.module, '.', 1))"


@query(f"WITH {_PY_MODULES}, {_ROOTS}, {_MODULE_FRAMEWORK} SELECT module, framework FROM mf WHERE framework IS NOT NULL")
def module_frameworks(spark: SparkSession, d: str) -> DataFrame:
    """Python modules and the frameworks that they belong to."""
    return M.module_framework(python_modules(spark, d), python_roots(spark, d))


_OWN = r"""own AS (SELECT DISTINCT lower(repo) AS repo, array_to_string(list_slice(p, i, len(p)), '.') AS module FROM (SELECT repo, list_filter(string_split(regexp_replace(path, '\.py$', ''), '/'), lambda x: x NOT IN ('', '.', '__init__')) AS p FROM source_files WHERE regexp_matches(path, '(?i)\.py$')), unnest(generate_series(1, len(p))) AS g(i))"""


@query(rf"""WITH {_PY_MODULES}, {_ROOTS}, {_MODULE_FRAMEWORK}, {_OWN}
SELECT pm.repo, mf.framework, count(*) AS n FROM pm JOIN mf USING (module) WHERE mf.framework IS NOT NULL AND NOT EXISTS (SELECT 1 FROM own WHERE own.repo = pm.repo AND (own.module = pm.module OR own.module = regexp_replace(pm.module, '\.[^.]*$', ''))) GROUP BY ALL""")
def framework_uses(spark: SparkSession, d: str) -> DataFrame:
    """How often each repository imports a framework, without modules of its own."""
    rows = python_modules(spark, d)
    named = rows.join(M.module_framework(rows, python_roots(spark, d)), "module")
    return S.without_local(named, table(spark, d, "source_files")).groupBy("repo", "framework").agg(F.count("*").alias("n"))


_SCRIPT = r"""(?m)(?:\bfrom\s+|\brequire\(\s*|^\s*import\s+)['"]([^'"\n]+)['"]"""


@query(rf"""WITH j AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_SCRIPT.replace("'", "''")}', 1)) AS module FROM source_files WHERE text IS NOT NULL AND regexp_matches(path, '(?i)\.[cm]?[jt]sx?$')),
e AS (SELECT dep AS entry, min(name) AS framework FROM (SELECT name, unnest(dependencies) AS dep FROM framework_registry UNION ALL SELECT name, regexp_extract(dep, '^@[^/]+/', 0) FROM (SELECT name, unnest(dependencies) AS dep FROM framework_registry) WHERE dep LIKE '@%/%') GROUP BY 1),
h AS (SELECT j.module, e.entry, e.framework FROM j JOIN e ON (regexp_matches(e.entry, '[/-]$') AND starts_with(regexp_replace(j.module, '^node:', ''), e.entry)) OR regexp_replace(j.module, '^node:', '') = e.entry OR starts_with(regexp_replace(j.module, '^node:', ''), e.entry || '/') WHERE NOT starts_with(j.module, '.'))
SELECT module, arg_max(entry, length(entry)) AS entry, arg_max(framework, length(entry)) AS framework FROM h GROUP BY module""")
def package_frameworks(spark: SparkSession, d: str) -> DataFrame:
    """Script packages and the longest entry that names each."""
    files = table(spark, d, "source_files").where("text is not null").where(F.col("path").rlike(r"(?i)\.[cm]?[jt]sx?$"))
    modules = files.select(F.explode(F.regexp_extract_all("text", F.lit(_SCRIPT), 1)).alias("module"))
    deps = table(spark, d, "framework_registry").select(F.col("name").alias("framework"), F.explode("dependencies").alias("entry"))
    scopes = deps.select("framework", F.regexp_extract("entry", "^@[^/]+/", 0).alias("entry")).where("entry <> ''")
    return M.package_framework(modules, deps.unionByName(scopes).groupBy("entry").agg(F.min("framework").alias("framework")))


def made_objects(spark: SparkSession, d: str) -> DataFrame:
    """``file_id, kind, name, framework`` of agents and stores that findings name in known files."""
    found = findings(spark, d).where("type in ('agent', 'store') and name is not null").select("repo", "file", F.col("type").alias("kind"), "name", "framework")
    files = table(spark, d, "source_files").select("file_id", F.lower("repo").alias("repo"), F.col("path").alias("file"))
    return found.join(files, ["repo", "file"]).select("file_id", "kind", "name", "framework").distinct()


@query(rf"""WITH {_FINDINGS}, md AS (SELECT DISTINCT s.file_id, s.path, f.repo, f.type AS kind, f.name, f.framework FROM f JOIN source_files s ON lower(s.repo) = f.repo AND s.path = f.file WHERE f.type IN ('agent', 'store') AND f.name IS NOT NULL AND f.name NOT LIKE '%.%'),
mk AS (SELECT md.*, array_to_string(list_slice(p, i, len(p)), '.') AS module FROM (SELECT *, list_filter(string_split(regexp_replace(path, '\.py$', ''), '/'), lambda x: x NOT IN ('', '.', '__init__')) AS p FROM md WHERE regexp_matches(path, '(?i)\.py$')) md, unnest(generate_series(1, len(p))) AS g(i)
 UNION ALL SELECT *, NULL, path FROM md WHERE regexp_matches(path, '(?i)\.[cm]?[jt]sx?$')),
b AS (SELECT DISTINCT repo, module, name FROM (SELECT repo, module, name, kind FROM mk GROUP BY ALL HAVING count(DISTINCT file_id) > 1))
SELECT repo, module, name, kind, min(framework) AS framework, min(file_id) AS made_in FROM mk ANTI JOIN b ON mk.repo = b.repo AND mk.module = b.module AND mk.name = b.name GROUP BY repo, module, name, kind""")
def exported_names(spark: SparkSession, d: str) -> DataFrame:
    """What files offer to import, without what two files offer under one name."""
    return S.exported_names(table(spark, d, "source_files"), made_objects(spark, d))


@query()
def imported_objects(spark: SparkSession, d: str) -> DataFrame:
    """Imported names joined with what other files export."""
    return S.imported_objects(table(spark, d, "source_files"), made_objects(spark, d))


@query(r"""WITH RECURSIVE q AS (SELECT DISTINCT file_id, regexp_extract(line, '(?m)^[ \t]*(?:(?:const|let|var)[ \t]+)?([A-Za-z_]\w*)[ \t]*=[ \t]*([A-Za-z_]\w*)[ \t]*;?[ \t]*$', 1) AS x, regexp_extract(line, '(?m)^[ \t]*(?:(?:const|let|var)[ \t]+)?([A-Za-z_]\w*)[ \t]*=[ \t]*([A-Za-z_]\w*)[ \t]*;?[ \t]*$', 2) AS y
 FROM (SELECT file_id, unnest(regexp_extract_all(text, '(?m)^[ \t]*(?:(?:const|let|var)[ \t]+)?([A-Za-z_]\w*)[ \t]*=[ \t]*([A-Za-z_]\w*)[ \t]*;?[ \t]*$')) AS line FROM (SELECT file_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS text FROM source_files WHERE text IS NOT NULL))),
e0 AS (SELECT * FROM q WHERE x <> y AND y NOT IN ('None', 'True', 'False', 'null', 'undefined', 'true', 'false', 'this', 'self')), e AS (SELECT file_id, x, y FROM e0 UNION SELECT file_id, y, x FROM e0),
r AS (SELECT file_id, x AS name, x AS reached FROM e UNION SELECT r.file_id, r.name, e.y FROM r JOIN e ON e.file_id = r.file_id AND e.x = r.reached)
SELECT file_id, name, min(reached) AS root FROM r GROUP BY ALL""")
def alias_groups(spark: SparkSession, d: str) -> DataFrame:
    """Variables that hold the same thing."""
    return R.alias_groups(table(spark, d, "source_files"))


_HOST = "codeforge.example"


@query(rf"""SELECT row_id, x AS at_host, p[1] || '/' || p[2] AS owner_repo, NOT contains(lower(coalesce(url, '')), '{_HOST}') AS elsewhere FROM (SELECT row_id, url, nullif(regexp_replace(regexp_extract(trim(url), '(?i)^(?:https?://)?(?:www\.)?codeforge\.example/([^/?#\s]+/[^/?#\s]+)', 1), '\.git$', ''), '') AS x,
CASE WHEN len(q) >= 2 AND q[1] <> '' AND q[2] <> '' THEN [q[1], regexp_replace(q[2], '\.git$', '')] END AS p FROM (SELECT row_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(trim(url), '^(?:https?://(?:www\.)?[^/]+/|git@[^:]+:|ssh://git@[^/]+/)', ''), '^/+|/+$', '', 'g'), '\.git$', ''), '/') AS q FROM repos_test))""")
def owner_repos(spark: SparkSession, d: str) -> DataFrame:
    """Owner and name of addresses, and addresses elsewhere."""
    return table(spark, d, "repos_test").select("row_id", T.repo_at_host(F.col("url"), _HOST).alias("at_host"), T.owner_repo(F.col("url")).alias("owner_repo"), (~F.contains(F.lower(F.coalesce("url", F.lit(""))), F.lit(_HOST))).alias("elsewhere"))


@query("SELECT row_id, CAST(printf('%.2f', language_percentage) AS DOUBLE) AS share FROM repos_test")
def rounded_shares(spark: SparkSession, d: str) -> DataFrame:
    """shares rounded by their exact value."""
    return table(spark, d, "repos_test").select("row_id", T.rounded(F.col("language_percentage")).alias("share"))


_OBJECT = r"regexp_extract(text, '\{[^{}]*\}', 0)"
_LABEL = f"CASE WHEN json_valid({_OBJECT}) AND {_OBJECT} <> '' THEN CASE WHEN lower(trim(json_extract_string({_OBJECT}, '$.classification'))) IN ('app', 'framework', 'needs_review') THEN lower(trim(json_extract_string({_OBJECT}, '$.classification'))) END END"


@query(f"""WITH x AS (SELECT doc_id, text, lower(text) AS low, {_LABEL} AS said FROM documents)
SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'needs_review' WHEN said IS NOT NULL THEN said WHEN contains(low, 'needs review') OR contains(low, 'needs_review') OR contains(low, 'unclear') OR contains(low, 'ambiguous') THEN 'needs_review'
 WHEN contains(low, 'framework') AND contains(low, 'app') THEN CASE WHEN length(low) - instr(reverse(low), 'krowemarf') - 8 > length(low) - instr(reverse(low), 'ppa') - 2 THEN 'framework' ELSE 'app' END
 WHEN contains(low, 'framework') THEN 'framework' WHEN contains(low, 'app') THEN 'app' ELSE 'needs_review' END AS label, coalesce(said, 'needs_review') AS strict FROM x""")
def answer_labels(spark: SparkSession, d: str) -> DataFrame:
    """texts read as free answers."""
    return table(spark, d, "documents").select("doc_id", T.answer_label(F.col("text")).alias("label"), T.object_label(F.col("text")).alias("strict"))


#: The labels of whole answers.
ANSWER_LABELS = (
    "Agentic Applications", "Non-Agentic Software", "Curated Lists, Courses & Playbooks", "External-Agent Wrappers & Interfaces",
    "Tools & Skills for External Agents", "Templates, Models & Benchmarks", "Needs Review",
)
_KNOWN = ", ".join(f"'{x}'" for x in ANSWER_LABELS)


@query(f"SELECT judge, count(*) AS n, count(*) FILTER (classification IN ({_KNOWN}) AND trim(reasoning) <> '') AS valid, count(*) FILTER (error IS NULL AND coalesce(classification IN ({_KNOWN}), false)) AS done FROM votes GROUP BY judge")
def valid_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers written as objects and read strictly, and answers that need not be asked for again."""
    rows = table(spark, d, "votes").withColumn("answer", F.to_json(F.struct(F.col("classification").alias("label"), F.col("reasoning").alias("reason"))))
    done = J.is_done(F.col("classification"), F.col("error"), ANSWER_LABELS)
    return rows.groupBy("judge").agg(F.count("*").alias("n"), F.count_if(T.valid_answer(F.col("answer"), ANSWER_LABELS).isNotNull()).alias("valid"), F.count_if(done).alias("done"))


_WANTED = "agentic applications"


@query(f"""WITH {_ANSWERS}, rv AS (SELECT max(judge) AS judge FROM l), m AS (SELECT p.url, p.label AS decision FROM p, rv WHERE p.judge = rv.judge AND p.label IS NOT NULL),
k AS (SELECT DISTINCT url AS key FROM l), j AS (SELECT judge FROM l GROUP BY judge ORDER BY judge LIMIT 3),
y AS (SELECT k.key, max(coalesce(p.label, '')) AS high, min(coalesce(p.label, '')) AS low, count(*) AS n FROM k CROSS JOIN j LEFT JOIN p ON p.url = k.key AND p.judge = j.judge GROUP BY 1),
s AS (SELECT y.key, m.decision IS NOT NULL AS reviewed, CASE WHEN low = high AND low <> '' THEN CASE WHEN low = '{_WANTED}' THEN 'judges' ELSE 'other' END WHEN m.decision = '{_WANTED}' THEN 'manual' ELSE 'open' END AS source FROM y LEFT JOIN m ON m.url = y.key)
SELECT source, reviewed, count(*) AS n FROM s GROUP BY ALL""")
def selection_counts(spark: SparkSession, d: str) -> DataFrame:
    """By what repositories are selected when the first three judges must agree, with the last judge's answers as the manual sheet."""
    rows = latest(spark, d).withColumn("label", F.when(J.is_label(F.col("label")), F.lower("label")))
    names = rows.select("judge").distinct()
    three = names.orderBy("judge").limit(3)
    keys = rows.select(F.col("url").alias("key")).distinct()
    given = rows.join(three, "judge", "left_semi").select(F.col("url").alias("key"), "judge", "label")
    answers = keys.crossJoin(F.broadcast(three)).join(given, ["key", "judge"], "left").withColumn("label", F.coalesce("label", F.lit("")))  # three rows
    sheet = rows.join(names.agg(F.max("judge").alias("judge")), "judge", "left_semi").where("label is not null").select(F.col("url").alias("key"), F.col("label").alias("decision"))
    return J.selected(keys, answers, sheet, _WANTED).groupBy("source", "reviewed").agg(F.count("*").alias("n"))


@query(f"""WITH {_FINDINGS}, g AS (SELECT repo, bool_or(type = 'agent') AS agent, bool_or(type = 'write') AS write, bool_or(type = 'custom_agent') AS custom FROM f GROUP BY repo)
SELECT lower(r.name) AS name, coalesce(bool_or(g.agent), false) AS agent, coalesce(bool_or(g.write), false) AS write, coalesce(bool_or(g.custom), false) AS custom, NOT coalesce(bool_or(g.agent OR g.write OR g.custom), false) AS unclassified, count(*) > 1 AS duplicate
FROM repos_test r LEFT JOIN g ON g.repo = lower(r.name) WHERE r.name IS NOT NULL GROUP BY 1""")
def name_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags of names, OR-merged over repeated rows, with names in no set and repeated names."""
    flags = findings(spark, d).groupBy("repo").agg(*[F.bool_or(F.col("type") == t).alias(n) for n, t in (("agent", "agent"), ("write", "write"), ("custom", "custom_agent"))])
    rows = table(spark, d, "repos_test").where("name is not null").groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("_n"))
    told = rows.join(flags, rows["name"] == flags["repo"], "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    return told.select("name", no("agent").alias("agent"), no("write").alias("write"), no("custom").alias("custom"), (~(no("agent") | no("write") | no("custom"))).alias("unclassified"), (F.col("_n") > 1).alias("duplicate"))


@query("SELECT DISTINCT d AS dependency FROM (SELECT unnest(dependencies) AS d FROM framework_registry) WHERE d IS NOT NULL UNION SELECT DISTINCT found_via FROM repos_test WHERE found_via IS NOT NULL")
def search_terms(spark: SparkSession, d: str) -> DataFrame:
    """The union of all dependency names and of all terms that found something."""
    deps = table(spark, d, "framework_registry").select(F.explode("dependencies").alias("dependency")).where("dependency is not null")
    return deps.unionByName(table(spark, d, "repos_test").where("found_via is not null").select(F.col("found_via").alias("dependency"))).distinct()


@query("""SELECT file_id FROM (SELECT file_id FROM source_files ORDER BY file_id LIMIT 100) s ANTI JOIN file_results r ON s.file_id = r.file_id""")
def pending_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Of the first 100 files, those without a result."""
    return M.first_rows(table(spark, d, "source_files").select("file_id"), "file_id", table(spark, d, "file_results"), "file_id", 100)


@query(f"SELECT {_KEY} AS repo_key, strftime(max(processed_at), '%Y-%m-%dT%H:%M:%SZ') AS last_at FROM votes GROUP BY 1")
def latest_times(spark: SparkSession, d: str) -> DataFrame:
    """when each repository was last judged."""
    return table(spark, d, "votes").groupBy(T.repo_key(F.col("url")).alias("repo_key")).agg(T.iso_time(F.max("processed_at")).alias("last_at"))


@query(r"""SELECT category, lower(category_display) AS display, count(*) AS n, count(*) FILTER (len(list_filter(dependencies, lambda x: x LIKE '@%')) > 0) AS scoped FROM framework_registry GROUP BY ALL""")
def registry_lookup(spark: SparkSession, d: str) -> DataFrame:
    """the registry by category and display name, and those with a scoped dependency."""
    scoped = F.exists("dependencies", lambda x: x.startswith("@"))
    return table(spark, d, "framework_registry").groupBy("category", F.lower("category_display").alias("display")).agg(F.count("*").alias("n"), F.count_if(scoped).alias("scoped"))


@query("""
WITH n AS (SELECT DISTINCT lower(name) AS name FROM repos_test WHERE name IS NOT NULL AND name <> ''), p AS (SELECT DISTINCT split_part(lower(name), '/', 1) AS prefix, 'owner' AS label FROM repos_test WHERE name IS NOT NULL)
SELECT n.name, max(p.prefix) AS prefix, 'owner' AS label FROM n JOIN p ON n.name = p.prefix OR (starts_with(n.name, p.prefix) AND substr(n.name, length(p.prefix) + 1, 1) IN ('/', '-', '_', '.')) GROUP BY n.name""")
def longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "repos_test").where("name is not null").select(F.lower("name").alias("name"))
    owners = names.select(F.substring_index("name", "/", 1).alias("owner"), F.lit("owner").alias("label"))
    return M.longest_prefix(names, "name", owners, "owner", "label")
