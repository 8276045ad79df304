"""Operators over source lines and findings: markers, windows of lines, as-of lookups, ranked patterns, stores, and the roll-up by repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import SANITIZER_WORDS, module_keys, plain_folders, script_paths, store_role, suffix_language


#: Fixed value: the order of findings of one line.
TYPES = ("skill", "agent", "store", "call", "write", "read", "tool_use", "agent_marker", "tool_definition", "confirmed_tool_definition", "custom_agent")


def lines(files: DataFrame, key: str = "file_id") -> DataFrame:
    """``key, line, content`` with lines from 1."""
    return files.where("text is not null").select(key, F.posexplode(F.split("text", "\n")).alias("p", "content")).select(key, (F.col("p") + 1).alias("line"), "content")


def line_markers(files: DataFrame, pattern: str) -> DataFrame:
    """``file_id, line, matched``: the first hit of ``pattern`` in each line. Texts without a hit are passed over before they are split."""
    return lines(files.where(F.col("text").rlike(pattern))).where(F.col("content").rlike(pattern)).select("file_id", "line", F.regexp_extract("content", pattern, 0).alias("matched"))


def near_check(files: DataFrame, site: str, words: tuple[str, ...] = SANITIZER_WORDS, above: int = 4) -> DataFrame:
    """``file_id, line, checked``: whether the line of a ``site`` or one of the ``above`` lines before it has a word of a check.

    Each text is split once; the lines above are looked up in the file's own line array: no join of lines with lines.
    """
    split = files.where(F.col("text").rlike(site)).select("file_id", F.explode(F.array(F.split("text", "\n"))).alias("lines"))  # the generator keeps the split from being made for every line
    near = lambda i: F.greatest(*[F.coalesce(F.lower(F.get("lines", i - k)).rlike("|".join(words)), F.lit(False)) for k in range(above + 1)])
    at = F.transform("lines", lambda x, i: F.when(x.rlike(site), F.struct((i + 1).alias("line"), near(i).alias("checked"))))
    return split.select("file_id", F.explode(F.filter(at, lambda x: x.isNotNull())).alias("x")).select("file_id", "x.line", "x.checked")


def as_of(uses: DataFrame, made: DataFrame, keys: list[str], at: str, payload: list[str]) -> DataFrame:
    """``uses`` with the ``payload`` of the last of ``made`` at or before the use; where none is before, of the first after.

    Both sides go through one window by ``keys`` in the order of ``at``: one shuffle, no pairs of uses with all that was made.
    """
    cols = [c for c in uses.columns if c not in keys and c != at]
    value = F.struct(F.col(at).alias("made_at"), *payload)
    both = uses.select(*keys, at, F.struct(*cols).alias("_u"), F.lit(None).cast(made.select(value.alias("v")).schema["v"].dataType).alias("_m"), F.lit(1).alias("_o")).unionByName(
        made.select(*keys, at, F.lit(None).cast(uses.select(F.struct(*cols).alias("v")).schema["v"].dataType).alias("_u"), value.alias("_m"), F.lit(0).alias("_o"))
    )
    w = Window.partitionBy(*keys).orderBy(at, "_o")
    before = F.last("_m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_m", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return both.select(*keys, at, "_u", "_o", F.coalesce(before, after).alias("_hit")).where("_o = 1").select(*keys, at, "_u.*", *[F.col(f"_hit.{c}").alias(c) for c in ["made_at", *payload]])


def plain_file(file: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(file), r"\\", "/"), r"^(\./|/)+", "")


def distinct_findings(findings: DataFrame) -> DataFrame:
    """Findings without repeated rows, with plain paths and repository names in lower case."""
    cols = ["line", "type", "name", "framework", "matched", "unsanitized", "store", "source"]
    return findings.select(F.lower("repo_name").alias("repo"), plain_file(F.col("file")).alias("file"), *cols, "tools_bound", "tool_names").distinct()


#: Fixed value: how a store's id names the place where it is made.
STORE_PLACE = r"^(.*):(\d+):(\d+)$"


def store_usage(findings: DataFrame) -> DataFrame:
    """``repo, file, line, store, framework, n_writes, n_reads, role, known`` of all stores that are made or that sites refer to.

    A site belongs to the store made at the place that its store's id names. Stores that nothing refers to have no sites; sites whose store is made nowhere are not ``known``.
    """
    made = findings.where("type = 'store' and line is not null").groupBy("repo", "file", "line").agg(F.min("framework").alias("framework"))
    part = lambda i: F.nullif(F.regexp_extract("store", STORE_PLACE, i), F.lit(""))
    sites = (
        findings.where("store is not null and type in ('write', 'read')").groupBy("repo", "store").agg(F.count_if(F.col("type") == "write").alias("n_writes"), F.count_if(F.col("type") == "read").alias("n_reads"))
        .select("repo", part(1).alias("file"), part(2).try_cast("int").alias("line"), "store", "n_writes", "n_reads")
    )
    both = made.withColumn("known", F.lit(True)).join(sites, ["repo", "file", "line"], "full").withColumn("known", F.coalesce("known", F.lit(False))).na.fill(0, ["n_writes", "n_reads"])
    return both.select("repo", "file", "line", "store", "framework", "n_writes", "n_reads", store_role(F.col("n_writes"), F.col("n_reads")).alias("role"), "known")


def shared_stores(links: DataFrame, usage: DataFrame) -> DataFrame:
    """``repo, shared_across_agents, rag_writers, rag_readers``: which agents are linked with the stores that are written or read.

    ``links (repo, store, agent)``; links with stores that are not known, and without an agent, say nothing.
    """
    known = links.where("agent is not null").distinct().join(usage.where("known and store is not null").select("repo", "store", "n_writes", "n_reads"), ["repo", "store"])
    by = known.groupBy("repo", "store").agg(F.count("*").alias("n")).groupBy("repo").agg((F.max("n") >= 2).alias("shared_across_agents"))
    names = lambda n: F.array_join(F.array_sort(F.collect_set(F.when(F.col(n) > 0, F.col("agent")))), ",")
    return by.join(known.groupBy("repo").agg(names("n_writes").alias("rag_writers"), names("n_reads").alias("rag_readers")), "repo")


def custom_agents(findings: DataFrame) -> DataFrame:
    """``repo, file, name, first_line, framework, matched, tool_names``: custom agents by file and variable, with what their first finding says; tool names are null where none is known."""
    tools = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("tool_names", F.array().cast("array<string>"))))))
    return (
        findings.where("type = 'custom_agent'").groupBy("repo", "file", "name").agg(F.min("line").alias("first_line"), F.min(F.struct(F.coalesce("line", F.lit(-1)), F.coalesce("framework", F.lit("")).alias("f"), F.coalesce("matched", F.lit("")).alias("m"))).alias("x"), tools.alias("t"))
        .select("repo", "file", "name", "first_line", F.col("x.f").alias("framework"), F.col("x.m").alias("matched"), F.when(F.size("t") > 0, F.array_join("t", ",")).alias("tool_names"))
    )


def repository_summary(findings: DataFrame, skills: DataFrame) -> DataFrame:
    """One row for each repository of ``findings`` and ``skills (repo, path)``: counts, distinct names, and whether a write went unchecked.

    Every finding gives a few narrow facts (kind, value); one grouping makes them distinct and counts them, a second one adds them up by
    repository. Both combine before their shuffle, so that a repository with very many findings is no hot group.
    """
    none = F.array().cast("array<string>")
    kind = F.col("type")
    fact = lambda name, value: F.struct(F.lit(name).alias("kind"), value.alias("value"))
    facts = lambda name, values: F.transform(F.coalesce(values, none), lambda v: fact(name, v))
    named = F.col("name").isNotNull()
    empty = F.array().cast("array<struct<kind:string,value:string>>")
    site = F.concat(F.regexp_extract("store", STORE_PLACE, 1), F.lit(":"), F.regexp_extract("store", STORE_PLACE, 2))
    said = F.concat(
        F.array(fact("type", kind)),
        F.when(kind == "agent", facts("tool", F.col("tools_bound"))).when(kind == "custom_agent", F.concat(facts("tool", F.col("tool_names")), facts("llm_tool", F.col("tool_names")), F.array(fact("custom", F.to_json(F.struct("file", "name"))))))
        .when((kind == "confirmed_tool_definition") & named, F.array(fact("tool", F.col("name")), fact("confirmed", F.lit("")))).when(kind == "store", F.array(fact("store_framework", F.col("framework")), fact("made", F.concat_ws(":", "file", F.col("line").cast("string")))))
        .when(kind == "write", F.array(fact("write_framework", F.col("framework")), fact("written", site), fact("unsanitized", F.when(F.col("unsanitized"), F.lit("yes"))))).when(kind == "read", F.array(fact("read_framework", F.col("framework")), fact("read", site))).otherwise(empty),
    )
    rows = findings.select("repo", F.explode(F.filter(said, lambda x: x["value"].isNotNull())).alias("x")).select("repo", "x.*").unionByName(skills.select("repo", F.lit("skill").alias("kind"), F.col("path").alias("value")))
    place = F.when(F.col("kind").isin("made", "written", "read"), F.lit("place")).otherwise(F.col("kind"))
    flags = [F.bool_or(F.col("kind") == k).alias(k) for k in ("made", "written", "read")]
    by = rows.groupBy("repo", place.alias("sort"), "value").agg(F.count("*").alias("n"), *flags)
    of_type = lambda t: F.coalesce(F.sum(F.when((F.col("sort") == "type") & (F.col("value") == t), F.col("n"))), F.lit(0))
    distinct = lambda sort: F.count_if(F.col("sort") == sort)
    names = lambda sort: F.array_join(F.array_sort(F.collect_set(F.when(F.col("sort") == sort, F.col("value")))), ",")
    total = by.groupBy("repo").agg(
        of_type("agent").alias("n_agents"), distinct("custom").alias("n_custom_agents"), distinct("tool").alias("n_tools"), distinct("skill").alias("n_skills"), of_type("store").alias("n_stores"), of_type("write").alias("n_writes"), of_type("read").alias("n_reads"),
        of_type("tool_definition").alias("n_tool_markers"), F.coalesce(F.sum(F.when(F.col("sort") == "confirmed", F.col("n"))), F.lit(0)).alias("n_confirmed_tool_definitions"), (distinct("unsanitized") > 0).alias("unsanitized_writes"),
        F.count_if((F.col("sort") == "place") & F.col("made") & F.col("written")).alias("n_stores_written"), F.count_if((F.col("sort") == "place") & F.col("made") & F.col("read")).alias("n_stores_read"),
        names("llm_tool").alias("llm_tool_names"), names("store_framework").alias("store_frameworks"), names("write_framework").alias("rag_write_frameworks"), names("read_framework").alias("rag_read_frameworks"),
    )
    return total.withColumn("has_rag", F.col("n_stores") > 0).withColumn("has_confirmed_llm_tool_calling", F.col("n_custom_agents") > 0)


#: Fixed value: the fields of which histograms are made.
COUNT_FIELDS = ("n_agents", "n_custom_agents", "n_tools", "n_skills", "n_stores")


def histograms(summary: DataFrame, fields: list[str]) -> DataFrame:
    """``field, value, n_repos`` of each field, in one pass."""
    return summary.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("bigint").alias("value")) for f in fields])).alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n_repos"))


def framework_comparison(declared: DataFrame, detected: DataFrame) -> DataFrame:
    """``repo, agrees, declared_only, detected_only`` as sorted names; both sides are ``repo, framework``."""
    tagged = declared.select("repo", "framework", F.lit(1).alias("d"), F.lit(0).alias("f")).unionByName(detected.select("repo", "framework", F.lit(0).alias("d"), F.lit(1).alias("f")))
    by = tagged.groupBy("repo", "framework").agg(F.max("d").alias("d"), F.max("f").alias("f"))
    names = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("framework")))), ",")
    return by.groupBy("repo").agg(names((F.col("d") == 1) & (F.col("f") == 1)).alias("agrees"), names((F.col("d") == 1) & (F.col("f") == 0)).alias("declared_only"), names((F.col("d") == 0) & (F.col("f") == 1)).alias("detected_only"))


def framework_stages(made: DataFrame, imported: DataFrame, declared: DataFrame) -> DataFrame:
    """``repo, framework, stage``: the furthest of declared, imported and instantiated; all sides are ``repo, framework``."""
    tagged = made.withColumn("n", F.lit(3)).unionByName(imported.withColumn("n", F.lit(2))).unionByName(declared.withColumn("n", F.lit(1)))
    stage = F.when(F.max("n") == 3, "instantiated").when(F.max("n") == 2, "imported").otherwise("declared")
    return tagged.where("repo is not null and framework is not null").groupBy("repo", "framework").agg(stage.alias("stage"))


def failure_runs(rows: DataFrame, by: str, order: list[str], failed: Column, least: int, span: Column | None = None) -> DataFrame:
    """``by, started, n``: runs of at least ``least`` failures in a row.

    Rows are numbered within spans of the order (``span``, by default the hour of the first order column, or 4,096 of a number), so that no task holds all rows of a
    key. Runs inside a span are whole; of those that touch its ends, one narrow row goes on to be joined with the next span's.
    """
    if span is None:
        span = F.date_trunc("hour", order[0]) if dict(rows.dtypes)[order[0]].startswith(("timestamp", "date")) else F.floor(F.col(order[0]) / 4096)
    rows = rows.withColumn("_f", failed).withColumn("_s", span)
    within = Window.partitionBy(by, "_s").orderBy(*order)
    numbered = rows.withColumn("_i", F.row_number().over(within)).withColumn("_g", F.col("_i") - F.sum(F.col("_f").cast("int")).over(within))
    sizes = rows.groupBy(by, "_s").agg(F.count("*").alias("_n"))
    parts = (
        numbered.where("_f").groupBy(by, "_s", "_g").agg(F.min(order[0]).alias("started"), F.count("*").alias("n"), F.min("_i").alias("_first"), F.max("_i").alias("_last"))
        .join(sizes, [by, "_s"]).select(by, "_s", "started", "n", (F.col("_first") == 1).alias("_opens"), (F.col("_last") == F.col("_n")).alias("_closes"))
    )
    inner = parts.where("not _opens and not _closes").select(by, "started", "n")
    # the ends of all spans, also of those without failures, which keep runs apart
    spans = sizes.select(by, "_s", F.dense_rank().over(Window.partitionBy(by).orderBy("_s")).alias("_k"))
    ends = parts.where("_opens or _closes").join(spans, [by, "_s"])
    w = Window.partitionBy(by).orderBy("_k", F.col("_opens").desc())
    joined = (F.lag("_closes").over(w) & F.col("_opens") & (F.lag("_k").over(w) == F.col("_k") - 1))
    runs = ends.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    met = runs.groupBy(by, "_run").agg(F.min("started").alias("started"), F.sum("n").alias("n")).select(by, "started", "n")
    return inner.unionByName(met).where(F.col("n") >= least)


#: How imports of scripts and of Python modules are written, as far as one line shows it.
SCRIPT_IMPORT = r"""(?m)^\s*(?:import|export)\b([^'"\n]*)\bfrom\s+['"](\.{1,2}/[^'"\n]+)['"]"""
PYTHON_IMPORT = r"(?m)^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import[ \t]+\(?[ \t]*([\w \t,]+)"


def imported_names(files: DataFrame) -> DataFrame:
    """``file_id, repo, module, name, local``: names that files import from modules; for scripts, ``module`` is a path below the repository's root.

    Renamed imports keep both names; whole-module and default imports have no name of their own and are left out.
    """
    rows = files.where("text is not null").select("file_id", F.lower("repo").alias("repo"), "path", "text")
    spoken = lambda names: F.transform(F.split(names, ","), lambda x: F.split(F.trim(F.regexp_replace(x, r"\s+", " ")), " as "))
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    scripts = rows.where(suffix_language(F.col("path")) == "javascript").select("file_id", "repo", folder.alias("folder"), F.explode(F.regexp_extract_all("text", F.lit(SCRIPT_IMPORT), 0)).alias("said"))
    scripts = scripts.select("file_id", "repo", plain_folders(F.concat("folder", F.regexp_extract("said", SCRIPT_IMPORT, 2))).alias("module"), F.explode(spoken(F.regexp_extract("said", r"\{([^}]*)\}", 1))).alias("n"))
    python = rows.where(suffix_language(F.col("path")) == "python").select("file_id", "repo", F.explode(F.regexp_extract_all("text", F.lit(PYTHON_IMPORT), 0)).alias("said"))
    python = python.select("file_id", "repo", F.regexp_replace(F.regexp_extract("said", PYTHON_IMPORT, 1), r"^\.+", "").alias("module"), F.explode(spoken(F.regexp_extract("said", PYTHON_IMPORT, 2))).alias("n"))
    both = scripts.unionByName(python).select("file_id", "repo", "module", F.trim(F.get("n", 0)).alias("name"), F.trim(F.coalesce(F.get("n", 1), F.get("n", 0))).alias("local"))
    return both.where("name <> '' and module <> ''").distinct()


def module_files(files: DataFrame) -> DataFrame:
    """``repo, module, file_id`` of all names under which a file can be imported: dotted suffixes of Python paths, and for scripts their own path."""
    rows = files.select(F.lower("repo").alias("repo"), "path", "file_id")
    python = rows.where(suffix_language(F.col("path")) == "python").select("repo", F.explode(module_keys(F.col("path"))).alias("module"), "file_id")
    return python.unionByName(rows.where(suffix_language(F.col("path")) == "javascript").select("repo", F.col("path").alias("module"), "file_id"))


def exported_names(files: DataFrame, made: DataFrame) -> DataFrame:
    """``repo, module, name, kind, framework, made_in``: what ``made (file_id, kind, name, framework)`` offers to importing files.

    Names with a dot are no variables of the module. A name that two files offer under the same module is dropped for all kinds rather than guessed.
    """
    offered = made.where("name is not null and not contains(name, '.')").join(module_files(files), "file_id")
    alone = offered.groupBy("repo", "module", "name", "kind").agg(F.min("file_id").alias("made_in"), F.max("file_id").alias("other"), F.min("framework").alias("framework"))
    doubtful = alone.where("made_in <> other").select("repo", "module", "name").distinct()
    return alone.join(doubtful, ["repo", "module", "name"], "left_anti").drop("other")


def imported_objects(files: DataFrame, made: DataFrame) -> DataFrame:
    """``file_id, local, kind, framework, made_in``: imported names joined with what other files of the repository export, by module and name.

    Of the paths that a script's import may mean, the first that is a file counts. A name that the importing file makes itself is its own.
    """
    wants = imported_names(files)
    scripts = wants.where(F.contains("module", F.lit("/")) | F.col("module").rlike(r"\.[A-Za-z]+$"))
    tried = wants.select("repo", "module").distinct().select("repo", "module", F.posexplode(script_paths(F.col("module"))).alias("rank", "path"))
    exists = tried.join(module_files(files).where(F.contains("module", F.lit("."))).select("repo", F.col("module").alias("path")).distinct(), ["repo", "path"])
    target = exists.groupBy("repo", "module").agg(F.min_by("path", "rank").alias("path"))
    placed = wants.join(target, ["repo", "module"], "left").withColumn("module", F.coalesce("path", "module")).drop("path")
    met = placed.join(exported_names(files, made), ["repo", "module", "name"]).where("made_in <> file_id")
    own = made.select("file_id", F.col("name").alias("local"), "kind").distinct()
    return met.join(own, ["file_id", "local", "kind"], "left_anti").select("file_id", "local", "kind", "framework", "made_in").distinct()


def local_modules(files: DataFrame) -> DataFrame:
    """``repo, module`` of a repository's own Python modules."""
    return files.where(suffix_language(F.col("path")) == "python").select(F.lower("repo").alias("repo"), F.explode(module_keys(F.col("path"))).alias("module")).distinct()


def without_local(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports (repo, module, ...)`` without those that name a module of the repository itself, or something in one."""
    own = local_modules(files)
    outer = F.when(F.contains("module", F.lit(".")), F.regexp_replace("module", r"\.[^.]*$", ""))
    return imports.join(own, ["repo", "module"], "left_anti").withColumn("_outer", outer).join(own.withColumnRenamed("module", "_outer"), ["repo", "_outer"], "left_anti").drop("_outer")


def tools_evidence(findings: DataFrame) -> DataFrame:
    """``repo, source, tool`` of the three ways by which a tool shows."""
    bound = findings.where("type = 'agent'").select("repo", F.lit("agent").alias("source"), F.explode("tools_bound").alias("tool"))
    named = findings.where("type = 'custom_agent'").select("repo", F.lit("custom_agent").alias("source"), F.explode("tool_names").alias("tool"))
    defined = findings.where("type = 'confirmed_tool_definition'").select("repo", F.lit("definition").alias("source"), F.col("name").alias("tool"))
    return bound.unionByName(named).unionByName(defined).where("tool is not null")
