"""Readers of manifests, lists, tables of rules, and archives. Every reader has an explicit schema."""

from __future__ import annotations

import io
import json
import re
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import FALSE_TOKENS, SUFFIX_LANGUAGES, TRUE_TOKENS, repo_key, scanned_path, yes_or_no
from tessera.operators.nested import normal_json

REPO = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("url", T.StringType()), T.StructField("stars", T.LongType()), T.StructField("language_percentage", T.DoubleType()),
    T.StructField("languages", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("percentage", T.DoubleType())]))),
    T.StructField("frameworks", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("category", T.StringType()), T.StructField("category_display", T.StringType())]))),
    T.StructField("found_via", T.StringType()), T.StructField("found_at", T.StringType()),
])


def texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, value``: one row for each file, whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def json_array(spark: SparkSession, path: str, item: T.StructType) -> DataFrame:
    """The objects of JSON files that hold an array, one object, or an array under ``repos``, ``results``, ``items`` or ``urls``; of a file that
    was cut off, the complete objects. ``pos`` is the object's place in its file."""
    parsed = texts(spark, path).select("path", normal_json(_unwrapped(F.col("value")), T.ArrayType(item)).alias("v"))
    return parsed.select("path", F.posexplode("v").alias("pos", "x")).where("x is not null").select("path", "pos", "x.*")


def _unwrapped(text: Column) -> Column:
    """JSON text whose array is under one of the usual keys, as if it were under ``items``."""
    return F.regexp_replace(text, r'^(\s*\{(?s:.*?))"(?:repos|results|urls)"\s*:(?=\s*\[)', '$1"items":')


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Repositories of a manifest file, with ``pos``."""
    return json_array(spark, path, REPO).drop("path")


def json_lines(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """Line-delimited JSON; of a repeated key the last line counts. Lines end at ``\\n`` only."""
    rows = spark.read.option("lineSep", "\n").text(path).select(F.monotonically_increasing_id().alias("_at"), F.from_json("value", schema).alias("x")).where("x is not null")
    return rows.groupBy(F.col(f"x.{key}").alias("_k")).agg(F.max_by("x", "_at").alias("x")).where("_k is not null").select("x.*")


def repository_list(spark: SparkSession, path: str) -> DataFrame:
    """``repo_key`` of a text list (blank lines and ``#`` lines passed over), a CSV (``url``, ``repo``, ``repository``, ``name``, else the first column), or JSON.

    JSON holds an array of objects or of plain strings, bare or under one of the usual keys; of objects with a classification, those that are applications count."""
    if path.endswith(".csv"):
        rows = spark.read.csv(path, header=True)
        column = next((c for c in ("url", "repo", "repository", "name") if c in rows.columns), rows.columns[0])
        found = rows.select(F.col(column).alias("v"))
    elif path.endswith(".json"):
        kind = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("url", "repo", "name", "classification")]))
        plain = F.regexp_replace(F.col("value"), r"(?<=[\[,])(\s*)(\"(?:[^\"\\]|\\.)*+\")(?=\s*[,\]])", '$1{"url":$2}')  # strings in an array, as objects
        found = texts(spark, path).select(F.explode(normal_json(_unwrapped(plain), kind)).alias("x")).select("x.*")
        found = found.where("coalesce(classification, 'app') = 'app'").select(F.coalesce("url", "repo", "name").alias("v"))
    else:
        found = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' and not v like '#%'")
    return found.select(repo_key(F.col("v")).alias("repo_key")).where("repo_key <> ''").distinct()


def repository_names(entries: DataFrame, order: str) -> DataFrame:
    """``name, order`` of ``entries (name, full_name, url, ...)``: ``owner/repo`` without host and ``.git``, the first of repeated ones, in their order; others are left out."""
    x = F.trim(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("name", "full_name", "url") if c in entries.columns]))
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^(https?://)?(www\.)?github\.com/", ""), r"\.git$", ""), "^/+|/+$", "")
    return entries.select(x.alias("name"), order).where(F.size(F.split("name", "/")) == 2).groupBy("name").agg(F.min(order).alias(order))


def judge_answers(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """``judge, url, label`` of a judge's result file; ``name`` comes before the file's model, whose part behind ``:`` is dropped. An error, or no label, is ``error``."""
    row = "array<struct<url:string,classification:string,error:string>>"
    read = texts(spark, path).select(F.get_json_object("value", "$.model").alias("model"), F.explode(F.from_json(F.get_json_object("value", "$.results"), row)).alias("x"))
    judge = F.lit(name) if name else F.replace(F.split(F.coalesce("model", F.lit("")), ":")[0], F.lit("gpt-gpt-"), F.lit("gpt-"))
    failed = (F.coalesce("x.error", F.lit("")) != "") | (F.coalesce("x.classification", F.lit("")) == "")
    return read.select(judge.alias("judge"), "x.url", F.when(failed, "error").otherwise(F.col("x.classification")).alias("label"))


def flag_table(spark: SparkSession, path: str, sep: str = ",", header: bool | None = None) -> DataFrame:
    """``name, a, b, c`` of a table of names with three flags in any of the usual spellings; blank lines and ``#`` lines are passed over.

    Without ``header`` told, the first row is one if one of its flags is no yes or no. A row with fewer cells or an empty name is an error."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "^\ufeff", "").alias("v"))
    lines = raw.where((F.trim(F.replace("v", F.lit(sep), F.lit(""))) != "") & ~F.ltrim("v").startswith("#"))
    cells = lines.select("f", "at", F.from_csv("v", "name string, a string, b string, c string", {"sep": sep}).alias("x"), (F.size(F.split("v", re.escape(sep))) >= 4).alias("enough")).select("f", "at", "enough", "x.name", *[F.coalesce(f"x.{c}", F.lit("")).alias(c) for c in "abc"])
    first = cells.groupBy("f").agg(F.min("at").alias("at"))
    known = F.forall(F.array("a", "b", "c"), lambda v: F.lower(F.trim(v)).isin(*TRUE_TOKENS, *FALSE_TOKENS))
    heads = cells.join(first, ["f", "at"], "left_semi").where(~known if header is None else F.lit(header)).select("f", "at")
    rows = cells.join(heads, ["f", "at"], "left_anti")
    name = F.when(~F.col("enough") | (F.trim(F.coalesce("name", F.lit(""))) == ""), F.raise_error(F.lit("a row without a name or with fewer than four cells"))).otherwise(F.trim("name"))
    return rows.select(name.alias("name"), *[yes_or_no(F.col(c)).alias(c) for c in "abc"])


def rule_tables(spark: SparkSession, path: str) -> DataFrame:
    """``section, label, pattern`` of Markdown tables: patterns are back-quoted in the second cell, else in the first; other rows are passed over."""
    split = F.split("value", "\n")
    state = F.aggregate(
        split,
        F.struct(F.lit("").alias("section"), F.array().cast("array<struct<section:string,label:string,cell:string>>").alias("rows")),
        lambda a, x: F.struct(
            F.when(x.rlike(r"^##\s"), F.trim(F.regexp_replace(x, r"^#+\s+", ""))).otherwise(a["section"]).alias("section"),
            F.when(
                x.rlike(r"^\s*\|") & ~x.rlike(r"^\s*\|[\s|:-]+$"),
                F.concat(a["rows"], F.array(F.struct(a["section"].alias("section"), F.regexp_replace(F.trim(F.get(F.split(x, r"(?<!\\)\|"), 1)), "[*`]", "").alias("label"),
                    F.when(F.get(F.split(x, r"(?<!\\)\|"), 2).contains("`"), F.get(F.split(x, r"(?<!\\)\|"), 2)).otherwise(F.get(F.split(x, r"(?<!\\)\|"), 1)).alias("cell")))),
            ).otherwise(a["rows"]).alias("rows"),
        ),
    )
    rows = texts(spark, path).select(F.explode(state["rows"]).alias("r")).select("r.*")
    return rows.select("section", "label", F.explode(F.regexp_extract_all("cell", F.lit("`([^`]+)`"), 1)).alias("pattern"))


def archive_files(spark: SparkSession, path: str, most: int = 2 * 1024 * 1024, group: int = 16 * 1024 * 1024) -> DataFrame:
    """``archive, path, size, text, is_relevant`` of the members of ``.tar.gz`` archives, without the archive's top folder.

    Excluded folders and test files are left out; members of other suffixes or over ``most`` bytes have no text but are counted.
    One task unpacks an archive, member by member, and holds at most about ``group`` characters of texts.
    """
    columns = ["archive", "path", "size", "text", "is_relevant"]

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive, content in zip(b["path"], b["content"]):
                out, held = [], 0
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                    for m in tar:
                        if not m.isfile() or "/" not in m.name:
                            continue
                        rel = m.name.split("/", 1)[1]
                        relevant = rel.lower().endswith(tuple(SUFFIX_LANGUAGES)) or rel.rsplit("/", 1)[-1] == "SKILL.md"
                        text = tar.extractfile(m).read().decode("utf-8", "replace") if relevant and m.size <= most else None
                        out.append((archive, rel, m.size, text, relevant))
                        held += len(text or "")
                        if held > group or len(out) == 10_000:  # the texts of one group at a time
                            yield pd.DataFrame(out, columns=columns)
                            out, held = [], 0
                yield pd.DataFrame(out, columns=columns)

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.mapInPandas(members, "archive string, path string, size bigint, text string, is_relevant boolean").where(scanned_path(F.col("path")))


def skills(files: DataFrame, most: int = 2 * 1024 * 1024) -> DataFrame:
    """``path, name`` of skill descriptions: files named ``SKILL.md``, with the folder's name or null."""
    parts = F.split("path", "/")
    return files.where((F.element_at(parts, -1) == "SKILL.md") & (F.col("size") <= most)).select("path", F.when(F.size(parts) > 1, F.element_at(parts, -2)).alias("name")).distinct()


def write_totals(totals: DataFrame, path: str, histograms: DataFrame | None = None) -> None:
    """Corpus totals as one JSON object; with ``histograms (field, value, n_repos)`` also their map under ``distributions``."""
    if histograms is not None:
        by = histograms.groupBy("field").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("value", "n_repos"))), lambda x: F.struct(x["value"].cast("string").alias("key"), x["n_repos"].alias("value")))).alias("m"))
        totals = totals.crossJoin(by.agg(F.map_from_entries(F.collect_list(F.struct("field", "m"))).alias("distributions")))  # one row each
    totals.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


#: Fixed value: the columns of the table of repositories.
RECORD_COLUMNS = ("repo_name", "repo_url", "stars", "n_agents", "n_custom_agents", "n_tools", "n_skills", "n_tool_definition_markers", "has_rag", "n_stores", "passes_instantiation_filter")


def write_csv(rows: DataFrame, path: str, columns: tuple[str, ...] | None = None) -> None:
    """Rows as CSV with a header, arrays as JSON text; with ``columns`` those in their order."""
    rows = rows.select(*columns) if columns else rows
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").csv(path, header=True, escape='"')


def write_logs(verdicts: DataFrame, path: str) -> None:
    """One text log of addresses for each verdict (``verdict, line``), as a folder each."""
    verdicts.select("verdict", "line").write.mode("overwrite").partitionBy("verdict").text(path)


def write_manifest(repos: DataFrame, path: str, **metadata: str) -> None:
    """Repositories as line-delimited JSON under ``repos``, beside one object of ``metadata`` with their number."""
    repos.write.mode("overwrite").json(f"{path}/repos")
    facts = [F.lit(v).alias(k) for k, v in metadata.items()]
    repos.agg(F.count("*").alias("total_repos")).select(F.to_json(F.struct(*facts, "total_repos")).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def read_sidecar(spark: SparkSession, path: str) -> dict:
    """A run's small metadata file in the shared folder, or an empty one."""
    try:
        rows = texts(spark, path).collect()  # one file
        return json.loads(rows[0].value)
    except (AnalysisException, IndexError, ValueError):
        return {}
