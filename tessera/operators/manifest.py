"""Operators over repository manifests: filters, ranking within arrays, order-aware deduplication, registry matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut


def language_share(languages: Column, wanted: tuple[str, ...]) -> Column:
    """The wanted languages' part of all shares in percent, 0 where there are none; null elements count nothing."""
    total = F.aggregate(F.coalesce(languages, F.array().cast("array<struct<name:string,percentage:double>>")), F.lit(0.0), lambda a, x: a + F.coalesce(x["percentage"], F.lit(0.0)))
    part = F.aggregate(F.coalesce(languages, F.array().cast("array<struct<name:string,percentage:double>>")), F.lit(0.0), lambda a, x: a + F.when(x["name"].isin(*wanted), F.coalesce(x["percentage"], F.lit(0.0))).otherwise(0.0))
    return F.when(total > 0, part / total * 100).otherwise(0.0)


def verdicts(repos: DataFrame, wanted: tuple[str, ...] = ("Python", "JavaScript", "TypeScript"), least: float = 70.0) -> DataFrame:
    """``repos`` with ``verdict``: the language filter decides before the framework filter."""
    named = F.filter(F.coalesce("frameworks", F.array().cast("array<struct<name:string,category:string,category_display:string>>")), lambda x: x["name"].isNotNull())
    return repos.withColumn(
        "verdict", F.when(language_share(F.col("languages"), wanted) < least, "failed_language").when(F.size(named) == 0, "failed_framework").otherwise("passed")
    )


def top_in_array(rows: DataFrame, key: str, array: str, by: str, k: int) -> DataFrame:
    """The ``k`` elements of an array column with the largest ``by``; ties keep the array's order. Sorts within the row, without a shuffle."""
    ranked = F.array_sort(F.transform(F.filter(array, lambda x: x.isNotNull() & x[by].isNotNull()), lambda x, i: F.struct((-x[by]).alias("minus"), i.alias("i"), x["name"].alias("name"))))
    return rows.select(key, F.posexplode(F.slice(ranked, 1, k)).alias("p", "x")).select(key, (F.col("p") + 1).cast("int").alias("rank"), F.col("x.name").alias("name"))


def first_by_any_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows none of whose keys stands in an earlier row that was itself kept, in ``order``; a rejected row marks nothing, a null key says nothing.

    Each round keeps the undecided rows that are the first of all their keys and rejects those that share a key with them, by grouped minima and
    joins over written tables, until none is undecided. The first undecided row is decided in each round. Rows with a key but no ``order`` are dropped.
    """
    keyless = " and ".join(f"`{k}` is null" for k in keys)
    todo = cut(rows.where(f"`{order}` is not null and not ({keyless})"))
    kept = rows.where(keyless)
    while not todo.isEmpty():
        marked = todo.withColumn("_ok", F.lit(True))
        for k in keys:
            first = todo.where(F.col(k).isNotNull()).groupBy(F.col(k).alias("_k")).agg(F.min(order).alias("_first"))
            marked = marked.join(first, marked[k] == first["_k"], "left").withColumn("_ok", F.col("_ok") & (F.col("_first").isNull() | (F.col(order) == F.col("_first")))).drop("_k", "_first")
        marked = cut(marked)
        won = marked.where("_ok").drop("_ok")
        kept = kept.unionByName(won)
        left = marked.where("not _ok").drop("_ok")
        for k in keys:
            left = left.join(won.where(F.col(k).isNotNull()).select(F.col(k).alias("_k")).distinct(), F.col(k) == F.col("_k"), "left_anti")
        todo = cut(left)
    return kept


def keyword_hits(texts: DataFrame, key: str, text: str, registry: DataFrame, at_once: int = 2_000) -> DataFrame:
    """``key, framework`` for each framework one of whose keywords the text contains in any case.

    The registry's words are a literal array, so that each text is scanned in the JVM without a join; a registry of more than ``at_once`` words
    is taken in as many passes over the texts as it needs.
    """
    words = registry.select(F.col("name").alias("framework"), F.explode("keywords").alias("keyword")).where("keyword is not null and keyword <> ''").select("framework", F.lower("keyword").alias("keyword")).distinct()
    low = texts.select(key, F.lower(text).alias("_t"))
    passes, known = [], []
    for r in words.orderBy("framework", "keyword").toLocalIterator():
        known.append((r.framework, r.keyword))
        if len(known) == at_once:
            passes.append(known)
            known = []
    out = None
    for part in [*passes, known]:
        by: dict[str, list[str]] = {}
        for framework, word in part:
            by.setdefault(framework, []).append(word)
        found = F.array(*[F.when(F.greatest(*[F.contains("_t", F.lit(w)) for w in ws], F.lit(False)), F.lit(name)) for name, ws in sorted(by.items())]).cast("array<string>")
        hits = low.select(key, F.explode(F.array_compact(found)).alias("framework"))
        out = hits if out is None else out.unionByName(hits)
    return out.distinct() if passes else out


def imported_frameworks(files: DataFrame, registry: DataFrame) -> DataFrame:
    """``file_id, framework`` of the registry's dependencies that a file imports: the import's root package, or its scoped package."""
    pattern = r"(?m)^\s*(?:from|import)\s+(?:.*\bfrom\s+)?['\"]?([@A-Za-z][\w./@-]*)"
    modules = files.where("text is not null").select("file_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("module"))
    root = F.regexp_extract("module", r"^(@[^/]+/[^/]+|[^/.]+)", 1)
    deps = registry.select(F.col("name").alias("framework"), F.explode("dependencies").alias("dependency")).where("dependency is not null").distinct()
    return modules.select("file_id", root.alias("dependency")).distinct().join(deps, "dependency").select("file_id", "framework").distinct()


def longest_prefix(values: DataFrame, value: str, prefixes: DataFrame, prefix: str, label: str) -> DataFrame:
    """``value, label`` of the longest of ``prefixes`` that is the value or one of its ``/``, ``-``, ``_`` or ``.`` bounded beginnings.

    Each value's beginnings are listed and joined by equality, so that no pairs of values and prefixes are formed.
    """
    beginnings = F.array_distinct(F.concat(F.array(F.col(value)), F.transform(F.filter(F.sequence(F.lit(1), F.length(value)), lambda i: F.substring(F.col(value), i, F.lit(1)).isin("/", "-", "_", ".")), lambda i: F.substring(F.col(value), F.lit(1), i - 1))))
    listed = values.where(F.col(value).isNotNull() & (F.col(value) != "")).select(value).distinct().select(value, F.explode(beginnings).alias("_p"))
    found = listed.join(prefixes.select(F.col(prefix).alias("_p"), F.col(label)).distinct(), "_p")
    return found.groupBy(value).agg(F.max_by(F.struct("_p", label), F.struct(F.length("_p"), F.col(label))).alias("x")).select(value, F.col("x._p").alias("prefix"), f"x.{label}")


def most_common(rows: DataFrame, value: Column, order: str, k: int, whole: DataFrame | None = None) -> DataFrame:
    """``value, n`` of the ``k`` most frequent values, and with ``whole`` their share of its rows; ties go to the one met first."""
    top = rows.select(value.alias("value"), F.col(order).alias("_o")).groupBy("value").agg(F.count("*").alias("n"), F.min("_o").alias("_o")).orderBy(F.desc("n"), "_o").limit(k).select("value", "n")
    return top if whole is None else top.crossJoin(F.broadcast(whole.agg(F.count("*").alias("_all")))).select("value", "n", (F.col("n") / F.col("_all")).alias("share"))  # one row


def with_share(counts: DataFrame, n: str) -> DataFrame:
    """``counts`` with each row's ``share`` of the sum; 0 where there is nothing."""
    whole = F.broadcast(counts.agg(F.sum(n).alias("_all")))  # one row
    return counts.crossJoin(whole).withColumn("share", F.when(F.col("_all") > 0, F.col(n) / F.col("_all")).otherwise(F.lit(0.0))).drop("_all")


def running_budget(sections: DataFrame, key: str, rank: str, order: str, size: str, budget: int, least: int) -> DataFrame:
    """Sections that still fit when a document's sections are taken by rank: chosen while more than ``least`` of the budget is left before them."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(key).orderBy(rank, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sections.withColumn("left_before", F.lit(budget) - before).where(F.col("left_before") > least)


#: Packages of frameworks whose parts are published under names with a common beginning.
SPLIT_PACKAGES = {"langchain_": "LangChain"}


def module_framework(modules: DataFrame, roots: DataFrame, parts: DataFrame | None = None, beginnings: dict[str, str] = SPLIT_PACKAGES) -> DataFrame:
    """``module, framework`` of dotted Python modules: by the first two names (``parts``: module, framework), else by the first (``roots``), else by its beginning.

    All are equality joins on dimension tables; modules that nothing names are left out.
    """
    split = F.split("module", r"\.")
    told = modules.where("module is not null and module <> ''").select("module").distinct().select("module", F.get(split, 0).alias("_root"), F.when(F.size(split) > 1, F.concat_ws(".", F.get(split, 0), F.get(split, 1))).alias("_part"))
    told = told.join(roots.select(F.col("module").alias("_root"), F.col("framework").alias("_by_root")), "_root", "left")
    if parts is not None:
        told = told.join(parts.select(F.col("module").alias("_part"), F.col("framework").alias("_by_part")), "_part", "left")
    else:
        told = told.withColumn("_by_part", F.lit(None).cast("string"))
    begun = F.coalesce(*[F.when(F.col("_root").startswith(b), F.lit(f)) for b, f in beginnings.items()], F.lit(None).cast("string"))
    return told.select("module", F.coalesce("_by_part", "_by_root", begun).alias("framework")).where("framework is not null")


def package_framework(modules: DataFrame, entries: DataFrame) -> DataFrame:
    """``module, entry, framework`` of script import specifiers: the longest of ``entries (entry, framework)`` that names it.

    An entry ending in ``/`` or ``-`` names all that begin with it, others the package itself and what lies below it. Relative imports name no package. A module's
    beginnings are listed and joined by equality, so that no pairs of modules and entries are formed.
    """
    bare = F.regexp_replace("module", "^node:", "")
    n = F.length("_m")
    cuts = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(F.col("_m"), i, F.lit(1)).isin("/", "-"))
    below = F.transform(cuts, lambda i: F.substring(F.col("_m"), F.lit(1), i))
    parents = F.transform(F.filter(cuts, lambda i: F.substring(F.col("_m"), i, F.lit(1)) == "/"), lambda i: F.substring(F.col("_m"), F.lit(1), i - 1))
    listed = modules.where("module is not null and not startswith(module, '.') and module <> ''").select("module").distinct().withColumn("_m", bare).where(n > 0)
    listed = listed.select("module", F.explode(F.array_distinct(F.concat(F.array("_m"), below, parents))).alias("entry"))
    whole = listed.where("entry <> ''").join(entries.select("entry", "framework").distinct(), "entry")
    return whole.groupBy("module").agg(F.max_by(F.struct("entry", "framework"), F.struct(F.length("entry"), "framework")).alias("x")).select("module", "x.entry", "x.framework")


def with_status(rows: DataFrame, status: Column, summary: Column) -> DataFrame:
    """``rows`` with ``counted``: ``scanned`` (and with a summary), ``failed`` (any other status), or ``empty`` (scanned, without a summary)."""
    return rows.withColumn("counted", F.when(status.eqNullSafe(F.lit("scanned")), F.when(summary, "scanned").otherwise("empty")).otherwise("failed"))


def instantiating(rows: DataFrame, usage: str, passes: str) -> DataFrame:
    """``rows (status, ...)`` without scanned ones that do not pass; failed rows stay. A scanned row without ``usage`` is an error, as it may come from an older run."""
    scanned = F.col("status").eqNullSafe(F.lit("scanned"))
    missing = F.raise_error(F.lit("scanned rows without framework usage: scan them again")).cast("boolean")
    return rows.where(F.when(~scanned, True).when(~F.col(usage), missing).otherwise(F.coalesce(F.col(passes), F.lit(False))))


def first_rows(rows: DataFrame, order: str, done: DataFrame, key: str, most: int) -> DataFrame:
    """Of the first ``most`` rows in their order, those whose key is not ``done`` yet; the limit is the feature."""
    return rows.orderBy(order).limit(most).join(done.select(key).distinct(), key, "left_anti")
