"""Operators over judges' votes: latest answers, merging with a manual sheet, agreement, and set overlap."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels that decide nothing.
UNDECIDED = ("", "error", "needs_review", "needs review")


def vote_label(classification: Column, error: Column) -> Column:
    """A vote's label; an error comes before any label."""
    return F.when(error.isNotNull() | classification.isNull() | (F.trim(classification) == ""), "error").otherwise(F.trim(classification))


def is_label(label: Column) -> Column:
    return ~F.lower(label).isin(*UNDECIDED)


def latest_votes(votes: DataFrame, key: Column) -> DataFrame:
    """``url, judge, label``: each judge's last row for an address; combined before the shuffle."""
    return (
        votes.select(key.alias("url"), "judge", F.struct("processed_at", vote_label(F.col("classification"), F.col("error")).alias("label")).alias("v"))
        .where("url is not null and judge is not null").groupBy("url", "judge").agg(F.max("v").alias("v")).select("url", "judge", F.col("v.label").alias("label"))
    )


def merged_votes(latest: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """``url, n_judges, decision, source``: a unanimous label decides; where judges differ, the manual sheet does, else nobody."""
    by = latest.groupBy("url").agg(F.count("*").alias("n_judges"), F.min(F.lower("label")).alias("low"), F.max(F.lower("label")).alias("high"))
    agreed = F.when((F.col("low") == F.col("high")) & is_label(F.col("low")), F.col("low"))
    out = by.withColumn("agreed", agreed)
    if manual is None:
        out = out.withColumn("decided", F.lit(None).cast("string"))
    else:
        out = out.join(manual.select("url", F.lower(F.trim("decision")).alias("decided")), "url", "left")
    return out.select(
        "url", "n_judges", F.coalesce("agreed", "decided").alias("decision"),
        F.when(F.col("agreed").isNotNull(), "judges").when(F.col("decided").isNotNull(), "manual").otherwise("none").alias("source"),
    )


def pairwise_agreement(latest: DataFrame) -> DataFrame:
    """``judge_a, judge_b, n_both, n_same, agreement`` of every two judges that labelled a common address.

    An address has at most one vote of each judge. Its pairs are made one vote after the other, so that no row holds them all, and are counted before the shuffle.
    """
    sets = latest.where(is_label(F.col("label"))).groupBy("url").agg(F.sort_array(F.collect_list(F.struct("judge", F.lower("label").alias("label")))).alias("v"))
    first = sets.select("v", F.posexplode("v").alias("i", "x")).select("x", F.expr("slice(v, i + 2, size(v))").alias("rest"))
    pairs = first.select("x", F.explode("rest").alias("y")).select(F.col("x.judge").alias("judge_a"), F.col("y.judge").alias("judge_b"), (F.col("x.label") == F.col("y.label")).alias("same"))
    return pairs.groupBy("judge_a", "judge_b").agg(F.count("*").alias("n_both"), F.count_if("same").alias("n_same")).withColumn("agreement", F.col("n_same") / F.col("n_both"))


def regions(flags: DataFrame, sets: list[str]) -> DataFrame:
    """``region_key, n``: how many rows lie in each exclusive region of the sets; rows in none are left out."""
    key = F.concat(*[F.when(F.col(s), "1").otherwise("0") for s in sets])
    return flags.select(key.alias("region_key")).where(F.col("region_key").contains("1")).groupBy("region_key").agg(F.count("*").alias("n"))


def jaccard(flags: DataFrame, sets: list[str]) -> DataFrame:
    """``a, b, both, either, jaccard`` of every two sets, in one pass; 0 where both are empty."""
    pairs = list(combinations(sets, 2))
    counts = flags.agg(*[f(F.coalesce(c, F.lit(False))).alias(f"{n}_{i}") for i, (a, b) in enumerate(pairs) for n, f, c in (("both", F.count_if, F.col(a) & F.col(b)), ("either", F.count_if, F.col(a) | F.col(b)))])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"both_{i}").alias("both"), F.col(f"either_{i}").alias("either")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*").withColumn("jaccard", F.when(F.col("either") > 0, F.col("both") / F.col("either")).otherwise(F.lit(0.0)))


def all_answers(votes: DataFrame) -> DataFrame:
    """``url, judge, label`` for each repository and each judge of ``votes (url, judge, label)``; '' where there is no label."""
    judges = votes.agg(F.array_sort(F.collect_set("judge")).alias("judges"))  # one row
    pairs = votes.select("url").distinct().crossJoin(F.broadcast(judges)).select("url", F.explode("judges").alias("judge"))
    labels = votes.where(is_label(F.col("label"))).select("url", "judge", F.lower("label").alias("label"))
    return pairs.join(labels, ["url", "judge"], "left").select("url", "judge", F.coalesce("label", F.lit("")).alias("label"))


def judge_columns(answers: DataFrame, judges: list[str]) -> DataFrame:
    """One row for each address of ``answers (url, judge, label)`` and one column for each judge; '' where there is no label."""
    return answers.groupBy("url").pivot("judge", judges).agg(F.max("label")).na.fill("", judges)


def selected(repos: DataFrame, answers: DataFrame, manual: DataFrame, label: str) -> DataFrame:
    """``key, source`` of the repositories that get ``label``: ``judges`` where all give the same answer, else ``manual`` where the sheet says so.

    ``repos (key)``, ``answers (key, judge, label)``, ``manual (key, decision)``. A judge without an answer gives ''. Judges' labels are compared as they are
    spelled, the sheet's in any case; where all judges agree on another label, the sheet is not asked.
    """
    judges = answers.select("judge").distinct().agg(F.count("*").alias("n_all"))
    by = answers.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    told = repos.select("key").join(by, "key", "left").join(manual.select("key", F.lower(F.trim("decision")).alias("decided")), "key", "left").crossJoin(judges)  # one row: the number of judges
    agree = (F.col("n") == F.col("n_all")) & (F.col("low") == F.col("high")) & is_label(F.col("low"))
    agree = F.coalesce(agree, F.lit(False))
    source = F.when(agree & (F.col("low") == label), "judges").when(~agree & (F.col("decided") == label.lower()), "manual").when(agree, "other").otherwise("open")
    return told.select("key", source.alias("source"), F.col("decided").isNotNull().alias("reviewed"))


def last_decisions(sheet: DataFrame, url: str, decision: str, order: str) -> DataFrame:
    """``url, decision`` of a manual sheet: rows with an address and a decision that is typed in, in lower case; of repeated addresses the last row."""
    good = F.col(url).startswith("http") & F.col(decision).isNotNull() & (F.trim(decision) != "") & ~F.col(decision).startswith("=")
    return sheet.where(good).groupBy(F.col(url).alias("url")).agg(F.max_by(F.lower(F.trim(decision)), order).alias("decision"))


def is_done(row_label: Column, error: Column, labels: tuple[str, ...]) -> Column:
    """Whether an answer need not be asked for again."""
    return error.isNull() & F.coalesce(row_label.isin(*labels), F.lit(False))
