"""Rule tables (label, pattern, language) as a dimension, ranked matching, sweeps, and the closure of aliases."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import plain_label
from tessera.operators.components import components


def is_pattern(text: str) -> bool:
    """Whether a rule's text is a regular expression; others are taken literally."""
    try:
        re.compile(text)
    except re.error:
        return False
    return True


def dimension(rows: DataFrame, labels: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """``category, label, is_generic, language, pattern`` of ``rows (category, section, label, pattern)`` as they stand in rule tables.

    Sections on detection methods do not count; a section that begins with a language's name is for that language; labels that are not in ``labels``, after ``aliases``, are generic.
    """
    label = plain_label(F.col("label"), aliases)
    language = F.when(F.col("section").startswith("Python"), "python").when(F.col("section").startswith("JavaScript"), "javascript")
    kept = rows.where(~F.contains(F.lower("section"), F.lit("detection methods")))
    return kept.select("category", label.alias("label"), (~label.isin(*labels)).alias("is_generic"), language.alias("language"), "pattern").distinct()


def ranked(rules: list[dict]) -> list[dict]:
    """Rules (label, pattern, is_generic) in the order in which they are tried: specific before generic ones, longer texts first, then as given."""
    return sorted(rules, key=lambda r: (r["is_generic"], -len(r["pattern"])))


def hits(value: Column, pattern: str) -> Column:
    """Whether ``value`` holds the rule's pattern."""
    return value.rlike(pattern) if is_pattern(pattern) and re.escape(pattern) != pattern else F.contains(value, F.lit(pattern))


def first_label(value: Column, rules: list[dict], imported: Column | None = None) -> Column:
    """The label of the first rule, by rank, that the value holds; null if none.

    With ``imported`` (an array of labels), a specific rule counts only if its label is among them; otherwise the first generic rule does. The rules
    are a hand-made dimension table, taken as literals: no join of texts with rules.
    """
    told = lambda r: F.lit(True) if imported is None or r["is_generic"] else F.coalesce(F.array_contains(imported, r["label"]), F.lit(False))
    return F.coalesce(*[F.when(told(r) & hits(value, r["pattern"]), F.lit(r["label"])) for r in ranked(rules)], F.lit(None).cast("string"))


def sweep(texts: DataFrame, key: str, text: str, rules: list[dict]) -> DataFrame:
    """``key, label, n``: the hits of all of a label's patterns in each text; patterns of several labels count for each of them."""
    by: dict[str, list[str]] = {}
    for r in rules:
        by.setdefault(r["label"], []).append(r["pattern"])

    def count(p: str) -> Column:
        if is_pattern(p) and re.escape(p) != p:
            return F.regexp_count(F.col(text), F.lit(p)).cast("bigint")
        gone = F.length(text) - F.length(F.replace(F.col(text), F.lit(p), F.lit("")))
        return F.when(F.contains(F.col(text), F.lit(p)), (gone / len(p)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))

    counted = F.array(*[F.struct(F.lit(label).alias("label"), sum((count(p) for p in ps[1:]), count(ps[0])).alias("n")) for label, ps in sorted(by.items())])
    return texts.where(F.col(text).isNotNull()).select(key, F.explode(F.filter(counted, lambda x: x["n"] > 0)).alias("x")).select(key, "x.*")


#: A line that gives one name to what another name holds, and names that hold nothing of their own.
ALIAS = r"(?m)^[ \t]*(?:(?:const|let|var)[ \t]+)?([A-Za-z_]\w*)[ \t]*=[ \t]*([A-Za-z_]\w*)[ \t]*;?[ \t]*$"

CONSTANTS = ("None", "True", "False", "null", "undefined", "true", "false", "this", "self")


def alias_groups(files: DataFrame) -> DataFrame:
    """``file_id, name, root``: names of a file that hold the same thing, through any number of steps, and the first of them in the alphabet.

    The closure is that of connected components over all files at once: names are numbered by a hash, and the component's first name is a grouped minimum.
    """
    plain = files.select("file_id", F.regexp_replace("text", r"\r\n?", "\n").alias("text"))
    said = plain.where(F.col("text").rlike(ALIAS)).select("file_id", F.explode(F.regexp_extract_all("text", F.lit(ALIAS), 0)).alias("line"))
    pairs = said.select("file_id", F.regexp_extract("line", ALIAS, 1).alias("x"), F.regexp_extract("line", ALIAS, 2).alias("y")).where(F.col("x") != F.col("y")).where(~F.col("y").isin(*CONSTANTS)).distinct()
    edges = pairs.select(F.xxhash64("file_id", "x").alias("a"), F.xxhash64("file_id", "y").alias("b"))
    names = pairs.select("file_id", F.explode(F.array("x", "y")).alias("name")).distinct().withColumn("node", F.xxhash64("file_id", "name"))
    told = names.join(components(edges), "node")
    first = told.groupBy("root").agg(F.min("name").alias("first"))
    return told.join(first, "root").select("file_id", "name", F.col("first").alias("root"))
