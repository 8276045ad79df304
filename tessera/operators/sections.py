"""Sections of Markdown texts and excerpts made of them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import clean_markdown

#: Headings that an excerpt prefers, and those it leaves out; what is cut is marked.
PRIORITY = r"(?i)about|overview|introduc|what is|why|feature|how it works|architect|install|quick ?start|getting started|usage|use|demo|example|run"
SKIP = r"(?i)licen|contribut|star history|sponsor|acknowledg|citation|cite|contact|community|changelog|news|roadmap|faq|support|team|author|thanks|table of contents"
LIMIT, RESERVE, SECTION, LEAST = 3000, 60, 1200, 150
CUT, OMITTED = "\n[...section truncated]", "\n\n[README excerpt; remaining text omitted]"

_HEADING = re.compile(r"#{1,4}\s")


def split_sections(text: str) -> list[dict[str, str]]:
    """Heading and text of each section with text: a heading outside fenced code begins one; what stands before the first is the introduction."""
    parts, fenced = [("(intro)", [])], False
    for line in text.splitlines():
        fenced ^= line.startswith("```")
        if not fenced and _HEADING.match(line):
            parts.append((line.lstrip("#").strip(), []))
        parts[-1][1].append(line)
    joined = [(heading, "\n".join(lines).strip()) for heading, lines in parts]
    return [{"heading": heading, "text": body} for heading, body in joined if body]


def sections(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, sections``: the sections of each row's cleaned Markdown, in one narrow pass; null texts have none."""

    @F.pandas_udf("array<struct<heading:string,text:string>>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(split_sections)

    return rows.where(F.col(text).isNotNull()).select(key, split(clean_markdown(F.col(text))).alias("sections"))


def ranked(of: Column) -> Column:
    """The sections with ``i``, ``rank`` (0 introduction, 1 preferred, 2 others, 9 left out) and ``cost``, the first one always being the introduction."""
    rank = lambda x, i: F.when(i == 0, 0).when(x["heading"].rlike(SKIP), 9).when(x["heading"].rlike(PRIORITY), 1).otherwise(2)
    return F.transform(of, lambda x, i: F.struct(rank(x, i).alias("rank"), i.alias("i"), (F.least(F.length(x["text"]), F.lit(SECTION)) + 2).alias("cost")))


def chosen(of: Column) -> Column:
    """Which sections are taken by rank while enough of the budget is left, with what was left before each (``i, left``).

    At most about a thousand are taken, as each costs three characters or more."""
    start = F.struct(F.lit(LIMIT - RESERVE).alias("left"), F.array().cast("array<struct<i:int,left:int>>").alias("taken"))
    step = lambda a, x: F.when((x["rank"] == 9) | (a["left"] <= LEAST), a).otherwise(F.struct((a["left"] - x["cost"]).alias("left"), F.concat(a["taken"], F.array(F.struct(x["i"].cast("int").alias("i"), a["left"].alias("left")))).alias("taken")))
    return F.aggregate(F.array_sort(ranked(of)), start, step)["taken"]


def excerpt(of: Column) -> Column:
    """The whole text if it is short; else the introduction and the preferred sections within the limit, each cut at a line's end, in the text's order."""
    whole = F.array_join(F.transform(of, lambda x: x["text"]), "\n\n")
    body = lambda t: F.when(F.length(t) > SECTION, F.concat(F.regexp_replace(F.substring(t, 1, SECTION), r"(?s)\n[^\n]*\z", ""), F.lit(CUT))).otherwise(t)
    parts = F.transform(F.array_sort(chosen(of)), lambda x: body(F.get(of, x["i"])["text"]))
    return F.when(F.length(whole) <= LIMIT, whole).otherwise(F.concat(F.substring(F.array_join(parts, "\n\n"), 1, LIMIT - RESERVE), F.lit(OMITTED)))
