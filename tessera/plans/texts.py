"""Queries over Markdown texts: cleaning, sections, excerpts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import sections as X
from tessera.plans.core import query
from tessera.sources.tables import table

_BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANK}|{_BLANK}$', '', 'g')"


_PLAIN = "text"
for _noise in T.MARKDOWN_NOISE:
    _PLAIN = f"regexp_replace({_PLAIN}, '{_noise}', '', 'g')"
_CLEAN = _strip(rf"regexp_replace({_PLAIN}, '\n{{3,}}', chr(10) || chr(10), 'g')")
_SECTIONS = rf"""
x AS (SELECT row_number() OVER () AS k, doc_id, {_CLEAN} AS t FROM documents WHERE text IS NOT NULL),
l AS (SELECT k, doc_id, i, x[i] AS line FROM (SELECT k, doc_id, regexp_split_to_array(t, '\r\n|[\n\r\x{{0b}}\x{{0c}}\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]') AS x FROM x), unnest(generate_series(1, len(x))) AS g(i)),
c AS (SELECT *, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) % 2 AS fenced FROM l),
h AS (SELECT *, fenced = 0 AND regexp_matches(line, '^#{{1,4}}\s') AS heads FROM c),
n AS (SELECT *, sum(CASE WHEN heads THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS part FROM h),
p AS (SELECT k, doc_id, part, coalesce(max({_strip("ltrim(line, '#')")}) FILTER (heads), '(intro)') AS heading, {_strip("string_agg(line, chr(10) ORDER BY i)")} AS text FROM n GROUP BY k, doc_id, part),
s AS (SELECT k, doc_id, CAST(row_number() OVER (PARTITION BY k ORDER BY part) - 1 AS INTEGER) AS i, heading, text FROM p WHERE text <> ''),
r AS (SELECT *, CASE WHEN i = 0 THEN 0 WHEN regexp_matches(heading, '{X.SKIP}') THEN 9 WHEN regexp_matches(heading, '{X.PRIORITY}') THEN 1 ELSE 2 END AS rank, least(length(text), {X.SECTION}) + 2 AS cost FROM s),
b AS (SELECT *, CAST({X.LIMIT - X.RESERVE} - coalesce(sum(cost) FILTER (rank <> 9) OVER (PARTITION BY k ORDER BY rank, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS left_before FROM r)"""


@query(f"SELECT doc_id, length(x) AS n_clean FROM (SELECT doc_id, {_CLEAN} AS x FROM documents)")
def clean_lengths(spark: SparkSession, d: str) -> DataFrame:
    """F7."""
    return table(spark, d, "documents").select("doc_id", F.length(T.clean_markdown(F.col("text"))).cast("bigint").alias("n_clean"))


@query(f"WITH {_SECTIONS} SELECT doc_id, i AS section, heading, CAST(length(text) AS BIGINT) AS size FROM s")
def document_sections(spark: SparkSession, d: str) -> DataFrame:
    """Headings and sizes of all sections."""
    rows = X.sections(table(spark, d, "documents"), "doc_id", "text")
    return rows.select("doc_id", F.posexplode("sections").alias("section", "x")).select("doc_id", "section", "x.heading", F.length("x.text").cast("bigint").alias("size"))


@query(f"WITH {_SECTIONS} SELECT doc_id, i AS section, left_before FROM b WHERE rank <> 9 AND left_before > {X.LEAST}")
def excerpt_budget(spark: SparkSession, d: str) -> DataFrame:
    """The sections taken by rank, and how much was left before each."""
    rows = X.sections(table(spark, d, "documents"), "doc_id", "text")
    return rows.select("doc_id", F.explode(X.chosen(F.col("sections"))).alias("x")).select("doc_id", F.col("x.i").alias("section"), F.col("x.left").alias("left_before"))


@query(rf"""WITH {_SECTIONS},
w AS (SELECT k, string_agg(text, chr(10) || chr(10) ORDER BY i) AS whole FROM s GROUP BY k),
e AS (SELECT k, string_agg(CASE WHEN length(text) > {X.SECTION} THEN regexp_replace(substr(text, 1, {X.SECTION}), '\n[^\n]*$', '') || chr(10) || '[...section truncated]' ELSE text END, chr(10) || chr(10) ORDER BY i) AS parts FROM b WHERE rank <> 9 AND left_before > {X.LEAST} GROUP BY k)
SELECT x.doc_id, CASE WHEN length(coalesce(whole, '')) <= {X.LIMIT} THEN coalesce(whole, '') ELSE substr(parts, 1, {X.LIMIT - X.RESERVE}) || chr(10) || chr(10) || '[README excerpt; remaining text omitted]' END AS excerpt FROM x LEFT JOIN w USING (k) LEFT JOIN e USING (k)""")
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    """the excerpt of each text."""
    rows = X.sections(table(spark, d, "documents"), "doc_id", "text")
    return rows.select("doc_id", X.excerpt(F.col("sections")).alias("excerpt"))


@query(r"""SELECT file_id, length(regexp_replace(regexp_replace(text, '(?s)/\*.*?\*/', '', 'g'), '//[^\n]*', '', 'g')) AS n_code FROM source_files WHERE text IS NOT NULL AND regexp_matches(path, '(?i)\.[cm]?[jt]sx?$')""")
def comment_free_lengths(spark: SparkSession, d: str) -> DataFrame:
    """F27."""
    files = table(spark, d, "source_files").where("text is not null").where(F.col("path").rlike(r"(?i)\.[cm]?[jt]sx?$"))
    return files.select("file_id", F.length(T.without_comments(F.col("text"))).cast("bigint").alias("n_code"))
