"""Keyword-stuffed, link-list and tag pages (problem 8).

Each text is cut into blocks (paragraphs, short ones joined, long ones split). A block's compression ratio is compared with
the usual ratio of blocks of its length and language, measured over all blocks of the corpus. A block is stuffing if it is
far more redundant than usual and has hardly any sentence punctuation. In a block of extreme redundancy only sentences that say something new
in the block count as punctuated, so that a slogan with changing fillers is confirmed too. A document is reported with the share of its words that stand in such blocks.

Texts are read once: block figures (about 40 bytes a block) go to a table in the shared folder, and both the usual ratios and the
documents' shares come from that table. The usual ratios are one row per language and length class; whether they are broadcast is left to Spark, which
knows the size of their written table.

Defined results: null, empty and blank texts have no words and are not stuffing (share 0); a null or unknown language is judged
by script; rows are judged one by one, so that repeated rows get repeated results; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut, scratch

_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_STOP = re.compile(r"[.!?;:](?=\s|$|[\"')\]*_<`])|[。！？；]")
_LINK = re.compile(r"(?:https?://|www\.)\S+")
_WORD = re.compile(r"\w+")
_GAP = re.compile(r"\n[ \t]*\n")

#: Ratio that prose of these lengths (log2 of bytes) has before any corpus is known; it steadies classes with few blocks.
_PROSE = ((6.5, 0.87), (7.5, 0.74), (8.5, 0.67), (9.5, 0.60), (10.5, 0.53), (11.5, 0.42), (12.5, 0.36))


def split_blocks(text: str, least: int = 200, most: int = 1600) -> Iterator[str]:
    """Paragraphs; those under ``least`` characters are joined with the next, those over ``most`` are split at white space."""
    short = ""
    for part in _GAP.split(text.replace("\r\n", "\n").replace("\r", "\n")):
        if not part.strip():
            continue
        if len(part) >= least and short:
            yield short
            short = ""
        short = f"{short}\n\n{part}" if short else part
        if len(short) < least:
            continue
        start = 0
        while start < len(short):
            end = min(len(short), start + most)
            if len(short) - end < least:
                end = len(short)
            elif end < len(short) and (cut := max(short.rfind(" ", start + most // 2, end), short.rfind("\n", start + most // 2, end))) > start:
                end = cut
            yield short[start:end]
            start = end
        short = ""
    if short:
        yield short


def count_words(text: str) -> float:
    """Words between white space; two ideographs count as one word."""
    n = float(len(text.split()))
    return n if text.isascii() else n + len(_CJK.findall(text)) / 2


def new_sentences(plain: str) -> int:
    """Sentence stops of ``plain`` after sentences of whose word pairs at least half are new in the block."""
    seen: set[tuple[str, str]] = set()
    n = start = 0
    for m in _STOP.finditer(plain):
        words = _WORD.findall(plain[start : m.start()].lower())
        pairs = set(zip(words, words[1:])) or {(w, "") for w in words}
        n += 2 * len(pairs - seen) >= len(pairs) > 0
        seen |= pairs
        start = m.end()
    return n


def _figures(text: str, extreme: float) -> tuple[float, float, float, float, float]:
    raw = text.encode("utf-8", "replace")
    plain = _LINK.sub(" ", text) if "://" in text or "www." in text else text
    words = max(len(_WORD.findall(plain)) if text.isascii() else count_words(plain), 1)
    ratio, size, stops = len(zlib.compress(raw, 6)) / len(raw), math.log2(len(raw)), len(_STOP.findall(plain))
    fresh = new_sentences(plain) if stops and ratio < extreme else stops  # no usual ratio is above 1
    return ratio, size, stops / words, fresh / words, count_words(text)


def block_figures(documents: DataFrame, extreme: float) -> DataFrame:
    """``doc_id, lang, ratio, size, stops, fresh, words`` of every block; ``fresh`` are the stops of new sentences where the ratio may be extreme."""

    def figures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, langs, rows = [], [], []
            for i, (doc, lang, text) in enumerate(zip(b["doc_id"], b["lang"], b["text"])):
                if not isinstance(text, str):
                    continue
                lang = re.sub(r"[^a-z].*", "", (lang or "").strip().lower()) or "-"
                for block in split_blocks(text):
                    ids.append(doc)
                    cjk = not block.isascii() and len(_CJK.findall(block)) > len(block) / 4
                    langs.append("zh" if cjk and lang not in ("ja", "ko") else "-" if lang == "zh" and not cjk else lang)
                    rows.append(_figures(block, extreme))
            ratio, size, stops, fresh, words = np.array(rows).reshape(-1, 5).T
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "lang": pd.Series(langs, dtype="str"), "ratio": ratio, "size": size, "stops": stops, "fresh": fresh, "words": words})

    return documents.select("doc_id", "lang", "text").where("doc_id is not null").mapInPandas(figures, "doc_id bigint, lang string, ratio double, size double, stops double, fresh double, words double")


def prose_ratio(size: Column) -> Column:
    """The ratio of prose of this size, between the points of ``_PROSE`` in straight lines."""
    out = F.lit(_PROSE[0][1])
    for (a, ra), (b, rb) in zip(_PROSE, _PROSE[1:]):
        out = F.when(size > a, F.lit(ra) + (F.least(size, F.lit(b)) - a) / (b - a) * (rb - ra)).otherwise(out)
    return out


def usual_ratios(blocks: DataFrame, quiet: float, steady: int = 30) -> DataFrame:
    """``lang, class, usual``: the median ratio of blocks with sentence punctuation, by language and half power of two of the size.

    Classes with few blocks lean on the prose curve by ``steady`` blocks' weight.
    """
    by = (
        blocks.where(F.col("stops") >= quiet).withColumn("class", F.floor(F.col("size") * 2))
        .groupBy("lang", "class").agg(F.percentile_approx("ratio", 0.5, 1000).alias("median"), F.count("*").alias("n"))
    )
    return by.select("lang", "class", ((F.col("median") * F.col("n") + prose_ratio(F.col("class") / 2 + 0.25) * steady) / (F.col("n") + steady)).alias("usual"))


def stuffing_shares(documents: DataFrame, redundant: float = 0.86, quiet: float = 0.03, extreme: float = 0.52) -> DataFrame:
    """``doc_id, words, stuffed_words, share`` of every document that has a word.

    ``redundant``: a block under this part of the usual ratio is a candidate; ``quiet``: candidates with fewer stops a word are
    confirmed; ``extreme``: under this part of the usual ratio only stops of new sentences count.
    """
    spark = documents.sparkSession
    path = scratch(spark, "blocks")
    block_figures(documents, extreme).write.parquet(path)
    blocks = spark.read.parquet(path)
    usual = cut(usual_ratios(blocks, quiet).withColumnRenamed("class", "u_class").withColumnRenamed("lang", "u_lang"))
    part = F.col("ratio") / F.coalesce("usual", prose_ratio(F.col("size")))
    stuffed = (part < redundant) & (F.when(part < extreme, F.col("fresh")).otherwise(F.col("stops")) < quiet)
    return (
        blocks.join(usual, (F.col("lang") == F.col("u_lang")) & (F.floor(F.col("size") * 2) == F.col("u_class")), "left")
        .groupBy("doc_id").agg(F.sum("words").alias("words"), F.sum(F.when(stuffed, F.col("words")).otherwise(0.0)).alias("stuffed_words"))
        .withColumn("share", F.when(F.col("words") > 0, F.col("stuffed_words") / F.col("words")).otherwise(F.lit(0.0)))
    )


def stuffed_documents(documents: DataFrame, share: float = 0.5) -> DataFrame:
    """``doc_id`` of the documents of whose words more than ``share`` stand in stuffing."""
    return stuffing_shares(documents).where(F.col("share") > share).select("doc_id")
