"""Held-out passages inside a corpus (problem 7).

Pigeonhole edit matching on words: a window of ``span`` words with at most ``budget`` differing words holds, cut into
``budget + 1`` pieces, one piece unchanged. All word runs of piece length of the items form the piece table. One narrow pass over the documents
keeps the stretches around words whose run may be a piece; the stretches meet the piece table by equality of hashes, and each stretch and item
that share a piece are verified by Myers' bit-parallel edit distance over the words of the window.
What passes is aligned exactly, and counts if the aligned passage begins and ends with matching words, spans
``span`` or more words of the item and differs in at most about ``rate`` of them.

However many items there are, they stay tables: their words, the wording that several of them share (a grouped count) and their pieces are made by
Spark. What the pass over the documents gets is a Bloom filter of the pieces of at most ``most_bits`` bits; when more pieces than it is made for go in, more
stretches come out and meet no piece, but none is lost. Texts are read once and never shuffled, only stretches that may hold something are.

Words are runs of letters and digits after undoing escapes, entities, tags and compatibility forms, in lower case. Wording
that stands in several items (runs of ``common`` words or more) is not an item's own and does not count.

Defined results: null and empty texts and items match nothing; each pair of ids is given once, however often a row or a
passage is repeated; items shorter than ``span`` words match nothing; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

_WORD = re.compile(r"[^\W_]+")
_CODE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|%([2-7][0-9a-fA-F])")
_SLASH = re.compile(r"\\+[nrtbf](?![a-z]:)|\\+")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>|<!--|-->")
_BLANK = re.compile("[­​-‏⁠﻿]")


def plain_words(text: str) -> list[str]:
    """The words of ``text``, whatever its case, punctuation, spacing, markup and escaping."""
    if "&" in text:
        text = html.unescape(text)
        if "&" in text:
            text = html.unescape(text)
    if "\\" in text or "%" in text:
        text = _CODE.sub(lambda m: chr(int(m[1] or m[2] or m[3], 16)), text)
        text = _SLASH.sub(" ", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _BLANK.sub("", text))
    return _WORD.findall(text.lower())


class WordNumbers(dict):
    """64-bit numbers of words; what is remembered is bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return got

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def run_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[i : len(ids) - n + 1 + i]
        out ^= out >> np.uint64(29)
    return out


def myers(pattern: list, text: list) -> int:
    """The least edit distance of ``pattern`` to any stretch of ``text``: Myers' bit vectors with words as symbols."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for w in text:
        eq = masks.get(w, 0)
        d0 = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (~(d0 | plus) & full)
        down = plus & d0
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (~(d0 | up) & full)
        minus = up & d0
        best = min(best, score)
    return best


def aligned(item: np.ndarray, own: np.ndarray, text: np.ndarray, rate: float) -> tuple[int, int]:
    """The longest passage of the item's own wording in ``text``: its words and its differing words.

    Local alignment in which a match earns 1 and a difference costs ``(1 - rate) / rate`` over two, so that a stretch holds
    together as long as differences stay near ``rate``; it begins and ends with a match. Ends within a step that lowers the sum are trimmed.
    """
    cost = (1 - rate) / rate / 2
    n, m = len(item), len(text)
    best = (0, 0)
    steps = np.arange(m + 1)
    score = np.zeros(m + 1)
    start = np.zeros(m + 1, np.int64)
    errors = np.zeros(m + 1, np.int64)
    for i in range(1, n + 1):
        if not own[i - 1]:
            score, start, errors = np.zeros(m + 1), np.full(m + 1, i), np.zeros(m + 1, np.int64)
            continue
        new, begin, wrong = np.zeros(m + 1), np.full(m + 1, i), np.zeros(m + 1, np.int64)
        hit = text == item[i - 1]
        diagonal = score[:-1] + np.where(hit, 1.0, -cost)
        above = score[1:] - cost
        take = diagonal >= above
        value = np.where(take, diagonal, above)
        live = value > 0
        new[1:] = np.where(live, value, 0)
        begin[1:] = np.where(live, np.where(take, np.where(score[:-1] > 0, start[:-1], i - 1), start[1:]), i)
        wrong[1:] = np.where(live, np.where(take, np.where(score[:-1] > 0, errors[:-1], 0) + ~hit, errors[1:] + 1), 0)
        reach = new + cost * steps  # additions in the text
        top = np.maximum.accumulate(reach)
        source = np.maximum.accumulate(np.where(reach == top, steps, 0))
        new, begin, wrong = top - cost * steps, begin[source], wrong[source] + steps - source
        ends = np.flatnonzero(hit & (new[1:] > 0)) + 1
        for j in ends:
            length = i - int(begin[j])
            if length > best[0]:
                best = (length, int(wrong[j]))
        score, start, errors = new, begin, wrong
    return best


def holds(ids: np.ndarray, words: np.ndarray, own: np.ndarray, span: int, budget: int, rate: float) -> bool:
    """Whether a stretch of a document, as word numbers, holds a passage of the item ``words``."""
    piece = span // (budget + 1)
    runs, mine = run_hashes(ids, piece), run_hashes(words, piece)
    whole = np.flatnonzero(np.convolve(own, np.ones(piece, int), "valid") == piece)  # pieces of the item's own wording
    order = whole[np.argsort(mine[whole], kind="stable")]
    left, right = np.searchsorted(mine[order], runs), np.searchsorted(mine[order], runs, side="right")
    known = np.isin(ids, words)
    near_known = np.concatenate([[0], np.cumsum(known)])
    reach = span + budget
    tried: set[tuple[int, int]] = set()
    aligned_at: dict[int, int] = {}  # on each diagonal, the last window that was aligned
    for d in np.flatnonzero(right > left).tolist():
        # a window within the budget leaves at least so many of the item's words
        if near_known[min(len(ids), d + piece + reach)] - near_known[max(0, d - reach)] < span - budget:
            continue
        for p in order[left[d] : right[d]].tolist():
            for s in range(max(0, p + piece - span), min(p, len(words) - span) + 1):
                if (s, d - p) in tried or not own[s : s + span].all():
                    continue
                tried.add((s, d - p))
                if d - p in aligned_at and s - aligned_at[d - p] <= span // 2:
                    continue
                a = d - (p - s)
                if myers(words[s : s + span].tolist(), ids[max(0, a - budget) : a + span + budget].tolist()) > budget:
                    continue
                aligned_at[d - p] = s
                part = slice(max(0, s - span), s + 2 * span)  # holds every passage of ``span`` words that meets this window, and those of the next windows
                length, _ = aligned(words[part], own[part], ids[max(0, a - span - 2 * budget) : max(0, a) + 2 * span + 2 * budget], rate)
                if length >= span:
                    return True
    return False


def item_words(items: DataFrame, span: int, common: int, piece: int) -> DataFrame:
    """``item_id, ids, own, pieces``: an item's words as numbers, which of them are its own wording, and the hashes of its own pieces."""

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = WordNumbers()
        for b in batches:
            ids = [numbers.of(plain_words(t)).view(np.int64) for t in b["text"]]
            yield pd.DataFrame({"item_id": b["item_id"], "ids": pd.Series([x.tolist() for x in ids], dtype="object")})

    plain = items.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    numbered = cut(plain.mapInPandas(number, "item_id bigint, ids array<bigint>").where(F.size("ids") >= span))
    slices = F.transform(F.sequence(F.lit(1), F.size("ids") - common + 1), lambda i: F.xxhash64(F.slice("ids", i, common)))
    runs = numbered.select(F.xxhash64("ids").alias("item"), F.posexplode(slices).alias("at", "run"))
    several = runs.groupBy("run").agg(F.min("item").alias("least"), F.max("item").alias("most")).where("least <> most").select("run")
    shared = runs.join(several, "run").groupBy("item").agg(F.collect_set("at").alias("shared"))  # as many as the item has words at most

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own, pieces = [], []
            for ids, at in zip(b["ids"], b["shared"]):
                mine = np.ones(len(ids), bool)
                for i in at if at is not None else ():
                    mine[i : i + common] = False
                whole = np.convolve(mine, np.ones(piece, int), "valid") == piece
                own.append(mine.tolist())
                pieces.append(np.unique(run_hashes(np.asarray(ids, np.int64).view(np.uint64), piece)[whole]).view(np.int64).tolist())
            yield pd.DataFrame({"item_id": b["item_id"], "ids": b["ids"], "own": pd.Series(own, dtype="object"), "pieces": pd.Series(pieces, dtype="object")})

    return numbered.withColumn("item", F.xxhash64("ids")).join(shared, "item", "left").select("item_id", "ids", "shared").mapInPandas(told, "item_id bigint, ids array<bigint>, own array<boolean>, pieces array<bigint>")


_PROBES = 4


def piece_filter(pieces: DataFrame, most_bits: int) -> np.ndarray:
    """A Bloom filter of ``pieces (piece)`` as 64-bit words: 64 bits for each piece up to ``most_bits``, whose words are all that the driver gets."""
    n = pieces.count()
    bits = 1 << min(max(10, (64 * n).bit_length()), most_bits.bit_length() - 1)
    spots = F.explode(F.array(*[F.expr(f"((piece & 4294967295L) + {i}L * (shiftrightunsigned(piece, 32) | 1L)) % {bits}L") for i in range(_PROBES)]))
    words = pieces.select(spots.alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def may_hold(runs: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The places of ``runs`` that the filter lets through."""
    at = np.arange(len(runs))
    low, high, n = runs & np.uint64(0xFFFFFFFF), (runs >> np.uint64(32)) | np.uint64(1), np.uint64(len(bits) * 64)
    for i in range(_PROBES):
        spot = (low[at] + np.uint64(i) * high[at]) % n
        at = at[(bits[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) == 1]
    return at


def stretches(documents: DataFrame, bits: np.ndarray, span: int, budget: int) -> DataFrame:
    """``doc_id, ids, hits``: the stretches of documents around runs that may be pieces, as word numbers, with those runs' hashes."""
    piece, around = span // (budget + 1), 2 * (span + budget)
    ready = documents.sparkSession.sparkContext.broadcast(bits)

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, numbers = ready.value, WordNumbers()
        for b in batches:
            docs, ids, hits = [], [], []
            for doc, text in zip(b["doc_id"], b["text"]):
                words = plain_words(text)
                if len(words) < span - budget:
                    continue
                x = numbers.of(words)
                runs = run_hashes(x, piece)
                at = may_hold(runs, bits)
                if not len(at):
                    continue
                for part in np.split(at, np.flatnonzero(np.diff(at) > 2 * around) + 1):
                    docs.append(doc)
                    ids.append(x[max(0, part[0] - around) : part[-1] + piece + around].view(np.int64).tolist())
                    hits.append(np.unique(runs[part]).view(np.int64).tolist())
            yield pd.DataFrame({"doc_id": pd.Series(docs, dtype="int64"), "ids": pd.Series(ids, dtype="object"), "hits": pd.Series(hits, dtype="object")})

    return documents.select("doc_id", "text").where("doc_id is not null and text is not null").mapInPandas(sweep, "doc_id bigint, ids array<bigint>, hits array<bigint>")


def leaked_items(documents: DataFrame, items: DataFrame, span: int = 25, budget: int = 3, rate: float = 0.14, common: int = 8, most_bits: int = 1 << 28) -> DataFrame:
    """``doc_id, item_id`` of every document that holds a passage of an item; see the module's text."""
    piece = span // (budget + 1)
    asked = cut(item_words(items, span, common, piece))
    pieces = asked.select("item_id", F.explode("pieces").alias("piece"))
    found = cut(stretches(documents, piece_filter(pieces.select("piece").distinct(), most_bits), span, budget).withColumn("stretch", F.xxhash64("doc_id", "ids")))
    pairs = found.select("stretch", F.explode("hits").alias("piece")).join(pieces, "piece").select("stretch", "item_id").distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = [
                holds(np.asarray(x, np.int64).view(np.uint64), np.asarray(w, np.int64).view(np.uint64), np.asarray(o, bool), span, budget, rate)
                for x, w, o in zip(b["ids"], b["words"], b["own"])
            ]
            yield b.loc[keep, ["doc_id", "item_id"]]

    met = pairs.join(found.select("stretch", "doc_id", "ids"), "stretch").join(asked.select("item_id", F.col("ids").alias("words"), "own"), "item_id")
    return met.select("doc_id", "item_id", "ids", "words", "own").mapInPandas(verify, "doc_id bigint, item_id bigint").distinct()
