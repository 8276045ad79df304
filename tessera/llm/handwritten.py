"""Generated, minified, vendored and data files among source files (problem 1).

Three linear support-vector classifiers look at a file: at its body (hashed character n-grams, with the head comment masked, so
that giveaway headers are not what it learns), at its head comment (hashed character n-grams, with the giveaway words masked), and at its path (path
components and their n-grams). They are fitted on a bounded sample of rows labelled by what is already known - the older
scanner's ``skipped_reason``, plain giveaways in head comments and well-known path parts - and each view's threshold is set on repositories that
its fit never saw. A second fit takes over what the first one found, so that the labels' gaps count less as negatives. Reasons, which may be
wrong, label bodies only: a head comment is often unlike any other and would be learnt by heart.

A copy of third-party code that was put among a repository's own files, perhaps patched and without its header, looks like
any other code. It is found by its line runs: winnowed fingerprints of files that the head or path view reports, matched with
all other files' fingerprints. Files match a set of fingerprints, not each other, so no pairs arise however often a text recurs.

Defined results: a null text gives no row; an empty text is judged by its path; null paths and repositories count as empty;
files judged alike have the same text and path; repeated ids give repeated rows; extra columns are ignored. An empty table, or one
without labels, gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import scratch

#: Words of head comments that say a file was not written by hand, and path parts that hold such files by convention.
GIVEAWAYS = r"generated|do not edit|regenerate|automatically produced|vendored|copied from|upstream|minified"
PATH_PARTS = r"(^|/)(node_modules|bower_components|_?vendor(ed)?|_vendored|third_?party|3rd_?party|external|extern|deps|static/libs|_?generated)/|\.min\.|\.bundle\.|\.gen\.|_pb2\."
#: Reasons for skipping that say nothing about who wrote a file.
PLAIN_REASONS = r"^\s*(unsupported extension|file too large)"

WIDTH = 1 << 16
_HEAD = re.compile(r"\ufeff?(?:[ \t]*(?:(?:#|//|<!--|--)[^\n]*|/\*.*?\*/|\"\"\"[^\n]*?\"\"\"|'''[^\n]*?''')?[ \t]*(?:\n|\Z))*", re.S)
_GIVEAWAY = re.compile(GIVEAWAYS, re.I)
_PATH_PART = re.compile(PATH_PARTS, re.I)
_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|-?\b[0-9][0-9a-fA-FxX_.eE+-]*|\b(?:true|false|null|None|True|False)\b|[\s\[\]{}(),:;]+")
_NUMBER = re.compile(r"[0-9]+")
_VERSION = re.compile(r"-\d+(\.\d+)+")


def split_head(text: str) -> tuple[str, str]:
    """The comment lines that a file begins with, and the rest."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    end = _HEAD.match(text).end()
    return text[:end], text[end:]


def _ngrams(raw: bytes, n: int, salt: int) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(x) < n:
        return np.empty(0, np.uint32)
    h = np.full(len(x) - n + 1, salt, np.uint32)
    for i in range(n):
        h = (h * np.uint32(0x01000193)) ^ x[i : len(x) - n + 1 + i]
    h *= np.uint32(0x9E3779B1)
    return h >> np.uint32(16)


def body_features(body: str) -> np.ndarray:
    """Which buckets the body's 4-grams fall into; digits and indents are made alike."""
    seen = np.zeros(WIDTH, bool)
    seen[_ngrams(_NUMBER.sub("0", body).encode("utf-8", "replace"), 4, 7)] = True
    return np.flatnonzero(seen)


def head_features(head: str) -> np.ndarray:
    """Which buckets the head comment's 3- and 5-grams fall into; the words that label it are masked, so that only the rest can be learnt."""
    raw = _NUMBER.sub("0", " ".join(_GIVEAWAY.sub(" ", head).lower().split())).encode("utf-8", "replace")
    return np.unique(np.concatenate([_ngrams(raw, n, n) for n in (3, 5)])).astype(np.int64)


def path_features(path: str) -> np.ndarray:
    *folders, name = path.lower().split("/")
    parts = [f"d:{_VERSION.sub('-V', f)}" for f in folders] + ["d:*-V" for f in folders if _VERSION.search(f)]
    stem = re.split(r"[._]", name)
    parts += [f"n:{s}" for s in stem[1:]] + [f"e:{'.'.join(name.split('.')[1:])}", f"k:{len(folders)}"]
    return np.unique(np.array([zlib.crc32(p.encode()) % WIDTH for p in parts], np.int64))


VIEWS = ("body", "head", "path")


@dataclass
class Linear:
    weights: np.ndarray
    bias: float
    threshold: float = 0.0

    def score(self, idx: np.ndarray) -> float:
        return float(self.weights[idx].sum() / np.sqrt(len(idx)) + self.bias) if len(idx) else float("-inf")


def fit_linear(rows: list[np.ndarray], labels: np.ndarray, ridge: float = 1e-4, epochs: int = 4, seed: int = 0) -> Linear:
    """A linear support-vector classifier by averaged stochastic subgradients of the hinge loss; both classes weigh the same."""
    rng = np.random.default_rng(seed)
    w, total, b, b_total, t, scale = np.zeros(WIDTH), np.zeros(WIDTH), 0.0, 0.0, 0, 1.0
    n = len(rows)
    pos = max(1, int((labels > 0).sum()))
    cost = {1: n / (2 * pos), -1: n / (2 * max(1, n - pos))}
    for epoch in range(epochs):
        for i in rng.permutation(n):
            t += 1
            rate = 1.0 / (ridge * (t + 1.0 / ridge))
            idx, y = rows[i], int(labels[i])
            scale *= 1 - rate * ridge
            if len(idx):
                norm = np.sqrt(len(idx))
                if y * (scale * w[idx].sum() / norm + b) < 1:
                    w[idx] += rate * y * cost[y] / norm / scale
                    b += 0.1 * rate * y * cost[y]
        if epoch >= epochs // 2:
            total += scale * w
            b_total += b
    kept = epochs - epochs // 2
    return Linear(total / kept, b_total / kept)


def _threshold(scores: np.ndarray, low: float = 0.1, high: float = 1.0, width: float = 0.15) -> float:
    """Where, between the margins, the fewest held-out scores lie near: the valley between both kinds, the middle of it if it is wide."""
    at = np.round(np.arange(low, high + 1e-9, 0.02), 2)
    near = np.array([(np.abs(scores - t) < width).sum() for t in at])
    best = np.flatnonzero(near == near.min())
    return float(at[best[len(best) // 2]])


def is_data(body: str, share: float = 0.8, least: int = 5) -> bool:
    """Whether nearly all lines, or nearly all characters, are literals without any code between them."""
    lines = [x for x in body.split("\n") if x.strip()]
    if len(lines) >= least:
        return sum(sum(len(m[0]) for m in _LITERAL.finditer(x)) >= len(x.rstrip()) - 1 for x in lines) >= share * len(lines)
    return len(body) > 200 and sum(len(m[0]) for m in _LITERAL.finditer(body)) >= share * len(body)


def labelled(files: DataFrame, results: DataFrame) -> DataFrame:
    """Files with text, with ``reason``: whether the older scanner skipped the file as not written by hand."""
    reasons = (
        results.where(F.col("skipped_reason").isNotNull() & (F.trim("skipped_reason") != "") & ~F.lower("skipped_reason").rlike(PLAIN_REASONS))
        .select(F.col("file_id").alias("r_id")).distinct()
    )
    return (
        files.where("text is not null").select("file_id", F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("path", F.lit("")).alias("path"), "text")
        .join(reasons, F.col("file_id") == F.col("r_id"), "left").withColumn("reason", F.col("r_id").isNotNull()).drop("r_id")
    )


def fit_views(rows: DataFrame, sample: int = 12_000, held_out: int = 5) -> dict[str, Linear]:
    """Fits the views on about ``sample`` rows, drawn by a hash of the id; that bound is a parameter. One task fits each view.

    A narrow pass makes the features; only the numbers of a view's buckets go on to its task (at most 128 KB for a file of any length), no texts.
    Repositories whose hash falls in one of ``held_out`` parts are kept for the thresholds, which are set in the valley of the kept
    rows' scores: labels are incomplete, so that they cannot measure precision.
    """
    share = sample / max(1, rows.count())
    drawn = rows.where(F.pmod(F.xxhash64("file_id"), F.lit(1_000_003)) < share * 1_000_003) if share < 1 else rows

    def views(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for repo, path, text, reason in zip(b["repo"], b["path"], b["text"], b["reason"]):
                head, body = split_head(text)
                told = bool(_GIVEAWAY.search(head) or _PATH_PART.search(path))
                apart = zlib.crc32(repo.lower().encode()) % held_out == 0
                order = f"{repo}\n{path}"
                for view, x, y in (("body", body_features(body), told or bool(reason) or is_data(body)), ("head", head_features(head), told), ("path", path_features(path), told)):
                    out.append((view, order, apart, y, x.astype(np.uint16).tobytes()))
            yield pd.DataFrame(out, columns=["view", "at", "apart", "told", "buckets"])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        view = rows["view"].iloc[0]
        rows = rows.sort_values("at")
        x = [np.frombuffer(v, np.uint16).astype(np.int64) for v in rows["buckets"]]
        y, apart = np.where(rows["told"].to_numpy(bool), 1, -1), rows["apart"].to_numpy(bool)
        if not (y[~apart] > 0).any() or not (y[~apart] < 0).any() or not apart.any():
            return pd.DataFrame({"view": [view], "weights": [np.zeros(WIDTH, np.float32).tobytes()], "bias": [0.0], "threshold": [float("inf")]})
        keep = np.flatnonzero(~apart)
        labels = y
        for _ in range(2):  # what the first fit finds is no negative for the second
            model = fit_linear([x[i] for i in keep], labels[keep])
            scores = np.array([model.score(i) for i in x])
            threshold = _threshold(scores[apart])
            labels = np.where((y > 0) | (scores >= threshold), 1, -1)
        return pd.DataFrame({"view": [view], "weights": [model.weights.astype(np.float32).tobytes()], "bias": [model.bias], "threshold": [threshold]})

    made = drawn.select("repo", "path", "text", "reason").mapInPandas(views, "view string, at string, apart boolean, told boolean, buckets binary")
    fitted = made.groupBy("view").applyInPandas(fit, "view string, weights binary, bias double, threshold double").collect()
    return {r.view: Linear(np.frombuffer(r.weights, np.float32), r.bias, r.threshold) for r in fitted}


def fingerprints(body: str, run: int = 5, window: int = 4) -> list[int]:
    """Winnowed hashes of runs of ``run`` lines: any ``run + window - 1`` equal lines share one."""
    lines = [x for x in (line.strip() for line in body.split("\n")) if x]
    if len(lines) < run:
        return []
    h = [zlib.crc32(x.encode("utf-8", "replace")) for x in lines]
    runs = []
    for i in range(len(h) - run + 1):
        v = 0xCBF29CE484222325
        for x in h[i : i + run]:
            v = ((v ^ x) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        runs.append(v - (1 << 63))
    return list({min(runs[i : i + window]) for i in range(max(1, len(runs) - window + 1))})


def judged_files(files: DataFrame, results: DataFrame, sample: int = 12_000, copied: float = 0.5) -> DataFrame:
    """``file_id, body, head, path, copy, found``: how far each view's score lies above its threshold, the share of a file's line runs
    that stand in third-party files, and whether the file was not written by hand for its repository.

    ``copied``: from this share on a file is a copy.
    """
    spark = files.sparkSession
    rows = labelled(files, results)
    models = fit_views(rows, sample)
    if not models:
        return spark.createDataFrame([], "file_id bigint, body double, head double, path double, copy double, found boolean")
    ready = spark.sparkContext.broadcast(models)  # three vectors of 65,536 numbers

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have = ready.value
        for b in batches:
            out = {v: [] for v in VIEWS}
            prints = []
            for path, text in zip(b["path"], b["text"]):
                head, body = split_head(text)
                for v, x in (("body", body_features(body)), ("head", head_features(head)), ("path", path_features(path))):
                    s = have[v].score(x)
                    out[v].append(max(-99.0, s - have[v].threshold))
                prints.append(fingerprints(body))
            yield pd.DataFrame({"file_id": b["file_id"], **out, "prints": prints})

    path = scratch(spark, "judged")
    rows.select("file_id", "path", "text").mapInPandas(judge, "file_id bigint, body double, head double, path double, prints array<bigint>").write.parquet(path)
    scored = spark.read.parquet(path)
    foreign = scored.where("head >= 0 or path >= 0").select(F.explode("prints").alias("p")).distinct()
    shares = (
        scored.where("not (head >= 0 or path >= 0 or body >= 0) and size(prints) > 0").select("file_id", F.explode("prints").alias("p"))
        .join(foreign.withColumn("hit", F.lit(1)), "p", "left").groupBy("file_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("copy"))
    )
    return (
        scored.drop("prints").join(shares, "file_id", "left").withColumn("copy", F.coalesce("copy", F.lit(0.0)))
        .withColumn("found", (F.col("body") >= 0) | (F.col("head") >= 0) | (F.col("path") >= 0) | (F.col("copy") >= copied))
    )


def not_handwritten(files: DataFrame, results: DataFrame) -> DataFrame:
    """``file_id`` of the files that nobody wrote by hand for their repository."""
    return judged_files(files, results).where("found").select("file_id")


def plain_path(path: Column) -> Column:
    """A path without ``./``, doubled or leading slashes, and with forward slashes."""
    x = F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), r"/+", "/")
    return F.regexp_replace(x, r"^(\./|/)+", "")


def handwritten_findings(findings: DataFrame, files: DataFrame, results: DataFrame) -> DataFrame:
    """The findings that stand in files not reported by ``not_handwritten``; repeated rows stay, findings in unknown files too."""
    reported = (
        not_handwritten(files, results).join(files.select("file_id", "repo", "path"), "file_id")
        .select(F.lower(F.trim("repo")).alias("r_repo"), plain_path(F.col("path")).alias("r_path")).distinct()
    )
    return findings.join(reported, (F.lower(F.trim("repo_name")) == F.col("r_repo")) & (plain_path(F.col("file")) == F.col("r_path")), "left_anti")
