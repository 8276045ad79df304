"""One consensus label per item from several judges' labels (problem 3).

Feature-assisted consensus: expectation-maximisation fits, together, a regularised multinomial classifier over item
features and one confusion matrix per judge; the classifier's output is the label prior of the item in the E step.
Features are the words of the item's owner and name, and those of the reasons that its judges gave. The classifier has two halves, each fitted on the items of one
half (by a hash) and used for the other's, so that an item's prior never comes from its own label; how far features count at all is fitted there too. It goes on until
neither part moves.
Judges that repeat one another's mistakes are found by their agreement where they err, and share one vote.

All item work is one pass of ``mapInPandas`` over the item table per iteration. A task sends back only partial sums (of each judge's labels, and the
classifier's gradient), whose size depends on the number of judges and features and not on the number of items; Spark adds them up and the driver gets one model.
Pairs of judges are counted where both answered, by Spark, and only those that look like copies come to the driver. The model's size is checked against ``max_entries``.

Defined results: rows with a null judge, url or time are not countable; a judge's latest row for an item counts (ties in
time: the row without error, then the smaller label); an item with fewer than ``least`` countable answers gives no row; ties
between labels go to the label that comes first in ``labels``; empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

#: The six countable labels as they are spelled in results.
LABELS = (
    "Agentic Applications",
    "Non-Agentic Software",
    "Curated Lists, Courses & Playbooks",
    "External-Agent Wrappers & Interfaces",
    "Tools & Skills for External Agents",
    "Templates, Models & Benchmarks",
)


def plain_url(url: Column) -> Column:
    """Lower case, https, without blanks around, final slashes or ``.git``."""
    x = F.lower(F.trim(F.regexp_replace(url, r"^\s+|\s+$", "")))
    x = F.regexp_replace(x, r"^(?:git\+)?(?:https?|ssh|git)://(?:git@)?(?:www\.)?|^git@|^www\.", "")
    x = F.regexp_replace(x, r"^([^/:]+):(?!\d)", "$1/")
    x = F.regexp_replace(F.regexp_replace(x, r"/+$", ""), r"\.git$", "")
    return F.concat(F.lit("https://"), F.regexp_replace(x, r"/+$", ""))


def countable(votes: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """``url, judge, label, reasoning``: each judge's latest row for an item, if it has no error and one of the labels.

    One grouping with ``max_by`` on the compound order, which combines before the shuffle: repeated and hot rows cost one row per task.
    """
    given = F.lower(F.regexp_replace(F.coalesce(F.col("classification"), F.lit("")), r"^\s+|\s+$", ""))
    number = F.create_map(*[x for i, label in enumerate(labels) for x in (F.lit(label.lower()), F.lit(i))])
    clean = F.col("error").isNull() | (F.trim("error") == "")
    rows = votes.where(F.col("judge").isNotNull() & F.col("url").isNotNull() & F.col("processed_at").isNotNull()).select(
        plain_url(F.col("url")).alias("url"), F.trim("judge").alias("judge"),
        F.struct(F.col("processed_at").alias("at"), clean.alias("clean"), (-F.coalesce(number[given], F.lit(99))).alias("rank"), F.when(clean, number[given]).alias("label"), "reasoning").alias("v"),
    )
    return rows.groupBy("url", "judge").agg(F.max("v").alias("v")).select("url", "judge", F.col("v.label").alias("label"), "v.reasoning").where("label is not null")


def features(width: int) -> tuple[Column, Column]:
    """Numbers of an item's words (of ``url``: owner and name), and of an answer's words (of ``reasoning``), in ``width`` buckets."""

    def numbers(words: Column) -> Column:
        return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) > 1), lambda w: F.pmod(F.xxhash64(w), F.lit(width)).cast("int")))

    name, owner = F.substring_index("url", "/", -1), F.element_at(F.split("url", "/"), -2)
    own = F.concat(F.transform(F.split(name, r"[^\p{L}\p{N}]+"), lambda w: F.concat(F.lit("n:"), w)), F.array(F.concat(F.lit("o:"), owner)))
    return numbers(own), numbers(F.transform(F.split(F.lower(F.coalesce("reasoning", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.when(w != "", F.concat(F.lit("r:"), w)).otherwise("")))


@dataclass
class Answers:
    """A batch of items as flat arrays: the item, judge and label of each answer, and the items' features with a constant."""

    n: int
    item: np.ndarray
    judge: np.ndarray
    label: np.ndarray
    half: np.ndarray
    x: np.ndarray

    @classmethod
    def of(cls, b: pd.DataFrame, width: int) -> "Answers":
        flat = lambda c: np.concatenate([np.asarray(v, np.int64) for v in b[c]]) if len(b) else np.empty(0, np.int64)
        x = np.zeros((len(b), width + 1))
        x[:, -1] = 1.0
        if width:
            for i, f in enumerate(b["feats"]):
                if len(f):
                    x[i, f] = 1.0
        return cls(len(b), np.repeat(np.arange(len(b)), [len(v) for v in b["js"]]), flat("js"), flat("ls"), b["half"].to_numpy(np.int64), x)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


@dataclass
class Model:
    """Judges' confusion matrices (true label x given label), judges that share a vote, and the classifier."""

    judges: list[str]
    confusion: np.ndarray
    twins: dict[tuple[int, int], float]
    weights: np.ndarray  # half x features x labels
    trust: float = 0.0  # how far the features' part holds on the other half

    def scores(self, a: Answers, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The constant's and the features' part by the other half's weights, or by those of the item's own half, for fitting them."""
        z = np.empty((a.n, self.weights.shape[2]))
        base = np.empty_like(z)
        for half in (0, 1):
            at, w = a.half == half, self.weights[half if own else 1 - half]
            z[at], base[at] = a.x[at, :-1] @ w[:-1], w[-1]
        return base, z

    def prior(self, a: Answers, own: bool = False) -> np.ndarray:
        base, z = self.scores(a, own)
        return softmax(base + (1.0 if own else self.trust) * z)

    def posterior(self, a: Answers) -> np.ndarray:
        shared = np.zeros(len(a.item))
        for (one, two), w in self.twins.items():  # judges that err together share one vote where both answered
            at = {j: np.flatnonzero(a.judge == j) for j in (one, two)}
            for j, other in ((one, two), (two, one)):
                shared[at[j]] += w * np.isin(a.item[at[j]], a.item[at[other]])
        logs = np.log(np.maximum(self.prior(a), 1e-12))
        np.add.at(logs, a.item, np.log(self.confusion[a.judge, :, a.label]) / (1.0 + shared)[:, None])
        return softmax(logs)


def majority(a: Answers, k: int) -> np.ndarray:
    p = np.full((a.n, k), 0.01)
    np.add.at(p, (a.item, a.label), 1.0)
    return p**2 / (p**2).sum(1, keepdims=True)


def find_twins(items: DataFrame, model: Model | None, k: int, width: int, least: int = 5, alike: float = 0.6) -> dict[tuple[int, int], float]:
    """Pairs of judges that give the same wrong label more often than not where one of them errs, with how much of a vote they share."""

    def erring(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a = Answers.of(b, width)
            best = (majority(a, k) if model is None else model.posterior(a)).argmax(1)
            wrong = a.label != best[a.item]
            out = []
            for at in np.split(np.arange(len(a.item)), np.flatnonzero(np.diff(a.item)) + 1) if len(a.item) else ():
                if wrong[at].any():
                    js, ls, bad = a.judge[at], a.label[at], wrong[at]
                    i, j = np.triu_indices(len(at), 1)
                    keep = bad[i] | bad[j]
                    i, j = i[keep], j[keep]
                    out.append(np.stack([js[i], js[j], bad[i] & bad[j] & (ls[i] == ls[j]), bad[i], bad[j]], 1))
            rows = pd.DataFrame(np.concatenate(out) if out else np.empty((0, 5), np.int64), columns=["a", "b", "both", "wrong_a", "wrong_b"])
            yield rows.groupby(["a", "b"], as_index=False).sum()

    schema = "a bigint, b bigint, both bigint, wrong_a bigint, wrong_b bigint"
    counts = items.mapInPandas(erring, schema).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("both", "wrong_a", "wrong_b")])
    share = F.col("both") / F.col("wrong_a") * (F.col("both") / F.col("wrong_b"))
    close = counts.where((F.least("wrong_a", "wrong_b") >= least) & (share > alike)).select("a", "b", F.sqrt(share).alias("w"))
    return {(r.a, r.b): r.w for r in close.collect()}  # copies only


def products(items: DataFrame, width: int) -> np.ndarray:
    """The features' products with each other, summed over the items of each half."""
    side = width + 1

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, side, side))
        for b in batches:
            a = Answers.of(b, width)
            for half in (0, 1):
                x = a.x[a.half == half]
                total[half] += x.T @ x
        at = np.flatnonzero(total)
        yield pd.DataFrame({"i": at, "x": total.ravel()[at]})

    return summed(items.mapInPandas(sums, "i bigint, x double"), 2 * side * side).reshape(2, side, side)


def summed(parts: DataFrame, n: int) -> np.ndarray:
    """``n`` sums over tasks, added up by Spark."""
    got = parts.groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    flat = np.zeros(n)
    flat[got["i"].to_numpy(np.int64)] = got["x"].to_numpy()
    return flat


def fit(items: DataFrame, judges: list[str], n_labels: int, width: int = 256, ridge: float = 20.0, rounds: int = 40, smooth: float = 0.5, still: float = 0.002) -> Model:
    """EM over ``items (url, js array<int>, ls array<int>, feats array<int>)`` until no confusion entry and no prior moves by more than ``still``; warns if ``rounds`` do not suffice."""
    n, k = len(judges), n_labels
    model: Model | None = None
    blank = Model(judges, np.full((n, k, k), 1.0 / k), {}, np.zeros((2, width + 1, k)))
    held = np.array([ridge] * width + [ridge / 2])[:, None]
    curve = 0.5 * products(items, width) + np.diag(held[:, 0])  # bounds the curvature of the classifier's likelihood, so that a step never overshoots
    checks = {0, 1, 3, 7, 15, 31}
    for step in range(rounds):
        twins = find_twins(items, model, k, width) if step in checks else (model or blank).twins
        now = Model(judges, (model or blank).confusion, twins, (model or blank).weights, (model or blank).trust)
        first = model is None

        def sums(batches: Iterator[pd.DataFrame], now=now, first=first) -> Iterator[pd.DataFrame]:
            c, g, t = np.zeros((n * k, k)), np.zeros((2, width + 1, k)), np.zeros(3)
            for b in batches:
                a = Answers.of(b, width)
                p = majority(a, k) if first else now.posterior(a)
                np.add.at(c, a.judge * k + a.label, p[a.item])
                off = p - now.prior(a, own=True)
                for half in (0, 1):
                    g[half] += a.x[a.half == half].T @ off[a.half == half]
                base, z = now.scores(a)
                q = softmax(base + now.trust * z)
                t += ((p - q) * z).sum(), ((q * z * z).sum(1) - (q * z).sum(1) ** 2).sum(), a.n
            flat = np.concatenate([c.ravel(), g.ravel(), t])
            at = np.flatnonzero(flat)
            yield pd.DataFrame({"i": at, "x": flat[at]})

        shapes = ((n, k, k), (2, width + 1, k), (3,))
        ends = np.cumsum([int(np.prod(x)) for x in shapes])
        c, g, t = (x.reshape(shape) for x, shape in zip(np.split(summed(items.mapInPandas(sums, "i bigint, x double"), ends[-1]), ends[:-1]), shapes))
        if not t[2]:
            return blank
        confusion = c.transpose(0, 2, 1) + smooth
        confusion /= confusion.sum(2, keepdims=True)
        step_up = np.stack([np.linalg.solve(curve[half], g[half] - held * now.weights[half]) for half in (0, 1)])
        trust = float(np.clip(now.trust + t[0] / (t[1] + 1.0), 0.0, 1.0))
        moved = max(np.abs(confusion - now.confusion).max(), np.abs(step_up).max() / 4, abs(trust - now.trust) / 4)
        model = Model(judges, confusion, twins, now.weights + step_up, trust)
        if moved < still and step > 3:
            again = find_twins(items, model, k, width)
            if again.keys() == twins.keys():
                return model
            model.twins = again
    warnings.warn(f"the consensus did not settle in {rounds} rounds", stacklevel=2)
    return model or blank


@dataclass
class Consensus:
    items: DataFrame  # url, classification, confidence, agreement, n_votes
    judges: DataFrame  # judge, reliability, n_votes, copies
    model: Model


def consensus(votes: DataFrame, labels: tuple[str, ...] = LABELS, least: int = 3, max_entries: int = 20_000_000, width: int = 256) -> Consensus:
    """Consensus items and judge reliabilities of ``votes (judge, url, classification, error, processed_at, reasoning)``.

    The model has ``labels`` squared entries for each judge; ``max_entries`` bounds what is broadcast (more than half a million judges of six labels)."""
    spark = votes.sparkSession
    own, said = features(width) if width else (F.array().cast("array<int>"),) * 2
    rows = cut(countable(votes, labels).select("url", "judge", "label", said.alias("said")))
    known = sorted(r.judge for r in rows.select("judge").distinct().limit(max_entries // len(labels) ** 2 + 1).collect())
    if len(known) * len(labels) ** 2 > max_entries:
        raise ValueError("too many judges for a model that every task holds: raise max_entries")
    place = spark.createDataFrame([(j, i) for i, j in enumerate(known)], "judge string, j int")
    items = cut(
        rows.join(place, "judge").groupBy("url").agg(F.sort_array(F.collect_list(F.struct("j", "label"))).alias("v"), F.array_distinct(F.flatten(F.collect_list("said"))).alias("said"))
        .where(F.size("v") >= least).select("url", F.col("v.j").alias("js"), F.col("v.label").alias("ls"), F.array_union(own, "said").alias("feats"), F.pmod(F.xxhash64("url"), F.lit(2)).cast("int").alias("half"))
    )
    n, k = len(known), len(labels)
    model = fit(items, known, k, width) if n else Model([], np.zeros((0, k, k)), {}, np.zeros((2, width + 1, k)))

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a = Answers.of(b, width)
            p = model.posterior(a)
            best = p.argmax(1)
            counts = np.bincount(a.item, minlength=a.n)
            agree = np.bincount(a.item, a.label == best[a.item], minlength=a.n) / np.maximum(counts, 1)
            yield pd.DataFrame({"url": b["url"], "classification": [labels[i] for i in best], "confidence": p.max(1), "agreement": agree, "n_votes": counts})

    out = items.mapInPandas(label, "url string, classification string, confidence double, agreement double, n_votes bigint")
    counts = rows.groupBy("judge").agg(F.count("*").alias("n_votes"))
    copies: dict[int, list[str]] = {}
    for one, two in sorted(model.twins):
        copies.setdefault(one, []).append(known[two])
        copies.setdefault(two, []).append(known[one])
    shares = spark.createDataFrame([(j, float(np.diag(model.confusion[i]).mean()), json.dumps(copies.get(i, []))) for i, j in enumerate(known)], "judge string, reliability double, copies string")
    return Consensus(out, counts.join(shares, "judge"), model)
