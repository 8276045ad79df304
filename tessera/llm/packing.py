"""Filling fixed containers with whole texts (problem 6).

Token counts come from a public tokenizer whose file is a parameter. Texts longer than a container are cut into full pieces and a rest.
The items are dealt by a hash to shards of about ``shard_items`` items, which bounds what a task holds; each shard is packed by a
grouping genetic algorithm on several islands. A solution is a set of containers; crossover puts another solution's well-filled containers whole
into a copy, removes the containers that now hold an item twice and best-fits the displaced items, largest first. After each epoch the islands'
elites migrate: one shuffle brings a shard's elites together on the next island. The best solution of each shard is kept, and the few containers that
are not well filled are opened again and packed in another round across shards, until one shard is left or rounds are used up.

Defined results: null and empty texts have no tokens and no container; equal rows are packed each for itself; a document of exactly the capacity
fills a container; ties go by id; repeated ids are packed as often as they occur; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's makers split text before merging.
_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoding(path: str):
    """The tokenizer of a rank file, loaded once a process."""
    if path not in _LOADED:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        _LOADED[path] = tiktoken.Encoding("own", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


_LOADED: dict = {}


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, tokens`` of every document with text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(tokenizer).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": np.array([len(encode(t)) for t in b["text"]], np.int64)})

    return documents.select("doc_id", "text").where("doc_id is not null and text <> ''").mapInPandas(count, "doc_id bigint, tokens bigint")


def pieces(counts: DataFrame, capacity: int) -> DataFrame:
    """``doc_id, piece, tokens``: whole texts, or full pieces and a rest of those longer than a container."""
    n = F.ceil(F.col("tokens") / capacity)
    return (
        counts.where("tokens > 0").select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("piece"))
        .select("doc_id", "piece", F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).cast("int").alias("tokens"))
    )


def fitness(assign: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer containers first, then fuller ones beside emptier ones."""
    fill = np.bincount(assign, sizes)
    fill = fill[fill > 0]
    return -len(fill), float(((fill / capacity) ** 2).sum())


def best_fit(items: np.ndarray, assign: np.ndarray, room: list[int], sizes: np.ndarray, capacity: int) -> None:
    """Puts ``items`` in their order where the least room is left, or into new containers. ``room`` holds each container's room and grows."""
    order = sorted((r << 24) | b for b, r in enumerate(room) if r > 0)
    for i in items.tolist():
        size = int(sizes[i])
        at = bisect_left(order, size << 24)
        if at < len(order):
            key = order.pop(at)
            b, left = key & 0xFFFFFF, (key >> 24) - size
        else:
            b, left = len(room), capacity - size
            room.append(left)
        room[b] = left
        assign[i] = b
        if left:
            insort(order, (left << 24) | b)


def crossed(one: np.ndarray, two: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A copy of ``one`` with some of the well-filled containers of ``two`` put in whole."""
    fill = np.bincount(two, sizes)
    good = np.argsort(-fill, kind="stable")[: max(1, (fill > 0).sum() // 2)]
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(good, max(1, len(good) // 3), replace=False)] = True
    injected = chosen[two]
    broken = np.zeros(one.max() + 1, bool)
    broken[one[injected]] = True
    return _repacked(one, two, injected, broken, sizes, capacity)


def _repacked(one: np.ndarray, two: np.ndarray, injected: np.ndarray, broken: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Containers of ``one`` that are not ``broken``, the ``injected`` items as in ``two``, and the others by best fit, largest first."""
    lost = broken[one] & ~injected
    tag = np.where(injected, two + one.max() + 1, one)
    _, kept = np.unique(tag[~lost], return_inverse=True)
    out = np.full(len(one), -1)
    out[~lost] = kept
    room = (capacity - np.bincount(kept, sizes[~lost])).astype(int).tolist() if len(kept) else []
    best_fit(np.flatnonzero(lost), out, room, sizes, capacity)
    return out


def shaken(one: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """``one`` with its emptiest and a few other containers opened and packed again."""
    fill = np.bincount(one, sizes)
    broken = np.zeros(len(fill), bool)
    broken[np.argsort(fill)[: max(2, len(fill) // 20)]] = True
    broken[rng.integers(0, len(fill), max(2, len(fill) // 20))] = True
    return _repacked(one, one, np.zeros(len(one), bool), broken, sizes, capacity)


def evolved(sizes: np.ndarray, start: list[np.ndarray], capacity: int, seed: int, population: int = 6, generations: int = 10, elite: int = 2) -> list[np.ndarray]:
    """The ``elite`` best solutions of one island after ``generations``; ``sizes`` fall. Ends early at the least possible number of containers."""
    rng = np.random.default_rng(seed)
    least = -(-int(sizes.sum()) // capacity)
    pool = list(start)
    while len(pool) < population:  # best fit decreasing, and with a disturbed order
        order = np.arange(len(sizes)) if not pool else np.argsort(-(sizes * rng.uniform(0.8, 1.25, len(sizes))), kind="stable")
        assign, room = np.full(len(sizes), -1), []
        best_fit(order, assign, room, sizes, capacity)
        pool.append(assign)
    scored = sorted(((fitness(a, sizes, capacity), k, a) for k, a in enumerate(pool)), key=lambda x: (x[0], -x[1]), reverse=True)
    for g in range(generations):
        if -scored[0][0][0] <= least:
            break
        children = []
        for _ in range(population // 2):
            i, j = np.sort(rng.choice(len(scored), 2, replace=False))
            children.append(crossed(scored[i][2], scored[j][2], sizes, capacity, rng))
        children.append(shaken(scored[0][2], sizes, capacity, rng))
        scored += [(fitness(a, sizes, capacity), 1000 * (g + 1) + k, a) for k, a in enumerate(children)]
        scored = sorted(scored, key=lambda x: (x[0], -x[1]), reverse=True)[:population]
    return [x[2] for x in scored[:elite]]


def _pack_round(items: DataFrame, capacity: int, shards: int, islands: int, epochs: int, label: str) -> DataFrame:
    """``doc_id, piece, tokens, container`` of ``items``, packed in ``shards`` groups that a hash deals."""
    groups = cut(
        items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(label)), F.lit(shards)).cast("int"))
        .groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("tokens", "doc_id", "piece")), asc=False).alias("v"))
        .select("shard", F.col("v.tokens").alias("sizes"), "v")
    )
    state = groups.select("shard", "sizes", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.array().cast("array<array<int>>").alias("pool"))
    schema = "shard int, island int, sizes array<int>, pool array<array<int>>, score double"

    for epoch in range(epochs):

        def evolve(batches: Iterator[pd.DataFrame], epoch=epoch) -> Iterator[pd.DataFrame]:
            for b in batches:
                pools, scores = [], []
                for shard, island, sizes, pool in zip(b["shard"], b["island"], b["sizes"], b["pool"]):
                    sizes = np.asarray(sizes, np.int64)
                    best = evolved(sizes, [np.asarray(x, np.int64) for x in pool], capacity, hash((int(shard), int(island), epoch)) & 0x7FFFFFFF)
                    pools.append([x.astype(np.int32).tolist() for x in best])
                    n, squares = fitness(best[0], sizes, capacity)
                    scores.append(n + squares / (len(sizes) + 1))
                yield pd.DataFrame({"shard": b["shard"], "island": b["island"], "sizes": b["sizes"], "pool": pools, "score": scores})

        spread = state.repartition(max(shards * islands // 4, 1), "shard", "island") if shards * islands > 4 else state
        state = cut(spread.select("shard", "island", "sizes", "pool").mapInPandas(evolve, schema))
        if epoch + 1 < epochs:  # each island's elite moves on to the next one
            guests = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.slice("pool", 1, 1).alias("guest"))
            state = state.join(guests, ["shard", "island"]).select("shard", "island", "sizes", F.concat(F.slice("pool", 1, 2), "guest").alias("pool"))
    best = state.groupBy("shard").agg(F.max_by(F.get("pool", 0), F.struct(F.col("score"), -F.col("island"))).alias("plan"))
    return (
        groups.select("shard", "v").join(best, "shard").select("shard", F.explode(F.arrays_zip("v", "plan")).alias("x"))
        .select("x.v.doc_id", "x.v.piece", "x.v.tokens", F.concat_ws("-", F.lit(label), "shard", "x.plan").alias("container"))
    )


def packed(documents: DataFrame, capacity: int = 2_048, tokenizer: str = TOKENIZER, shard_items: int = 2_000, islands: int = 2, epochs: int = 2, rounds: int = 3, full: float = 0.995) -> DataFrame:
    """``doc_id, piece, tokens, container`` of every text or piece.

    Containers filled to ``full`` stay; the others are opened and packed again with those of other shards, in up to ``rounds`` rounds.
    """
    every = cut(pieces(token_counts(documents, tokenizer), capacity).withColumn("row", F.monotonically_increasing_id()))
    left = every.where(F.col("tokens") < capacity).drop("row")
    whole = every.where(F.col("tokens") == capacity)
    out = whole.select("doc_id", "piece", "tokens", F.concat_ws("-", F.lit("full"), "row").alias("container"))
    for r in range(rounds):
        n = left.count()
        if not n:
            break
        shards = -(-n // shard_items)
        done = cut(_pack_round(left, capacity, shards, islands, epochs, f"r{r}"))
        if r + 1 == rounds or shards == 1:
            return out.unionByName(done)
        kept = done.groupBy("container").agg(F.sum("tokens").alias("fill")).where(F.col("fill") >= full * capacity).select("container")
        out = out.unionByName(done.join(kept, "container", "left_semi").select("doc_id", "piece", "tokens", "container"))
        left = done.join(kept, "container", "left_anti").select("doc_id", "piece", "tokens")
    return out


def fill_report(plan: DataFrame, capacity: int = 2_048) -> DataFrame:
    """``containers, tokens, least_possible, fill`` of a packing."""
    return (
        plan.groupBy("container").agg(F.sum("tokens").alias("t"))
        .agg(F.count("*").alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"))
        .select("containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least_possible"), (F.col("tokens") / (F.col("containers") * capacity)).alias("fill"))
    )
