"""Filling containers of fixed capacity: vector best-fit.

A container has three capacities: tokens, number of documents, and attention cost (the
sum of squared lengths). Items are taken from long to short; among the open containers
that can hold an item under every constraint the one with the smallest weighted norm of
relative residuals after placing it is chosen (or, by ``rule="dot"``, the one with the
greatest weighted dot product of item and residual); if none can, a new one is opened.

Items are spread over groups by a hash of their key; each group is packed on its own, in
blocks of at most ``block`` items, so no task holds more than a block. What this costs is
at most one thinly filled container per block and kind of limit. Only keys and sizes are
shuffled, never texts.

Defined results: an item longer than the capacity is cut into full containers of its own
and a rest that is packed like an item; no other item is split. Items of null or
non-positive size are not placed. Repeated rows are items of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LIMITS = 1_000
#: Attention capacity as a share of the square of the token capacity. Below 1 it binds: a container's squared lengths cannot sum up to what its tokens would allow.
ATTENTION = 0.8


def pack_block(sizes: np.ndarray, capacity: int, max_items: int, max_cost: float, weights: tuple[float, float, float] = (1.0, 0.05, 0.2), rule: str = "norm") -> np.ndarray:
    """Container number of every item (0-based); ``sizes`` positive and at most ``capacity``."""
    n = len(sizes)
    where = np.empty(n, np.int64)
    left = np.empty((max(1, n), 3))
    full = np.array([capacity, max_items, max_cost], float)
    w = np.asarray(weights, float)
    open_ids = np.empty(max(1, n), np.int64)
    n_open = n_bins = 0
    smallest = int(sizes.min()) if n else 0
    for i in np.argsort(-sizes, kind="stable"):
        s = float(sizes[i])
        need = np.array([s, 1.0, s * s])
        ids = open_ids[:n_open]
        rest = left[ids] - need
        ok = (rest >= 0).all(1) if n_open else np.zeros(0, bool)
        if ok.any():
            if rule == "dot":
                score = -((left[ids] / full) * (need / full) * w).sum(1)
            else:
                score = ((np.maximum(rest, 0) / full) ** 2 * w).sum(1)
            score[~ok] = np.inf
            k = int(np.argmin(score))
            b = ids[k]
        else:
            b = n_bins
            left[b] = full
            open_ids[n_open] = b
            k, n_open, n_bins = n_open, n_open + 1, n_bins + 1
        left[b] -= need
        where[i] = b
        # A container that cannot take the smallest item any more is closed.
        if left[b, 0] < smallest or left[b, 1] < 1 or left[b, 2] < smallest * smallest:
            n_open -= 1
            open_ids[k] = open_ids[n_open]
    return where


def pack(
    sizes: DataFrame, limits: DataFrame, key: str = "doc_id", size: str = "n_tokens", max_items: int = 64, cost_factor: float = ATTENTION,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.2), rule: str = "norm", block: int = 4_000, groups: int | None = None,
) -> DataFrame:
    """(limit_id, container_id, key, part_pos, start_token, n_tokens) for each limit.

    ``limits`` has limit_id and capacity_tokens (at most MAX_LIMITS rows are accepted; they
    are configuration); capacities that are null or not positive are skipped. The attention
    capacity is cost_factor * capacity**2: at 1 it would exclude nothing that the token
    capacity allows; below 1 it keeps long items apart, and an item that alone exceeds it
    gets a container of its own. ``groups`` defaults to one per ``block`` items.
    """
    caps = [(int(r.limit_id), int(r.capacity_tokens)) for r in limits.filter("limit_id is not null and capacity_tokens > 0").select("limit_id", "capacity_tokens").distinct().limit(MAX_LIMITS + 1).collect()]
    if len(caps) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} limits")
    items = sizes.filter(F.col(size) > 0).select(F.col(key), F.col(size).cast("bigint").alias("__n"))
    kind = items.schema[key].dataType.simpleString()
    if groups is None:
        groups = max(1, -(-items.count() // block))
    spread = items.withColumn("__g", F.pmod(F.xxhash64(key), F.lit(groups)).cast("int"))
    # As many partitions as there are groups, up to a few per core; a task streams its groups.
    parts = max(1, min(groups, 4 * sizes.sparkSession.sparkContext.defaultParallelism if groups < 10_000 else groups // 16))
    spread = spread.repartition(parts, "__g").sortWithinPartitions("__g", key, "__n")

    def block_rows(group: int, number: int, keys: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for limit, cap in caps:
            whole, rest = np.divmod(n, cap)
            # The full pieces of long items, each a container of its own.
            at = np.repeat(np.arange(len(n)), whole)
            pos = np.arange(len(at)) - np.repeat(np.cumsum(whole) - whole, whole)
            small = np.flatnonzero(rest)
            bins = pack_block(rest[small], cap, max_items, cost_factor * cap * cap, weights, rule)
            head = f"{limit}-{group}-{number}-"
            ids = [f"{head}f{i}" for i in range(len(at))] + [f"{head}{b}" for b in bins]
            index = np.r_[at, small]
            part = np.r_[pos, whole[small]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(index), limit), pa.int32()), pa.array(ids, pa.string()), keys.take(pa.array(index, pa.int64())), pa.array(part, pa.int32()),
                 pa.array(part * cap, pa.int64()), pa.array(np.r_[np.full(len(at), cap), rest[small]], pa.int64())],
                names=["limit_id", "container_id", key, "part_pos", "start_token", "n_tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group, number, count = None, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held).combine_chunks()
                yield from block_rows(group, number, t.column(0).chunk(0), t.column(1).to_numpy().astype(np.int64))

        for batch in batches:
            g = batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(g)) + 1), len(g)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if g[a] != group:
                    yield from flush()
                    held, group, number, count = [], int(g[a]), 0, 0
                while a < b:
                    take = min(b - a, block - count)
                    held.append(batch.slice(a, take))
                    a, count = a + take, count + take
                    if count == block:
                        yield from flush()
                        held, number, count = [], number + 1, 0
        yield from flush()

    return spread.mapInArrow(run, f"limit_id int, container_id string, `{key}` {kind}, part_pos int, start_token bigint, n_tokens bigint")


def fill_report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """Per limit: containers, items, tokens, the share of the capacity that is used, and the greatest attention cost as a share of the squared capacity among containers of several pieces."""
    bins = packed.groupBy("limit_id", "container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"), F.sum(F.col("n_tokens").cast("double") * F.col("n_tokens")).alias("c"))
    return (
        bins.groupBy("limit_id").agg(F.count("*").alias("containers"), F.sum("k").alias("pieces"), F.sum("t").alias("tokens"), F.max(F.when(F.col("k") > 1, F.col("c"))).alias("c"))
        .join(limits.select("limit_id", "capacity_tokens").distinct(), "limit_id")
        .select("limit_id", "capacity_tokens", "containers", "pieces", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"),
                (F.col("c") / (F.col("capacity_tokens").cast("double") * F.col("capacity_tokens"))).alias("most_attention"))
    )
