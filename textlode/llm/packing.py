"""Filling containers of fixed capacity: plan on the histogram of lengths, then hand out the planned places."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.operators.skew import rank_within


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Best-fit decreasing over counts: ``(length, first rank, first container, items a container)`` runs, by length
    and rank; each run goes up to the next one's first rank. Length 0 shares container 0.

    Each step fills equal open containers with equal items, so there are at most a few steps per distinct length,
    however many items there are; distinct lengths are at most ``capacity + 1``.
    """
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free space -> runs (first container, number)
    spaces: list[int] = []
    runs, made = [], 0

    def put(space: int, first: int, n: int) -> None:
        if space and n:
            if not open_[space]:
                insort(spaces, space)
            open_[space].append((first, n))

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect_left(spaces, length)
            if k < len(spaces):
                space = spaces[k]
                first, n = open_[space].pop()
                if not open_[space]:
                    spaces.pop(k)
                each = space // length
            else:
                space, each = capacity, capacity // length
                first, n = made, -(-left // each)
                made += n
            full = min(n, left // each)
            if full:
                runs.append((length, rank, first, each))
                rank, left = rank + full * each, left - full * each
                put(space - each * length, first, full)
            if full < n and left and left < each:  # the last, partly filled container of this length
                runs.append((length, rank, first + full, left))
                put(space - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(space, first + full, n - full)
    if 0 in histogram:
        runs.append((0, 0, 0, histogram[0]))
    return runs


class Places:
    """The planned places of a kind of container, searched by length first and then by rank."""

    def __init__(self, runs: list[tuple[int, int, int, int]]) -> None:
        length, self.rank, self.first, self.each = (np.array([r[k] for r in sorted(runs)], dtype="i8") for k in range(4))
        self.lengths, self.begin = np.unique(length, return_index=True)
        self.end = np.append(self.begin[1:], len(length)).astype("i8")

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """The container of each item, given its length and its rank among the items of that length."""
        at = np.searchsorted(self.lengths, lengths)
        lo, hi = self.begin[at], self.end[at] - 1  # the last run of the length that begins at or before the rank
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            below = self.rank[mid] <= ranks
            lo, hi = np.where(below, mid, lo), np.where(below, hi, mid - 1)
        return self.first[lo] + (ranks - self.rank[lo]) // np.maximum(self.each[lo], 1)


def pack(df: DataFrame, row_id: str, tokens: str, capacities: dict[str, int]) -> DataFrame:
    """``(container_name, container_no, row_id, piece_no, token_start, n_tokens)``: every row's place in each kind of container.

    A row longer than the capacity alone is cut into pieces of exactly the capacity, each filling a container, and one rest;
    no other row is cut. Rows of no (or null) size lie in container 0. The histogram, collected for planning, has at most
    ``capacity + 1`` entries a kind. Places within a length go by rank (``rank_within``), so one length may hold any share of the rows.
    Repeated ids are packed as separate rows. An empty table gives no rows.
    """
    spark = df.sparkSession
    if any(c < 1 for c in capacities.values()):
        raise ValueError("a capacity must be at least 1")
    if not capacities:
        raise ValueError("there must be a container")
    kinds = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(c).cast("int").alias("capacity")) for name, c in capacities.items()])
    size = F.greatest(F.coalesce(F.col(tokens), F.lit(0)), F.lit(0)).cast("long")
    items = df.select(F.col(row_id).alias("_id"), size.alias("_size"), F.explode(kinds).alias("_kind"))
    items = items.select("_id", "_size", F.col("_kind.name").alias("container_name"), F.col("_kind.capacity").alias("capacity"))
    whole = F.floor(F.col("_size") / F.col("capacity")).cast("int")
    rest = (F.col("_size") % F.col("capacity")).cast("int")
    # the rest is piece number `whole`; it exists if it isn't empty or the row has no tokens at all
    last = F.when((rest > 0) | (F.col("_size") == 0), whole).otherwise(whole - 1)
    items = items.select(
        "container_name", "capacity", "_id", F.explode(F.sequence(F.lit(0), last)).alias("piece_no"), whole.alias("_whole"), rest.alias("_rest")
    ).select("container_name", "capacity", "_id", "piece_no", F.when(F.col("piece_no") < F.col("_whole"), F.col("capacity")).otherwise(F.col("_rest")).alias("n_tokens"))
    counts = items.groupBy("container_name", "n_tokens").count().collect()
    plans = {name: Places(plan({r["n_tokens"]: r["count"] for r in counts if r["container_name"] == name}, c)) for name, c in capacities.items()}
    shared = spark.sparkContext.broadcast(plans)
    ranked = rank_within(items, ["container_name", "n_tokens"], ["_id", "piece_no"], "_rank")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plans = shared.value
        for batch in batches:
            numbers = np.zeros(len(batch), dtype="i8")
            for name, part in batch.groupby("container_name", sort=False).indices.items():
                numbers[part] = plans[name].of(batch["n_tokens"].to_numpy("i8")[part], batch["_rank"].to_numpy("i8")[part])
            yield batch.assign(container_no=numbers)[["container_name", "container_no", "_id", "piece_no", "capacity", "n_tokens"]]

    kind = df.schema[row_id].dataType.simpleString()
    out = ranked.mapInPandas(place, f"container_name string, container_no long, _id {kind}, piece_no int, capacity int, n_tokens int")
    return out.select(
        "container_name", "container_no", F.col("_id").alias(row_id), "piece_no",
        (F.col("piece_no").cast("long") * F.col("capacity")).alias("token_start"), "n_tokens",
    )
