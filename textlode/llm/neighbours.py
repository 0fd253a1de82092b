"""The k most similar vectors of every vector: a partitioned four-bit scan with exact reranking.

1. Vectors are scaled to length one, so that cosine similarity is an inner product.
2. Cells are fitted on bounded samples: the largest collections have centres of their own, the others share some, and where a collection needs more
   cells than it has centres, what remains of a vector after its centre is divided again, by as many levels as the collection's size asks for. Each vector
   belongs to its nearest ``spill`` cells a level, and two vectors meet if they share one.
3. A product code (16 centres for each pair of dimensions, four bits) is fitted score-aware: the loss weighs a residual's
   part parallel to the vector ``eta`` times its orthogonal part, as only that part shifts large inner products.
4. In each cell, every member's look-up tables (one byte an entry) are summed over the codes of the other members, and the
   best ``rerank`` go to the exact inner product in double precision.
5. The k best over a row's cells are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlode.functions import vectors
from textlode.session import stage

#: Rows used to fit centres and codes: as many of the whole table, and as many of the ``OWN`` largest collections together, each with an equal part.
#: Every collection with more than one of ``OWN`` of all rows is among those. The bounds are the same at any size.
SAMPLE, OWN = 60_000, 64
#: Aimed-at rows of a cell, and the most centres of one level.
CELL, MOST_CENTRES = 64, 4096
SUB, CENTRES = 2, 16  # dimensions a subspace and its centres: four bits
ETA = 4.0
BLOCK = 512  # members whose tables are summed at once
MOST_IN_TASK = 8192  # members of one cell in one task; a larger cell is scanned by pairs of blocks


def usable(df: DataFrame, row_id: str, group: str, vector: str, dims: int) -> DataFrame:
    """``(id, grp, v)`` of the rows that have an id, a group and ``dims`` finite values, not all zero."""
    fine = F.col(group).isNotNull() & F.col(row_id).isNotNull() & vectors.usable(F.col(vector), dims)
    return df.where(fine).select(F.col(row_id).alias("id"), F.col(group).alias("grp"), F.col(vector).cast("array<float>").alias("v"))


def _unit(rows: object) -> np.ndarray:
    x = np.stack(rows).astype("f8")
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow of the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centres(x: np.ndarray, n: int, seed: int = 7, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; empty cells are seeded again from random rows."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), n, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 8192] @ centres.T).argmax(1) for i in range(0, len(x), 8192)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        empty = norms[:, 0] < 1e-9
        centres = np.where(empty[:, None], x[rng.choice(len(x), n)], sums / np.maximum(norms, 1e-9)).astype(x.dtype)
    return centres


def fit_rest(rest: np.ndarray, n: int, rounds: int = 6, seed: int = 11) -> np.ndarray:
    """k-means of what remains of vectors."""
    rng = np.random.default_rng(seed)
    out = rest[rng.choice(len(rest), n, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(2 * rest[i : i + 8192] @ out.T - (out * out).sum(1)).argmax(1) for i in range(0, len(rest), 8192)])
        sums = np.zeros_like(out)
        np.add.at(sums, near, rest)
        counts = np.bincount(near, minlength=n)[:, None]
        out = np.where(counts > 0, sums / np.maximum(counts, 1), rest[rng.choice(len(rest), n)]).astype(rest.dtype)
    return out


def sizes_of(wanted: int, first: int) -> list[int]:
    """Numbers of centres of the further levels that make about ``wanted`` cells of ``first`` ones: powers of 4, so that few tables serve all sizes."""
    out, rest = [], wanted / max(1, first)
    while rest > 2:
        size = 4
        while size < rest and size < MOST_CENTRES:
            size *= 4
        out.append(size)
        rest /= size
    return out


class Cells:
    """The cells of every collection: centres of its own or shared ones, then shared tables of what remains."""

    def __init__(self, own: dict[str, np.ndarray], shared: dict[int, np.ndarray], finer: dict[int, np.ndarray]) -> None:
        self.own, self.shared, self.finer = own, shared, finer

    def levels(self, grp: str, n: int) -> list[np.ndarray]:
        """The tables by which the cells of a collection of ``n`` rows are told, none for a single cell."""
        wanted = n // CELL
        if wanted < 2:
            return []
        first = self.own.get(grp)
        if first is None:
            fits = [k for k in self.shared if k <= wanted] or sorted(self.shared)[:1]
            if not fits:
                return []
            first = self.shared[max(fits)]
        return [first] + [self.finer[k] for k in sizes_of(wanted, len(first)) if k in self.finer]

    def nearest(self, x: np.ndarray, grp: str, n: int, spill: int) -> np.ndarray:
        """The nearest cells of each row, ``spill`` for each level, by the best ones of the levels before."""
        levels = self.levels(grp, n)
        if not levels:
            return np.zeros((len(x), 1), dtype="i8")
        keep = spill * len(levels)
        sims = x @ levels[0].T
        p = min(keep, sims.shape[1])
        cells = np.argpartition(-sims, p - 1, axis=1)[:, :p]
        rest = x[:, None, :] - levels[0][cells]
        cells = cells.astype("i8")
        for table in levels[1:]:
            dist = ((table * table).sum(1) - 2 * rest @ table.T + (rest * rest).sum(2)[:, :, None]).reshape(len(x), -1)
            p = min(keep, dist.shape[1])
            best = np.argpartition(dist, p - 1, axis=1)[:, :p]
            row, at = best // len(table), best % len(table)
            rest = np.take_along_axis(rest, row[:, :, None], 1) - table[at]
            cells = np.take_along_axis(cells, row, 1) * len(table) + at
        return cells


def anisotropic_codes(x: np.ndarray, book: np.ndarray, eta: float = ETA, sweeps: int = 2) -> np.ndarray:
    """Codes (rows x subspaces) that lower ``|r|^2 + (eta-1) (r.x)^2`` for the residual r, by coordinate descent."""
    n, d = x.shape
    m = d // SUB
    parts = x.reshape(n, m, SUB)
    dist = ((parts[:, :, None, :] - book[None]) ** 2).sum(-1)  # rows, subspaces, centres
    along = (parts[:, :, None, :] * (parts[:, :, None, :] - book[None])).sum(-1)  # residual along x by choice
    codes = dist.argmin(2)
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
    rows = np.arange(n)
    for _ in range(sweeps):
        for j in range(m):
            rest = total - along[rows, j, codes[:, j]]
            loss = dist[:, j] + (eta - 1) * (rest[:, None] + along[:, j]) ** 2
            codes[:, j] = loss.argmin(1)
            total = rest + along[rows, j, codes[:, j]]
    return codes.astype("u1")


def fit_book(x: np.ndarray, eta: float = ETA, rounds: int = 5, seed: int = 7) -> np.ndarray:
    """Centres (subspaces, 16, 2) fitted to the score-aware loss: code, then solve each subspace by weighted least squares."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    m = d // SUB
    parts = x.reshape(n, m, SUB)
    book = np.stack([parts[rng.choice(n, CENTRES, replace=n < CENTRES), j] for j in range(m)])
    for _ in range(rounds):
        codes = anisotropic_codes(x, book, eta, 1)
        decoded = np.stack([book[j, codes[:, j]] for j in range(m)], axis=1)
        along = (parts * (parts - decoded)).sum(2)
        total = along.sum(1)
        for j in range(m):
            rest = total - along[:, j]
            for c in range(CENTRES):
                mine = codes[:, j] == c
                if not mine.any():
                    continue
                p, r = parts[mine, j], rest[mine]
                # d/dc of sum |p-c|^2 + (eta-1) (r + p.(p-c))^2
                a = mine.sum() * np.eye(SUB) + (eta - 1) * p.T @ p
                b = p.sum(0) + (eta - 1) * (p * (r + (p * p).sum(1))[:, None]).sum(0)
                book[j, c] = np.linalg.solve(a, b)
    return book


def _fit(rows: DataFrame, counts: DataFrame, dims: int) -> tuple[Cells, np.ndarray]:
    """Cells and code book from bounded samples, both of bounded size."""
    large = counts.orderBy(F.desc("n"), "grp").limit(OWN).collect()
    if not large:
        return Cells({}, {}, {}), np.zeros((dims // SUB, CENTRES, SUB))
    total = counts.agg(F.sum("n")).first()[0]
    sizes = {r["grp"]: r["n"] for r in large}
    each = max(1, SAMPLE // len(sizes))
    hashed = F.pmod(F.xxhash64("id", "grp"), F.lit(1 << 30))  # a slice of the hashed ids
    own_bound = F.coalesce(*[F.when(F.col("grp") == g, F.lit(int((1 << 30) * min(1.0, each / n)))) for g, n in sizes.items()], F.lit(0))
    bound = int((1 << 30) * min(1.0, SAMPLE / total))
    sample = rows.withColumn("_h", hashed).where((F.col("_h") < bound) | (F.col("_h") < own_bound))
    pdf = sample.select("grp", "v", (F.col("_h") < own_bound).alias("mine"), (F.col("_h") < bound).alias("all")).limit(2 * (SAMPLE + SAMPLE // 8)).toPandas()
    if not len(pdf):
        return Cells({}, {}, {}), np.zeros((dims // SUB, CENTRES, SUB))
    x = _unit(pdf["v"].to_numpy()).astype("f4")
    everything = pdf["all"].to_numpy()
    own: dict[str, np.ndarray] = {}
    rest, wanted = [], set()
    for grp, at in pdf[pdf["mine"]].groupby("grp", sort=False).indices.items():
        at = np.flatnonzero(pdf["mine"].to_numpy())[at]
        cells = min(sizes[grp] // CELL, MOST_CENTRES, len(at) // 4)
        if cells > 1:
            own[grp] = fit_centres(x[at], cells)
            more = sizes_of(sizes[grp] // CELL, cells)
            wanted |= set(more)
            if more:
                rest.append(x[at] - own[grp][(x[at] @ own[grp].T).argmax(1)])
    # the largest of the other collections says which shared tables are needed
    others = counts.where(~F.col("grp").isin(list(own))).agg(F.max("n")).first()[0] or 0
    shared, k = {}, 4
    while k <= min(others // CELL, MOST_CENTRES, everything.sum() // 4):
        shared[k] = fit_centres(x[everything], k)
        k *= 4
    if shared:
        more = sizes_of(others // CELL, max(shared))
        smaller = {s for k in shared for n in (k, 2 * k, 4 * k) for s in sizes_of(min(n, others // CELL), k)}
        wanted |= set(more) | smaller
        if wanted:
            base = shared[max(shared)]
            rest.append(x[everything] - base[(x[everything] @ base.T).argmax(1)])
    pool = np.concatenate(rest) if rest else x[:0]
    finer = {k: fit_rest(pool, k) for k in wanted if k <= len(pool)}
    part = pdf["v"].sample(min(len(pdf), 8000), random_state=3)
    return Cells(own, shared, finer), fit_book(_unit(part.to_numpy()))


def _best(x: np.ndarray, codes: np.ndarray, book: np.ndarray, rows: slice, rerank: int) -> tuple[np.ndarray, np.ndarray]:
    """For the members ``rows``: positions of the ``rerank`` members of the highest scanned score, and exact similarities."""
    m, q = book.shape[0], x[rows]
    tables = np.einsum("njd,jcd->jcn", q.reshape(len(q), m, SUB).astype("f4"), book.astype("f4"))
    low = tables.min(axis=1, keepdims=True)
    scale = 255.0 / max(float((tables.max(axis=1, keepdims=True) - low).max()), 1e-12)
    tables = np.rint((tables - low) * scale).astype("u1")  # each table from its own least: one scale for all sums of a query
    scores = np.zeros((len(codes), len(q)), dtype="u2")
    for j in range(m):
        scores += tables[j][codes[:, j]]
    near = min(rerank, len(codes))
    if near < len(codes):
        cand = np.argpartition(scores, len(codes) - near, axis=0)[len(codes) - near :].T
    else:
        cand = np.broadcast_to(np.arange(len(codes)), (len(q), len(codes)))
    exact = np.empty(cand.shape)
    for i in range(0, len(q), 256):
        exact[i : i + 256] = np.einsum("nd,ncd->nc", q[i : i + 256], x[cand[i : i + 256]])
    return cand, np.round(exact, 6)


def top_similar(df: DataFrame, row_id: str, group: str, vector: str, dims: int = 64, k: int = 4, spill: int = 3, rerank: int = 64) -> DataFrame:
    """``(id, neighbour, similarity, rank)``: for every usable row the ``k`` other usable rows of its ``group`` with the highest cosine
    similarity (double, 6 places; ties to the smaller id).

    Ids are strings. Usable: a group, an id and exactly ``dims`` finite values, not all zero; other rows neither search nor are found. A row
    of a group with fewer than ``k`` others gets as many as there are; a repeated row (same id and vector) counts once. Equal vectors are first reduced to their ``k + 1`` smallest ids -
    larger ones can't be neighbours of anything - and each equal row is answered from those. Every usable row is indexed;
    only centres and codes are fitted on a sample. An empty table gives no rows.
    """
    spark = df.sparkSession
    if dims % (2 * SUB):
        raise ValueError("dims must be divisible by 4")
    rows = usable(df, row_id, group, vector, dims)
    rows = stage(rows.withColumn("h", F.xxhash64("grp", F.transform("v", lambda x: x + F.lit(0.0).cast("float")))))
    counts = stage(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")))
    shared = spark.sparkContext.broadcast(_fit(rows, counts, dims))
    # equal vectors: the k + 1 smallest ids stand for all of them
    copies = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1).select("h")
    copies = stage(copies)
    many = not copies.isEmpty()
    standing = rows
    if many:  # the group limit runs before the shuffle, so a hot vector sends a few rows a partition
        first = Window.partitionBy("h").orderBy("id")
        some = rows.join(copies, "h", "left_semi").select("h", "id").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
        some = stage(some)
        standing = rows.join(copies, "h", "left_anti").unionByName(rows.join(some.select("h", "id"), ["h", "id"], "left_semi"), allowMissingColumns=False)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted, book = shared.value
        for batch in batches:
            if not len(batch):
                continue
            x = _unit(batch["v"].to_numpy())
            codes = np.concatenate([anisotropic_codes(x[i : i + 2048], book) for i in range(0, len(x), 2048)])
            packed = (codes[:, 0::2] << 4 | codes[:, 1::2]).astype("u1")
            cells: list = [[0]] * len(batch)
            for grp, at in batch.groupby("grp", sort=False).indices.items():
                n = int(batch["n"].iloc[at[0]])
                step = 1024 if len(fitted.levels(grp, n)) < 2 else 64  # what a step holds in memory is bounded
                for i in range(0, len(at), step):
                    for r, found in zip(at[i : i + step], fitted.nearest(x[at[i : i + step]].astype("f4"), grp, n, spill)):
                        cells[r] = found
            yield pd.DataFrame({"grp": batch["grp"], "id": batch["id"], "v": batch["v"], "code": [r.tobytes() for r in packed], "cells": cells})

    # an inner join with one row a collection: broadcast if there are few, else its large partitions are split
    sized = standing.select("grp", "id", "v").join(counts, "grp")
    coded = stage(sized.mapInPandas(assign, "grp string, id string, v array<float>, code binary, cells array<long>"))
    members = coded.select("grp", "id", "v", "code", F.explode("cells").alias("cell"))
    big = coded.select("grp", F.explode("cells").alias("cell")).groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("n"))
    big = stage(big.where(F.col("n") > MOST_IN_TASK).select("grp", "cell", F.ceil(F.col("n") / MOST_IN_TASK).cast("int").alias("blocks")))
    if big.isEmpty():
        members = members.withColumn("pair", F.lit(0))
    else:  # a crowded cell is scanned by pairs of blocks
        members = members.join(big, ["grp", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        mine = F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int")
        others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, mine) * F.col("blocks") + F.greatest(o, mine))
        members = members.withColumn("pair", F.explode(others)).drop("blocks")

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        _, book = shared.value
        order = np.unique(pdf["id"].to_numpy(), return_index=True)[1]  # a repeated row counts once; positions order ties by id
        ids, x = pdf["id"].to_numpy()[order], _unit(pdf["v"].to_numpy()[order])
        packed = np.frombuffer(b"".join(pdf["code"].to_numpy()[order]), dtype="u1").reshape(len(ids), -1)
        codes = np.empty((len(ids), packed.shape[1] * 2), dtype="u1")
        codes[:, 0::2], codes[:, 1::2] = packed >> 4, packed & 15
        near, sims = [], []
        for lo in range(0, len(ids), BLOCK):
            rows = slice(lo, min(lo + BLOCK, len(ids)))
            cand, exact = _best(x, codes, book, rows, rerank)
            exact = np.where(cand == np.arange(rows.start, rows.stop)[:, None], -9.0, exact)
            best = np.lexsort((cand, -exact), axis=1)[:, :k]
            near.extend(np.take_along_axis(cand, best, 1))
            sims.extend(np.take_along_axis(exact, best, 1))
        return pd.DataFrame({"id": ids, "ns": [ids[n[s > -2]] for n, s in zip(near, sims)], "ss": [s[s > -2] for s in sims]})

    found = members.groupBy("grp", "cell", "pair").applyInPandas(scan, "id string, ns array<string>, ss array<double>")
    pairs = F.transform(F.arrays_zip("ss", "ns"), lambda z: F.struct((-z["ss"]).alias("d"), z["ns"].alias("n")))
    # a row has at most k entries from each of its cells
    best = found.select("id", pairs.alias("z")).groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("z")))), 1, k).alias("z"))
    if many:  # the other equal rows: what the last of those that stand for them found
        best = stage(best)
        last = some.groupBy("h").agg(F.max("id").alias("last"))
        rest = rows.join(copies, "h", "left_semi").join(some.select("h", "id"), ["h", "id"], "left_anti").select("h", "id").distinct()
        rest = rest.join(last.join(best, F.col("last") == best["id"]).select("h", "z"), "h").select("id", "z")
        best = best.unionByName(rest)
    out = best.select("id", F.posexplode("z").alias("rank", "z"))
    return out.select("id", F.col("z.n").alias("neighbour"), (-F.col("z.d")).alias("similarity"), (F.col("rank") + 1).alias("rank"))
