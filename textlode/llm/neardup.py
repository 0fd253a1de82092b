"""Near-duplicate texts: an inverted index of positional bytes with count filtering and exact verification.

Each text is the set of its word shingles. Its signature has one byte for each of ``POSITIONS`` random orders of all shingles
(from the hash of the set's first shingle in that order), so two sets of similarity J agree at a position with probability
J + (1 - J) / 256. A posting is the row under ``RUN`` consecutive positional bytes: postings of single bytes would hold one of 256 of all
rows, whose pairs nothing could count. Shared postings are tallied by pair; then the equal positional bytes of a pair are counted, and
pairs with fewer than a pair at the threshold is sure to have (but for one in 10^7) are dropped. The others are verified on the whole sets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.llm.components import components
from textlode.operators.skew import attach_groups, join_to_one
from textlode.session import stage

POSITIONS, RUN = 200, 4  # RUN bytes are an int
#: Rows of a posting list all of which are paired; in longer ones, rows pair if they also share a rare shingle.
FEW = 64
#: Counters of shingles, by which rare ones are told from common ones.
SLOTS = 1 << 18
_WORD = re.compile(r"[^\W_]+")
_rng = np.random.default_rng(20)
_MUL = (_rng.integers(1, 1 << 63, POSITIONS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)


def least_matches(threshold: float, positions: int = POSITIONS) -> int:
    """Equal positional bytes that a pair at ``threshold`` has but for a chance of about one in 10^7."""
    p = threshold + (1 - threshold) / 256
    return int(positions * p - 5.2 * (positions * p * (1 - p)) ** 0.5)


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 1_000_000:
            self[word] = h
        return h


def shingles(text: str, words: int, least_words: int, hashes: dict) -> np.ndarray | None:
    """Distinct 64-bit hashes of the runs of ``words`` words, sorted; None for a text of fewer than ``least_words`` words."""
    found = _WORD.findall(text.lower())
    if len(found) < max(least_words, words):
        return None
    h = np.fromiter(map(hashes.__getitem__, found), dtype=np.uint64, count=len(found))
    n, out = len(h) - words + 1, np.zeros(len(h) - words + 1, dtype=np.uint64)
    for k in range(words):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(items: np.ndarray) -> np.ndarray:
    """The positional bytes of a set."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    wide = items * np.uint64(0xD6E8FEB86659FD93)
    wide ^= wide >> np.uint64(32)
    for i in range(0, len(wide), 2048):
        least = np.minimum(least, (_MUL[:, None] * wide[None, i : i + 2048] + _ADD[:, None]).min(axis=1))
    least *= np.uint64(0x9E3779B97F4A7C15)  # of equal minima equal bytes, of others independent ones
    return (least >> np.uint64(56)).astype(np.uint8)


def _index(df: DataFrame, row_id: str, text: str, words: int, least_words: int) -> DataFrame:
    """``(id, sh, sig, digest, rid)``: the set, the signature as runs of RUN bytes, 128 bits of the set's cryptographic digest, and a number of the row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHash()
        for batch in batches:
            ids, sets, signs, digests = [], [], [], []
            for key, body in zip(batch["id"], batch["t"]):
                items = shingles(body, words, least_words, hashes)
                if items is not None:
                    ids.append(key)
                    sets.append(items.view(np.int64))
                    signs.append(signature(items).view(np.int32))
                    digests.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest())
            yield pd.DataFrame({"id": ids, "sh": sets, "sig": signs, "digest": digests})

    rows = df.select(F.col(row_id).alias("id"), F.col(text).alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
    rows = rows.mapInPandas(run, f"id {df.schema[row_id].dataType.simpleString()}, sh array<long>, sig array<int>, digest binary")
    return rows.withColumn("rid", F.monotonically_increasing_id())


def _verify(pairs: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """Of the candidate ``pairs`` (a, b) those whose sets are similar enough. Signatures come first, and only pairs that they leave get their
    sets. Both ends of the pairs meet the rows in one join: few pairs are broadcast, if their size allows, else the rows are shuffled once, in an inner
    join whose partitions Spark splits if a row with many candidates makes one too large."""
    need = least_matches(threshold)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, y = (np.stack(batch[c].to_numpy()).view(np.uint8) for c in ("sig_a", "sig_b"))
                yield batch[(x == y).sum(axis=1) >= need][["a", "b"]]

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for i, (a, b) in enumerate(zip(batch["sh_a"], batch["sh_b"])):
                small, large = sorted((len(a), len(b)))
                if small >= threshold * large:
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    if both >= threshold * (small + large - both) - 1e-9:
                        keep.append(i)
            yield batch.iloc[keep][["a", "b"]]

    def with_both(pairs: DataFrame, c: str) -> DataFrame:
        ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("rid")).join(rows.select("rid", c), "rid")
        both = [F.first(F.when(F.col("rid") == F.col(s), F.col(c)), ignorenulls=True).alias(f"{c}_{s}") for s in ("a", "b")]
        return ends.groupBy("a", "b").agg(*both)

    likely = stage(with_both(pairs, "sig").mapInPandas(count, "a long, b long"))
    return with_both(likely, "sh").mapInPandas(verify, "a long, b long")


def _common(rows: DataFrame) -> np.ndarray:
    """How often shingles fall into each of ``SLOTS`` counters, over all rows: a table of a fixed size, whatever the number of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLOTS, dtype="i8")
        for batch in batches:
            if len(batch):
                total += np.bincount(np.concatenate(batch["sh"].to_numpy()) & (SLOTS - 1), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"slot": at, "n": total[at]})

    found = rows.select("sh").mapInPandas(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SLOTS, dtype="i8")
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return out


def _rare(rows: DataFrame, threshold: float, common: np.ndarray) -> DataFrame:
    """``(rid, rare)``: of each set, in one order of all shingles from rare to common, as many of the first as may be missing in a set at the
    threshold, and one more. Two such sets have one of them in common, whatever the order is."""
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for items in batch["sh"]:
                keep = len(items) - int(np.ceil(threshold * len(items) - 1e-9)) + 1
                out.append(items[np.lexsort((items, shared.value[items & (SLOTS - 1)]))[:keep]])
            yield pd.DataFrame({"rid": batch["rid"], "rare": out})

    return rows.select("rid", "sh").mapInPandas(run, "rid long, rare array<long>")


def _stars(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The postings that several rows share, ``(key, rid, a)`` with the first row ``a`` of each list, and the pairs ``(a, b, shared)`` of a first
    row and another with the number of lists they share: at most one pair a posting."""
    postings = rows.select("rid", F.posexplode("sig").alias("place", "run")).select("rid", (F.col("run").cast("long") * POSITIONS + F.col("place")).alias("key"))
    lists = postings.groupBy("key").agg(F.min("rid").alias("a"), F.max("rid").alias("z")).where("a < z").select("key", "a")
    shared = stage(postings.join(lists, "key").select("key", "rid", "a"))
    return shared, shared.where("rid <> a").groupBy("a", F.col("rid").alias("b")).agg(F.count(F.lit(1)).alias("shared"))


def _open_pairs(shared: DataFrame, tied: DataFrame, star: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, shared)``: pairs of rows of a list that are not tied together yet and weren't compared.

    In a list of up to ``FEW`` rows all of them are paired, at most FEW / 2 pairs a row. The rows of longer lists pair if they share one of
    their rarest shingles too, as all rows at the threshold do: rows that only have common text in common meet nowhere.
    """
    named = shared.select("key", "rid").join(tied, "rid", "left").withColumn("c", F.coalesce("component", "rid"))
    split = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("f")).where("lo < hi")
    open_ = stage(named.join(split, "key").select("key", "rid", "c", "f"))
    lists = open_.where(F.col("f") <= FEW).select(F.col("key"), F.lit(0).cast("long").alias("g"), "rid", "c")
    crowded = open_.where(F.col("f") > FEW)
    if not crowded.isEmpty():
        some = rows.join(crowded.select("rid").distinct(), "rid", "left_semi")
        finer = crowded.join(_rare(some, threshold, _common(rows)), "rid").select("key", F.explode("rare").alias("g"), "rid", "c")
        several = finer.groupBy("key", "g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key", "g")
        lists = lists.unionByName(finer.join(several, ["key", "g"]).select("key", "g", "rid", "c"))
    x, y = lists.alias("x"), lists.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.g") == F.col("y.g"))).where("x.rid < y.rid AND x.c <> y.c")
    pairs = pairs.groupBy(F.col("x.rid").alias("a"), F.col("y.rid").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    return stage(pairs.join(star.select("a", "b"), ["a", "b"], "left_anti"))


def near_duplicates(df: DataFrame, row_id: str, text: str, threshold: float = 0.8, words: int = 5, least_words: int = 5) -> DataFrame:
    """``(row_id, component)`` of the rows linked to another one, directly or through others.

    Two rows are linked if of the distinct runs of ``words`` lower-cased words (runs of letters and digits) in either at
    least ``threshold`` occur in both. Rows of fewer than ``least_words`` words, null ids and null texts take no part. ``component`` is a number that
    the rows of a group share. Rows with the same id take part each. An empty table gives no rows.

    Rows with the same set (128 bits of a cryptographic digest) stand behind one of theirs and are never paired. All rows of a posting
    list are first compared with the list's first row only, a number of pairs linear in the postings. Rows which that ties together need no
    further comparison; between rows of different components that still share a list, see ``_open_pairs``.
    """
    rows = stage(_index(df, row_id, text, words, least_words))
    equal = attach_groups(rows.select("rid", "digest"), "digest", "rid", {"a": F.min("rid")}, "_n > 1").select("a", "rid")
    equal = stage(equal)
    alone = rows.join(equal.where("rid <> a").select("rid"), "rid", "left_anti")
    shared, star = _stars(alone)
    star = stage(star)
    tied = stage(components(stage(_verify(star, rows, threshold))).withColumnRenamed("node", "rid"))
    late = stage(_verify(_open_pairs(shared, tied, star, rows, threshold), rows, threshold))
    # links between components make larger ones
    name = lambda c: tied.select(F.col("rid").alias(c), F.col("component").alias(f"c_{c}"))
    between = late.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    larger = components(between).select(F.col("node").alias("c"), F.col("component").alias("larger"))
    nodes = tied.select("rid", F.col("component").alias("c")).unionByName(late.select(F.col("a").alias("rid")).union(late.select("b")).distinct().join(tied, "rid", "left_anti").select("rid", F.col("rid").alias("c")))
    labels = stage(nodes.join(larger, "c", "left").select("rid", F.coalesce("larger", "c").alias("component")))
    # rows with equal sets take the component of the row they stand behind, or make one with it
    copies = join_to_one(equal, labels.withColumnRenamed("rid", "a"), "a", "left").select("rid", F.coalesce("component", "a").alias("component"))
    groups = copies.unionByName(labels.join(equal.select("rid"), "rid", "left_anti"))
    return rows.select("rid", F.col("id").alias(row_id)).join(groups, "rid").select(row_id, "component")


def pairs_of(groups: DataFrame, row_id: str) -> DataFrame:
    """All pairs of rows of a component, the smaller id first."""
    a = groups.select("component", F.col(row_id).alias("uuid_a"))
    b = groups.select("component", F.col(row_id).alias("uuid_b"))
    return a.join(b, "component").where("uuid_a < uuid_b").select("uuid_a", "uuid_b")
