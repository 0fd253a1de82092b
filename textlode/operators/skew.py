"""Per-key results without a task for each key: a few keys may own most of the rows.

Every operator here first compresses rows by (key, value) - which spreads a hot key over its values and
combines on the map side - and only then reduces to the key. No operator gathers the rows of a key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlode.session import stage

#: The commonest keys are treated as hot. Every key with more than one of so many rows is among them, and what is broadcast for them
#: is one narrow row each.
HOT_KEYS = 1024
#: Rows of a key that a window may sort, or one of ``LARGEST`` of all rows, if that is more.
MOST_SORTED, LARGEST = 100_000, 10_000
#: Consecutive whole values that are weighed together in the search for a median.
VALUES = 1024


def value_frequencies(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Rows ``(key, *values, _n)``: how often each combination of values occurs under each key.

    Rows with a null key belong to no key and are left out; null values are kept as a value.
    """
    return df.where(F.col(key).isNotNull()).groupBy(key, *values).agg(F.count(F.lit(1)).alias("_n"))


def key_profile(df: DataFrame, key: str, digest: str, number: str) -> DataFrame:
    """One row for each non-null ``key``, from value frequencies:

    ``n_rows``, ``share`` of all rows with a key, ``n_digests`` (exact distinct, null and '' apart),
    ``n_copies`` (rows beyond the first of each digest), ``top_digest`` and its count (ties to the
    smaller), ``first``/``last``/``median``/``mode`` of ``number`` (null where it has no number; ties of the mode
    to the smaller). An empty table gives no rows. Other columns may have any name.
    """
    df = df.select(F.col(key).alias("k"), F.nullif(F.col(digest), F.lit("")).alias("d"), F.col(number).alias("p"))
    by_digest = value_frequencies(df, "k", ["d"])
    digests = by_digest.groupBy("k").agg(
        F.sum("_n").alias("n_rows"),
        F.count("d").alias("n_digests"),
        F.sum(F.when(F.col("d").isNotNull(), F.col("_n") - 1).otherwise(0)).alias("n_copies"),
        F.min(F.when(F.col("d").isNotNull(), F.struct((-F.col("_n")).alias("m"), F.col("d").alias("d")))).alias("top"),
    )
    by_number = value_frequencies(df, "k", ["p"])
    numbers = by_number.groupBy("k").agg(
        F.min("p").alias("first_value"),
        F.max("p").alias("last_value"),
        F.min(F.when(F.col("p").isNotNull(), F.struct((-F.col("_n")).alias("m"), F.col("p").alias("p")))).alias("mode"),
    )
    both = digests.join(numbers, "k").join(weighted_median(by_number, "k", "p").withColumnRenamed("median", "median_value"), "k", "left")
    return both.select(
        F.col("k").alias(key),
        "n_rows",
        (F.col("n_rows") / digests.agg(F.sum("n_rows")).scalar()).alias("share"),
        "n_digests",
        "n_copies",
        F.col("top.d").alias("top_digest"),
        (-F.col("top.m")).alias("top_digest_rows"),
        "first_value",
        "last_value",
        "median_value",
        F.col("mode.p").alias("mode_value"),
    )


def weighted_median(weighted: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, median)`` of ``weighted`` rows (key, value, ``_n``); nulls don't count, and keys without a value are left out.

    The weights are summed by blocks of ``VALUES`` consecutive whole values; running sums over the blocks show in which the middle lies,
    and only the values of that block (or of the two, for an even number between blocks) are put in order.
    """
    some = weighted.where(F.col(value).isNotNull()).withColumn("_b", F.floor(F.col(value) / F.lit(VALUES)))
    blocks = some.groupBy(key, "_b").agg(F.sum("_n").alias("_w"))
    upto = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    blocks = blocks.select(key, "_b", (F.sum("_w").over(upto) - F.col("_w")).alias("_lo"), F.sum("_w").over(upto).alias("_hi"), F.sum("_w").over(whole).alias("_all"))
    # 1-based places of the two middle rows, the same one if their number is odd
    first, second = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    blocks = blocks.where(((first > F.col("_lo")) & (first <= F.col("_hi"))) | ((second > F.col("_lo")) & (second <= F.col("_hi"))))
    inside = Window.partitionBy(key, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    near = some.join(blocks, [key, "_b"]).withColumn("_upto", F.col("_lo") + F.sum("_n").over(inside))
    at = lambda place: F.min(F.when(F.col("_upto") >= place, F.col(value)))
    return near.groupBy(key).agg(((at(first) + at(second)) / F.lit(2.0)).alias("median"))


def rank_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank", sizes: DataFrame | None = None, most: int = MOST_SORTED, share: int = LARGEST,
) -> DataFrame:
    """``df`` with the 0-based position of each row under its ``keys``, by the columns of ``order`` (nulls last).

    Rows that agree in all of ``order`` get different positions, in no fixed order. Null keys count as one key. A key with more rows than
    ``most`` and than one of ``share`` of all is large: there are fewer than ``share`` such keys. The rows of large keys are partitioned and sorted by
    ranges of (keys, order), so that a key goes over as many tasks as its rows need; a position is the row's place in its partition
    plus the rows of the key in the partitions before, of which a table of one row for each key and partition tells. All
    other keys are numbered by a window, which so never sorts more rows than the larger of the two bounds. ``sizes`` (keys, ``_n``) may give
    the numbers of rows, or what is no less than a fixed part of them, more cheaply than counting ``df``. An empty table gives no rows.
    """
    keys, order = list(keys), list(order)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if sizes is None else sizes.select(*keys, "_n")
    large = counts.where(F.col("_n") > F.greatest(F.lit(most), counts.agg(F.sum("_n")).scalar() / share))
    large = stage(large.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.lit(True).alias("_large")))
    ascending = [F.asc_nulls_last(c) for c in order]
    if large.isEmpty():
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*ascending)) - 1).cast("long"))

    def on(left: DataFrame, right: DataFrame) -> Column:
        return reduce(and_, [left[k].eqNullSafe(right[f"_k{i}"]) for i, k in enumerate(keys)])

    rows = df.join(F.broadcast(large), on(df, large), "left")  # fewer than ``share`` keys
    small = rows.where("_large IS NULL").select(*[df[c] for c in df.columns])
    small = small.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*ascending)) - 1).cast("long"))
    hot = rows.where("_large").select(*[df[c] for c in df.columns])
    ranges = [*[F.asc_nulls_last(k) for k in keys], *ascending]
    hot = hot.repartitionByRange(*ranges).sortWithinPartitions(*ranges).withColumn("_at", F.monotonically_increasing_id())
    hot = stage(hot.withColumn("_part", F.shiftright("_at", 33)))
    runs = hot.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p")).agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_c").over(earlier), F.lit(0)) - F.col("_from"))
    # a partition holds a run of keys, so there are fewer runs than large keys and partitions together
    hot = hot.join(F.broadcast(runs), on(hot, runs) & (hot["_part"] == runs["_p"]))
    return small.unionByName(hot.select(*[hot[c] for c in df.columns], (F.col("_at") + F.col("_before")).alias(name)))


def join_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "inner", keys: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has at most one row a ``key``; a few keys may own most rows of ``left``.

    The ``HOT_KEYS`` commonest keys of ``left`` get their row of ``right`` by a broadcast of that many rows; the rows of all
    others meet theirs in a shuffle. ``how`` is inner or left. ``keys`` may name a cheaper table with the keys of ``left`` to count. The right side's other columns come last, under names ``left`` must not have.
    """
    names = [c for c in right.columns if c != key]
    hot = (left if keys is None else keys).where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hk")).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "_hk").limit(HOT_KEYS)
    packed = right.select(F.col(key).alias("_k"), F.struct(*names).alias("_r"))
    hot = hot.join(packed, F.col("_hk") == F.col("_k"), "left").select("_hk", F.col("_r").alias("_hr"), F.lit(True).alias("_hot"))
    seen = left.join(F.broadcast(hot), left[key] == F.col("_hk"), "left")
    spread = F.pmod(F.xxhash64(*left.columns), F.lit(1024)) if all(t not in ("map", "variant") for _, t in left.dtypes) else F.lit(0)
    seen = seen.withColumn("_salt", F.when(F.col("_hot"), 1 + spread).otherwise(0).cast("int"))
    cold = packed.withColumn("_zero", F.lit(0))
    out = seen.join(cold, (seen[key] == cold["_k"]) & (seen["_salt"] == cold["_zero"]), "left")
    both = F.coalesce("_hr", "_r")
    out = out if how == "left" else out.where(both.isNotNull())
    return out.select(*[left[c] for c in left.columns], *[both[n].alias(n) for n in names])


def attach_groups(df: DataFrame, key: str, spread: str, aggregates: dict[str, Column], keep: Column | str) -> DataFrame:
    """``df`` with the ``aggregates`` of the row's group, for groups that fulfil ``keep`` (over the aggregates and ``_n``, the
    number of rows); rows with a null key and those of other groups are left out.

    The aggregates are combined on the map side. The ``HOT_KEYS`` largest groups - one row each, so the broadcast is
    bounded - are attached without a shuffle of their rows; all others by a shuffled join. ``spread`` is a
    column of many values by which rows of hot groups are scattered.
    """
    df = df.where(F.col(key).isNotNull())
    names = list(aggregates)
    groups = df.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"), *[c.alias(n) for n, c in aggregates.items()]).where(keep)
    groups = groups.select("_k", "_n", F.struct(*names).alias("_a"))
    hot = groups.orderBy(F.desc("_n"), "_k").limit(HOT_KEYS).select(F.col("_k").alias("_hk"), F.col("_a").alias("_ha"))
    seen = df.join(F.broadcast(hot), df[key] == F.col("_hk"), "left")
    # rows of hot keys already have their result: they are scattered, and meet no row on the other side
    salt = F.when(F.col("_hk").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1024))).cast("int")
    seen = seen.withColumn("_salt", salt)
    right = groups.drop("_n").withColumn("_zero", F.lit(0))
    out = seen.join(right, (seen[key] == right["_k"]) & (seen["_salt"] == right["_zero"]), "left")
    both = F.coalesce("_ha", "_a")
    return out.where(both.isNotNull()).select(*[df[c] for c in df.columns], *[both[n].alias(n) for n in names])


def attach_group_min(df: DataFrame, key: str, row_id: str) -> DataFrame:
    """``df`` with ``kept`` (smallest ``row_id`` of the row's group) and ``copies`` (rows in it), for groups of two or more."""
    return attach_groups(df, key, row_id, {"kept": F.min(row_id), "copies": F.count(F.lit(1))}, "copies > 1")
