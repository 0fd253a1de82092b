"""Mixing sources to target weights under a cap on repetition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlode.session import stage

#: Slices of the seeded order in which the cut for a fractional repetition is searched.
SLICES = 4096
#: A row is large for its source if it alone is more than one of so many parts of the amount to cut.
LARGE = 4


def water_fill(weights: dict[str, float], most: dict[str, float], total: float) -> dict[str, float]:
    """Amounts by source that follow ``weights`` and sum to ``total``, none above ``most``.

    Sources that would exceed their most are clamped, and what they leave is shared by the others in proportion,
    until nothing exceeds; if all are clamped, the sum falls short of ``total``.
    """
    amounts: dict[str, float] = {}
    free = {s for s, w in weights.items() if w > 0 and most[s] > 0}
    left = total
    while free:
        weight = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / weight > most[s]}
        if not over:
            amounts |= {s: left * weights[s] / weight for s in free}
            break
        amounts |= {s: float(most[s]) for s in over}
        left -= sum(most[s] for s in over)
        free -= over
    return {s: amounts.get(s, 0.0) for s in weights}


def _amounts(sizes: DataFrame, targets: DataFrame, source: str, total: float | None) -> list[tuple]:
    """(source, share, repeats, tokens there, tokens wanted) by source: as many rows as there are targets."""
    wanted = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy("source").agg(
        F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")
    )
    there = sizes.groupBy(F.col(source).alias("source")).agg(F.sum("n_tokens").alias("tokens"))
    rows = wanted.join(there, "source", "left").select("source", "share", "repeats", F.coalesce("tokens", F.lit(0)).alias("tokens")).collect()
    weights = {r["source"]: r["share"] for r in rows}
    most = {r["source"]: float(r["repeats"] * r["tokens"]) for r in rows}
    size = sum(r["tokens"] for r in rows) if total is None else total
    got = water_fill(weights, most, size)
    return [(r["source"], r["share"], r["repeats"], r["tokens"], got[r["source"]]) for r in rows]


def mix(sizes: DataFrame, targets: DataFrame, row_id: str, source: str, total: float | None = None, seed: int = 17) -> DataFrame:
    """``(row_id, source, n_tokens, copies)`` of the rows that the mixture uses.

    ``sizes`` has the rows with ``n_tokens``; ``targets`` the columns ``source``, ``target_share``, ``max_repeats``, one row
    for each source wanted (it is collected). ``total`` is the size of the mixture in tokens; without it, as many as the
    wanted sources hold. A source is used a whole number of times, and once more for as many rows, in an order
    seeded by ``seed``, as come closest to its amount; rows that are large beside it are drawn first, so that smaller ones level it
    out. No row is used more than ``max_repeats`` times. Rows of no or null
    source, of a source without a target, and rows without tokens are not used. Repeated ids are separate rows.
    """
    spark = sizes.sparkSession
    plan = _amounts(sizes, targets, source, total)
    rows = [(s, int(a // t), float(a - a // t * t)) for s, _, _, t, a in plan if t > 0 and a > 0]
    plan_df = F.broadcast(spark.createDataFrame(rows, "source string, whole int, part double"))
    used = sizes.select(F.col(row_id).alias("_id"), F.col(source).alias("source"), F.col("n_tokens").cast("long").alias("n_tokens"))
    used = used.where("n_tokens > 0").join(plan_df, "source")
    order = F.xxhash64(F.lit(seed), "_id")
    used = used.withColumn("_order", order).withColumn("_slice", F.pmod(F.shiftright("_order", 20), F.lit(SLICES)).cast("int"))
    held = F.broadcast(spark.createDataFrame([(s, float((a - a // t * t) / t)) for s, _, _, t, a in plan if t > 0 and a > 0], "source string, chance double"))
    is_large = F.col("n_tokens") * LARGE > F.col("part")
    lot = F.pmod("_order", F.lit(1 << 30)) < F.col("chance") * (1 << 30)
    # a row of its own number each, repeated ids too
    large = stage(used.where(is_large).join(held, "source").withColumn("_row", F.monotonically_increasing_id()))
    seeded = Window.partitionBy("source").orderBy("_order", "_id", "_row")
    upto = seeded.rowsBetween(Window.unboundedPreceding, 0)
    # those whose lot is drawn are about LARGE rows a source at most
    drawn = large.where(lot).withColumn("_end", F.sum("n_tokens").over(upto)).where("_end <= part")
    taken = drawn.groupBy("source").agg(F.sum("n_tokens").alias("_taken"))  # a row a source
    # where all the small rows together leave a gap, more large ones fill it: no more than LARGE of them fit, and the group limit is
    # taken before the shuffle
    small = used.where(~is_large).groupBy("source").agg(F.sum("n_tokens").alias("_small"))
    others = large.where(~lot).withColumn("_k", F.row_number().over(seeded)).where(F.col("_k") <= LARGE)
    others = others.join(F.broadcast(taken), "source", "left").join(F.broadcast(small), "source", "left")
    gap = F.col("part") - F.coalesce("_taken", F.lit(0)) - F.coalesce("_small", F.lit(0))
    others = others.withColumn("_end", F.sum("n_tokens").over(upto)).where(F.col("_end") <= gap)
    picked = drawn.select("_row").union(others.select("_row")).withColumn("_more", F.lit(1))
    large = large.join(picked, "_row", "left")
    large = large.select("_id", "source", "n_tokens", (F.col("whole") + F.coalesce("_more", F.lit(0))).alias("copies"))
    used = used.where(~is_large).join(F.broadcast(taken), "source", "left").withColumn("part", F.col("part") - F.coalesce("_taken", F.lit(0)))
    slices = used.groupBy("source", "_slice").agg(F.sum("n_tokens").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))  # at most SLICES rows a source
    placed = used.join(slices, ["source", "_slice"])
    # slices wholly before the cut get one copy more; only the slice that holds it is put in order
    inside = (F.col("_before") < F.col("part")) & (F.col("_before") + F.col("_sum") > F.col("part"))
    running = F.sum("n_tokens").over(Window.partitionBy("source", "_slice").orderBy("_order", "_id").rowsBetween(Window.unboundedPreceding, 0))
    cut = placed.where(inside).withColumn("_end", F.col("_before") + running)
    cut = cut.withColumn("_more", (F.col("_end") - F.col("n_tokens") / 2 <= F.col("part")).cast("int"))
    clear = placed.where(~inside).withColumn("_more", (F.col("_before") + F.col("_sum") <= F.col("part")).cast("int"))
    columns = ["_id", "source", "n_tokens", (F.col("whole") + F.col("_more")).alias("copies")]
    out = cut.select(*columns).union(clear.select(*columns)).union(large).where("copies > 0")
    return out.withColumnRenamed("_id", row_id)


def shares(mixture: DataFrame, sizes: DataFrame, targets: DataFrame, source: str) -> DataFrame:
    """By wanted source: the target, the tokens there and in the ``mixture``, the share reached, and the most
    any row is used."""
    wanted = targets.where("source IS NOT NULL").groupBy("source").agg(
        F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")
    )
    there = sizes.groupBy(F.col(source).alias("source")).agg(F.sum("n_tokens").alias("tokens_there"))
    got = mixture.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_used"), F.max("copies").alias("most_copies"), F.count(F.lit(1)).alias("rows_used")
    )
    both = wanted.join(there, "source", "left").join(got, "source", "left").na.fill(0)
    total = both.agg(F.sum("tokens_used")).scalar()
    share = F.when(total > 0, F.col("tokens_used") / total).otherwise(F.lit(0.0))
    return both.select(
        "source", "target_share", share.alias("share_reached"), "tokens_there", "tokens_used", "rows_used", "most_copies", "max_repeats"
    )
