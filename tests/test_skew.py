from collections import Counter, defaultdict

from pyspark.sql import functions as F

from textlode.operators.skew import attach_group_min, attach_groups, key_profile, rank_within

SCHEMA = "row_seq long, file_id string, digest string, page int, k string, _n int"


def _rows(n=600):
    out = []
    for i in range(n):
        file = "hot" if i % 3 else f"f{i % 7}" if i % 5 else None
        out.append((i, file, None if i % 11 == 0 else "" if i % 13 == 0 else f"d{i % 17}", None if i % 4 == 0 else i % 9, "x", 1))
    return out + out[:20]  # repeated rows


def test_key_profile_matches_brute_force(spark):
    rows = _rows()
    got = {r["file_id"]: r for r in key_profile(spark.createDataFrame(rows, SCHEMA), "file_id", "digest", "page").collect()}
    files = defaultdict(list)
    for r in rows:
        if r[1] is not None:
            files[r[1]].append(r)
    assert set(got) == set(files)
    total = sum(map(len, files.values()))
    for f, mine in files.items():
        digests = Counter(r[2] for r in mine if r[2])
        pages = sorted(r[3] for r in mine if r[3] is not None)
        g = got[f]
        assert (g["n_rows"], g["n_digests"]) == (len(mine), len(digests))
        assert g["n_copies"] == sum(digests.values()) - len(digests)
        assert g["top_digest"] == min(digests, key=lambda d: (-digests[d], d))
        assert (g["first_value"], g["last_value"]) == (pages[0], pages[-1])
        mid = len(pages) // 2
        assert g["median_value"] == (pages[mid] if len(pages) % 2 else (pages[mid - 1] + pages[mid]) / 2)
        assert abs(g["share"] - len(mine) / total) < 1e-12


def test_key_profile_of_nothing_and_of_nulls(spark):
    assert key_profile(spark.createDataFrame([], SCHEMA), "file_id", "digest", "page").count() == 0
    only = spark.createDataFrame([(1, "a", None, None, None, None), (2, None, "d", 1, None, None)], SCHEMA)
    (row,) = key_profile(only, "file_id", "digest", "page").collect()
    assert row["n_rows"] == 1 and row["n_digests"] == 0 and row["top_digest"] is None and row["first_value"] is None and row["share"] == 1.0


def test_rank_within_orders_each_key(spark):
    rows = [r for r in _rows(900)[:900]]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["row_seq"]: r["rank"] for r in rank_within(df, ["file_id"], ["page", "row_seq"]).collect()}
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    for mine in groups.values():
        mine.sort(key=lambda r: (r[3] is None, r[3] or 0, r[0]))
        assert [got[r[0]] for r in mine] == list(range(len(mine)))
    # keys beyond the bound go over several sorted ranges
    spread = rank_within(df, ["file_id"], ["page", "row_seq"], most=100).collect()
    assert {r["row_seq"]: r["rank"] for r in spread} == got and len(spread) == len(rows)
    assert rank_within(df.limit(0), ["file_id"], ["page"]).count() == 0


def test_no_window_sorts_a_large_key(spark):
    """The rows of a large key are sorted by ranges: no task of the plan gets all of them."""
    df = spark.range(40_000).select(F.col("id"), (F.col("id") % 5).alias("page"), F.lit("hot").alias("file_id"))
    df = df.unionByName(spark.range(100).select((F.col("id") + 50_000).alias("id"), F.lit(None).cast("long").alias("page"), F.lit(None).cast("string").alias("file_id")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = rank_within(df, ["file_id"], ["page", "id"], most=1000)
        seen = out.where("file_id = 'hot'").withColumn("p", F.spark_partition_id()).collect()
        assert [r["id"] for r in sorted(seen, key=lambda r: r["rank"])] == sorted(range(40_000), key=lambda i: (i % 5, i))
        assert max(Counter(r["p"] for r in seen).values()) < 25_000 and len({r["rank"] for r in seen}) == 40_000
        assert {r["rank"] for r in out.where("file_id IS NULL").collect()} == set(range(100))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_medians_of_values_far_apart(spark):
    from textlode.operators.skew import value_frequencies, weighted_median

    cases = {"a": [1, 5000], "b": [7], "c": [1, 2, 3000, 9000], "d": [-5000, -4000, 3], "e": [4] * 5 + [100_000] * 5, "f": [None, None]}
    df = spark.createDataFrame([(k, v) for k, values in cases.items() for v in values], "k string, p int")
    got = {r["k"]: r["median"] for r in weighted_median(value_frequencies(df, "k", ["p"]), "k", "p").collect()}
    assert got == {"a": 2500.5, "b": 7.0, "c": 1501.0, "d": -4000.0, "e": 50_002.0}


def test_attach_group_min_hot_and_cold(spark):
    rows = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"c{i % 400}", "v") for i in range(1200)]
    df = spark.createDataFrame(rows, "row_seq long, key string, kept_by string")
    got = {r["row_seq"]: (r["kept"], r["copies"]) for r in attach_group_min(df, "key", "row_seq").collect()}
    groups = defaultdict(list)
    for i, k, _ in rows:
        if k is not None:
            groups[k].append(i)
    assert got == {i: (min(g), len(g)) for g in groups.values() if len(g) > 1 for i in g}
    assert attach_group_min(df.limit(0), "key", "row_seq").count() == 0


def test_attach_groups_keeps_only_groups_asked_for(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 5), ("b", 4, 5)], "key string, id int, page int")
    out = attach_groups(df, "key", "id", {"lo": F.min("page"), "hi": F.max("page")}, "lo < hi")
    assert {r["id"] for r in out.collect()} == {1, 2}


def test_join_to_one_hot_and_cold(spark):
    from textlode.operators.skew import join_to_one

    left = spark.createDataFrame([(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"c{i % 90}") for i in range(600)], "id long, key string")
    right = spark.createDataFrame([("hot", 1, "x")] + [(f"c{i}", i, "y") for i in range(60)] + [("unused", 5, "z")], "key string, value int, tag string")
    for how in ("inner", "left"):
        got = {(r["id"], r["value"], r["tag"]) for r in join_to_one(left, right, "key", how).collect()}
        assert got == {(r["id"], r["value"], r["tag"]) for r in left.join(right, "key", how).collect()}


def test_rank_by_id_alone(spark):
    df = spark.createDataFrame([(i * 7 % 1000, i % 3) for i in range(1000)], "row_seq long, page int")
    got = {r["row_seq"]: r["rank"] for r in rank_within(df, ["page"], ["row_seq"], most=64).collect()}
    for p in range(3):
        mine = sorted(i * 7 % 1000 for i in range(1000) if i % 3 == p)
        assert [got[i] for i in mine] == list(range(len(mine)))
