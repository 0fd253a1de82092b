import json
import math

import pytest
from pyspark.sql import functions as F

from textlode.functions.text import batch_count, clean_text, digest, drop_surrogates, store_id, strip
from textlode.functions.vectors import distance
from textlode.operators import lookup, search
from textlode.operators.filters import compile_filter

CHUNKS = [
    ("u1", "c1", [1.0, 0.0], "one", '{"file_id":"a","user_id":"ann","n":5}', "a"),
    ("u2", "c1", [0.0, 1.0], "two", '{"file_id":"a","user_id":null,"n":"5"}', "a"),
    ("u3", "c2", [1.0, 1.0], "three", '{"file_id":"b","user_id":"bob","n":7.5}', "b"),
    ("u4", "c2", [0.0, 0.0], "four", None, None),
    ("u5", None, None, None, "not json", "b"),
    ("u6", "c1", [1.0, 0.0, 0.0], "other size", '{"file_id":"a","flag":true}', "a"),
    ("u7", "c1", [2.0, 0.0], "tie", '{"file_id":"a","user_id":"ann","n":-1}', "a"),
]
SCHEMA = "uuid string, collection_id string, embedding array<float>, document string, cmetadata string, custom_id string"


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, SCHEMA)


def ids(df, column="uuid"):
    return [r[column] for r in df.collect()]


def test_distances(spark, chunks):
    rows = {r["uuid"]: r for r in chunks.select("uuid", *[distance(F.col("embedding"), [1.0, 0.0], m).alias(m) for m in ("cosine", "l2", "inner_product")]).collect()}
    assert rows["u1"]["cosine"] == 0 and rows["u2"]["cosine"] == 1 and abs(rows["u3"]["cosine"] - (1 - 0.5**0.5)) < 1e-12
    assert math.isnan(rows["u4"]["cosine"]) and rows["u5"]["cosine"] is None and rows["u6"]["l2"] is None
    assert rows["u7"]["l2"] == 1 and rows["u7"]["inner_product"] == -2
    with pytest.raises(ValueError):
        distance(F.col("embedding"), [1.0], "manhattan")


def test_top_k_orders_ties_by_id_and_nan_last(chunks):
    assert ids(search.top_k(chunks, [1.0, 0.0], 10)) == ["u1", "u7", "u3", "u2", "u4"]
    assert ids(search.top_k(chunks, [1.0, 0.0], 2, where={"file_id": "a"})) == ["u1", "u7"]
    assert ids(search.top_k(chunks, [1.0, 0.0], 0)) == []
    assert ids(search.top_k(chunks, [1.0, 0.0], 3, profile="dedup")) == ["u1", "u7", "u3"]


def test_top_k_plan_is_a_bounded_sort(chunks):
    plan = search.top_k(chunks, [1.0, 0.0], 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_threshold_is_inclusive_and_ignored_for_similarities(chunks):
    hits = search.top_k(chunks, [1.0, 0.0], 4)
    assert ids(search.within(hits, 0.0)) == ["u1", "u7"]
    assert len(ids(search.within(hits, None))) == 4
    assert len(ids(search.within(hits, 0.0, "dedup"))) == 4


@pytest.mark.parametrize(
    ("file", "user", "entity", "n"),
    [("a", "ann", None, 3), ("a", "bob", None, 0), ("a", "ann", "agent", 3), ("a", "bob", "agent", 0), ("b", "bob", None, 1), ("b", None, None, 0), ("b", None, "bob", 1), ("none", "ann", None, 0)],
)
def test_owner_of_first_hit_decides(chunks, file, user, entity, n):
    assert len(ids(search.query(chunks, [1.0, 0.0], file, 10, user, entity))) == n


def test_owner_missing_on_first_hit_allows(chunks):
    assert len(ids(search.query(chunks, [0.0, 1.0], "a", 10, "anyone"))) == 3


def test_multiple_files_share_one_limit(chunks):
    assert ids(search.query_multiple(chunks, [1.0, 0.0], ["a", "b"], 3)) == ["u1", "u7", "u3"]
    assert ids(search.query_multiple(chunks, [1.0, 0.0], ["zzz"], 3)) == []


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        ({"n": 5}, {"u1", "u2"}),
        ({"n": {"$gt": 4}}, {"u1", "u3"}),  # the text "5" is no number
        ({"n": {"$gte": "5"}}, {"u2"}),
        ({"n": {"$between": [5, 7.5]}}, {"u1", "u3"}),
        ({"n": {"$lt": 0}}, {"u7"}),
        ({"n": {"$lte": 5}}, {"u1", "u7"}),
        ({"n": {"$ne": 5}}, {"u3", "u7"}),  # missing keys are not unequal
        ({"n": {"$in": [5, 7.5]}}, {"u1", "u2", "u3"}),
        ({"n": {"$nin": [5]}}, {"u3", "u7"}),
        ({"user_id": {"$like": "a%"}}, {"u1", "u7"}),
        ({"user_id": {"$ilike": "BO_"}}, {"u3"}),
        ({"$or": [{"user_id": "bob"}, {"n": 5}]}, {"u1", "u2", "u3"}),
        ({"file_id": "a", "user_id": "ann"}, {"u1", "u7"}),
        ({"$and": [{"file_id": "a"}, {"n": {"$gt": 0}}]}, {"u1"}),
        ({"flag": True}, set()),  # the text of True is not the JSON text true
        ({}, {c[0] for c in CHUNKS}),
    ],
)
def test_filters(chunks, spec, want):
    assert set(ids(chunks.where(compile_filter(spec)))) == want


@pytest.mark.parametrize("spec", [{1: "x"}, {"$bad": 1}, {"a-b": 1}, {"a": {"$gt": 1, "$lt": 2}}, {"a": {}}, {"a": {"$regex": "x"}}, {"a": {"$in": 3}}, {"$or": []}, {"a": {"$between": [1]}}, {"a": {"$gt": None}}, "x"])
def test_bad_filters(spec):
    with pytest.raises(ValueError):
        compile_filter(spec)


def test_promoted_key_is_pushed_down(spark, tmp_path):
    spark.createDataFrame([("a", "{}"), ("b", "{}")], "file_id string, cmetadata string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = df.where(compile_filter({"file_id": {"$in": ["a", "c"]}}, promoted={"file_id": "file_id"}))._jdf.queryExecution().executedPlan().toString()
    assert "In(file_id, [a,c])" in plan


def test_lookup_and_deletion(spark, chunks):
    assert {r["id"] for r in lookup.list_ids(chunks).collect()} == {"a", "b"}
    assert sorted(ids(lookup.existing_ids(chunks, ["a", "x"], distinct=False), "id")) == ["a"] * 4
    assert ids(lookup.missing_ids(chunks, ["a", "x", None]), "id") == ["x"]
    assert {r["cmetadata"] for r in lookup.fetch_by_ids(chunks, ["b"]).collect()} == {"not json", CHUNKS[2][4]}
    many = [f"id{i}" for i in range(500)] + ["a"]
    assert len(ids(lookup.with_ids(chunks, many))) == 4
    with pytest.raises(lookup.NotFound, match="x"):
        lookup.require_ids(chunks, ["a", "x"])
    assert set(ids(lookup.delete_by_ids(chunks, ["a"]))) == {"u3", "u4", "u5"}
    assert set(ids(lookup.delete_by_ids(chunks, ["b"], collection="c1"))) == {c[0] for c in CHUNKS}
    assert lookup.delete_by_ids(chunks, None) is chunks
    assert set(ids(lookup.delete_by_metadata(chunks, {"user_id": "ann"}, "c1"))) == {"u2", "u3", "u4", "u5", "u6"}
    with pytest.raises(ValueError):
        lookup.delete_by_metadata(chunks, {}, "c1")
    assert lookup.list_ids(chunks.limit(0)).count() == 0


def test_scalar_functions(spark):
    df = spark.createDataFrame([("f", "", "Hello\x00World"), (None, "d", "x"), ("f", None, "　é\n")], "f string, d string, t string")
    rows = df.select(clean_text(F.col("t")).alias("c"), digest(F.col("t")).alias("g"), store_id(F.col("f"), F.col("d"), F.col("t")).alias("s"), strip(F.col("t")).alias("p")).collect()
    assert rows[0]["c"] == "HelloWorld" and rows[1]["s"] is None and rows[2]["p"] == "é"
    assert rows[2]["s"].startswith("f_") and len(rows[2]["s"]) == 34
    assert drop_surrogates("hello\ud800world") == "helloworld"
    cases = {(10, 3): 4, (9, 3): 3, (1, 3): 1, (0, 3): 0, (5, 10): 1, (10, 0): 1, (5, 1): 5, (100, 150): 1}
    assert {k: batch_count(*k) for k in cases} == cases


def test_white_space_is_pythons():
    from textlode.functions.text import WHITE_SPACE

    assert set(WHITE_SPACE) == {c for c in map(chr, range(0x110000)) if c.isspace()}


def test_json_of_metadata(spark):
    from textlode.functions import metadata as M

    df = spark.createDataFrame([(json.dumps({"k": v}),) for v in (5, 5.0, "5", True, None, -1, 1755747710726532292)] + [("{",), (None,)], "m string")
    rows = df.select(M.as_text(F.col("m"), "k").alias("t"), M.kind(F.col("m"), "k").alias("k"), M.as_index(F.col("m"), "k").alias("i")).collect()
    assert [r["t"] for r in rows] == ["5", "5.0", "5", "true", None, "-1", "1755747710726532292", None, None]
    assert [r["k"] for r in rows] == ["number", "number", "string", "boolean", None, "number", "number", None, None]
    assert [r["i"] for r in rows] == [5, None, None, None, None, None, 1755747710726532292, None, None]


def test_promoted_keys_compare_by_their_kind(spark):
    df = spark.createDataFrame([("5", 5, '{"a": "5", "n": 5}'), ("10", 10, '{"a": "10", "n": 10}')], "a string, n int, cmetadata string")
    for spec in ({"a": {"$gt": 4}}, {"a": {"$gt": "4"}}, {"n": {"$gt": 7}}, {"n": {"$lte": "7"}}, {"n": 5}, {"a": {"$in": [10]}}, {"n": {"$between": [1, 6]}}):
        plain = df.where(compile_filter(spec)).collect()
        assert df.where(compile_filter(spec, promoted={"a": "a", "n": ("n", "number")})).collect() == plain, spec
