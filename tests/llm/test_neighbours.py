import numpy as np
import pytest

from textlode.llm import neighbours

SCHEMA = "uuid string, collection_id string, embedding array<float>, id int, v string, rank int"


def brute(rows, k, dims):
    groups = {}
    for u, c, v, *_ in {r[0]: r for r in rows}.values():
        if c is not None and v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v) and any(v):
            groups.setdefault(c, []).append((u, v))
    out = {}
    for mine in groups.values():
        mine.sort()
        x = np.array([v for _, v in mine], dtype="f8")
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = np.round(x @ x.T, 6)
        np.fill_diagonal(s, -9)
        for i, (u, _) in enumerate(mine):
            best = np.lexsort((np.arange(len(mine)), -s[i]))[: min(k, len(mine) - 1)]
            out[u] = [(mine[j][0], s[i, j]) for j in best]
    return out


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    out = {}
    for r in neighbours.top_similar(df, "uuid", "collection_id", "embedding", **kw).orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append((r["neighbour"], r["similarity"]))
    return out


def clustered(n, dims, seed=0, noise=0.35):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 40), dims))
    return (centres[rng.integers(len(centres), size=n)] + noise * rng.normal(size=(n, dims))).astype("f4")


def test_recall_against_brute_force(spark):
    x = clustered(1500, 16)
    rows = [(f"u{i:05d}", "ab"[i % 3 == 0], [float(a) for a in v], 1, "v", 1) for i, v in enumerate(x)]
    got, want = found(spark, rows, dims=16), brute(rows, 4, 16)
    assert set(got) == set(want)
    hits = sum(len({n for n, _ in got[u]} & {n for n, _ in want[u]}) for u in want) / sum(map(len, want.values()))
    assert hits >= 0.97


def test_unusable_rows_ties_and_small_groups(spark):
    a = [1.0, 0.0, 0.0, 0.0]
    rows = [
        ("u1", "c", a, 1, "", 1), ("u2", "c", [2.0, 0.0, 0.0, 0.0], 1, "", 1), ("u3", "c", [0.5, 0.0, 0.0, 0.0], 1, "", 1), ("u4", "c", [0.0, 1.0, 0.0, 0.0], 1, "", 1),
        ("n1", "c", None, 1, "", 1), ("n2", None, a, 1, "", 1), ("n3", "c", [1.0], 1, "", 1), ("n4", "c", [0.0] * 4, 1, "", 1), ("n5", "c", [float("nan"), 1.0, 0.0, 0.0], 1, "", 1),
        ("n6", "c", [float("inf"), 1.0, 0.0, 0.0], 1, "", 1), ("n7", "c", [None, 1.0, 0.0, 0.0], 1, "", 1), ("s1", "single", a, 1, "", 1), (None, "c", a, 1, "", 1),
        ("u1", "c", a, 1, "", 1),
    ]
    got = found(spark, rows, dims=4, k=2)
    assert got["u1"] == [("u2", 1.0), ("u3", 1.0)] and got["u3"] == [("u1", 1.0), ("u2", 1.0)] and got["u4"] == [("u1", 0.0), ("u2", 0.0)]
    assert set(got) == {"u1", "u2", "u3", "u4"}
    assert found(spark, [], dims=4) == {}


def test_a_third_of_the_rows_are_copies(spark):
    x = clustered(400, 8, 1)
    rows = [(f"u{i:05d}", "c", [float(a) for a in (x[0] if i % 3 == 0 else v)], 1, "", 1) for i, v in enumerate(x)]
    got, want = found(spark, rows, dims=8), brute(rows, 4, 8)
    copies = [r[0] for r in rows[::3]]
    assert all([n for n, _ in got[u]] == [n for n, _ in want[u]] for u in copies)
    assert set(got) == set(want)


def test_a_crowded_cell_is_scanned_in_blocks(spark, monkeypatch):
    x = clustered(300, 8, 2)
    rows = [(f"u{i:05d}", "c", [float(a) for a in v], 1, "", 1) for i, v in enumerate(x)]
    monkeypatch.setattr(neighbours, "MOST_IN_TASK", 40)
    monkeypatch.setattr(neighbours, "CELL", 10_000)  # one cell
    got, want = found(spark, rows, dims=8), brute(rows, 4, 8)
    assert sum([n for n, _ in got[u]] == [n for n, _ in want[u]] for u in want) >= 0.97 * len(want)


def test_anisotropic_codes_keep_inner_products_better():
    x = clustered(800, 16, 3).astype("f8")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    book = neighbours.fit_book(x)
    decode = lambda c: np.stack([book[j, c[:, j]] for j in range(8)], 1).reshape(len(x), 16)
    plain, aware = (decode(neighbours.anisotropic_codes(x, book, eta)) for eta in (1.0, neighbours.ETA))
    along = lambda y: np.abs(((x - y) * x).sum(1)).mean()
    assert along(aware) < along(plain)


def test_dims_must_fit():
    with pytest.raises(ValueError):
        neighbours.top_similar(type("D", (), {"sparkSession": None})(), "a", "b", "c", dims=6)


def recall(got, want):
    assert set(got) == set(want)
    return sum(len({n for n, _ in got[u]} & {n for n, _ in want[u]}) for u in want) / sum(map(len, want.values()))


def _table(parts, dims):
    """Rows of collections of the given sizes, each with vectors of its own."""
    rows = []
    for c, (name, n) in enumerate(parts.items()):
        rows += [(f"{name}{i:06d}", name, [float(a) for a in v], 1, "v", 1) for i, v in enumerate(clustered(n, dims, c))]
    return rows


def test_two_levels_of_centres(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MOST_CENTRES", 16)
    monkeypatch.setattr(neighbours, "CELL", 40)
    rows = _table({"c": 6000}, 16)
    df = neighbours.usable(spark.createDataFrame(rows, SCHEMA), "uuid", "collection_id", "embedding", 16)
    cells, _ = neighbours._fit(df, df.groupBy("grp").count().withColumnRenamed("count", "n"), 16)
    assert [len(t) for t in cells.levels("c", 6000)] == [16, 16]
    assert recall(found(spark, rows, dims=16), brute(rows, 4, 16)) >= 0.95


def test_a_small_collection_of_a_large_table(spark, monkeypatch):
    """Collections of a thousandth of the table and less, without centres of their own, are divided by their own size."""
    monkeypatch.setattr(neighbours, "OWN", 1)
    monkeypatch.setattr(neighbours, "CELL", 16)
    rows = _table({"large": 9000, "mid": 600, "small": 90, "few": 9, "one": 1}, 16)
    df = neighbours.usable(spark.createDataFrame(rows, SCHEMA), "uuid", "collection_id", "embedding", 16)
    cells, _ = neighbours._fit(df, df.groupBy("grp").count().withColumnRenamed("count", "n"), 16)
    assert set(cells.own) == {"large"} and len(cells.levels("mid", 600)) >= 1 and cells.levels("few", 9) == []
    got, want = found(spark, rows, dims=16), brute(rows, 4, 16)
    del want["one000000"]
    for name in ("large", "mid", "small", "few"):
        assert recall({u: v for u, v in got.items() if u.startswith(name)}, {u: v for u, v in want.items() if u.startswith(name)}) >= 0.95, name
