import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tillflow.llm import cover_trees, registry
from tillflow.llm.cover_trees import (
    NOTHING,
    OP9_SQL,
    cover_tree,
    dual_search,
    products,
    top_inner_products,
)


def clustered(seed, n, size=6, spread=8):
    r = np.random.default_rng(seed)
    centres = r.integers(-100, 100, (7, size))
    return centres[r.integers(0, 7, n)] + r.integers(-spread, spread, (n, size))


@pytest.mark.parametrize("n", [1, 2, 33, 700])
def test_nodes_cover_their_points(n):
    points = clustered(n, n)
    tree = cover_tree(points, np.arange(n))
    assert sorted(tree.ids) == list(range(n))
    assert (tree.points == points[tree.ids]).all()
    for i, children in enumerate(tree.children):
        inside = tree.points[tree.lo[i] : tree.hi[i]]
        away = np.sqrt(((inside - tree.points[tree.centre[i]]) ** 2).sum(axis=1))
        assert away.max() <= tree.radius[i] + 1e-9
        if children:
            assert [tree.lo[c] for c in children] + [tree.hi[i]] == [tree.lo[i]] + [tree.hi[c] for c in children]


@pytest.mark.parametrize("seed", range(4))
def test_dual_search_is_exact(seed):
    data, queries = clustered(seed, 900), clustered(seed + 50, 120)
    floor = np.full(120, NOTHING)
    d, q = cover_tree(data, np.arange(900)), cover_tree(queries, np.arange(5000, 5120))
    best = dual_search(q, d, 5, floor)
    for at, (scores, ids) in enumerate(best.found):
        every = sorted((-int(s), i) for i, s in enumerate(data @ q.points[at]))
        assert list(zip((-scores).tolist(), ids.tolist())) == every[:5]


def test_pairs_of_nodes_are_dropped(monkeypatch):
    taken = []
    monkeypatch.setattr(cover_trees, "products", lambda a, b: taken.append(len(a) * len(b)) or products(a, b))
    data, queries = clustered(1, 2000, spread=2), clustered(2, 200, spread=2)
    dual_search(cover_tree(queries, np.arange(200)), cover_tree(data, np.arange(2000)), 5, np.full(200, NOTHING))
    assert sum(taken) < 0.7 * 2000 * 200


def test_large_products_are_exact():
    a = np.array([[2**30, 3], [1, -(2**30)]])
    assert products(a, a).tolist() == [[2**60 + 9, 2**30 - 3 * 2**30], [2**30 - 3 * 2**30, 2**60 + 1]]


def brute(rows, k=5):
    usable = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for q, v in {i: v for i, v in usable if i % 50 == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [2048, 40])
def test_whole_table(spark, block_rows):
    sf = "/root/testdata/sf0.001"
    found = top_inner_products(spark.read.parquet(f"{sf}/embeddings.parquet"), block_rows=block_rows)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS FROM '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, found.collect())) == sorted(duck.sql(OP9_SQL).fetchall())


def test_registered(spark):
    found = registry.QUERIES["op9_cover_trees"](spark, "/root/testdata/sf0.001")
    assert dict(found.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.25]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [-0.5, 0.1]),
            (6, [0.5, 0.25]), (7, [0.5, 0.25]), (50, [0.1, -0.9]), (None, [1.0, 1.0]), (100, [0.0, 0.0]),
            (8, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>").selectExpr("*", "1 AS cell", "2 AS v")
    assert sorted(map(tuple, top_inner_products(df).collect())) == brute(rows)
    few = spark.createDataFrame(rows[:1] + rows[5:6], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    assert sorted(map(tuple, top_inner_products(few).collect())) == brute(rows[:1] + rows[5:6])
    assert top_inner_products(df.limit(0)).count() == 0


def test_one_vector_in_a_third_of_all_rows(spark):
    r = np.random.default_rng(8)
    rows = [(i, [0.3, -0.2, 0.9] if i % 3 == 0 else r.normal(size=3).astype(np.float32).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>")
    assert sorted(map(tuple, top_inner_products(df, block_rows=64).collect())) == brute(rows)


def test_rows_repeated_under_one_id(spark):
    rows = [(i % 120, [float(i % 7), 1.0]) for i in range(240)]
    df = spark.createDataFrame([(i, v) for i, v in rows if i % 50], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    asks = spark.createDataFrame([(0, [1.0, 2.0])] * 3, "vec_id BIGINT, embedding ARRAY<FLOAT>")
    found = top_inner_products(df.union(asks))
    assert found.count() == 5 and found.select("rank").distinct().count() == 5


def brute_held(rows, k=5):
    """Sorted (query_id, rank, vec_id, score) by exact integers, held to 64 bits."""
    low, high = -(2**63), 2**63 - 1
    whole = [(i, [min(max(math.floor(256 * x), low), high) for x in v]) for i, v in rows]
    out = []
    for q, v in whole:
        if q % 50 == 0:
            found = [(-min(max(sum(a * b for a, b in zip(v, w)), -high), high), i) for i, w in whole if i != q]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def test_finite_components_beyond_64_bits(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=4).tolist()) for i in range(120)]
    rows[7] = (7, [1e20, -1e20, 3.0, 1e-3])
    rows[50] = (50, [-1e15, 2e14, 1e9, 0.5])
    rows[100] = (100, [1e300, 1.0, -1e300, 0.0])
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    for block_rows in (16, 2048):
        found = top_inner_products(df, block_rows=block_rows).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == brute_held(rows)


def test_blocks_of_one_cell_are_met_with_floors(spark, monkeypatch):
    """A third of all rows in one cell: its blocks beyond the first are met with what that one gave."""
    met = []
    searched = cover_trees._searched

    def watch(meetings, k):
        met.append(meetings.select("cell", "block", F.col("floor").isNotNull().alias("known")).collect())
        return searched(meetings, k)

    monkeypatch.setattr(cover_trees, "_searched", watch)
    r = np.random.default_rng(5)
    rows = [(i, ((i % 3 == 0) * 50 + r.normal(size=4) * (0.01 if i % 3 == 0 else 9)).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    found = top_inner_products(df, block_rows=50).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == brute_held(rows)
    first, second = met
    assert {m.block for m in first} == {0} and not any(m.known for m in first)
    assert all(m.known for m in second) and any(m.block > 0 for m in second)


def test_of_vectors_that_share_an_id_the_least_asks(spark):
    rows = [(0, [2.0, 0.0]), (0, [1.0, 5.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    found = sorted((r["rank"], r.vec_id, r.score) for r in top_inner_products(df).collect())
    assert found == [(1, 2, 256 * 256 * 5), (2, 1, 256 * 256)]


def placed_in_one_cell(spark, rows):
    df = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in enumerate(rows)], "vec_id LONG, v ARRAY<BIGINT>")
    return df.selectExpr("vec_id", "v", "0 AS cell", "CAST(0 AS DOUBLE) AS away")


@pytest.mark.parametrize("large", [0, 2**62])
def test_a_crowded_cell_is_cut_until_its_blocks_are_small(spark, large, monkeypatch):
    """A third copies; with ``large`` added, doubles cannot tell the others apart either."""
    monkeypatch.setattr(cover_trees, "FAN", 4)
    points = clustered(3, 2400) + large
    points[::3] = points[0]
    found = cover_trees._cut(placed_in_one_cell(spark, points), 6, 50).collect()
    assert sorted(r.vec_id for r in found) == list(range(2400))
    assert all(r.v == points[r.vec_id].tolist() for r in found)
    blocks = {}
    for r in found:
        blocks.setdefault(r.block, []).append(points[r.vec_id])
    assert max(map(len, blocks.values())) < 3 * 50 and 0 in blocks
    if not large:  # copies aside, blocks of the cell are much narrower than the cell
        spans = [np.ptp(b, axis=0).max() for n, b in blocks.items() if n > 0]
        assert np.mean(spans) < 0.4 * np.ptp(points, axis=0).max()


def test_bytes_met_in_one_cell_grow_less_than_with_the_square(spark, monkeypatch):
    met = []
    searched = cover_trees._searched
    monkeypatch.setattr(cover_trees, "MOST_CENTRES", 1)

    def watch(meetings, k):
        met.append(meetings.agg(F.sum(F.length("data"))).first()[0])
        return searched(meetings, k)

    monkeypatch.setattr(cover_trees, "_searched", watch)
    for n in (2000, 8000):
        r = np.random.default_rng(n)
        middle = r.normal(size=(20, 6)) * 20
        rows = [(i, (middle[r.integers(20)] + r.normal(size=6)).tolist()) for i in range(n)]
        df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
        found = top_inner_products(df, block_rows=40).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == brute_held(rows)
    _, few, _, many = met
    assert many < 12 * few, met


def test_query_groups_are_near_and_bounded(spark):
    rows = [(i, [i], 0, f"{i // 7:04d}" if i < 140 else "") for i in range(400)]
    asking = spark.createDataFrame(rows, "vec_id LONG, v ARRAY<BIGINT>, cell INT, path STRING")
    found = cover_trees._query_groups(asking, 20).collect()
    groups = {}
    for r in found:
        groups.setdefault((r.part, r.salt), []).append(r.vec_id)
    assert sorted(i for g in groups.values() for i in g) == list(range(400))
    assert max(map(len, groups.values())) <= 2 * 20
    assert all(max(g) - min(g) < 40 for g in groups.values() if max(g) < 140)
