import zlib

import pytest
from pyspark.sql import functions as F

from tillflow.llm.common import saved
from tillflow.llm.kd_shards import CELLS, _cut, document_points, kd_leaves, shard_documents


def check(docs, shards):
    found = shard_documents(docs, shards).collect()
    expected = sorted(
        ((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()))
         for r in docs.collect()), key=repr
    )
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in found), key=repr) == expected
    by_shard = {}
    for r in found:
        assert 0 <= r.shard < shards
        by_shard.setdefault(r.shard, []).append(r)
    for rows in by_shard.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    return {s: sum(r["size"] for r in rows) for s, rows in by_shard.items()}


@pytest.mark.parametrize("shards", [16, 5, 1])
def test_shards_are_near_equal(spark, shards):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sizes = check(docs, shards)
    largest = docs.selectExpr("max(octet_length(text)) AS n").first().n
    mean = sum(sizes.values()) / shards
    assert len(sizes) == shards
    assert all(abs(s - mean) <= 2.5 * largest for s in sizes.values())


def test_one_text_in_a_third_of_all_rows_is_split(documents):
    docs = documents(["hot copy of one text"] * 2000 + [f"text number {i}" for i in range(4000)])
    docs = docs.selectExpr("doc_id", "text", "'en' AS lang", "'one' AS source", "n_chars")
    sizes = check(docs, 16)
    mean = sum(sizes.values()) / 16
    assert len(sizes) == 16 and max(abs(s - mean) for s in sizes.values()) < 0.02 * mean


def test_target_bytes_give_the_number_of_leaves(documents):
    docs = documents(["x" * 99] * 1000)
    leaves = kd_leaves(document_points(docs), target_bytes=10_000)
    assert leaves.select("shard").distinct().count() == 10


def test_odd_rows(odd, repeated):
    check(odd, 16)
    check(repeated, 16)
    assert shard_documents(odd.limit(0)).count() == 0


def test_no_cross_join(spark, documents):
    points = saved(document_points(documents(["a", "b", "c d"] * 20)).withColumn("node", F.lit(0)), "test")
    plan = _cut(points.withColumn("leaves", F.lit(4)))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and plan.count("Join Inner, (") == plan.count("Join Inner") >= 3


def brute_shards(points, node, leaves):
    """Leaf of each uid: the widest dimension cut where its bytes first reach their share."""
    if leaves == 1 or not points:
        return {p["uid"]: node for p in points}
    names = ["at0", "at1", "at2"]
    widths = {c: max(p[c] for p in points) - min(p[c] for p in points) for c in names}
    widest = max(names, key=lambda c: (widths[c], -names.index(c)))
    place = lambda p: (int(p[widest] * CELLS), p["fine"], p["finest"])
    left = leaves // 2
    wanted, upto = sum(p["size"] for p in points) * (left / leaves), 0
    for p in sorted(points, key=place):
        upto, cut = upto + p["size"], place(p)
        if upto >= wanted:
            break
    lower = [p for p in points if place(p) <= cut]
    upper = [p for p in points if place(p) > cut]
    return brute_shards(lower, node, left) | brute_shards(upper, node + left, leaves - left)


@pytest.mark.parametrize("leaves", [2, 5, 16])
def test_cuts_lie_at_weighted_medians_of_the_widest_dimension(spark, leaves):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    points = saved(document_points(docs), "test-points")
    found = {r.uid: r.shard for r in kd_leaves(points, leaves).collect()}
    assert found == brute_shards([r.asDict() for r in points.collect()], 0, leaves)


def test_cuts_of_copies_and_odd_rows(spark, documents, repeated):
    hot = documents(["hot copy of one text"] * 300 + [f"text number {i}" for i in range(300)])
    for docs in (hot, repeated.select(hot.columns)):
        points = saved(document_points(docs), "test-points")
        found = {r.uid: r.shard for r in kd_leaves(points, 16).collect()}
        assert found == brute_shards([r.asDict() for r in points.collect()], 0, 16)
