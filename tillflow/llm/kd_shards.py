"""Shards of near equal bytes by k-d splits at distributed weighted medians.

Every row is a point in a cube of metadata coordinates. Level by level, each
node picks its widest dimension and is cut at the median of that dimension,
weighted by bytes, until its leaves have the target size. All nodes of a level
are cut at once, by aggregations with map-side sums; nodes stay in DataFrames.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillflow.llm.common import empty_if_null, saved, table

#: Histogram cells of a dimension, and of each order that splits a cell.
CELLS = 4096
FINE_CELLS = 1 << 16
#: Orders in which rows of a node are cut: by cell, then copies of a text, then rows.
ORDERS = ("cell", "fine", "finest")
ROWS_PER_NUMBERING_TASK = 50_000


def _unit_hash(column: Column) -> Column:
    text = F.coalesce(column.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) / F.lit(float(1 << 32))


def document_points(docs: DataFrame) -> DataFrame:
    """Size, checksum and coordinates in [0, 1] of each document.

    The dimensions are language and source, by hash so that equal values share a
    coordinate whatever their number, and the size on a logarithmic scale. Null
    metadata count as empty text. ``fine`` keeps copies of a text side by side;
    ``finest`` tells rows apart, so a group of copies of any size can be cut.
    """
    text = empty_if_null("text")
    size = (F.octet_length(text) + F.lit(1)).cast("long")
    points = docs.select(
        "doc_id",
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        _unit_hash(F.col("lang")).alias("at0"),
        _unit_hash(F.col("source")).alias("at1"),
        (F.log2(size.cast("double")) / F.lit(32.0)).alias("at2"),
        F.pmod(F.xxhash64(text), F.lit(FINE_CELLS)).cast("int").alias("fine"),
        F.monotonically_increasing_id().alias("uid"),
    )
    finest = F.pmod(F.xxhash64("uid"), F.lit(FINE_CELLS)).cast("int")
    return points.withColumn("finest", finest)


def _dimensions(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c.startswith("at")]


def _open_nodes(rows: DataFrame) -> DataFrame:
    """Nodes with several leaves: their widest dimension and the bytes that go left."""
    dimensions = _dimensions(rows)
    widths = [(F.max(c) - F.min(c)).alias(c) for c in dimensions]
    nodes = rows.filter("leaves > 1").groupBy("node", "leaves")
    nodes = nodes.agg(F.sum("size").alias("bytes"), *widths)
    widest = F.greatest(*[F.col(c) for c in dimensions])
    named = F.coalesce(*[F.when(F.col(c) == widest, F.lit(c)) for c in dimensions])
    share = F.floor(F.col("leaves") / 2) / F.col("leaves")
    return nodes.select("node", named.alias("widest"), (F.col("bytes") * share).alias("wanted"))


def _reached(rows: DataFrame, order: str) -> DataFrame:
    """Per node, where its bytes in ``order`` first reach ``wanted``, and what is still wanted there."""
    histogram = rows.groupBy("node", "wanted", order).agg(F.sum("size").alias("bytes"))
    upto = F.sum("bytes").over(Window.partitionBy("node").orderBy(order))
    histogram = histogram.withColumn("upto", upto)
    hit = F.min(F.struct(order, (F.col("wanted") - F.col("upto") + F.col("bytes")).alias("rest")))
    found = histogram.filter("upto >= wanted").groupBy("node").agg(hit.alias("hit"))
    return found.select("node", F.col(f"hit.{order}").alias(f"cut_{order}"), "hit.rest")


def _cut(rows: DataFrame) -> DataFrame:
    """All open nodes cut once; the left part keeps the node's name."""
    at = F.coalesce(*[F.when(F.col("widest") == c, F.col(c)) for c in _dimensions(rows)])
    placed = rows.join(_open_nodes(rows), "node").withColumn(
        "cell", F.floor(at * F.lit(CELLS)).cast("int")
    )
    tied, cuts = placed, None
    for order in ORDERS:
        found = saved(_reached(tied, order), "kd-cuts")
        cuts = found if cuts is None else cuts.drop("rest").join(found, "node")
        here = found.select("node", F.col(f"cut_{order}").alias(order), "rest")
        tied = tied.join(here, ["node", order]).withColumn("wanted", F.col("rest")).drop("rest")
    goes_left = F.struct(*ORDERS) <= F.struct(*[F.col(f"cut_{o}").alias(o) for o in ORDERS])
    first = F.floor(F.col("leaves") / 2).cast("int")
    split = placed.join(cuts, "node").select(
        *[c for c in rows.columns if c not in ("node", "leaves")],
        F.when(goes_left, F.col("node")).otherwise(F.col("node") + first).alias("node"),
        F.when(goes_left, first).otherwise(F.col("leaves") - first).alias("leaves"),
    )
    return split.select(*rows.columns).union(rows.filter("leaves <= 1"))


def kd_leaves(
    points: DataFrame, leaves: int | None = None, target_bytes: int | None = None
) -> DataFrame:
    """``points`` with their leaf as ``shard``, from 0.

    ``points`` has ``size``, ``fine``, ``finest``, ``uid`` and coordinates
    ``at0``, ``at1``, ... in [0, 1]. Either ``leaves`` or ``target_bytes`` is
    given. Sizes differ by what ``finest`` cannot tell apart, a few rows.
    """
    # Written with its node: a literal would turn the joins on it into cross joins.
    points = saved(points.withColumn("node", F.lit(0)), "kd-points")
    if leaves is None:
        total = points.agg(F.sum("size").alias("bytes")).first()["bytes"] or 0
        leaves = max(1, math.ceil(total / target_bytes))
    rows = points.withColumn("leaves", F.lit(leaves))
    for _ in range(math.ceil(math.log2(leaves))):
        rows = saved(_cut(rows), "kd-level")
    return rows.withColumnRenamed("node", "shard").drop("leaves")


def numbered(rows: DataFrame, total: int) -> DataFrame:
    """``slot``: the place of a row in its shard, gapless from 0.

    A shard is numbered by many tasks: each numbers one block, and the counts of
    the blocks before give its start.
    """
    blocks = max(1, total // ROWS_PER_NUMBERING_TASK)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int"))
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")
    starts = counts.select("shard", "block", before.alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "uid"))
    placed = rows.withColumn("place", place).join(starts, ["shard", "block"])
    slot = (F.col("start") + F.col("place") - F.lit(1)).cast("long")
    return placed.withColumn("slot", slot).drop("start", "place", "block")


def shard_documents(
    docs: DataFrame, shards: int | None = 16, target_bytes: int | None = None
) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` for every row of ``docs``.

    A null text has no bytes and still takes one row of size 1. Repeated rows
    are separate rows. An empty table gives an empty result. Columns other than
    ``doc_id``, ``text``, ``lang`` and ``source`` are ignored.
    """
    placed = kd_leaves(document_points(docs), shards, target_bytes)
    return numbered(placed, placed.count()).select(
        "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot"
    )


def op5_kd_tree_shards(spark, sf_dir):
    sharded = shard_documents(table(spark, sf_dir, "documents"), shards=16)
    return sharded.withColumns(
        {"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}
    )
