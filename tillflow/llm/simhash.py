"""Near-duplicate groups: SimHash fingerprints linked through pivot distance tables.

A fingerprint's distances to a fixed set of reference fingerprints (pivots) are
computed once. By the triangle inequality no coordinate of two linked
fingerprints differs by more than the link distance, so the greatest coordinate
difference discards a pair before its exact distance is taken.

Distances to pivots say which pairs to drop, not where to look: of two random
64-bit fingerprints, a third pass each pivot. Candidates therefore meet on bit
blocks. With ``distance + 3`` blocks, two linked fingerprints agree on at least
three of them, so every choice of three blocks is one bucket key.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillflow.llm.common import bounded_batches, saved, table
from tillflow.llm.components import components

SEED = 42
BITS = 64
AGREEING_BLOCKS = 3


def fingerprint_of(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of a text's word shingles as an unsigned number; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    size = min(shingle, len(words))
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    hashes = np.array(
        [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], dtype="<u8"
    )
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # bounds the unpacked bits of long texts
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(bit) for bit in np.flatnonzero(2 * ones > len(hashes)))


def with_fingerprints(docs: DataFrame, shingle: int = 3, *also: str) -> DataFrame:
    """``doc_id``, the fingerprint of ``text`` as a signed long, and the columns ``also``."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.array([fingerprint_of(t, shingle) for t in texts], dtype=np.uint64)
            yield pd.Series(found.view(np.int64))

    found = fingerprints(F.col("text").cast("binary")).alias("fingerprint")
    return docs.select("doc_id", found, *also)


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def pivots(count: int) -> list[int]:
    """Reference fingerprints: hashes of their numbers, so every task has the same."""
    return [xxhash.xxh64_intdigest(f"pivot {i}", SEED) for i in range(count)]


def _block_masks(distance: int) -> list[int]:
    blocks = np.array_split(np.arange(BITS), distance + AGREEING_BLOCKS)
    masks = [sum(1 << int(bit) for bit in block) for block in blocks]
    return [sum(chosen) for chosen in combinations(masks, AGREEING_BLOCKS)]


def _differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(
    fingerprints: DataFrame, distance: int = 2, n_pivots: int = 8, bucket_limit: int = 256
) -> DataFrame:
    """Links ``a``, ``b`` that join all distinct fingerprints within ``distance``.

    Buckets of up to ``bucket_limit`` fingerprints are joined with themselves.
    A crowded bucket takes an exact way that makes no pairs: two fingerprints
    within 2 bits meet at a point within one bit of both, and each fingerprint
    visits all 65 such points around it.
    """
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2")
    fp = F.col("fingerprint")
    masks = _block_masks(distance)
    keys = F.array(
        *[
            F.struct(F.lit(i).alias("blocks"), fp.bitwiseAND(F.lit(_signed(m))).alias("bits"))
            for i, m in enumerate(masks)
        ]
    )
    members = fingerprints.select("fingerprint", F.explode(keys).alias("key")).select(
        "fingerprint", "key.blocks", "key.bits"
    )
    crowds = members.groupBy("blocks", "bits").agg(F.count("*").alias("size")).filter("size > 1")
    members = saved(members.join(crowds, ["blocks", "bits"]), "simhash-buckets")

    table = members.filter(F.col("size") <= bucket_limit).select(
        "blocks",
        "bits",
        "fingerprint",
        *[
            _differing(fp, F.lit(_signed(p))).cast("byte").alias(f"to{i}")
            for i, p in enumerate(pivots(n_pivots))
        ],
    )
    left, right = table.alias("x"), table.alias("y")
    near = F.col("x.fingerprint") < F.col("y.fingerprint")
    for i in range(n_pivots):
        near &= F.abs(F.col(f"x.to{i}") - F.col(f"y.to{i}")) <= distance
    near &= _differing(F.col("x.fingerprint"), F.col("y.fingerprint")) <= distance
    same = (F.col("x.blocks") == F.col("y.blocks")) & (F.col("x.bits") == F.col("y.bits"))
    joined = left.join(right, same & near).select(
        F.col("x.fingerprint").alias("a"), F.col("y.fingerprint").alias("b")
    )

    crowded = members.filter(F.col("size") > bucket_limit).select("fingerprint").distinct()
    around = F.array(fp, *[fp.bitwiseXOR(F.lit(_signed(1 << bit))) for bit in range(BITS)])
    visits = crowded.select("fingerprint", F.explode(around).alias("point"))
    if distance == 2:
        met = visits.groupBy("point").agg(F.collect_list("fingerprint").alias("all"))  # 65 at most
        met = met.select(F.array_min("all").alias("a"), F.explode("all").alias("b"))
    else:
        homes = crowded.select(F.col("fingerprint").alias("point"))
        met = visits.join(homes, "point").select(
            F.least("fingerprint", "point").alias("a"), F.greatest("fingerprint", "point").alias("b")
        )
    return joined.union(met.filter("a <> b")).distinct()


def _named(rows: DataFrame, distance: int, n_pivots: int, bucket_limit: int, least: Column) -> DataFrame:
    """``fingerprint`` and ``least`` over the rows of its component, for each fingerprint."""
    distinct = rows.groupBy("fingerprint").agg(least.alias("least"))
    found = components(links(distinct.select("fingerprint"), distance, n_pivots, bucket_limit))
    rooted = distinct.join(
        found.select(F.col("node").alias("fingerprint"), "root"), "fingerprint", "left"
    ).withColumn("root", F.coalesce("root", "fingerprint"))
    names = rooted.groupBy("root").agg(F.min("least").alias("least"))
    return rooted.select("fingerprint", "root").join(names, "root")


def near_duplicates(
    docs: DataFrame, shingle: int = 3, distance: int = 2, n_pivots: int = 8, bucket_limit: int = 256
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hex) and ``component_id`` for every row of ``docs``.

    ``component_id`` is the least ``doc_id`` reachable over links. Equal
    fingerprints are linked; the pair search sees each of them once, so a group
    of copies costs one row. Texts that are null or without words have
    fingerprint zero. Rows with a null ``doc_id`` take part and are named by the
    others of their component, null if it has none. Repeated rows all come back.
    An empty table gives an empty result, other columns are ignored.
    """
    rows = saved(with_fingerprints(docs, shingle), "simhash")
    named = _named(rows, distance, n_pivots, bucket_limit, F.min("doc_id"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return rows.join(named, "fingerprint").select("doc_id", digits, F.col("least").alias("component_id"))


def one_of_each_group(
    docs: DataFrame, shingle: int = 3, distance: int = 2, n_pivots: int = 8, bucket_limit: int = 256
) -> DataFrame:
    """The row with the least ``doc_id`` of each component, all columns kept.

    Of rows that share that ``doc_id`` within a component the one of the least text
    checksum stays, and of repeated rows one. Rows that share a ``doc_id`` but not a
    component stay each for its own. Rows without a ``doc_id`` stay, as nothing names
    them. An empty table gives an empty result.
    """
    key = F.xxhash64("text")
    keyed = docs.select("doc_id", "text", key.alias("text_key"))
    rows = saved(with_fingerprints(keyed, shingle, "text_key"), "simhash").filter("doc_id IS NOT NULL")
    named = _named(rows, distance, n_pivots, bucket_limit, F.min(F.struct("doc_id", "text_key")))
    kept = named.select("least.*").distinct().select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")
    )
    rows = docs.withColumn("_text_key", key)
    same = (F.col("doc_id") == F.col("_id")) & (F.col("_text_key") == F.col("_key"))
    stay = rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_text_key"])
    return stay.drop("_text_key").unionByName(docs.filter("doc_id IS NULL"))


def op3_simhash_pivots(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
