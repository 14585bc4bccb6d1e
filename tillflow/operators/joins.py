"""Enrichment of sales with the item master."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillflow.settings import JoinSettings


def hot_items(sales: DataFrame, settings: JoinSettings) -> DataFrame:
    """``item_code`` and ``buckets`` of items with more than ``hot_share`` of the sales.

    At most ``1 / hot_share`` items can have that much. Each gets one bucket for
    every ``hot_share`` of the sales it has, begun ones included, so that no
    bucket holds more than that.
    """
    counts = sales.groupBy("item_code").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    share = F.col("n") / total
    buckets = F.ceil(share / F.lit(settings.hot_share)).cast("int")
    hot = counts.filter(share > settings.hot_share)
    return hot.filter("item_code IS NOT NULL").select("item_code", buckets.alias("buckets"))


def given_hot_items(sales: DataFrame, settings: JoinSettings) -> DataFrame:
    """The table of hot items the settings name."""
    rows = [(code, int(buckets)) for code, buckets in settings.hot_items.items()]
    return sales.sparkSession.createDataFrame(rows, "item_code STRING, buckets INT")


def salt_of(sales: DataFrame, buckets: Column) -> Column:
    """A number below ``buckets`` for each sale, 0 where that is null.

    The input partition is part of the hash, so even copies of one and the
    same sale spread out, and a task that runs again gives the same salts.
    """
    row = F.xxhash64(F.spark_partition_id(), *[c for c in sales.columns if c != "buckets"])
    return F.coalesce(F.pmod(row, buckets), F.lit(0)).cast("int").alias("salt")


def copied_master(master: DataFrame, hot: DataFrame) -> DataFrame:
    """Each master row with its salts: one copy for a cold item, one per bucket for a hot one."""
    every_salt = F.explode(F.sequence(F.lit(0), F.coalesce("buckets", F.lit(1)) - F.lit(1)))
    counted = master.join(F.broadcast(hot), "item_code", "left")
    return counted.select(*master.columns, every_salt.alias("salt"))


def join_master(
    sales: DataFrame, master: DataFrame, settings: JoinSettings = JoinSettings()
) -> DataFrame:
    """Inner equi-join on ``item_code``; keeps no state on a stream.

    In batch the kind of join is left to Catalyst and adaptive execution, which
    know the sizes. On a stream both sides are shuffled whatever the master's
    size, so a master that grows under a running query changes nothing.
    ``broadcast`` is for a master that is small and stays so.

    With ``salt`` (batch) or ``hot_items``, the sales of hot items are spread
    over several tasks and only these items' master rows are copied. The table
    of hot items is broadcast: it has ``1 / hot_share`` rows at most, or those
    the caller wrote down.
    """
    if settings.broadcast:
        return sales.join(F.broadcast(master), "item_code", "inner")
    if settings.hot_items:
        hot = given_hot_items(sales, settings)
    elif settings.salt and not sales.isStreaming:
        hot = hot_items(sales, settings)
    else:
        kept = master.hint("merge") if sales.isStreaming else master
        return sales.join(kept, "item_code", "inner")
    known = sales.join(F.broadcast(hot), "item_code", "left")
    salted_sales = known.select(*sales.columns, salt_of(known, F.col("buckets")))
    # The hint keeps the copied master from being broadcast after all.
    salted_master = copied_master(master, hot).hint("merge")
    return salted_sales.join(salted_master, ["item_code", "salt"], "inner").drop("salt")
