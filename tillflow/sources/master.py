"""Checks on a loaded item master."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.operators.cleaning import usable_master


def duplicate_codes(master: DataFrame) -> DataFrame:
    """Item codes that occur more than once, with their number of rows."""
    return (
        master.filter(F.col("item_code").isNotNull())
        .groupBy("item_code")
        .agg(F.count("*").alias("copies"))
        .filter(F.col("copies") > 1)
    )


def require_unique_codes(master: DataFrame) -> DataFrame:
    """The same master; raises if a code repeats, as each repeat counts its sales again.

    Only rows with all fields filled meet sales, so only these are checked.
    """
    found = duplicate_codes(usable_master(master)).take(1)
    if found:
        raise ValueError(
            f"item master lists code {found[0]['item_code']!r} {found[0]['copies']} times"
        )
    return master
