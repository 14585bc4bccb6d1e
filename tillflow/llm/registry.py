"""The operators' queries over the given tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillflow.llm import (
    attention_mil,
    bm25_packing,
    conversation_repair,
    cover_trees,
    disguised_pii,
    entropy_secrets,
    gumbel_lattice,
    importance_resampling,
    kd_shards,
    license_scan,
    line_windows,
    risk_rules,
    simhash,
)
from tillflow.settings import use_utc

Query = Callable[[SparkSession, str], DataFrame]


def _in_utc(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        use_utc(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {
    query.__name__: _in_utc(query)
    for query in (
        bm25_packing.op1_bm25_packing,
        disguised_pii.op2_disguised_pii,
        simhash.op3_simhash_pivots,
        gumbel_lattice.op4_gumbel_lattice,
        kd_shards.op5_kd_tree_shards,
        risk_rules.op6_risk_rules,
        attention_mil.op7_attention_mil,
        line_windows.op8_line_windows,
        cover_trees.op9_cover_trees,
        entropy_secrets.op10_entropy_secrets,
        license_scan.op11_license_scan,
        importance_resampling.op12_importance_resampling,
        conversation_repair.op13_conversation_repair,
    )
}

#: Fingerprints, token ids, checksums and fitted models have no SQL form; the tests
#: hold those queries against brute force.
ORACLES: dict[str, str] = {
    "op6_risk_rules": risk_rules.OP6_SQL,
    "op8_line_windows": line_windows.OP8_SQL,
    "op9_cover_trees": cover_trees.OP9_SQL,
    "op10_entropy_secrets": entropy_secrets.OP10_SQL,
    "op11_license_scan": license_scan.OP11_SQL,
    "op12_importance_resampling": importance_resampling.OP12_SQL,
}
