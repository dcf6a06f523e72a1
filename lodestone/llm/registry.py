"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, elkan, exact_dedup, licenses, mixing, pii, secrets, sharding, simhash, spelling, tokens, toxicity, weighted_sampling

QUERIES = [
    weighted_sampling.op1_weighted_fingerprints,
    decontaminate.op2_decontamination,
    secrets.op3_secret_scan,
    pii.op4_pii_surrogates,
    sharding.op5_hash_tree_shards,
    tokens.op6_token_files,
    simhash.op7_simhash,
    licenses.op8_license_scan,
    mixing.op9_curriculum_mix,
    toxicity.op10_toxicity,
    exact_dedup.op11_exact_dedup,
    spelling.op12_spelling_variants,
    elkan.op13_centroid_clusters,
]
ORACLES = {
    "op2_decontamination": decontaminate.OP2_SQL,
    "op3_secret_scan": secrets.OP3_SQL,
    "op8_license_scan": licenses.OP8_SQL,
    "op9_curriculum_mix": mixing.OP9_SQL,
    "op11_exact_dedup": exact_dedup.OP11_SQL,
    "op12_spelling_variants": spelling.OP12_SQL,
    "op13_centroid_clusters": elkan.OP13_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
