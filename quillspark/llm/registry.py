"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import collocations, crosspolytope, decontaminate, langid, licenses, merkle, mixing, pii, sharding, simhash, toxicity, urlfilter, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_fingerprints": merkle.op3_fingerprints,
        "op4_simhash": simhash.op4_simhash,
        "op5_decontamination": decontaminate.op5_decontamination,
        "op6_url_filter": urlfilter.op6_url_filter,
        "op7_pii": pii.op7_pii,
        "op8_mixing": mixing.op8_mixing,
        "op9_licenses": licenses.op9_licenses,
        "op10_language_id": langid.op10_language_id,
        "op11_collocations": collocations.op11_collocations,
        "op12_whitening": whitening.op12_whitening,
        "op13_embedding_neardup": crosspolytope.op13_embedding_neardup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_fingerprints": merkle.OP3_SQL,
        "op6_url_filter": urlfilter.OP6_SQL,
        "op11_collocations": collocations.OP11_SQL,
        "op13_embedding_neardup": crosspolytope.OP13_SQL,
    }
