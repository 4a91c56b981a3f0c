"""Driver queries of this subpackage: one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from changelens.llm import chat, flac, licenses, mixing, negatives, packing, pieces, pii, quality, resampling, simhash, urls, warc

_QUERIES = [
    simhash.op1_simhash_covering, chat.op2_chat_prefix_targets, licenses.op3_license_rules, pii.op4_pii_bootstrap, mixing.op5_mix_sources,
    packing.op6_pack_bin_slack, warc.op7_warc_segments, flac.op8_flac_media, urls.op9_url_gbt, quality.op10_quality_divergence,
    resampling.op11_resample_postings, pieces.op12_pieces_distinct, negatives.op13_negatives_summa,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_prefix_targets": chat.OP2_SQL, "op7_warc_segments": warc.OP7_SQL,
        "op11_resample_postings": resampling.OP11_SQL, "op13_negatives_summa": negatives.OP13_SQL,
    }
