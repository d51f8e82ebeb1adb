"""The text operators' queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import fingerprints, jaccard, licenses, mixing, pieces, quality, sharding, suffixes, topk, warc


def queries():
    return {
        "op1_fingerprints": fingerprints.query,
        "op2_licenses": licenses.query,
        "op3_topk": topk.query,
        "op4_jaccard": jaccard.query,
        "op5_sharding": sharding.query,
        "op6_suffixes": suffixes.query,
        "op7_warc": warc.query,
        "op8_pieces": pieces.query,
        "op9_quality": quality.query,
        "op10_mixing": mixing.query,
    }


def oracle_sql():
    return {"op3_topk": topk.ORACLE, "op4_jaccard": jaccard.ORACLE, "op6_suffixes": suffixes.ORACLE, "op7_warc": warc.ORACLE}
