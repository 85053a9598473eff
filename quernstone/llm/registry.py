"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import (
    exact_dedup,
    fingerprints,
    language_id,
    license_scan,
    merkle_manifest,
    minhash_dedup,
    mixing,
    packing,
    piece_encoding,
    spelling_variants,
    substring_dedup,
    toxicity,
    url_filter,
)


def queries() -> dict:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_packing": packing.op2_packing,
        "op3_url_filter": url_filter.op3_url_filter,
        "op4_license_scan": license_scan.op4_license_scan,
        "op5_document_fingerprints": fingerprints.op5_document_fingerprints,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_language_id": language_id.op8_language_id,
        "op9_mixing": mixing.op9_mixing,
        "op10_minhash_dedup": minhash_dedup.op10_minhash_dedup,
        "op11_piece_encoding": piece_encoding.op11_piece_encoding,
        "op12_merkle_manifest": merkle_manifest.op12_merkle_manifest,
        "op13_spelling_variants": spelling_variants.op13_spelling_variants,
    }


def oracle_sql() -> dict:
    return {
        "op1_substring_dedup": substring_dedup.OP1_SQL,
        "op7_exact_dedup": exact_dedup.OP7_SQL,
        "op9_mixing": mixing.OP9_SQL,
        "op10_minhash_dedup": minhash_dedup.OP10_SQL,
        "op12_merkle_manifest": merkle_manifest.OP12_SQL,
        "op13_spelling_variants": spelling_variants.OP13_SQL,
    }
