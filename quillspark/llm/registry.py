"""The corpus queries and their SQL."""

from __future__ import annotations

from . import decontaminate, divergence, embeddings, langid, manifest, mixing, pii, pitman_yor, prefixes, quality, sharding, simhash, tokens

QUERIES = {
    "op1_pitman_yor": pitman_yor.op1_pitman_yor,
    "op2_tokens": tokens.op2_tokens,
    "op3_mixing": mixing.op3_mixing,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_sharding": sharding.op5_sharding,
    "op6_language": langid.op6_language,
    "op7_pii": pii.op7_pii,
    "op8_simhash": simhash.op8_simhash,
    "op9_quality": quality.op9_quality,
    "op10_embeddings": embeddings.op10_embeddings,
    "op11_divergence": divergence.op11_divergence,
    "op12_manifest": manifest.op12_manifest,
    "op13_token_counts": prefixes.op13_token_counts,
}

ORACLE_SQL = {"op3_mixing": mixing.OP3_SQL, "op11_divergence": divergence.OP11_SQL, "op12_manifest": manifest.OP12_SQL}
