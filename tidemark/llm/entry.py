"""Queries of the training-data operators and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from . import chat, codes, decontaminate, licenses, media, merkle, mixing, pii, sharding, simhash, tokens, toxicity, urls

QUERIES = {
    "op1_mpeg_audio": media.op1,
    "op2_license_rules": licenses.op2,
    "op3_toxicity": toxicity.op3,
    "op4_url_trust": urls.op4,
    "op5_simhash_components": simhash.op5,
    "op6_decontaminate": decontaminate.op6,
    "op7_token_counts": tokens.op7,
    "op8_mix_sources": mixing.op8,
    "op9_shard_documents": sharding.op9,
    "op10_personal_data": pii.op10,
    "op11_vector_codes": codes.op11,
    "op12_chat_spans": chat.op12,
    "op13_merkle_manifest": merkle.op13,
}

#: The others train models, hash by XXH64, measure edits or write audio, which SQL can't.
ORACLES: dict[str, str] = {
    "op2_license_rules": licenses.oracle_sql(),
    "op4_url_trust": urls.ORACLE_SQL,
    "op8_mix_sources": mixing.ORACLE_SQL,
    "op9_shard_documents": sharding.ORACLE_SQL,
    "op11_vector_codes": codes.oracle_sql(),
    "op12_chat_spans": chat.ORACLE_SQL,
    "op13_merkle_manifest": merkle.oracle_sql(),
}
