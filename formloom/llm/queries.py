"""The registered queries of this subpackage and their DuckDB texts."""

from __future__ import annotations

import corpus_pipeline
from formloom.llm import bpe, chat, collocations, exact, licenses, mixing, neardup, pii, pu, rules, sharding, turns, vafile

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_minhash_dedup": neardup.query,
    "op3_vafile_topk": vafile.query,
    "op4_chat_format": chat.query,
    "op5_quality_rules": rules.query,
    "op6_pii": pii.query,
    "op7_license_scan": licenses.query,
    "op8_kd_shards": sharding.query,
    "op9_pu_quality": pu.query,
    "op10_bpe": bpe.query,
    "op11_repair_turns": turns.query,
    "op12_exact_dedup": exact.query,
    "op13_collocations": collocations.query,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_mix_sources": mixing.ORACLE,
    "op2_minhash_dedup": neardup.ORACLE,
    "op3_vafile_topk": vafile.ORACLE,
    "op4_chat_format": chat.ORACLE,
    "op11_repair_turns": turns.ORACLE,
    "op12_exact_dedup": exact.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
