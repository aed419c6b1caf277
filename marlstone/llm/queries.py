"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from marlstone.llm import chat, decontaminate, language, licenses, minhash, mixing, quality, sharding, substring_dedup, suffix_dedup

QUERIES = {
    "op1_chat_windows": chat.op1_chat_windows,
    "op2_line_quality": quality.op2_line_quality,
    "op3_column_transform": suffix_dedup.op3_column_transform,
    "op4_byte_network": language.op4_byte_network,
    "op5_benchmark_windows": decontaminate.op5_benchmark_windows,
    "op6_fm_index": substring_dedup.op6_fm_index,
    "op7_rendezvous_sharding": sharding.op7_rendezvous_sharding,
    "op8_license_diagonals": licenses.op8_license_diagonals,
    "op10_bayesian_minhash": minhash.op10_bayesian_minhash,
    "op9_source_mixing": mixing.op9_source_mixing,
}

SQL: dict[str, str] = {
    "op2_line_quality": quality.SQL,
    "op5_benchmark_windows": decontaminate.SQL,
    "op6_fm_index": substring_dedup.SQL,
    "op8_license_diagonals": licenses.SQL,
    "op10_bayesian_minhash": minhash.SQL,
}
