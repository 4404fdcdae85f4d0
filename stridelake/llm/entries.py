"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from stridelake.llm import op1_mixing, op2_tools, op3_repair, op4_packing, op5_secrets, op6_sharding, op7_spotsigs, op8_quality, op9_urls, op10_partenum, op11_whitening, op12_prefix_trie, op13_decontamination

MODULES = {
    "op1_soft_mixing": op1_mixing.op1_soft_mixing,
    "op2_tool_calls": op2_tools.op2_tool_calls,
    "op3_repair": op3_repair.op3_repair,
    "op4_packing": op4_packing.op4_packing,
    "op5_secrets": op5_secrets.op5_secrets,
    "op6_interleaved_shards": op6_sharding.op6_interleaved_shards,
    "op7_spotsigs": op7_spotsigs.op7_spotsigs,
    "op8_quality_rules": op8_quality.op8_quality_rules,
    "op9_url_filter": op9_urls.op9_url_filter,
    "op10_partenum": op10_partenum.op10_partenum,
    "op11_whitening": op11_whitening.op11_whitening,
    "op12_prefix_trie": op12_prefix_trie.op12_prefix_trie,
    "op13_decontamination": op13_decontamination.op13_decontamination,
}


def queries() -> dict:
    return dict(MODULES)


def oracle_sql() -> dict[str, str]:
    return dict(op9_urls.ORACLE)
