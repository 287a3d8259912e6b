"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from framesql.llm import decontaminate, jaccard, langid, lines, mixing, pii, quality, sstable, topk, warc

QUERIES = {
    "op1_content_addressed_warc": warc.op1_content_addressed_warc,
    "op2_block_max_search": topk.op2_block_max_search,
    "op3_curriculum_mix": mixing.op3_curriculum_mix,
    "op4_template_decontamination": decontaminate.op4_template_decontamination,
    "op5_importance_resampling": quality.op5_importance_resampling,
    "op6_contextual_pii": pii.op6_contextual_pii,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_adaptive_prefix_join": jaccard.op8_adaptive_prefix_join,
    "op9_compression_langid": langid.op9_compression_langid,
    "op10_sorted_string_table": sstable.op10_sorted_string_table,
}

ORACLE_SQL = {
    "op1_content_addressed_warc": warc.OP1_SQL,
    "op2_block_max_search": topk.OP2_SQL,
    "op3_curriculum_mix": mixing.OP3_SQL,
    "op7_line_dedup": lines.OP7_SQL,
    "op8_adaptive_prefix_join": jaccard.OP8_SQL,
}
