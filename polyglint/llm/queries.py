"""The registered queries of this subpackage and the SQL that DuckDB checks them with."""

from __future__ import annotations

from . import attention, bagminhash, hosts, langid, lines, mixing, rindex, sharding, templates, warc


def queries() -> dict:
    return {
        "op1_compression_langid": langid.op1,
        "op2_revisit_resolution": warc.op2,
        "op3_lpt_sharding": sharding.op3,
        "op4_attention_scoring": attention.op4,
        "op5_bagminhash_dedup": bagminhash.op5,
        "op6_budget_mixing": mixing.op6,
        "op7_template_decontamination": templates.op7,
        "op8_host_quality": hosts.op8,
        "op9_run_length_index": rindex.op9,
        "op10_line_windows": lines.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_revisit_resolution": warc.OP2_SQL, "op8_host_quality": hosts.OP8_SQL, "op10_line_windows": lines.OP10_SQL}
