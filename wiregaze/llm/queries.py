"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import decontam, html, langid, lines, packing, pii, pipeline, quality, simhash, topk, urls

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_quality": quality.op2_quality,
    "op3_html": html.op3_html,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_pii": pii.op5_pii,
    "op6_decontam": decontam.op6_decontam,
    "op7_langid": langid.op7_langid,
    "op8_topk": topk.op8_topk,
    "op9_packing": packing.op9_packing,
    "op10_urls": urls.op10_urls,
    "pipeline": pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": lines.OP4_SQL,
    "op8_topk": topk.OP8_SQL,
    "op10_urls": urls.op10_sql(),
}
