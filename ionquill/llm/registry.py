"""All queries of the subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from ionquill.llm import queries_docs as rows
from ionquill.llm import queries_pages as pages
from ionquill.llm import queries_text as text

QUERIES = {
    "op1_simhash": text.op1_simhash,
    "op2_byte_bpe": text.op2_byte_bpe,
    "op3_quality": rows.op3_quality,
    "op4_main_text": rows.op4_main_text,
    "op5_pseudonyms": rows.op5_pseudonyms,
    "op6_bitsliced_topk": rows.op6_bitsliced_topk,
    "op7_imatch": text.op7_imatch,
    "op8_packing": text.op8_packing,
    "op9_url_filter": pages.op9_url_filter,
    "op10_archives": pages.op10_archives,
}

SQL = {"op6_bitsliced_topk": rows.OP6_SQL, "op10_archives": pages.OP10_SQL}


def queries() -> dict:
    """With ``pipeline``, which lies in a module of its own at the top."""
    import corpus_pipeline

    return {**QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
