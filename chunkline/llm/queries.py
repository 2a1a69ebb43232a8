"""The queries of this folder and their SQL."""

from __future__ import annotations

import corpus_pipeline
from chunkline.llm import bpe, chat, decontaminate, html_text, langid, licenses, line_dedup, merkle, minhash, spelling, spotsigs, suffix_dedup, toxicity


def queries() -> dict:
    return {
        "op1_minhash": minhash.op1_minhash,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_chat": chat.op3_chat,
        "op5_langid": langid.op5_langid,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_spotsigs": spotsigs.op7_spotsigs,
        "op8_bpe": bpe.op8_bpe,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_html": html_text.op10_html,
        "op11_spelling": spelling.op11_spelling,
        "op12_licenses": licenses.op12_licenses,
        "op13_merkle": merkle.op13_merkle,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_chat": chat.OP3_SQL,
        "op4_line_dedup": line_dedup.OP4_SQL,
        "op11_spelling": spelling.OP11_SQL,
        "op12_licenses": licenses.OP12_SQL,
        "op13_merkle": merkle.OP13_SQL,
    }
