"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from .chat import OP3_SQL, op3_chat_format
from .decontaminate import OP9_SQL, op9_decontamination
from .mixing import op2_mixing
from .ngram_join import OP1_LINKS_SQL, OP1_SQL, op1_links, op1_ngram_join
from .pii import op4_pii
from .quality import op8_quality
from .telephony import op5_telephony
from .tokens import op6_token_ids
from .toxicity import op10_toxicity
from .url_rules import OP7_SQL, op7_url_filter


def _pipeline(spark, sf_dir: str):
    from corpus_pipeline import run

    return run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": _pipeline,
        "op1_ngram_join": op1_ngram_join,
        "op1_links": op1_links,
        "op2_mixing": op2_mixing,
        "op3_chat_format": op3_chat_format,
        "op4_pii": op4_pii,
        "op5_telephony": op5_telephony,
        "op6_token_ids": op6_token_ids,
        "op7_url_filter": op7_url_filter,
        "op8_quality": op8_quality,
        "op9_decontamination": op9_decontamination,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": OP1_SQL,
        "op1_links": OP1_LINKS_SQL,
        "op3_chat_format": OP3_SQL,
        "op7_url_filter": OP7_SQL,
        "op9_decontamination": OP9_SQL,
    }
