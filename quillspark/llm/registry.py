"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from quillspark.llm import balls, brown, bytebpe, decontaminate, dialogue, jaccard, langid, mixing, neighbours, secrets, substrings, tokenfiles, warc
from quillspark.llm.sql import SQL


def queries() -> dict:
    return {
        "op1_token_files": tokenfiles.op1_token_files,
        "op2_substrings": substrings.op2_substrings,
        "op3_neighbours": neighbours.op3_neighbours,
        "op4_language": langid.op4_language,
        "op5_warc": warc.op5_warc,
        "op6_jaccard": jaccard.op6_jaccard,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_byte_bpe": bytebpe.op8_byte_bpe,
        "op9_secrets": secrets.op9_secrets,
        "op10_class_bigrams": brown.op10_class_bigrams,
        "op11_conversations": dialogue.op11_conversations,
        "op12_balls": balls.op12_balls,
        "op13_mixing": mixing.op13_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
