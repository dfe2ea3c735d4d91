"""The queries of this subpackage, one for each operator, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from asofgraph.llm import ann, chat, cotraining, langid, mixing, ngram_join, packing, pages, vector_dedup, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_pages": pages.op1_pages,
        "op2_mixing": mixing.op2_mixing,
        "op3_quality": cotraining.op3_quality,
        "op4_packing": packing.op4_packing,
        "op5_ngram_join": ngram_join.op5_ngram_join,
        "op6_language": langid.op6_language,
        "op7_chat_format": chat.op7_chat_format,
        "op8_warc": warc.op8_warc,
        "op9_ann": ann.op9_ann,
        "op10_vector_dedup": vector_dedup.op10_vector_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": mixing.ORACLE,
        "op5_ngram_join": ngram_join.ORACLE,
        "op7_chat_format": chat.ORACLE,
        "op8_warc": warc.ORACLE,
        "op10_vector_dedup": vector_dedup.ORACLE,
    }
