"""The corpus queries and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablemill.llm import align, chat, decontam, media, mixing, ranked, simhash, tokens, topk, toxicity, unigram, urlrules, warc
from tablemill.session import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    def documents(spark: SparkSession, root: str) -> DataFrame:
        return table(spark, root, "documents")

    return {
        "op1_media_columns": lambda spark, root: media.op1(documents(spark, root)),
        "op2_simhash_near_dedup": lambda spark, root: simhash.op2(documents(spark, root)),
        "op3_warc": lambda spark, root: warc.op3(table(spark, root, "pages")),
        "op4_mix_to_weights": lambda spark, root: mixing.op4(documents(spark, root)),
        "op5_decontaminate": lambda spark, root: decontam.op5(documents(spark, root), table(spark, root, "benchmark")),
        "op6_token_counts": lambda spark, root: unigram.op6(documents(spark, root)),
        "op7_chat_turns": lambda spark, root: chat.op7(table(spark, root, "conversations")),
        "op8_toxicity": lambda spark, root: toxicity.op8(documents(spark, root), table(spark, root, "labels")),
        "op9_url_rules": lambda spark, root: urlrules.op9(table(spark, root, "pages"), table(spark, root, "labels")),
        "op10_token_ids": lambda spark, root: tokens.op10(documents(spark, root)),
        "op11_top_k": lambda spark, root: topk.op11(table(spark, root, "embeddings")),
        "op12_token_alignment": lambda spark, root: align.op12(documents(spark, root)),
        "op13_ranked_search": lambda spark, root: ranked.op13(documents(spark, root), table(spark, root, "benchmark")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": warc.SQL, "op4_mix_to_weights": mixing.SQL, "op5_decontaminate": decontam.SQL, "op11_top_k": topk.SQL, "op13_ranked_search": ranked.SQL}
