"""The queries opN_<name> over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chatloom.llm import bpe, language_id, mixing, near_dedup, neighbours, quality, sharding, suffix_dedup, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix": mixing.query,
        "op2_fixity": warc.query,
        "op3_bpe": bpe.query,
        "op4_repeats": suffix_dedup.query,
        "op5_toxicity": toxicity.query,
        "op6_quality": quality.query,
        "op7_shards": sharding.query,
        "op8_near_dedup": near_dedup.query,
        "op9_language": language_id.query,
        "op10_neighbours": neighbours.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_fixity": warc.SQL, "op4_repeats": suffix_dedup.SQL}
