"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from sluice.llm.ann import op6_collision_counting
from sluice.llm.bpe import op1_byte_bpe
from sluice.llm.langid import op9_kneser_ney
from sluice.llm.media import op3_media_chunks
from sluice.llm.packing import op8_sum_of_squares_packing
from sluice.llm.pii import op4_weak_supervision
from sluice.llm.shards import op10_id_shards
from sluice.llm.simhash import op2_simhash
from sluice.llm.toxicity import op7_crf_toxicity
from sluice.llm.urls import op5_path_templates

Query = Callable[[SparkSession, str], DataFrame]


_ALL = (op1_byte_bpe, op2_simhash, op3_media_chunks, op4_weak_supervision, op5_path_templates, op6_collision_counting, op7_crf_toxicity, op8_sum_of_squares_packing, op9_kneser_ney, op10_id_shards)


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL} | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    return {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
