"""A corpus pipeline of five stages; each stage takes the rows its predecessor kept, written as Parquet and read again.

`run` gives the pieces of the packed documents. Stages but the last return the columns of documents, further ones included, whatever
their names are. Empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import langid, near, packing, pii, toxicity
from sluice.llm._common import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7 for toxicity. A null text counts as empty; rows that repeat an id or a text are judged alike."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the corpus's languages. Null texts and texts without a letter are in none, and go."""
    return langid.keep_known(docs, langid.learn(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies: texts of which 0.8 of the five-word shingles agree, and all they
    reach. Candidates are SimHash fingerprints within 3 bits by the Gray-order index, and, since texts of similarity 0.8 differ in about 10
    bits, MinHash keys; whole sets decide. Of equal ids one row stays, null ids come last."""
    return near.deduplicate(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind. Null texts stay null."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens. A null text is one token, the end."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near copies", drop_near_copies),
    ("personal data", redact_personal_data),
    ("packing", pack_sequences),
]

#: Fingerprints, models and tokenizers are beyond SQL: a test holds the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
