"""A corpus pipeline: language ID, exact dedup, SimHash near-dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage but the last returns the columns
of ``documents``. ``run`` writes each stage's result to the shared folder and reads it for the next.

Odd rows, in every stage: a null text counts as empty; columns of any name pass through; an empty table gives
an empty table; texts of any length are read whole. Rows with a null doc_id stay where ids decide (near duplicates) and
are told apart by their text where copies do (exact duplicates).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave.llm import language
from tomeweave.llm._session import materialize
from tomeweave.llm.exact_dedup import drop_exact
from tomeweave.llm.mixing import mix
from tomeweave.llm.packing import pack
from tomeweave.llm.similar import keep_one_similar

#: A document is rejected if no language can be told (null text, no letter) or the best share is below this.
LEAST_SCORE = 0.3
#: No source is repeated more often than this; every document stays in at least once.
MOST_REPEATED, TARGET_ENTROPY = 2.0, 0.95


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the model, fitted on their labelled rows, can tell; null, empty and letterless texts go.

    Without labelled rows no language can be told and all go. Repeated rows go or stay together.
    """
    found = language.predict(docs, language.fit(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the row with the largest doc_id; of repeated rows of it, one."""
    return drop_exact(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 or more (5-word shingles) keep the row with the smallest doc_id.

    Texts without words are alike. Repeated rows of the staying doc_id stay.
    """
    return keep_one_similar(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Flatten the sources; a row for each reading, so small sources' documents come up to MOST_REPEATED times.

    A null source is one of its own; sources without tokens are read once.
    """
    return mix(docs, target_entropy=TARGET_ENTROPY, max_repetition=MOST_REPEATED).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every document's tokens in sequences of 4096; an empty text is its end id alone, repeated rows are packed each."""
    return pack(docs)


STAGES = [
    ("language", identify_language),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Kernel regression, XXH64 fingerprints and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
