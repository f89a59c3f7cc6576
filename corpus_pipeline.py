"""A corpus pipeline of five stages over `documents`; each works on all that the one before kept.

Stages take documents with any other columns, of any type and name, and all but the last give them back as they were. Null and
empty texts: language ID lets them go, the others take them. Texts of any length are read as a whole; rows that are equal are
judged one by one, but near_dedup keeps one of them. Null ids are no one's copy. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warcspark.llm import language_id, mixing, near_dedup, packing, toxicity
from warcspark.llm.common import column, drop_staged, fresh, staging_path, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text that costs more bits a byte than eight, in every language, is worse than noise.
MAX_BITS = 8.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without a letter, or without any likeness to one, go."""
    p = fresh(docs.columns)
    found = language_id.identify(docs, language_id.fit_documents(docs), keep=tuple(docs.columns), prefix=p)
    return found.where((F.col(p + "lang_pred") != language_id.UNDETERMINED) & (F.col(p + "bits_per_byte") <= MAX_BITS)).select(*map(column, docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't predict to be toxic."""
    model = toxicity.fit_documents(docs, table(spark, sf_dir, "labels"))
    p = fresh(docs.columns)
    return toxicity.score(docs, model, keep=tuple(docs.columns), prefix=p).where(F.col(p + "predicted") == 0).select(*map(column, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id.

    Rows that share an id but not their words are different documents; those with a null id are no one's copy and stay.
    """
    return near_dedup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words: whole passes, and once more if it takes half of it."""
    return mixing.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the training sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models, sketches and a tokenizer have no SQL; the tests hold each stage of run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    before = None
    for name, stage in STAGES:
        path = staging_path(spark, f"stage-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            drop_staged(spark, before)
        before = path
    return docs
