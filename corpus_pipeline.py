"""The corpus pipeline: language ID, near-duplicate removal, masking of personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``
as they come, and each works on everything its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplane.llm.common import materialize, table
from chronoplane.llm.language_id import REJECT_RATE, UNKNOWN, held_out, identify_languages, training_sample
from chronoplane.llm.near_dup import without_near_duplicates
from chronoplane.llm.packing import pack_documents
from chronoplane.llm.pii import find_pii, masked_text


def set_aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of these names renamed, and how to name them back: operators add columns with such names."""
    moved = {n: f"__own_{n}" for n in names if n in docs.columns}
    return docs.withColumnsRenamed(moved), {v: k for k, v in moved.items()}


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language learned from the labelled ones.

    Rejected: null texts, texts without a letter, and texts that need so many phrases per character that they are in
    none of the languages. ``lang`` is filled in where it is null. With no labelled document nothing is learned, and
    only texts without a letter are rejected.
    """
    sample = training_sample(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    own, back = set_aside(docs, ("lang_pred", "score", "rate"))
    judged = identify_languages(own, sample)
    kept = judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("rate") < REJECT_RATE)) if sample else judged.filter(F.col("text").rlike(r"\p{L}"))
    found = F.coalesce("lang", F.when(F.col("lang_pred") != UNKNOWN, F.col("lang_pred")))
    return kept.withColumn("lang", found).drop("lang_pred", "score", "rate").withColumnsRenamed(back).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (five words, 0.8): the one with the smallest id, once.

    Rows are told apart by id and text, so different texts under one id both stay. Documents without an id stay.
    """
    return without_near_duplicates(docs.filter("doc_id is not null")).unionByName(docs.filter("doc_id is null"))


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and secrets by their kind in brackets; ``n_chars`` follows the text."""
    own, back = set_aside(docs, ("pii_spans",))
    masked = masked_text(find_pii(own)).withColumnsRenamed(back)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of at most 2048 tokens: one row per piece."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("near_duplicates", deduplicate),
    ("pii", mask),
    ("packing", pack),
]

#: Cross-parsing and packing have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
