"""From raw documents to token ids: five stages, each one operator over all that is left.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of ``documents``. ``run`` writes each stage as Parquet in the shared folder and reads it
again, so a lost executor costs no more than the stage in progress.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fumarole.llm.byte_bpe import encoded
from fumarole.llm.decontamination import without_leaks
from fumarole.llm.quality_rules import repetition_rules
from fumarole.llm.simhash import one_of_each
from fumarole.llm.substrings import cut_repeats
from fumarole.session import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def hidden(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table under names that no operator uses, and those names by the table's own."""
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    rows, names = hidden(docs)
    kept = repetition_rules(rows, names["text"]).where("kept")
    return kept.select(*names.values()).toDF(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest id, of each group of near-duplicates."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that occur twice."""
    rows, names = hidden(docs)
    text = names["text"]
    cut = cut_repeats(rows, text, names["doc_id"])
    cut = cut.withColumn(text, F.when(F.col(text).isNotNull(), F.col("kept_text")))
    cut = cut.withColumn(names["n_chars"], F.char_length(text).cast("long"))
    return cut.select(*names.values()).toDF(*names)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, with their digests in place of the text."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encoded(docs, path, public_tokenizers.PATTERN).drop("text")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", byte_bpe),
]

#: Rolling hashes, fingerprints and edit distances are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
