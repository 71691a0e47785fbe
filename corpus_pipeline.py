"""From raw documents to packed training sequences.

Each stage gets the documents that the one before it kept, as that stage left them, and learns
what it learns from those alone (and from ``labels``, for toxicity).

Of every stage: a null or empty text is a text without words, neither good nor toxic beyond what
the classes' shares say, and stays null; very long texts are read whole; rows with null or repeated
ids, and repeated rows, are rows of their own, but near-duplicates keeps one of repeated rows
with an id; columns beside those of ``documents`` go along, whatever their names, until packing;
an empty table stays empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framelode.llm import pii, quality, toxicity
from framelode.llm.common import discard, shared_dir, ship, table, written
from framelode.llm.encoding import tokenizer_path
from framelode.llm.packing import pack
from framelode.llm.simhash import without_near_duplicates


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer finds good."""
    weights, _ = quality.fit(docs)
    return quality.good_only(docs, weights)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7; two thirds of the labels are learnt from, as in the query."""
    rows = written(toxicity.training_rows(docs, table(spark, sf_dir, "labels"), toxicity.learnt_fold()))
    model = toxicity.fit(rows)
    discard(rows)
    return toxicity.without_toxic(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more), the smallest id."""
    return without_near_duplicates(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the kind's name."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 ids, alike documents together."""
    ship(spark)
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), cut="ranks").drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each),
    ("personal_data", redacted),
    ("packing", packed),
]
#: Trained scores, fingerprints and tokenizers are not SQL; tests compare with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        ship(spark)
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
