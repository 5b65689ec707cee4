"""The corpus pipeline: quality, exact and near copies, mixing, tokens. Each stage is written and read again by the next.

ORACLE_SQL is None: learned scores, min-max signatures and tokens have no SQL form; tests hold the stages against
brute-force versions.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup, min_max_dedup, mixing, piece_transducer, quality_mil
from ledgerloom.session import materialise

PIECE_MODEL = os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), "piece_bpe_32k.model")

ORACLE_SQL = None


def _documents(rows: DataFrame, like: DataFrame) -> DataFrame:
    return rows.select(*[rows[f"`{c}`"] for c in like.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    net = quality_mil.train(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))
    packed_docs = docs.select(docs["doc_id"], docs["text"], F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("own"))
    good = quality_mil.score(packed_docs, net).filter(F.col("predicted") == 1)
    return good.select("own.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _documents(exact_dedup.deduplicate(docs), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return _documents(min_max_dedup.deduplicate(docs), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for, in shuffled order."""
    return _documents(mixing.mix(docs, mixing.source_rates(docs)), docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their pieces."""
    return piece_transducer.encode(docs, PIECE_MODEL)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mix sources", mix_sources),
    ("encode pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
