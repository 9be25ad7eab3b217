"""A corpus pipeline: toxic documents go, near-duplicates go, sources are mixed, and the rest is encoded."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posequarry.llm import mixing, pieces, shingles, toxicity
from posequarry.llm.common import arrow_batches, fresh, located, lower_batches, marks, saved, scratch, selected, table
from posequarry.llm.queries import tokenizer_path

TOXIC = 0.7
# No document is taken more often than this.
CAP = 2.0
ORACLE_SQL = None
# Earlier stages leave less memory to the last one than it has alone.
KEPT_WORDS = 100_000
# Texts that the first and the last stage hand to Python at a time, with as many results held on both sides.
BATCH = 500


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; the classifier learns from ``labels`` outside the held-out fold."""
    with scratch(spark):
        model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    lower_batches(spark, BATCH)
    return docs.filter(toxicity.score(F.col("text"), model) < TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id, of each component of documents that share 0.8 of their five-word shingles.

    op10's links of fingerprints come first and are checked exactly; its four bits miss most such pairs, so the
    pairs that share a prefix of their shingles follow.
    """
    rows, ids = located(docs)
    with scratch(spark) as kept:
        groups = shingles.near_duplicates(rows, ids)
        firsts = kept(groups.filter("first").select(*ids), "first-rows")
    return selected(rows, ids, marks(firsts, ids)).drop(*ids)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows, ids = located(docs)
    with scratch(spark) as kept:
        copies = kept(mixing.mix(rows, cap=CAP, carry=ids).select(*ids, "copies"), "copies")
    # The n-th copies of all documents that have as many, for each n that the cap allows.
    parts = [selected(rows, ids, marks(copies.filter(F.col("copies") >= n), ids)) for n in range(1, math.ceil(CAP) + 1)]
    return reduce(DataFrame.unionAll, parts).drop(*ids)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their best segmentation into pieces, and figures of the three best."""
    lower_batches(spark, BATCH)
    (result,) = fresh(docs, "_pieces")
    column = pieces.segment(F.col("text"), tokenizer_path("piece_bpe_32k.model"), n=3, kept_words=KEPT_WORDS)
    names = fresh(docs, "ids", "n_ids", "scores", "n_best_sha256", "decoded_sha256", "lossless")
    fields = ("ids", "n_ids", "scores", "n_best_sha256", "decoded_sha256", "lossless")
    return docs.withColumn(result, column).select(
        *[c for c in docs.columns if c != "text"], *[F.col(f"{result}.{f}").alias(n) for f, n in zip(fields, names)]
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    # Stages lower it; here it is set back at the end, when all results are written.
    with arrow_batches(spark, BATCH):
        for name, stage in STAGES:
            docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
