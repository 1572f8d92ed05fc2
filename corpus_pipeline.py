"""The corpus pipeline: documents of low quality go, toxic ones go, one of each group of near
duplicates stays, sources are mixed to their weights, and what is left becomes token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the stage
before kept. Every stage but the last returns the columns of ``documents``.

Cases: null and empty texts are judged as what they are (quality and toxicity score them like any
other; they are copies of nothing; mixing gives them no words, and so no place); rows that repeat an
id are one document when copies go; rows without an id are kept or dropped by their text; an empty
table passes through; further columns pass the first four stages whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import bpe, curriculum, minhash, ordinal, toxicity
from folioflow.llm.common import Workspace, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose chance of the top grade is under one half."""
    model = ordinal.learn(docs, read_table(spark, sf_dir, "labels"), Workspace(spark, "quality"))
    return ordinal.grade(docs, model).where("selected").select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of 0.7 or more."""
    lexicon = toxicity.learn(docs, read_table(spark, sf_dir, "labels"), Workspace(spark, "toxic"))
    return toxicity.measure(docs, lexicon).where(F.col("score") < 0.7).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group (five-word shingles, similarity 0.8); ``minhash.without_copies`` has the cases."""
    return minhash.without_copies(docs, Workspace(spark, "near"), minhash.Plan(width=5, percent=80))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Weights 5, 2 and 1 in turn, at most 3 times a source: whole documents, repeated as due, in training order."""
    mixed = curriculum.curriculum_mix(docs, Workspace(spark, "mixing"), whole_documents=True)
    return curriculum.training_order(mixed).select("row.*").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its very bytes."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    told = bpe.encode(docs, path, pattern, exact=True, keep=["doc_id", "lang", "source"])
    return told.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "exact")


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxic),
    ("minhash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixing),
    ("byte-level BPE encoding and decoding", tokens),
]

#: Learned models and sketches have no SQL form; the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    ws = Workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
