"""The registered queries of this subpackage, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import ann, bpe, curriculum, hmm, hostrules, langid, minhash, ordinal, tokenstore, toxicity
from folioflow.llm.common import Workspace, held_out, read_table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of ``documents``: 3-word shingles, similarity of 0.85 or more."""
    plan = minhash.Plan(width=3, percent=85)
    groups = minhash.near_groups(read_table(spark, sf_dir, "documents"), Workspace(spark, "op1"), plan)
    return groups.withColumnRenamed("id", "doc_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of ``documents``, learned from the labels of the ids that aren't held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1))
    lexicon = toxicity.learn(docs, labels, Workspace(spark, "op2"))
    return toxicity.measure(docs, lexicon).select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "n_words", "n_hits",
    )


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes ``documents`` into a content-addressed store, and tells what its files hold."""
    ws = Workspace(spark, "op3")
    paths = tokenstore.write_store(read_table(spark, sf_dir, "documents"), ws, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenstore.read_checks(spark, paths).select("doc_id", "start", "n_tokens", "ids_crc32", "verified")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of ``documents``, learned from the texts and languages of the ids that aren't held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out("doc_id", 5, 0)
    model = langid.learn(docs.where(~out), Workspace(spark, "op4"))
    return langid.predict(docs.select("doc_id", "text", out.alias("held_out")), model).drop("text")


def op5_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found in ``embeddings`` of each row whose id is divisible by 50."""
    return ann.search(read_table(spark, sf_dir, "embeddings"), Workspace(spark, "op5"))


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of ``documents``, learned from the ratings of the ids that aren't held out (crc32 modulo 5 is not 0)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out("doc_id", 5, 0)
    model = ordinal.learn(docs, read_table(spark, sf_dir, "labels").where(~out), Workspace(spark, "op6"))
    return ordinal.grade(docs.withColumn("held_out", out), model).drop("text")


def op7_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood of ``documents``, from the texts whose crc32 modulo 7 is not 2."""
    ws = Workspace(spark, "op7")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out("doc_id", 7, 2))
    texts = docs.where("not held_out").select("text")
    counts = hmm.count_words(texts, ws)
    model = hmm.train(texts, counts, ws)
    return hmm.score(docs, counts, model, ws, ["doc_id", "held_out"])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``: weights 5, 2, 1 in turn, no source above 3 times its size."""
    ws = Workspace(spark, "op8")
    mixed = ws.save(curriculum.curriculum_mix(read_table(spark, sf_dir, "documents"), ws, keep=["doc_id"]), "mixed")
    return curriculum.with_places(mixed, ws).select("row.doc_id", "size", "source_size", "target", "taken", "position", "place")


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on ``documents``, and verdicts on their sources as hosts."""
    told = hostrules.host_rules(read_table(spark, sf_dir, "documents"), Workspace(spark, "op9"), F.col("source"), keep=["doc_id"])
    return told.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_docs", "host_failed",
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of ``documents``, and of what they decode to."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    told = bpe.encode(docs, path, pattern, decoded=True, keep=["doc_id"])
    return told.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_toxicity": op2_toxicity,
    "op3_token_store": op3_token_store,
    "op4_langid": op4_langid,
    "op5_learned_partitions": op5_learned_partitions,
    "op6_ordinal_quality": op6_ordinal_quality,
    "op7_hidden_markov": op7_hidden_markov,
    "op8_mixing": op8_mixing,
    "op9_host_rules": op9_host_rules,
    "op10_byte_bpe": op10_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {"op8_mixing": curriculum.MIX_SQL, "op9_host_rules": hostrules.RULES_SQL}
