"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import bpe, cnn, decontam, html_extract, linededup, maxent, quality_rules, sharding, simhash, token_files
from leafmill.llm.common import materialize, table

WORD_BPE = "word_bpe_49k.json"


def vocabulary_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's token ids and decoded text, as counts and digests."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path()
    lexicon = bpe.build_lexicon(docs, path)
    return bpe.encode_documents(docs, path, lexicon, digest=True).drop("text")


def op2_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's quality by the convolutional network."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = cnn.fit(*cnn.training_rows(docs, table(spark, sf_dir, "labels")))
    return cnn.score(docs, net)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place in token files that are written and read again."""
    docs = table(spark, sf_dir, "documents")
    path = token_files.write_tokens(token_files.encode_in_order(docs, vocabulary_path(), end_id=2))
    return token_files.token_digests(token_files.read_tokens(spark, path))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's counts and the verdict of the rules and the likelihood ratio."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    scored = materialize(quality_rules.score_rules(docs, quality_rules.fit_ratio(docs, trusted)).drop("text"), "scored")
    return quality_rules.judge(scored, quality_rules.fit_lowest(scored, trusted))


def op5_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document holds, a row for each."""
    return decontam.leak_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and the smallest id that it is linked to."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("key")


def op7_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's shard and place in it."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of deleted lines, and the length and digest of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.delete_repeats(docs, counts=True)
    return out.select("doc_id", "n_cut", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op9_consensus_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page."""
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op10_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's base score and log probability by the language model."""
    return maxent.score(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
