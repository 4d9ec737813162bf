"""The corpus pipeline: five operators of leafmill.llm over ``documents``, each stage's rows feeding the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import bpe, decontam, linededup, quality_rules, simhash
from leafmill.llm.common import materialize, table
from leafmill.llm.queries import vocabulary_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the likelihood ratio reject go."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    ratios = quality_rules.fit_ratio(docs, trusted)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    scored = quality_rules.score_rules(docs.select(row, "doc_id", "text"), ratios, lowest=float("-inf"))
    # Written without what the base rules reject, so that texts are scored once.
    scored = materialize(scored.where("kept").select("row", "doc_id", "base_failed", "mean_ratio"), "scored")
    return quality_rules.judge(scored, quality_rules.fit_lowest(scored, trusted)).where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks shared with an earlier document are deleted; a document that had nothing else goes."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    cut = linededup.delete_repeats(row, counts=True).where("n_cut = 0 or trim(text) <> ''")
    fields = [F.col("text") if c.lower() == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c.lower() == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return cut.select(*fields)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document of the smallest id stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, text, n_tokens, ids, decoded): the documents' token ids and what they decode to, one row for each."""
    path = vocabulary_path()
    return bpe.encode_documents(docs.select("doc_id", "text"), path, bpe.build_lexicon(docs, path))


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: The near-duplicate and decontamination stages cannot be said in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over ``documents``; each stage before it is written and read again.

    Null and empty texts fail the first stage's rules, so they go there. No documents, or none that a
    stage keeps, give no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
