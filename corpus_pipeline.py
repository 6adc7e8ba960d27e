"""From raw documents to token ids: classify, drop boilerplate lines, deduplicate, decontaminate, encode.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that its
predecessor kept; all but the last return the columns of ``documents``. Between
stages the rows are written to the shared folder and read again.

Defined results, for every stage: NULL and empty texts pass through all stages;
columns beyond those of ``documents`` are kept until the last stage; an empty
table gives an empty table. What each operator does with ties, repeated rows and
NULL ids is stated in its module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsalign.llm import kneser_ney, lines, minmax, pieces, seeds
from tsalign.llm.common import table
from tsalign.operators.durable import durable


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity the classifier rejects go."""
    return kneser_ney.drop_rejected(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from the texts; ``n_chars`` follows."""
    return lines.clean_pages(docs, sizes={"n_chars": F.length})


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minmax.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    return seeds.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, text, n_pieces, ids, score, alternatives``; the text is the one decoded from the ids."""
    rows = pieces.round_trip(docs)
    return rows.select("doc_id", F.col("decoded").alias("text"), "n_pieces", "ids", "score", "alternatives")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", encoding),
]

#: Kneser-Ney perplexities and lattice search have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
