"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsalign.llm import chat, kneser_ney, licenses, lines, merkle, minmax, onebit, pieces, seeds, tagpaths, threshold, toxicity, webarchive
from tsalign.llm.common import table
from tsalign.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]


@query("op1_zip_warc", webarchive.oracle())
def op1_zip_warc(spark, sf_dir):
    return webarchive.round_trip(table(spark, sf_dir, "pages"))


@query("op2_onebit_neighbours")
def op2_onebit_neighbours(spark, sf_dir):
    return onebit.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


#: Fixed rows: a conversation whose texts hold the template's control strings.
_PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query("op3_license_digest", licenses.oracle())
def op3_license_digest(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_texts(spark))


@query("op4_minmax_dedup", minmax.oracle())
def op4_minmax_dedup(spark, sf_dir):
    return minmax.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_line_dedup", lines.oracle())
def op5_line_dedup(spark, sf_dir):
    out = lines.drop_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_dropped", "clean")


@query("op6_decontamination", seeds.oracle())
def op6_decontamination(spark, sf_dir):
    out = seeds.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumn("item_ids", F.array_join(F.col("item_ids").cast("array<string>"), ","))


@query("op7_kneser_ney_quality")
def op7_kneser_ney_quality(spark, sf_dir):
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_chat_format", chat.oracle(tuple(_PLANTED)))
def op8_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(_PLANTED, "conv_id bigint, turn bigint, role string, text string")
    return chat.digest(chat.expand(turns.unionByName(planted)))


@query("op9_tag_path_text")
def op9_tag_path_text(spark, sf_dir):
    return tagpaths.extract(table(spark, sf_dir, "pages"))


@query("op10_nbest_pieces")
def op10_nbest_pieces(spark, sf_dir):
    return pieces.round_trip(table(spark, sf_dir, "documents")).drop("decoded")


@query("op11_toxicity")
def op11_toxicity(spark, sf_dir):
    return toxicity.toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_merkle_manifest", merkle.oracle())
def op12_merkle_manifest(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))


@query("op13_threshold_negatives", threshold.oracle())
def op13_threshold_negatives(spark, sf_dir):
    return threshold.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=threshold.shifted_label())
