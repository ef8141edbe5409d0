"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dailybars.llm import byte_gru, chosen_path, context_tree, diagonal_licenses, imatch, markov_secrets, personal_data, phrase_graph, qgram_decontam, slot_negatives, source_mix, subword_bag, suffix_dedup


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_context_tree(spark, sf_dir):
    return context_tree.score(documents(spark, sf_dir))


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op3_subword_toxicity(spark, sf_dir):
    return subword_bag.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_source_mix(spark, sf_dir):
    return source_mix.mix_sources(documents(spark, sf_dir))


def op5_markov_secrets(spark, sf_dir):
    return markov_secrets.scan(documents(spark, sf_dir))


def op6_qgram_decontam(spark, sf_dir):
    return qgram_decontam.passages(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_personal_data(spark, sf_dir):
    return personal_data.report(documents(spark, sf_dir))


def op8_diagonal_licenses(spark, sf_dir):
    return diagonal_licenses.scan(documents(spark, sf_dir))


def op9_chosen_path(spark, sf_dir):
    return chosen_path.join(documents(spark, sf_dir))


def op10_imatch(spark, sf_dir):
    return imatch.fingerprints(documents(spark, sf_dir))


def op11_slot_negatives(spark, sf_dir):
    return slot_negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_byte_gru(spark, sf_dir):
    return byte_gru.languages(documents(spark, sf_dir))


def op13_phrase_graph(spark, sf_dir):
    return phrase_graph.collocations(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_context_tree, op2_suffix_dedup, op3_subword_toxicity, op4_source_mix, op5_markov_secrets, op6_qgram_decontam, op7_personal_data,
    op8_diagonal_licenses, op9_chosen_path, op10_imatch, op11_slot_negatives, op12_byte_gru, op13_phrase_graph)}
SQL = {"op4_source_mix": source_mix.SQL, "op9_chosen_path": chosen_path.SQL, "op10_imatch": imatch.SQL,
       "op11_slot_negatives": slot_negatives.SQL, "op13_phrase_graph": phrase_graph.SQL}
