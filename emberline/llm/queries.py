"""Registered queries of the training-data operators, each over the whole table it is for."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from emberline.catalog import Catalog
from emberline.llm import bpe, decontaminate, jaccard, licenses, lines, mixing, negatives, pii, quality, repeats, scoring, search, sql, tokens
from emberline.llm.common import table

CATALOG = Catalog()


@CATALOG.add("op9_token_counts")
def op9_token_counts(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@CATALOG.add("op1_jaccard_join", sql.OP1)
def op1_jaccard_join(spark, sf_dir):
    return jaccard.similar_groups(table(spark, sf_dir, "documents"))


@CATALOG.add("op2_personal_data")
def op2_personal_data(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


@CATALOG.add("op3_decontaminate", sql.OP3)
def op3_decontaminate(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@CATALOG.add("op4_suffix_dedup")
def op4_suffix_dedup(spark, sf_dir):
    return repeats.repeat_report(table(spark, sf_dir, "documents"))


@CATALOG.add("op6_language_scores")
def op6_language_scores(spark, sf_dir):
    return scoring.language_scores(table(spark, sf_dir, "documents"))


@CATALOG.add("op8_quality_rules", sql.OP8)
def op8_quality_rules(spark, sf_dir):
    return lines.quality_rules(table(spark, sf_dir, "documents"))


@CATALOG.add("op5_mix_sources")
def op5_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@CATALOG.add("op7_quality_scores")
def op7_quality_scores(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@CATALOG.add("op10_license_scan", sql.OP10)
def op10_license_scan(spark, sf_dir):
    return licenses.license_scan(table(spark, sf_dir, "documents"))


@CATALOG.add("op11_byte_bpe")
def op11_byte_bpe(spark, sf_dir):
    """Digests of the ids, and of the bytes decoded from these ids."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, packed=True), path)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@CATALOG.add("op12_hard_negatives", sql.OP12)
def op12_hard_negatives(spark, sf_dir):
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", relabelled), F.col("vec_id") % 50 == 0)


@CATALOG.add("op13_lexical_search", sql.OP13)
def op13_lexical_search(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@CATALOG.add("pipeline")
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
