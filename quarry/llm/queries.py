"""The operators of this subpackage bound to the test tables: one query per operator, over whole tables and whole texts.

Phrase mining and suffix dedup have a SQL twin (``oracles``).  The results of the
others come from 64-bit byte hashes, fitted models, tokenizers or a search;
``tests/llm`` holds them against brute-force versions instead.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import cut_lineage

from . import fingerprint, htmltext, langid, maxent, oracles, packing, phrases, pieces, qda, quality, repair, simhash, suffixes, templates
from .common import crc_fold, needed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


@query
def op1_language_mixture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    langs, probs = langid.fit(langid.learned_fold(needed(docs, "doc_id", "text", "lang")))
    return langid.predict(needed(docs, "doc_id", "text"), langs, probs).select(
        "doc_id", (crc_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "languages", "proportions")


@query
def op2_maxent_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = maxent.score(docs, docs.where(~maxent.held_out(F.col("doc_id"))))
    return out.withColumn("held_out", maxent.held_out(F.col("doc_id"))).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op3_main_text(spark, sf_dir):
    return htmltext.extract(table(spark, sf_dir, "pages"))


@query
def op4_pieces(spark, sf_dir):
    out = pieces.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op5_quality_rules(spark, sf_dir):
    return quality.line_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left")


@query
def op6_line_templates(spark, sf_dir):
    return templates.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chars")


@query
def op7_simhash_components(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query
def op8_fingerprints(spark, sf_dir):
    """The fingerprints, and for every document whose id is divisible by 100 how many documents lie within 3 bits (n_near)."""
    t = cut_lineage(fingerprint.edited_fingerprints(table(spark, sf_dir, "documents")))
    asked = F.coalesce(F.col("doc_id") % 100 == 0, F.lit(False))
    near = fingerprint.search(t.where(asked), t, 3)
    cols = ["doc_id", "n_chars", F.col("edited_sha").alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    rest = t.where(~asked).select(*cols, F.lit(None).cast("bigint").alias("n_near"))
    return t.where(asked).join(near, "fingerprint").select(*cols, "n_near").unionByName(rest)


@query
def op9_quality_qda(spark, sf_dir):
    rows = cut_lineage(qda.features(table(spark, sf_dir, "documents")))
    model = qda.fit(qda.labelled(rows, table(spark, sf_dir, "labels")))
    return qda.score(rows, model).select(
        "doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@query
def op10_packing(spark, sf_dir):
    return pack_digests(table(spark, sf_dir, "documents"))


@query
def op11_phrases(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"), least=10, share=50, top=2000)


@query
def op12_conversation_repair(spark, sf_dir):
    rows = repair.conversations(table(spark, sf_dir, "conversations"))
    return repair.repair(rows, repair.damage(rows))


@query
def op13_suffix_dedup(spark, sf_dir):
    out = suffixes.cut_repeats(table(spark, sf_dir, "documents"), 50)
    removed = F.aggregate(F.zip_with("ends", "starts", lambda z, a: z - a), F.lit(0).cast("bigint"), lambda x, y: x + y)
    return out.select("doc_id", (F.octet_length("kept") + removed).cast("bigint").alias("n_bytes"), removed.alias("n_removed"),
                      F.size("starts").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLES |= {"op11_phrases": oracles.PHRASES, "op13_suffix_dedup": oracles.SUFFIXES}


def pack_digests(docs: DataFrame) -> DataFrame:
    """Places of all pieces, with the crc32 of each piece's ids instead of the ids."""
    parts = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.place(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
