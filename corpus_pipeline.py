"""Corpus pipeline: raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written to the shared folder and read again as the next stage's ``docs``.  All
but the last return the columns of documents.

Defined cases, for every stage: further columns are kept as they are, also with
names the operators use themselves (the last stage has its own columns); a null
source is a host of its own, a null lang is not learned from, a null id is an id
like any other; equal rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import langid, quality, queries, simhash, templates
from quarry.session import cut_lineage

ORACLE_SQL = None  # byte hashes, a fitted model, a tokenizer and a packing search; tests/llm has the brute-force version


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their lines that are common on their host.

    A null, empty or short text (under 20 words) fails the rules.
    """
    return quality.clean(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one or more known languages; text that they do not explain goes.

    A text without letters goes; codes and numbers are no evidence against a
    text.  Where no row has a language, all rows stay.
    """
    return langid.confident(docs, 0.4)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates; a text may become empty, a null text stays null."""
    return templates.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every SimHash component: 4-word shingles, 4 differing bits.

    The smallest id stays, of equal rows one; texts without a word are alike.
    """
    return simhash.one_of_each(docs, 4, 4)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their place in sequences of 1024 tokens; a null text is one end id, equal rows are pieces of their own."""
    return queries.pack_digests(docs)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("line_dedup", line_dedup),
          ("near_dedup", near_dedup), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
