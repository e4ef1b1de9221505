"""Quality rules: per-document base rules and cross-document line frequency.

Every line is hashed after normalisation; per host the distinct documents of
each line are counted; lines in more than ``max_docs`` documents of one host
are removed there; a document that fails a base rule, or that keeps less than
``min_left`` of its words, is rejected.

Defined cases: a null text is empty (no words, fails the base rule); a null
source is a host of its own; repeated rows each get a row with the same
verdict and count as one document; an empty table gives no rows; columns
beyond those used are ignored by ``line_rules`` and kept by ``clean``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import cut_lineage

from . import flat
from .lines import distinct_in_doc, keyed, map_documents, normal_lines, remove_hashed

WINDOW = 8                                   # words of a repeated window
MIN_WORDS, MAX_REPEAT_PCT = 20, 30           # base rules
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def base_counts(buf, off):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every document."""
    ws, we, woff = flat.words_of(buf, off)
    n_words = np.diff(woff)
    if not len(buf):
        return n_words, n_words, n_words, n_words, n_words
    chars = flat.per_doc(((buf & 0xC0) != 0x80) & ~flat._SPACE[buf], off)
    symbols = flat.per_doc(_SYMBOL[buf], off)
    ls, le, loff = flat.lines_of(buf, off)
    has = np.searchsorted(ws, le) > np.searchsorted(ws, ls)
    doc = flat.doc_of(loff)[has]
    lh = flat.hash_pieces(buf, ls[has], le[has])
    pick, _ = distinct_in_doc(doc, lh)
    n = len(off) - 1
    dup = np.bincount(doc, minlength=n) - np.bincount(doc[pick], minlength=n)
    wh = flat.hash_pieces(buf, ws, we)
    win, at = flat.window_hash(wh, woff, WINDOW)
    word_doc = flat.doc_of(woff)
    win = flat.mix(win ^ flat.mix(word_doc[at].astype(np.uint64) + np.uint64(1)))
    s = np.sort(win)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    rep = np.zeros(n, np.int64)
    if len(twice):
        sieve = np.zeros(1 << 16, bool)
        sieve[twice & np.uint64(0xFFFF)] = True
        near = np.flatnonzero(sieve[win & np.uint64(0xFFFF)])
        hit = at[near[np.isin(win[near], twice)]]
        step = np.zeros(len(wh) + 1, np.int64)
        np.add.at(step, hit, 1)
        np.add.at(step, hit + WINDOW, -1)
        rep = flat.per_doc(np.cumsum(step[:-1]) > 0, woff)
    return n_words, chars, symbols, dup, rep


def _per_run(buf, off):
    n = len(off) - 1
    base = base_counts(buf, off)
    doc, number, h, words, *_ = normal_lines(buf, off)
    pick, which = distinct_in_doc(doc, h)
    order = np.argsort(doc[pick], kind="stable")
    pick = pick[order]
    total = np.bincount(which, weights=words, minlength=len(pick)).astype(np.int64)[order]
    l_off = np.searchsorted(doc[pick], np.arange(n + 1))
    cols = [pa.array(x.astype(np.int64)) for x in base]
    item = pa.StructArray.from_arrays([pa.array(h[pick].view(np.int64)), pa.array(total)], names=["h", "words"])
    return [*cols, flat.list_array(item, l_off)]


LINE_SCHEMA = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
               "`lines` array<struct<h:bigint,words:bigint>>")


def line_rules(docs: DataFrame, max_docs: int = 100, min_left: float = 0.3) -> DataFrame:
    """One row per document row: doc_id, key, the base counts, words_left, common array<bigint>, base_failed, kept.

    ``common`` lists the hashes of the document's lines that are above the
    limit of its host (null: none).
    """
    t = cut_lineage(map_documents(keyed(docs), LINE_SCHEMA, _per_run))
    lines = t.select("row", "source", "key", F.explode("lines").alias("l")).select("row", "source", "key", "l.h", "l.words")
    frequent = (lines.groupBy("source", "h", "key").agg(F.lit(1).alias("one"))        # copies of a document count once
                .groupBy("source", "h").agg(F.count("one").alias("n")).where(F.col("n") > max_docs)
                .select(F.col("source").alias("host"), F.col("h").alias("hot")))
    frequent = cut_lineage(frequent)
    lost = (lines.join(frequent, (F.col("h") == F.col("hot")) & F.col("source").eqNullSafe(F.col("host")), "left_semi")
            .groupBy("row").agg(F.sum("words").alias("lost"), F.collect_list("h").alias("common")))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    left = F.col("n_words") - F.coalesce(F.col("lost"), F.lit(0))
    return (t.drop("lines").join(lost, "row", "left")
            .withColumn("words_left", left).withColumn("base_failed", base_failed)
            .withColumn("kept", ~F.col("base_failed") & (left >= F.lit(min_left) * F.col("n_words")))
            .select("doc_id", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "words_left", "common", "base_failed", "kept"))


def clean(docs: DataFrame, max_docs: int = 100, min_left: float = 0.3) -> DataFrame:
    """The kept documents without their lines above the limit; all columns stay, n_chars follows the text."""
    v = cut_lineage(line_rules(docs, max_docs, min_left).where("kept").select("doc_id", "key", "common"))
    good = v.groupBy("doc_id", "key").agg(F.first("common").alias("common"))
    return remove_hashed(docs, good)
