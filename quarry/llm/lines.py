"""Lines of documents as hashes, and the removal of flagged lines.

``map_documents`` reads every text once and gives one row per document, with
arrays over its distinct lines; ``remove_hashed`` rewrites the texts that lose
lines.  Both the quality rules and the template dedup work on that table,
which holds 64-bit hashes and never the texts.

A line's documents are counted by a hash of their whole text: exact copies
count as one document, all other carriers count each, however many lines they
share and also if they have no other line.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .common import content_key, free_name, needed

# Digits count as one symbol and A-Z as a-z when lines are compared.
NORMAL = flat.BYTE_HASH[flat.LOWER].copy()
NORMAL[48:58] = NORMAL[48]


def normal_lines(buf: np.ndarray, off: np.ndarray):
    """Lines with at least one word: (document, line number in it, hash of the normalised words, words, first word)."""
    ws, we, woff = flat.words_of(buf, off)
    wh = flat.hash_pieces(buf, ws, we, NORMAL)
    ls, le, loff = flat.lines_of(buf, off)
    first, last = np.searchsorted(ws, ls), np.searchsorted(ws, le)
    doc = flat.doc_of(loff)
    number = np.arange(len(ls)) - loff[:-1][doc] if len(ls) else np.zeros(0, np.int64)
    has = last > first
    return doc[has], number[has], flat.run_hash(wh, first[has], last[has]), (last - first)[has], first[has], wh, (ws, we, woff), (ls[has], le[has])


def distinct_in_doc(doc: np.ndarray, h: np.ndarray):
    """Index of the first line of every distinct (document, hash), in line order, and the distinct number of every line."""
    pick, number = flat.unique_pieces(flat.mix(h ^ flat.mix(doc.astype(np.uint64) + np.uint64(1))))
    return pick, number


def map_documents(docs: DataFrame, schema: str, per_run: Callable) -> DataFrame:
    """``per_run(buf, off, batch, i, j)`` -> Arrow columns for documents i..j of a batch; text is dropped, other columns stay."""
    keep = [c for c in docs.columns if c != "text"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    names = [c.split()[0].strip("`") for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            buf, off = flat.texts_of(b.column("text"))
            for i, j in flat.spans(off):
                cols = per_run(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                left = [b.column(c).slice(i, j - i) for c in keep]
                yield pa.RecordBatch.from_arrays([*left, *cols], names=[*keep, *names])

    return docs.mapInArrow(run, f"{fields}, {schema}" if fields else schema)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, source, key, row, text): key names the content, row this row."""
    return (needed(docs, "doc_id", "text", "source")
            .select("doc_id", "source", content_key().alias("key"), F.monotonically_increasing_id().alias("row"), "text"))


def remove_hashed(docs: DataFrame, verdicts: DataFrame, how: str = "inner") -> DataFrame:
    """Rows of ``docs`` without the lines whose hash is in ``common`` of their verdict(doc_id, key, common).

    ``how="inner"`` keeps the rows that have a verdict, ``"left"`` all rows.  A
    verdict without ``common`` leaves the text as it is, null included; n_chars
    follows a changed text; all columns stay.  Equal rows share one verdict.
    """
    mine, key, of, mark = (free_name(docs, x) for x in ("__key", "__k", "__id", "__common"))
    d = docs.select(*[F.col(f"`{c}`") for c in docs.columns], content_key().alias(mine))
    v = verdicts.select(F.col("doc_id").alias(of), F.col("key").alias(key), F.col("common").alias(mark))
    j = d.join(v, (F.col(mine) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(of)), how).drop(mine, of, key)

    def run(batches):
        for b in batches:
            at, counts = b.schema.get_field_index("text"), b.schema.get_field_index("n_chars")
            common, cols = b.column(b.schema.get_field_index(mark)), list(b.columns)
            new, chars = cols[at].to_pylist(), cols[counts].to_pylist() if counts >= 0 else None
            for r in np.flatnonzero(common.is_valid()):
                bad = np.array(common[int(r)].as_py(), np.int64).view(np.uint64)
                raw = np.frombuffer((new[r] or "").encode(), np.uint8)
                doc, number, h, *_ = normal_lines(raw, np.array([0, len(raw)]))
                lost = set(number[np.isin(h, bad)].tolist())
                new[r] = "\n".join(x for k, x in enumerate((new[r] or "").split("\n")) if k not in lost)
                if chars is not None:
                    chars[r] = len(new[r])
            cols[at] = pa.array(new, cols[at].type)
            if chars is not None:
                cols[counts] = pa.array(chars, cols[counts].type)
            names = [f.name for f in b.schema]
            keep = [k for k, x in enumerate(names) if x != mark]
            yield pa.RecordBatch.from_arrays([cols[k] for k in keep], names=[names[k] for k in keep])

    return j.mapInArrow(run, docs.schema)
