"""Document fingerprints: weighted SimHash and the search by permuted block tables.

Terms are runs of ``k`` words (A-Z lowered); each occurrence is one vote, so a
term weighs its frequency.  A term's hash gives ``64 * lanes`` signed votes and
a bit is set when its votes sum above zero.  Likeness is the share of equal
bits.

``search`` finds every stored fingerprint within ``radius`` bits of a query:
``radius + 1`` tables, each permuted to bring one block of bits in front, must
agree on at least one whole block; candidates of a block are compared in full
and a pair counts in the first block on which it agrees.

Defined cases: a null text is empty; a text without words has fingerprint
zero; a text of fewer than ``k`` words is one term; equal texts have equal
fingerprints.  The next document of a repeated doc_id is the next row in the
order (doc_id, text hash); a null doc_id comes first; a single row follows
itself; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import cut_lineage

from . import flat
from .common import needed

LANES = 4
_LANE_SEED = [np.uint64(0x9E3779B97F4A7C15 * (n + 1) % 2**64) for n in range(16)]


def term_hashes(buf: np.ndarray, off: np.ndarray, k: int):
    """Hashes of the k-word terms of every document and their offsets."""
    low = flat.LOWER[buf]
    ws, we, woff = flat.words_of(low, off)
    wh = flat.hash_pieces(low, ws, we)
    win, at = flat.window_hash(wh, woff, k)
    n = np.diff(woff)
    few = np.flatnonzero((n > 0) & (n < k))
    h = np.concatenate([win, flat.run_hash(wh, woff[few], woff[few + 1])])
    doc = np.concatenate([flat.doc_of(woff)[at], few])
    if len(few):
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    return h, np.searchsorted(doc, np.arange(len(off)))


def simhash(buf: np.ndarray, off: np.ndarray, k: int = 3, lanes: int = LANES) -> np.ndarray:
    """[n, lanes] 64-bit words of the fingerprints."""
    h, t_off = term_hashes(buf, off, k)
    out = np.zeros((len(off) - 1, lanes), np.uint64)
    for n in range(lanes):
        votes = 2 * flat.bit_votes(flat.mix(h ^ _LANE_SEED[n]), t_off) - np.diff(t_off)[:, None]
        out[:, n] = np.packbits(votes > 0, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - np.bitwise_count(a ^ b).sum(axis=1) / (64.0 * a.shape[1])


def hex_of(fp: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(fp[:, ::-1]).astype(">u8").tobytes()
    size = 8 * fp.shape[1]
    return pa.array([raw[i:i + size].hex() for i in range(0, len(raw), size)], pa.string())


def edited_texts(buf: np.ndarray, off: np.ndarray):
    """For documents 0..n-2: text with its last floor(chars / 2) code points replaced by the next document's first ones; and chars of all."""
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    lead_off = np.searchsorted(lead, off)
    chars = np.diff(lead_off)
    ends = np.append(lead, len(buf))
    half = chars[:-1] // 2
    cut = ends[lead_off[:-2] + chars[:-1] - half]
    head = ends[lead_off[1:-1] + np.minimum(half, chars[1:])]
    raw = buf.tobytes()
    parts = [raw[a:b] + raw[c:d] for a, b, c, d in zip(off[:-2].tolist(), cut.tolist(), off[1:-1].tolist(), head.tolist())]
    new_off = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)), out=new_off[1:])
    return np.frombuffer(b"".join(parts), np.uint8), new_off, chars


SCHEMA = ("doc_id bigint, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, part int, head string, tail string")


def _rows(ids, buf, off, k, lanes, part, head=None, tail=None):
    """Arrow rows of all documents but the last, whose text is only the next one of the last row."""
    fps = simhash(buf, off, k, lanes)
    e_buf, e_off, chars = edited_texts(buf, off)
    e_fp = simhash(e_buf, e_off, k, lanes)
    n = len(off) - 2
    none = pa.nulls(n, pa.string())
    return pa.RecordBatch.from_arrays([
        pa.array(ids[:n], pa.int64()), pa.array(chars[:n].astype(np.int64)), flat.binary_array(e_buf, e_off).cast(pa.string()),
        hex_of(fps[:n]), hex_of(e_fp), pa.array(likeness(fps[:n], e_fp)), pa.array(likeness(fps[:n], fps[1:])),
        pa.array(np.full(n, part, np.int32)), none, none], names=[c.split()[0] for c in SCHEMA.split(", ")])


def _mark(part, doc_id=None, head=None, tail=None):
    row = {"doc_id": doc_id, "part": part, "head": head, "tail": tail}
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([row.get(n)], kinds[c.split()[1]]) for n, c in zip(names, SCHEMA.split(", "))], names=names)


def edited_fingerprints(docs: DataFrame, k: int = 3, lanes: int = LANES) -> DataFrame:
    """doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Rows are range-partitioned and sorted by (doc_id, text hash) and streamed
    with one row of look-ahead.  The last row of each partition waits for the
    first text of the next non-empty one; those, two texts per partition, are
    joined afterwards.
    """
    d = needed(docs, "doc_id", "text").withColumn("tie", F.xxhash64("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches):
        from pyspark import TaskContext
        part, held = TaskContext.get().partitionId(), None
        for b in batches:
            ids_all = b.column("doc_id").to_pylist()
            buf, off = flat.texts_of(b.column("text"))
            for i, j in flat.spans(off):
                ids, run_buf, run_off = ids_all[i:j], buf[off[i]:off[j]], off[i:j + 1] - off[i]
                if held is None:
                    yield _mark(part, head=run_buf[:run_off[1]].tobytes().decode())
                else:
                    ids, run_buf = [held[0], *ids], np.concatenate([held[1], run_buf])
                    run_off = np.concatenate([[0], run_off + len(held[1])])
                if len(ids) > 1:
                    yield _rows(ids, run_buf, run_off, k, lanes, part)
                held = ids[-1], run_buf[run_off[-2]:].copy()
        if held is not None:
            yield _mark(part, doc_id=held[0], tail=held[1].tobytes().decode())

    t = cut_lineage(d.mapInArrow(run, SCHEMA).withColumn("edited_sha", F.sha2("edited", 256)).drop("edited"))
    heads = sorted(r.part for r in t.where("head is not null").select("part").collect())     # one number per partition
    if not heads:
        return t.drop("part", "head", "tail")
    order = t.sparkSession.createDataFrame(list(zip(heads, heads[1:] + heads[:1])), "part int, follows int")
    nxt = t.where("head is not null").select(F.col("part").alias("follows"), F.col("head").alias("next_head"))
    open_ = t.where("tail is not null").select("part", "doc_id", "tail").join(order, "part").join(nxt, "follows")

    def finish(batches):
        for b in batches:
            for doc_id, tail, head in zip(b.column("doc_id").to_pylist(), b.column("tail").to_pylist(), b.column("next_head").to_pylist()):
                buf, off = flat.texts_of(pa.array([tail, head], pa.string()))
                yield _rows([doc_id, None], buf, off, k, lanes, 0)

    ends = open_.select("doc_id", "tail", "next_head").mapInArrow(finish, SCHEMA).withColumn("edited_sha", F.sha2("edited", 256))
    cols = ["doc_id", "n_chars", "edited_sha", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return t.where("head is null and tail is null").select(*cols).unionByName(ends.select(*cols))


# ---- permuted block tables -------------------------------------------------

def _blocks(words: np.ndarray, radius: int) -> np.ndarray:
    """[n, radius + 1] block values; the bits of a fingerprint dealt into radius + 1 blocks of near-equal width."""
    bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
    edges = [bits.shape[1] * b // (radius + 1) for b in range(radius + 2)]
    out = np.empty((len(words), radius + 1), np.uint64)
    for b, (lo, hi) in enumerate(zip(edges, edges[1:])):
        packed = np.packbits(bits[:, lo:hi], axis=1, bitorder="little")
        h = np.full(len(words), b + 1, np.uint64)
        for c in range(packed.shape[1]):
            h = flat.mix(h ^ packed[:, c])
        out[:, b] = h
    return out


def _words(hexes) -> np.ndarray:
    raw = b"".join(bytes.fromhex(h) for h in hexes)
    n = len(hexes)
    return np.ascontiguousarray(np.frombuffer(raw, ">u8").reshape(n, -1)[:, ::-1].astype(np.uint64)) if n else np.zeros((0, 1), np.uint64)


def search(queries: DataFrame, stored: DataFrame, radius: int, salts: int = 8) -> DataFrame:
    """fingerprint, n_near: for every distinct query fingerprint, the stored rows within ``radius`` bits.

    Both sides have a ``fingerprint`` column; stored rows collapse to distinct
    fingerprints with counts first.  Only stored fingerprints with a block
    value that a query asks for are dealt out; those of one block value are
    salted over ``salts`` groups and the queries repeated for each, so a hot
    block is shared out.  A group holds many block values and returns counts,
    never pairs.
    """
    s = stored.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))
    q = queries.select("fingerprint").distinct()
    groups = 4 * int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def keys(batches):
        for b in batches:
            hexes = b.column("fingerprint").to_pylist()
            blocks = _blocks(_words(hexes), radius) if hexes else np.zeros((0, radius + 1), np.uint64)
            off = np.arange(len(hexes) + 1) * (radius + 1)
            yield pa.RecordBatch.from_arrays([*b.columns, flat.list_array(pa.array(blocks.ravel().view(np.int64)), off)],
                                             names=[*b.schema.names, "blocks"])

    group = F.pmod(F.xxhash64("b", "v"), F.lit(groups)).alias("g")
    s = (s.mapInArrow(keys, "fingerprint string, n bigint, blocks array<bigint>").select("fingerprint", "n", F.posexplode("blocks").alias("b", "v"))
         .select("*", group, F.pmod(F.xxhash64("fingerprint"), F.lit(salts)).alias("salt")))
    q = (q.mapInArrow(keys, "fingerprint string, blocks array<bigint>").select("fingerprint", F.posexplode("blocks").alias("b", "v")).select("*", group))
    live = s.join(q.select("b", "v").distinct(), ["b", "v"], "left_semi")
    asked = q.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt"))

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(len(left), np.int64)
        if len(left) and len(right):
            right = right.sort_values(["b", "v"], kind="stable")
            a, c = _words(left["fingerprint"].tolist()), _words(right["fingerprint"].tolist())
            ka, kc, n = _blocks(a, radius), _blocks(c, radius), right["n"].to_numpy()
            place = pd.MultiIndex.from_frame(right[["b", "v"]])
            first = dict(zip(place[::-1], range(len(right) - 1, -1, -1)))       # first and last row of every block value
            last = dict(zip(place, range(len(right))))
            for i, key in enumerate(zip(left["b"].tolist(), left["v"].tolist())):
                if key in first:
                    x, y, b = first[key], last[key] + 1, key[0]
                    ok = np.bitwise_count(c[x:y] ^ a[i]).sum(axis=1) <= radius
                    ok &= ~(kc[x:y, :b] == ka[i, :b]).any(axis=1)               # counted in an earlier block
                    out[i] = n[x:y][ok].sum()
        return pd.DataFrame({"fingerprint": left["fingerprint"], "n": out})

    parts = asked.groupBy("g", "salt").cogroup(live.groupBy("g", "salt")).applyInPandas(count, "fingerprint string, n bigint")
    return parts.groupBy("fingerprint").agg(F.sum("n").alias("n_near"))
