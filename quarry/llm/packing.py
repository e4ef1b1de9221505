"""Best-fit packing with a swap-based local search.

Documents are encoded, ended with ``end_id`` and cut into pieces of ``size``
tokens (only longer documents are cut; the first piece takes the remainder).
Full pieces are sequences by themselves.  The others are dealt by hash into
blocks of about ``block_rows`` pieces; a block is packed best-fit decreasing
and then improved: taking the emptiest bin, its pieces move into gaps of other
underfull bins, or are exchanged one for one or one for two against smaller
pieces there, whenever that raises the sum of squared fills; a bin that becomes
empty is gone.  The underfull bins that remain in all blocks are pooled and
packed once more, in blocks of the same size, until the blocks are down to one
(or a round fills next to no bin: ``LEAST_FILLED``).

Defined cases: a null text is empty and gives one piece with the end id only;
repeated rows are pieces of their own (same doc_id and piece); an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import cut_lineage

from . import flat
from .common import needed

SIZE, END_ID = 1024, 2
LEAST_FILLED = 0.98                                    # a round that leaves more than this share of its pieces in underfull bins is the last


class Tokenizer:
    """Byte-level BPE ids as the tokenizers library gives them, each distinct chunk encoded once.

    A cut in front of a space that follows a character other than white space
    is a cut of the tokenizer's own splitting, so the chunks encode alone.
    Many chunks go into one call, joined; the ids fall back into chunks by
    the lengths of their tokens.  The vocabulary and the splitting come from
    the tokenizer file; its byte-pair merges are run by tiktoken, which gives
    the same ids several times faster (merge order is id order in this kind of
    vocabulary; the tests compare both libraries).
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        vocab = whole["model"]["vocab"]
        self.added = {t["content"].encode(): t["id"] for t in whole.get("added_tokens") or ()}
        longest_first = sorted(self.added, key=lambda t: (-len(t), t))
        self.marks = re.compile(b"|".join(re.escape(t) for t in longest_first)) if self.added else None
        byte_of = _byte_letters()
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in vocab.items() if all(c in byte_of for c in t) and not t.startswith("<|")}
        self.bpe = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.cache = flat.WordCache()
        self.lengths = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)

    def encode(self, buf: np.ndarray, off: np.ndarray):
        """(ids, offsets) of all documents; a text is cut at the file's added tokens first, whose ids stand for them."""
        raw = buf.tobytes()
        marks = [m.span() for m in self.marks.finditer(raw)] if self.marks else []
        inside = np.searchsorted(off, [a for a, _ in marks], "right") == np.searchsorted(off, [z for _, z in marks], "left") if marks else []
        marks = [m for m, ok in zip(marks, inside) if ok]
        if not marks:
            return self._plain(buf, raw, off)
        edges = np.unique(np.concatenate([off, np.array(marks, np.int64).ravel()]))
        own, at = self._plain(buf, raw, edges)
        first = {a: self.added[raw[a:z]] for a, z in marks}
        special = np.array([first.get(e, -1) for e in edges[:-1].tolist()], np.int64)
        size = np.where(special >= 0, 1, np.diff(at))
        source = np.where(special >= 0, np.arange(len(special)), len(special))
        data, where = np.concatenate([np.maximum(special, 0).astype(np.int32), own]), np.where(special >= 0, source, at[:-1] + len(special))
        out_off = np.append(0, np.cumsum(size))
        ids = data[np.arange(out_off[-1]) + np.repeat(where - out_off[:-1], size)]
        return ids, out_off[np.searchsorted(edges, off)]

    def _plain(self, buf: np.ndarray, raw: bytes, off: np.ndarray):
        """(ids, offsets) of texts in which no added token counts."""
        cut = np.zeros(len(buf) + 1, bool)
        if len(buf) > 1:
            cut[1:-1] = (buf[1:] == 32) & ~flat._SPACE[buf[:-1]]
        cut[off[:-1]] = True
        starts = np.flatnonzero(cut[:-1])
        ends = np.append(starts[1:], len(buf))[:len(starts)]
        h = flat.hash_pieces(buf, starts, ends)

        def fresh(at):
            return self._chunks([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])

        out, at = self.cache.encode(h, fresh)
        return out, at[np.searchsorted(starts, off)]

    def _chunks(self, chunks: list[bytes]):
        """Ids of chunks: those that begin with a space and end without white space go joined, the others alone."""
        plain = [c[:1] == b" " and c[-1] not in b" \t\n\r\x0b\x0c" and c.isascii() for c in chunks]
        order = sorted(range(len(chunks)), key=plain.__getitem__, reverse=True)
        n_plain = sum(plain)
        jobs = [order[i:min(i + 4096, n_plain)] for i in range(0, n_plain, 4096)] + [[k] for k in order[n_plain:]]
        parts, sizes = [], np.zeros(len(chunks), np.int64)
        for job in jobs:
            ids = np.array(self.bpe.encode_ordinary(b"".join([chunks[k] for k in job]).decode()), np.int32)
            if len(job) == 1:
                sizes[job[0]] = len(ids)
            else:
                edge = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(chunks[k]) for k in job])) + 1
                sizes[job] = np.diff(edge, prepend=0)
            parts.append(ids)
        all_ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        place = np.empty(len(chunks), np.int64)
        place[order] = np.arange(len(chunks))
        return flat.gather(np.append(0, np.cumsum(sizes[order])), all_ids, place)


# Fixed value: how a byte-level vocabulary of this family splits text before its merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level token stands for: printable Latin-1 itself, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit) of every piece."""
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids binary"

    def run(batches):
        tok = tokenizer(path)
        for b in batches:
            buf, off = flat.texts_of(b.column("text"))
            doc_ids = b.column("doc_id")
            for i, j in flat.spans(off):
                ids, at = tok.encode(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                n = np.diff(at) + 1                                           # with the end id
                full = np.empty(len(ids) + len(n), "<u4")
                ends = np.cumsum(n) - 1
                body = np.ones(len(full), bool)
                body[ends] = False
                full[ends], full[body] = end_id, ids
                k = -(-n // size)
                doc = np.repeat(np.arange(len(n)), k)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
                first = (n - (k - 1) * size)[doc]                             # the first piece takes the remainder
                start = np.where(piece == 0, 0, first + (piece - 1) * size)
                length = np.where(piece == 0, first, size)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(i, j - i).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                     flat.binary_array(full.view(np.uint8), np.append(0, np.cumsum(length)) * 4)],
                    names=["doc_id", "piece", "start", "length", "ids"])

    return needed(docs, "doc_id", "text").mapInArrow(run, schema)


# ---- one block -------------------------------------------------------------

class Bins:
    """Bins of whole-number items; underfull bins are found by gap, by the size of an item and by the sum of two items."""

    def __init__(self, size: int):
        self.size, self.items, self.fill = size, [], []
        self.by_gap, self.by_item, self.by_sum = defaultdict(set), None, None
        self.mask = 0                                  # bit g set: some bin has gap g

    def index(self):
        """From now on items and sums of two are indexed too."""
        self.by_item, self.by_sum = defaultdict(set), defaultdict(set)
        for b in range(len(self.items)):
            if self.fill[b] < self.size:
                self._index(b, set.add)

    def _index(self, b, put):
        sizes = self.sizes(b)
        for s in set(sizes):
            put(self.by_item[s], b)
        for s in {sizes[i] + sizes[j] for i in range(len(sizes)) for j in range(i)}:
            put(self.by_sum[s], b)

    def sizes(self, b) -> list[int]:
        """The item sizes of a bin, each at most twice: all that single items and pairs can add up to."""
        count: dict[int, int] = {}
        for s, _ in self.items[b]:
            count[s] = count.get(s, 0) + 1
        return [s for s, c in count.items() for _ in range(min(c, 2))]

    def _put(self, b):
        g = self.size - self.fill[b]
        if g:
            self.by_gap[g].add(b)
            self.mask |= 1 << g
            if self.by_item is not None:
                self._index(b, set.add)

    def _take(self, b):
        g = self.size - self.fill[b]
        if g:
            self.by_gap[g].discard(b)
            if not self.by_gap[g]:
                self.mask &= ~(1 << g)
            if self.by_item is not None:
                self._index(b, set.discard)

    def change(self, b, gone, come):
        """Replace items in a bin."""
        self._take(b)
        for x in gone:
            self.items[b].remove(x)
        self.items[b] += come
        self.fill[b] += sum(x[0] for x in come) - sum(x[0] for x in gone)
        self._put(b)

    def add(self, item):
        """Best fit: into the bin with the smallest gap that holds the item, else a new one."""
        m = self.mask >> item[0]
        if m:
            self.change(min(self.by_gap[item[0] + (m & -m).bit_length() - 1]), [], [item])
        else:
            self.items.append([])
            self.fill.append(0)
            self.change(len(self.items) - 1, [], [item])


def improve(bins: Bins) -> None:
    """Empty bins by moves and exchanges of items for less between underfull bins.

    Every step takes weight from a bin into one at least as full, which raises
    the sum of squared fills; so the search ends.  A pass goes through the
    underfull bins, emptiest first; steps among the fuller ones open new gaps
    for the next pass, until one changes nothing.
    """
    bins.index()
    while True:
        moved = False
        order = sorted((b for b in range(len(bins.items)) if 0 < bins.fill[b] < bins.size), key=lambda b: (bins.fill[b], b))
        for a in order:
            while bins.items[a] and bins.fill[a] < bins.size and (
                    any(_shift(bins, a, x) for x in sorted(bins.items[a], reverse=True)) or _shift_two(bins, a)):
                moved = True
        if not moved:
            return


def _shift(bins: Bins, a: int, x: tuple[int, int]) -> bool:
    """One move or exchange that takes as much as possible of item ``x`` out of bin ``a`` into a fuller bin."""
    least, size = bins.fill[a], bins.size
    fits = lambda found, d: min((b for b in found if b != a and least <= bins.fill[b] <= size - d), default=None)
    m = bins.mask >> x[0]
    while m:                                           # move: smallest gap that holds it
        g = x[0] + (m & -m).bit_length() - 1
        m = (bins.mask >> (g + 1)) << (g + 1 - x[0]) if bins.mask >> (g + 1) else 0
        b = fits(bins.by_gap[g], x[0])
        if b is not None:
            bins.change(a, [x], [])
            bins.change(b, [], [x])
            return True
    for d in range(min(x[0] - 1, size - least), 0, -1):
        rest = x[0] - d
        b = fits(bins.by_item.get(rest, ()), d)
        if b is not None:                              # one for one
            y = max(i for i in bins.items[b] if i[0] == rest)
            bins.change(b, [y], [x])
            bins.change(a, [x], [y])
            return True
        b = fits(bins.by_sum.get(rest, ()), d)
        if b is not None:                              # two for one
            own = bins.items[b]
            y, z = next((own[i], own[j]) for i in range(len(own)) for j in range(i) if own[i][0] + own[j][0] == rest)
            bins.change(b, [y, z], [x])
            bins.change(a, [x], [y, z])
            return True
    return False


def _shift_two(bins: Bins, a: int) -> bool:
    """Two items of bin ``a`` for one smaller than their sum in a fuller bin."""
    least, size, own, seen = bins.fill[a], bins.size, [], {}
    for x in sorted(bins.items[a]):                    # of equal items two are enough
        seen[x[0]] = seen.get(x[0], 0) + 1
        if seen[x[0]] <= 2:
            own.append(x)
    tried = set()
    for i in range(len(own)):
        for j in range(i):
            both = own[i][0] + own[j][0]
            if both in tried:
                continue
            tried.add(both)
            for d in range(min(both - 1, size - least), 0, -1):
                b = min((b for b in bins.by_item.get(both - d, ()) if b != a and least <= bins.fill[b] <= size - d), default=None)
                if b is not None:
                    y = max(k for k in bins.items[b] if k[0] == both - d)
                    bins.change(b, [y], [own[i], own[j]])
                    bins.change(a, [own[i], own[j]], [y])
                    return True
    return False


def pack_block(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in it, fill of the bin) of every item; bins are numbered from 0."""
    bins = Bins(size)
    for i in np.lexsort((np.arange(len(lengths)), -lengths)).tolist():
        bins.add((int(lengths[i]), i))
    improve(bins)
    number, offset, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    k = 0
    for own in bins.items:
        if own:
            at = 0
            for s, i in sorted(own, reverse=True):
                number[i], offset[i] = k, at
                at += s
            for _, i in own:
                fill[i] = at
            k += 1
    return number, offset, fill


def place(parts: DataFrame, size: int = SIZE, block_rows: int = 40_000) -> DataFrame:
    """sequence_id and offset for pieces(doc_id, piece, start, length, and further columns).

    The pieces are written once with a row number; blocks see row and length only.
    """
    t = cut_lineage(parts.withColumn("row", F.monotonically_increasing_id()))
    whole = t.where(F.col("length") == size).select("row", (F.col("row") * 2).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    todo = cut_lineage(t.where(F.col("length") < size).select("row", "length"))
    done, rnd = [whole], 0
    n = todo.count()
    while n:
        blocks = max(1, math.ceil(n / block_rows))
        base = rnd

        def block(key, df):
            df = df.sort_values("row", kind="stable")
            number, offset, fill = pack_block(df["length"].to_numpy(), size)
            return pd.DataFrame({"row": df["row"], "length": df["length"], "number": number, "offset": offset, "fill": fill, "block": key[0]})

        parts = min(blocks, 4 * int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # blocks are small in bytes, heavy in work
        placed = cut_lineage(todo.withColumn("b", F.pmod(F.xxhash64("row", F.lit(base)), F.lit(blocks))).repartition(parts, "b")
                             .groupBy("b").applyInPandas(block, "row bigint, length bigint, number bigint, offset bigint, fill bigint, block bigint"))
        left = placed.where(F.col("fill") < size).count() if blocks > 1 else 0
        last = blocks == 1 or left > LEAST_FILLED * n
        keep = placed if last else placed.where(F.col("fill") == size)
        # odd numbers: round, block and bin of the block, apart from the even numbers of the full pieces
        ids = (F.col("number") * blocks + F.col("block")) * 256 + 2 * rnd + 1
        done.append(keep.select("row", ids.alias("sequence_id"), "offset"))
        if last:
            break
        todo = cut_lineage(placed.where(F.col("fill") < size).select("row", "length"))
        n, rnd = left, rnd + 1
    seq = done[0]
    for d in done[1:]:
        seq = seq.unionByName(d)
    return t.join(seq, "row").drop("row")


def pack(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their ids and their place: doc_id, piece, start, length, ids, sequence_id, offset."""
    return place(pieces(docs, path, size, end_id), size)
