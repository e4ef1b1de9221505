"""Removal of repeated passages by difference-cover suffix sorting, split over the cluster by content.

A byte goes if a string of ``length`` bytes that covers it also starts in a
document with a smaller id.  Suffixes need to be in order by their first
``length`` bytes only, and only those that may have an equal elsewhere need to
be sorted at all:

1. Anchors.  Every window of ``length`` bytes is governed by its smallest
   (hashed) gram of ``GRAM`` bytes, the leftmost of equal ones.  Equal windows
   have equal anchors, at the same place.  A chunk is a run of windows with one
   anchor, about 16 windows, and the bytes they cover.
2. Shared anchors.  Tasks send each anchor they read once; anchors that one
   document has alone cannot govern a repeat.  The shared ones go to a bit table
   of a bounded size, which may let more chunks pass and never loses one.
3. Suffix sorting.  The chunks of shared anchors, each once per run of
   documents, are dealt by anchor, so equal windows always meet; windows of very
   frequent anchors are dealt by their own bytes.  Each deal is sorted by the
   difference cover modulo 3: triples at positions 1 and 2 are sorted and named,
   the string of names is sorted by recursion until names cover ``length``
   bytes, the suffixes at positions 0 are merged in, and neighbours whose
   prefixes of ``length`` bytes agree form a class with its smallest document.
4. The classes go back to the runs that sent the chunks, where each document
   takes the windows whose class has a smaller id; overlapping ones are joined.

No document's text moves before the last step, which brings texts and their
removed spans together.  Nothing is gathered by passage: a passage in every
document is one string per run.

Defined cases: a null text is empty; a text shorter than ``length`` loses
nothing; a null id counts as larger than every other; of rows with the same id
none loses to another; repeated rows are treated alike; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import cut_lineage

from . import flat
from .common import needed

LENGTH, GRAM = 50, 20
BLOCK = 1 << 18                                      # windows handled at once
RUN = 8_000_000                                      # bytes of the documents that share a run
HELD = 1_500_000                                     # anchors a task holds before it sends them
PART = 25_000_000                                    # bytes of text whose anchors are decided together
LOW = 24                                             # bits of a key kept in three bytes; eight more select a bucket
HOT = 60_000                                         # chunks of one anchor, above which its windows are dealt one by one
MAX_BITS = 1 << 30
NO_ID = np.iinfo(np.int64).max
_FACTOR = 0x9E3779B97F4A7C15


# ---- anchors ---------------------------------------------------------------

def grams(buf: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of the ``k`` bytes from every position on."""
    part, size, out, done = flat.BYTE_HASH[buf], 1, None, 0
    while k >> (size.bit_length() - 1):
        if k & size:
            if out is None:
                out = part
            else:
                m = min(len(out), len(part) - done)
                out = out[:m] * np.uint64(pow(_FACTOR, size, 2**64)) + part[done:done + m]
            done += size
        if k >= 2 * size:
            part = part[:len(part) - size] * np.uint64(pow(_FACTOR, size, 2**64)) + part[size:]
        size *= 2
    return flat.mix(out)


def chunks(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(first window, windows, anchor) of the chunks of all documents, in order."""
    n = len(buf) - length + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    valid = np.ones(len(buf), bool)
    tail = (off[1:, None] - np.arange(1, length)).ravel()
    valid[tail[tail >= 0]] = False
    width, low = length - gram + 1, np.uint64((1 << 20) - 1)
    found = []
    for a in range(0, n, BLOCK):
        part = buf[a:a + BLOCK + length - 1]
        h = grams(part, gram)
        best, step = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
        whole = best
        while 2 * step <= width:
            best = np.minimum(best[:-step], best[step:])
            step *= 2
        m = len(whole) - width + 1
        best = np.minimum(best[:m], best[width - step:][:m])
        at = (best & low).astype(np.int64)
        p = np.flatnonzero(valid[a:a + m])
        g = at[p]
        new = np.empty(len(p), bool)
        new[:1], new[1:] = True, (g[1:] != g[:-1]) | (np.diff(p) != 1)
        first = np.flatnonzero(new)
        found.append((p[first] + a, np.diff(np.append(first, len(p))), h[g[first]]))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def _doc_runs(batch):
    """(bytes, offsets, first row, slice) per run of documents of an Arrow batch."""
    buf, off = flat.texts_of(batch.column("text"))
    for i, j in flat.spans(off, RUN):
        yield buf[off[i]:off[j]], off[i:j + 1] - off[i], i, j


# ---- shared anchors --------------------------------------------------------

def anchor_keys(anchors: np.ndarray) -> np.ndarray:
    """Anchors mixed anew: as smallest hashes they lie close to zero, and their top bits would fill the first parts and bits only."""
    return flat.mix(anchors)


class Shared:
    """Which anchors may be shared: a bit table over the top bits of their keys; and the keys, cut to ``key_bits``, of the few very frequent ones."""

    def __init__(self, bits: int, shared: np.ndarray, key_bits: int, hot: np.ndarray):
        self.bits, self.shared, self.key_bits, self.hot = bits, shared, key_bits, np.sort(hot)

    def __reduce__(self):                            # travels compressed
        return _unpack, (self.bits, zstandard.ZstdCompressor(level=1).compress(self.shared.tobytes()), self.key_bits, self.hot)

    def has(self, anchors):
        at = (anchor_keys(anchors) >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.shared[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1

    def is_hot(self, anchors):
        key = anchor_keys(anchors) >> np.uint64(64 - self.key_bits)
        return np.searchsorted(self.hot, key) < np.searchsorted(self.hot, key, "right")


def _unpack(bits: int, shared: bytes, key_bits: int, hot: np.ndarray) -> Shared:
    return Shared(bits, np.frombuffer(zstandard.ZstdDecompressor().decompress(shared), np.uint8), key_bits, hot)


def shared_anchors(docs: DataFrame, length: int, gram: int) -> tuple[Shared, int]:
    """The shared and the very frequent anchors of all documents, and how many chunks the shared anchors have in all."""
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    part_bits = max(4, int(n_bytes // PART).bit_length())
    key_bits = part_bits + 8 + LOW

    def collect(batches):
        held, rows = [], 0

        def flush():
            """Keys of this task with their number of chunks; ``many``: more than one document has it."""
            key, doc = (np.concatenate([x[k] for x in held]) for k in range(2))
            order = np.argsort(key, kind="stable")
            key, doc = key[order], doc[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            n = np.diff(np.append(first, len(key)))
            many = np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first)
            key = key[first]
            for flag in (False, True):
                k, c = key[many == flag], n[many == flag]
                edge = np.searchsorted(k, np.arange((1 << part_bits) + 1, dtype=np.uint64) << np.uint64(8 + LOW))
                for p in np.flatnonzero(np.diff(edge)).tolist():
                    own, count = k[edge[p]:edge[p + 1]], c[edge[p]:edge[p + 1]]
                    low = own.view(np.uint8).reshape(-1, 8)[:, :LOW // 8]
                    sizes = np.bincount((own >> np.uint64(LOW)).astype(np.int64) & 255, minlength=256).astype("<u4")
                    out.append((p, flag, sizes.tobytes(), np.ascontiguousarray(low).tobytes(), np.minimum(count, 2**32 - 1).astype("<u4").tobytes() if flag else b""))

        out, doc_no = [], 0
        for b in batches:
            for buf, off, _, _ in _doc_runs(b):
                first, _, anchor = chunks(buf, off, length, gram)
                held.append((anchor_keys(anchor) >> np.uint64(64 - key_bits), np.searchsorted(off, first, "right") + doc_no))
                doc_no += len(off)
                rows += len(anchor)
                if rows > HELD:
                    flush()
                    held, rows = [], 0
                    yield from _packed(out)
                    out.clear()
        if rows:
            flush()
            yield from _packed(out)

    def decide(key, table):
        parts = {False: [], True: []}
        for p, flag, sizes, low, count in zip(*[table.column(c).to_pylist() for c in ("part", "many", "sizes", "low", "count")]):
            raw = np.frombuffer(low, np.uint8).reshape(-1, LOW // 8)
            full = np.zeros((len(raw), 8), np.uint8)
            full[:, :LOW // 8] = raw
            keys = full.view("<u8").ravel() | (np.repeat(np.arange(256, dtype=np.uint64), np.frombuffer(sizes, "<u4")) << np.uint64(LOW))
            parts[flag].append((keys, np.frombuffer(count, "<u4").astype(np.int64) if flag else np.ones(len(keys), np.int64)))
        all_ = [*parts[False], *parts[True]]
        keys, counts = (np.concatenate([x[k] for x in all_]) for k in range(2))
        many = np.zeros(len(keys), bool)
        many[sum(len(x[0]) for x in parts[False]):] = True
        order = np.argsort(keys, kind="stable")
        keys, counts, many = keys[order], counts[order], many[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        n = np.add.reduceat(counts, first)
        yes = np.maximum.reduceat(many, first) | (np.diff(np.append(first, len(keys))) > 1)
        own, n = keys[first][yes].astype("<u4"), n[yes]
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(own)]), "chunks": pa.array([int(n.sum())]),
                         "low": pa.array([own.tobytes()], pa.binary()), "hot": pa.array([np.packbits(n > HOT).tobytes()], pa.binary())})

    sent = docs.select("text").mapInArrow(collect, "part int, many boolean, sizes binary, low binary, `count` binary")
    kept = cut_lineage(sent.groupBy("part").applyInArrow(decide, "part int, n bigint, chunks bigint, low binary, hot binary"))
    total = kept.agg(F.sum("n"), F.sum("chunks")).first()
    n_shared, n_chunks = int(total[0] or 0), int(total[1] or 0)
    bits = min(MAX_BITS, max(1 << 20, 1 << (64 * n_shared).bit_length()), 1 << key_bits).bit_length() - 1
    bits = max(bits, part_bits + 3)

    def slices(batches):
        """One part's share of the bit table, and the keys of its very frequent anchors."""
        size = 1 << (bits - part_bits)
        for b in batches:
            for p, low, hot in zip(*[b.column(c).to_pylist() for c in ("part", "low", "hot")]):
                low = np.frombuffer(low, "<u4")
                bit = np.zeros(size, bool)
                bit[low >> np.uint32(key_bits - bits)] = True
                often = low[np.unpackbits(np.frombuffer(hot, np.uint8), count=len(low)).astype(bool)] | np.uint64(p << (8 + LOW))
                both = zstandard.ZstdCompressor(level=1).compress(np.packbits(bit).tobytes()), often.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *[pa.array([x], pa.binary()) for x in both]], names=["part", "shared", "hot"])

    shared, hot = np.zeros(1 << (bits - 3), np.uint8), [np.zeros(0, np.uint64)]
    width = 1 << (bits - part_bits - 3)
    got = kept.mapInArrow(slices, "part int, shared binary, hot binary").toArrow()         # 2 ** bits bits at most, and a key for every HOT chunks
    for p, a, h in zip(*[got.column(c).to_pylist() for c in ("part", "shared", "hot")]):
        shared[p * width:(p + 1) * width] = np.frombuffer(zstandard.ZstdDecompressor().decompress(a), np.uint8)
        hot.append(np.frombuffer(h, "<u8"))
    return Shared(bits, shared, key_bits, np.concatenate(hot)), n_chunks


def _packed(out):
    for p, flag, sizes, low, count in out:
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([flag]), *[pa.array([x], pa.binary()) for x in (sizes, low, count)]],
                                         names=["part", "many", "sizes", "low", "count"])


# ---- chunks of shared anchors ----------------------------------------------

CHUNKS = "run bigint, shard bigint, base bigint, strings binary, text binary, places binary"
GROUPS = 16                                          # a deal is sorted in so many parts, each small enough for a processor's cache


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, compressed byte by byte of their eight."""
    flat_ = np.stack([np.ascontiguousarray(c, "<i8").view(np.uint8).reshape(-1, 8).T for c in columns]) if len(columns[0]) else np.zeros((0,), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(flat_.tobytes())


def _unpacked(raw: bytes, k: int) -> list[np.ndarray]:
    """The ``k`` columns of ``_pack``."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return [np.ascontiguousarray(x.T).view("<i8").ravel() for x in data.reshape(k, 8, -1)] if len(data) else [np.zeros(0, np.int64)] * k


def shared_chunks(docs: DataFrame, shared: Shared, shards: int, length: int, gram: int) -> DataFrame:
    """Per run of documents: its distinct chunks by shard, and a row (shard -1) with every place of a chunk.

    A run's strings are numbered by shard; a row's ``base`` is the number of its first one.
    """
    table = docs.sparkSession.sparkContext.broadcast(shared)

    def run(batches):
        known = table.value
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            ids = b.column("doc_id").fill_null(NO_ID).to_numpy()
            keys, rows = b.column("key").to_numpy(), b.column("row").to_numpy()
            for buf, off, i, j in _doc_runs(b):
                first, n, anchor = chunks(buf, off, length, gram)
                keep = known.has(anchor)
                first, n, anchor = first[keep], n[keep], anchor[keep]
                if not len(first):
                    continue
                hot = known.is_hot(anchor)
                if hot.any():                                         # one string per window
                    times = np.where(hot, n, 1)
                    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    first, anchor, n, hot = np.repeat(first, times) + step, np.repeat(anchor, times), np.where(np.repeat(hot, times), 1, np.repeat(n, times)), np.repeat(hot, times)
                doc = np.searchsorted(off, first, "right") - 1
                size = n + length - 1
                h = flat.hash_pieces(buf, first, first + size)
                pick, number = flat.unique_pieces(h)
                if not _equal(buf, first, size, pick[number]):        # two contents with one hash: none is merged
                    pick, number = np.arange(len(first)), np.arange(len(first))
                own = ids[i:j][doc]
                order = np.argsort(number, kind="stable")
                at = np.flatnonzero(np.append(True, np.diff(number[order]) != 0))
                least, most = np.minimum.reduceat(own[order], at), np.maximum.reduceat(own[order], at)
                deal = np.where(hot[pick], h[pick], flat.mix(anchor[pick]))
                shard, group = (deal % np.uint64(shards)).astype(np.int64), (deal >> np.uint64(60)).astype(np.int64) % GROUPS
                by = np.lexsort((group, shard))
                place = np.empty(len(by), np.int64)
                place[by] = np.arange(len(by))
                pick, shard, group, least, most = pick[by], shard[by], group[by], least[by], most[by]
                text, t_off = _slices(buf, first[pick], size[pick])
                edge = np.flatnonzero(np.append(True, np.diff(shard) != 0))
                out = []
                for a, z in zip(edge.tolist(), np.append(edge[1:], len(by)).tolist()):
                    out.append((int(rows[i]), int(shard[a]), a, _pack(n[pick[a:z]], group[a:z], least[a:z], most[a:z] - least[a:z]),
                                pack.compress(text[t_off[a]:t_off[z]].tobytes()), None))
                here = np.unique(doc)
                d = np.searchsorted(here, doc)
                start = first - off[doc]
                places = [_pack(ids[i:j][here], keys[i:j][here]), _pack(np.diff(d, prepend=0), np.diff(start, prepend=0), place[number])]
                out.append((int(rows[i]), -1, 0, places[0], None, places[1]))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                                                 names=[x.split()[0] for x in CHUNKS.split(", ")])

    return docs.select("doc_id", "key", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(run, CHUNKS)


def _slices(buf, start, size):
    """The bytes of all slices behind each other, and their offsets."""
    off = np.append(0, np.cumsum(size))
    out = np.empty(off[-1], buf.dtype)
    for a, z in flat.spans(off, BLOCK):                              # a place takes eight times its byte
        out[off[a]:off[z]] = buf[np.arange(off[a], off[z]) + np.repeat(start[a:z] - off[a:z], size[a:z])]
    return out, off


def _equal(buf, start, size, other) -> bool:
    """Whether every slice has the bytes of the slice ``other`` names for it."""
    if (size != size[other]).any():
        return False
    diff = np.flatnonzero(other != np.arange(len(other)))
    for a, z in flat.spans(np.append(0, np.cumsum(size[diff])), BLOCK):
        own = diff[a:z]
        mine, _ = _slices(buf, start[own], size[own])
        theirs, _ = _slices(buf, start[other[own]], size[own])
        if (mine != theirs).any():
            return False
    return True


# ---- difference-cover suffix sorting ---------------------------------------

def _join(a: np.ndarray, a_bound: int, b: np.ndarray, b_bound: int) -> tuple[np.ndarray, int]:
    """Order-preserving code of the pairs (a, b) below its bound; 0 <= a < a_bound, 0 <= b < b_bound."""
    if a_bound * b_bound >= 1 << 62:
        a = np.unique(a, return_inverse=True)[1]
        a_bound = int(a.max(initial=0)) + 1
    return a * b_bound + b, a_bound * b_bound


def _sorted(key: np.ndarray, bound: int) -> np.ndarray:
    """Positions of the keys in their order."""
    bits = max(1, (len(key) - 1).bit_length())
    if bound < 1 << (63 - bits):                                     # key and position fit one number, which sorts faster
        return np.sort((key << bits) | np.arange(len(key))) & ((1 << bits) - 1)
    return np.argsort(key)


def suffix_order(t: np.ndarray, need: int, cover: int = 1) -> np.ndarray:
    """Starts of all suffixes of ``t`` (whole numbers from 1 on; 0 separates strings) in order of their first symbols.

    A symbol stands for ``cover`` bytes; the order holds for ``need`` bytes at
    least, equal prefixes come in any order.
    """
    n = len(t)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    sigma = int(t.max()) + 1
    s = np.append(t, (0, 0, 0))
    n_one = (n + 1) // 3
    sample = np.concatenate([np.arange(1, n, 3), np.arange(2, n, 3)])
    pair, bound = _join(s[:-1], sigma, s[1:], sigma)                 # symbols i and i + 1 of every position
    triple, t_bound = _join(pair[sample], bound, s[sample + 2], sigma)
    order = None
    if t_bound <= 1 << 22:                                           # names of the sorted triples: by table, else by sorting
        mark = np.zeros(t_bound, np.int64)
        mark[triple] = 1
        names = np.cumsum(mark)[triple]
        n_names = int(mark.sum())
    else:
        by = _sorted(triple, t_bound)
        own = triple[by]
        new = np.empty(len(by), np.int64)
        new[0], new[1:] = 1, own[1:] != own[:-1]
        names = np.empty(len(by), np.int64)
        names[by] = np.cumsum(new)
        n_names, order = int(new.sum()), sample[by]
    if n_names == len(sample) or 3 * cover >= need:
        if order is None:
            order = sample[_sorted(names, n_names + 1)]
    else:
        sub = suffix_order(np.concatenate([names[:n_one], [0], names[n_one:]]), need, 3 * cover)
        sub = sub[sub != n_one]
        order = sample[sub - (sub > n_one)]
    rank = np.zeros(n + 3, np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    size = len(order) + 1
    zero = np.arange(0, n, 3)
    short, s_bound = _join(s[zero], sigma, rank[zero + 1], size)     # a suffix by its first symbol and the next sampled suffix
    by = _sorted(short, s_bound)
    zero, short = zero[by], short[by]
    at = order % 3
    first, second = order[at == 1], order[at == 2]
    both, _ = _join(pair[np.concatenate([zero, second])], bound, rank[np.concatenate([zero, second]) + 2], size)   # by two symbols and the one after
    before = np.searchsorted(s[first] * size + rank[first + 1], short) + np.searchsorted(np.maximum.accumulate(both[len(zero):]), both[:len(zero)])
    place = np.arange(len(zero)) + np.maximum.accumulate(before)
    out = np.full(n, -1, np.int64)
    out[place] = zero
    out[out < 0] = order
    return out


def window_classes(content: np.ndarray, off: np.ndarray, windows: np.ndarray, least: np.ndarray, length: int):
    """The smallest document of every window's class, for strings with their smallest documents."""
    n = len(windows)
    w_off = np.append(0, np.cumsum(windows))
    used = np.bincount(content, minlength=256) > 0
    code = np.cumsum(used)                                           # bytes as 1, 2, ... in their order
    t = np.zeros(len(content) + n, np.int64)
    body = np.ones(len(t), bool)
    body[off[1:] + np.arange(n)] = False
    t[body] = code[content]
    string = np.repeat(np.arange(n), windows)
    start = np.arange(w_off[-1]) - np.repeat(w_off[:-1], windows) + np.repeat(off[:-1] + np.arange(n), windows)
    number = np.full(len(t), -1, np.int64)
    number[start] = np.arange(len(start))
    order = suffix_order(t, length)
    order = order[number[order] >= 0]                                # windows only
    # neighbours with equal prefixes: words of eight symbols, the last one overlapping
    wide = np.append(t, np.zeros(8, np.int64)).astype(np.uint64) & np.uint64(255)
    word = np.zeros(len(t), np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | wide[k:k + len(t)]
    same = np.ones(len(order) - 1, bool)
    for k in [*range(0, length - 7, 8), length - 8] if length >= 8 else []:
        x = word[order + k]
        same &= x[1:] == x[:-1]
    if length < 8:
        for k in range(length):
            same &= t[order + k][1:] == t[order + k][:-1]
    head = np.append(True, ~same)
    which = np.cumsum(head) - 1
    own = least[string[number[order]]]
    smallest = np.minimum.reduceat(own, np.flatnonzero(head))
    out = np.empty(len(order), np.int64)
    out[number[order]] = smallest[which]
    return out


FOUND = "run bigint, lost binary"


def sort_shards(sent: DataFrame, length: int) -> DataFrame:
    """Per run and shard: string number, first window, windows and smallest document of every run of windows that some place of the string loses."""
    def shard(key, table):
        unpack = zstandard.ZstdDecompressor()
        rows = list(zip(*[table.column(c).to_pylist() for c in ("run", "base", "strings", "text")]))
        cols = [_unpacked(r[2], 4) for r in rows]
        windows, group, least, more = (np.concatenate([c[k] for c in cols]) for k in range(4))
        from_ = np.repeat(np.arange(len(rows)), [len(c[0]) for c in cols])
        number = np.concatenate([r[1] + np.arange(len(c[0])) for r, c in zip(rows, cols)])
        content = np.frombuffer(b"".join([unpack.decompress(r[3]) for r in rows]), np.uint8)
        size = windows + length - 1
        off = np.append(0, np.cumsum(size))
        pick, which = flat.unique_pieces(flat.hash_pieces(content, off[:-1], off[1:]))
        if not _equal(content, off[:-1], size, pick[which]):
            pick, which = np.arange(len(size)), np.arange(len(size))
        by = np.argsort(group[pick], kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        pick, which = pick[by], place[which]
        low = np.full(len(pick), NO_ID)
        np.minimum.at(low, which, least)
        w_off = np.append(0, np.cumsum(windows[pick]))
        edge = np.searchsorted(group[pick], np.arange(GROUPS + 1))
        smallest = np.empty(w_off[-1], np.int64)
        for a, z in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if z > a:
                own, own_off = _slices(content, off[:-1][pick[a:z]], size[pick[a:z]])
                smallest[w_off[a]:w_off[z]] = window_classes(own, own_off, windows[pick[a:z]], low[a:z], length)
        # runs of windows with one smallest document, per distinct string
        new = np.append(True, smallest[1:] != smallest[:-1])
        new[w_off[:-1]] = True
        head = np.flatnonzero(new)
        seg_string = np.searchsorted(w_off, head, "right") - 1
        seg_first, seg_n, seg_least = head - w_off[seg_string], np.diff(np.append(head, len(smallest))), smallest[head]
        seg_off = np.searchsorted(seg_string, np.arange(len(pick) + 1))
        # to every sent string its segments, as far as one of its documents is larger
        times = np.diff(seg_off)[which]
        at = np.repeat(np.arange(len(which)), times)
        seg = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(seg_off[which], times)
        hit = seg_least[seg] < (least + more)[at]
        at, seg = at[hit], seg[hit]
        edge = np.searchsorted(from_[at], np.arange(len(rows) + 1))
        out = [(rows[k][0], _pack(number[at[a:z]], seg_first[seg[a:z]], seg_n[seg[a:z]], seg_least[seg[a:z]]))
               for k, (a, z) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())) if z > a]
        return pa.table({"run": pa.array([r for r, _ in out], pa.int64()), "lost": pa.array([x for _, x in out], pa.binary())})

    return sent.groupBy("shard").applyInArrow(shard, FOUND)


def document_spans(places: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """doc_id, key, spans (binary: starts and ends of the removed runs, in order) of every document that loses bytes."""
    def run(key, table):
        rows = table.to_pylist()
        here = next(r for r in rows if r["places"] is not None)
        got = [_unpacked(r["lost"], 4) for r in rows if r["lost"] is not None]
        empty = pa.table({"doc_id": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "spans": pa.array([], pa.binary())})
        if not got:
            return empty
        ids, keys = _unpacked(here["strings"], 2)
        d, start, string = _unpacked(here["places"], 3)
        d, start = np.cumsum(d), np.cumsum(start)
        number, first, n, least = (np.concatenate([g[k] for g in got]) for k in range(4))
        order = np.argsort(number, kind="stable")
        number, first, n, least = number[order], first[order], n[order], least[order]
        lo, hi = np.searchsorted(number, string), np.searchsorted(number, string, "right")
        times = hi - lo
        at = np.repeat(np.arange(len(string)), times)
        seg = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)
        hit = least[seg] < ids[d[at]]
        at, seg = at[hit], seg[hit]
        if not len(at):
            return empty
        d, a = d[at], start[at] + first[seg]
        z = a + n[seg] + length - 1
        order = np.lexsort((a, d))
        d, a, z = d[order], a[order], z[order]
        base = d * (int(z.max()) + 1)                                 # ends so far, per document
        reach = np.maximum.accumulate(z + base) - base
        new = np.append(True, (d[1:] != d[:-1]) | (a[1:] > reach[:-1]))
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(d)) - 1
        spans = np.stack([a[head], reach[tail]], axis=1)
        edge = np.searchsorted(d[head], np.arange(len(ids) + 1))
        some = np.flatnonzero(np.diff(edge))
        ids_out = pa.array(ids[some], mask=ids[some] == NO_ID)
        return pa.table({"doc_id": ids_out, "key": pa.array(keys[some]), "spans": pa.array([spans[edge[k]:edge[k + 1]].astype("<i8").tobytes() for k in some.tolist()], pa.binary())})

    none = F.lit(None).cast("binary")
    both = places.select("run", "strings", "places", none.alias("lost")).unionByName(found.select("run", none.alias("strings"), none.alias("places"), "lost"))
    return both.groupBy("run").applyInArrow(run, "doc_id bigint, key bigint, spans binary")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int | None = None, shard_chunks: int = 40_000) -> DataFrame:
    """doc_id, key (xxhash64 of the text), spans of every distinct (id, text) of ``docs`` that loses bytes."""
    gram = gram or max(1, length * GRAM // LENGTH)
    d = needed(docs, "doc_id", "text").withColumn("key", F.xxhash64("text"))
    shared, n_chunks = shared_anchors(d, length, gram)
    sent = cut_lineage(shared_chunks(d, shared, max(1, n_chunks // shard_chunks), length, gram))
    found = sort_shards(sent.where("shard >= 0").select("shard", "run", "base", "strings", "text"), length)
    return document_spans(sent.where("shard = -1"), found, length).dropDuplicates(["doc_id", "key"])


def cut_repeats(docs: DataFrame, length: int = LENGTH, **kw) -> DataFrame:
    """doc_id, kept (the remaining bytes), starts and ends (byte positions of the removed runs) of every row of ``docs``."""
    spans = repeated_spans(docs, length, **kw).select(F.col("doc_id").alias("id"), F.col("key").alias("k"), "spans")
    d = needed(docs, "doc_id", "text").withColumn("key", F.xxhash64("text"))
    both = d.join(spans, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("id")), "left").select("doc_id", "text", "spans")

    def run(batches):
        for b in batches:
            buf, off = flat.texts_of(b.column("text"))
            lost = b.column("spans").to_pylist()
            kept, size = [], np.zeros(len(lost) + 1, np.int64)
            starts, ends = [], []
            for k, x in enumerate(lost):
                text = buf[off[k]:off[k + 1]]
                if x is None:
                    starts.append([])
                    ends.append([])
                else:
                    a, z = np.frombuffer(x, "<i8").reshape(-1, 2).T
                    step = np.zeros(len(text) + 1, np.int8)
                    step[a] += 1
                    step[z] -= 1
                    text = text[np.cumsum(step[:-1], dtype=np.int8) == 0]
                    starts.append(a.tolist())
                    ends.append(z.tolist())
                kept.append(text)
                size[k + 1] = size[k] + len(text)
            raw = np.concatenate(kept) if kept else np.zeros(0, np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), flat.binary_array(raw, size), *[pa.array(x, pa.list_(pa.int64())) for x in (starts, ends)]],
                                             names=["doc_id", "kept", "starts", "ends"])

    return both.mapInArrow(run, "doc_id bigint, kept binary, starts array<bigint>, ends array<bigint>")
