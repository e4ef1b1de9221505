"""Vectorised helpers on flat UTF-8: the bytes of many texts in one array, with offsets.

Used inside ``mapInArrow`` tasks.  A text column's Arrow buffers already have
this form, so nothing is decoded row by row.  ``spans`` cuts a batch into runs
of documents of a few MB, which bounds the working memory of a task; a longer
document forms a run of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 3_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Rolling hash: random 64-bit value per byte, odd multiplier per position.
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_HASH = _RNG.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False) | np.uint64(1)
_MULT = 0x9E3779B97F4A7C13 | 3
_MULT = _MULT - (_MULT % 8) + 3                       # 3 mod 8: powers stay far apart modulo 2**64
_INV = pow(_MULT, -1, 2**64)
_BLOCK = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW, _IPOW = _powers(_MULT, _BLOCK + 1), _powers(_INV, _BLOCK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def texts_of(arr) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null is an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(off, kind)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def spans(off: np.ndarray, limit: int = RUN_BYTES):
    """Runs [i, j) of documents of at most ``limit`` bytes together (one document at least)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def hash_pieces(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE_HASH) -> np.ndarray:
    """64-bit hash of every slice ``buf[starts:ends]`` (slices in order, not overlapping)."""
    first, last = _prefix(buf, starts, table), _prefix(buf, ends, table)
    blk = starts >> 18
    lift = np.array([pow(_INV, int(b) << 18, 2**64) for b in range(int(blk[-1]) + 1)], np.uint64) if len(starts) else np.zeros(1, np.uint64)
    h = (last - first) * _IPOW[starts & (_BLOCK - 1)] * (lift[blk] if len(starts) else np.uint64(1))
    return mix(h + (ends - starts).astype(np.uint64))


def _prefix(buf, at, table):
    """Sum of table[byte] * mult**i before each position (positions in order)."""
    out = np.zeros(len(at), np.uint64)
    carry, lo = np.uint64(0), 0
    for b, a in enumerate(range(0, len(buf) + 1, _BLOCK)):
        part = buf[a:a + _BLOCK]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * _POW[:len(part)], out=sums[1:])
        sums = sums * np.uint64(pow(_MULT, a, 2**64)) + carry
        hi = int(np.searchsorted(at, a + _BLOCK, "left"))
        out[lo:hi] = sums[at[lo:hi] - a]
        carry, lo = sums[-1], hi
    return out


def words_of(buf: np.ndarray, off: np.ndarray):
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ and the word offset of every document."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = ~_SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~word[:-1]
    starts = np.flatnonzero(word & (before | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~word[1:]
    ends = np.flatnonzero(word & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def lines_of(buf: np.ndarray, off: np.ndarray):
    """Starts and ends of the \\n-split lines and the line offset of every document."""
    cut = np.flatnonzero(buf == 10)
    starts = np.sort(np.concatenate([off[:-1], cut + 1]), kind="stable")
    doc_first = np.searchsorted(cut, off[:-1]) + np.arange(len(off) - 1)
    line_off = np.append(doc_first, len(starts))
    ends = np.empty(len(starts), np.int64)
    ends[:-1], ends[-1:] = starts[1:] - 1, len(buf)
    last = line_off[1:] - 1
    ends[last] = off[1:]
    return starts, ends, line_off


def run_hash(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of every run h[first:last] (runs in order)."""
    n = int(last.max(initial=0))
    p, q = _grown(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h[:n] * p[:n], out=sums[1:])
    return mix((sums[last] - sums[first]) * q[np.minimum(first, n)] + (last - first).astype(np.uint64))


_RUN = [_powers(_MULT, 1 << 12), _powers(_INV, 1 << 12)]


def _grown(n: int):
    if len(_RUN[0]) <= n:
        size = 1 << int(n + 1).bit_length()
        _RUN[0], _RUN[1] = _powers(_MULT, size), _powers(_INV, size)
    return _RUN


def window_hash(h: np.ndarray, doc_off: np.ndarray, k: int):
    """Hashes of the k-long windows that lie inside one document, and where they start."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    p = _powers(_MULT, k)
    out = h[:len(h) - k + 1] * p[0]
    for j in range(1, k):
        out = out + h[j:len(h) - k + 1 + j] * p[j]
    fits = np.ones(len(out), bool)
    for j in range(1, k):                              # windows that start in the last k-1 words of a document
        at = doc_off[1:] - j
        fits[at[(at >= 0) & (at < len(out)) & (at >= doc_off[:-1])]] = False
    at = np.flatnonzero(fits)
    return mix(out[at]), at


def per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` in every slice off[i]:off[i+1]."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def doc_of(off: np.ndarray) -> np.ndarray:
    """Document number of every item."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def unique_pieces(h: np.ndarray):
    """(index of one item of each distinct hash, number of the distinct hash of every item)."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.empty(len(s), bool)
    new[:1], new[1:] = True, s[1:] != s[:-1]
    number = np.empty(len(s), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def gather(off: np.ndarray, data: np.ndarray, which: np.ndarray):
    """Concatenation of the slices data[off[w]:off[w+1]] for w in ``which``, and its offsets."""
    n = off[which + 1] - off[which]
    out_off = np.zeros(len(which) + 1, np.int64)
    np.cumsum(n, out=out_off[1:])
    at = np.arange(out_off[-1]) + np.repeat(off[which] - out_off[:-1], n)
    return data[at], out_off


def binary_array(data: np.ndarray, off: np.ndarray) -> pa.Array:
    """Arrow binary column from bytes and offsets."""
    off = np.ascontiguousarray(off, np.int64)
    wide = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])
    return wide.cast(pa.binary())


def list_array(values: pa.Array, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), values)


def bit_votes(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For every slice off[i]:off[i+1] of the 64-bit values: how many have each bit set, [n, 64] (bit 0 first).

    Eight byte-wide counters lie in each 64-bit lane, so blocks of at most 255
    values add up without carry.
    """
    n = np.diff(off)
    blocks = -(-n // 255)
    b_doc = np.repeat(np.arange(len(n)), blocks)
    first = np.zeros(len(n) + 1, np.int64)
    np.cumsum(blocks, out=first[1:])
    b_start = off[:-1][b_doc] + (np.arange(len(b_doc)) - first[:-1][b_doc]) * 255
    votes = np.zeros((len(n), 64), np.int64)
    if not len(b_doc):
        return votes
    lane = np.uint64(0x0101010101010101)
    some = np.flatnonzero(blocks)
    for j in range(8):
        s = np.add.reduceat((h[off[0]:off[-1]] >> np.uint64(j)) & lane, b_start - off[0])
        counts = s.view(np.uint8).reshape(-1, 8).astype(np.int64)     # byte k counts bit 8k + j
        votes[some, j::8] = np.add.reduceat(counts, first[:-1][some], axis=0)
    return votes


class WordCache:
    """Ids of words already encoded, found by 64-bit word hash in a direct-mapped table.

    It holds at most ``limit`` words, then starts afresh.  It saves work and
    never changes a result, so tasks may share it or lose it.
    """

    def __init__(self, limit: int = 1_000_000):
        self.limit, self.mask = limit, np.uint64((1 << 21) - 1)
        self.key, self.slot = np.zeros(1 << 21, np.uint64), np.zeros(1 << 21, np.int32)
        self.off, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def encode(self, h: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the words with hashes ``h``; ``encode(which)`` gives those of words not held."""
        place = h & self.mask
        slot = self.slot[place].astype(np.int64)
        miss = np.flatnonzero(self.key[place] != h)
        if len(miss):
            pick, number = unique_pieces(h[miss])
            if len(self.off) + len(pick) > self.limit and len(self.off) > 1:
                self.__init__(self.limit)
                return self.encode(h, encode)
            ids, off = encode(miss[pick])
            slot[miss] = len(self.off) - 1 + number
            new = h[miss[pick]]
            self.key[new & self.mask], self.slot[new & self.mask] = new, len(self.off) - 1 + np.arange(len(new))
            self.ids, self.off = np.concatenate([self.ids, ids.astype(np.int32)]), np.concatenate([self.off, self.off[-1] + off[1:]])
        return gather(self.off, self.ids, slot)
