"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Text is cut in front of each run of spaces (no piece has a space mark behind
another character, so no merge crosses such a cut); every distinct word of a
run of documents is encoded once (a bounded cache carries words over to later
runs).  Its characters lie in flat symbol arrays.
In a round every word finds its smallest pair rank (segmented minimum), all
words merge their leftmost pair of that rank at the same time, and the arrays
are compacted; words without a mergeable pair leave.  A word longer than
``LONG`` symbols goes through an agenda (heap) instead, which gives the same
merges in n log n.

Decoding concatenates the pieces of all ids, turns space marks into spaces and
drops the leading one; bytes that form no valid character become U+FFFD.

Defined cases: a null text is empty; an empty text has the begin and end ids
only; characters outside the vocabulary become their UTF-8 bytes; the literal
space mark counts as a space; repeated rows each keep a row; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import flat
from .common import needed

MARK = "▁"
LONG = 200
NO_RANK = np.int64(1 << 40)


class Model:
    """Vocabulary of a SentencePiece BPE model: symbols, merge table, byte pieces and output bytes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.n, self.bos, self.eos = n, sp.bos_id(), sp.eos_id()
        names = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        normal = {p: i for i, p in enumerate(names) if not special[i]}
        self.byte_id = np.zeros(256, np.int64)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[int(names[i][3:5], 16)] = i
        # Characters: single-character pieces, by code point.
        chars = sorted((ord(p), i) for p, i in normal.items() if len(p) == 1)
        self.code, self.code_id = np.array([c for c, _ in chars], np.int64), np.array([i for _, i in chars], np.int64)
        # Pairs: every split of a piece into two pieces; pieces rank by falling score.
        scores = np.array([sp.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1]
        pairs = sorted((normal[p[:c]] * n + normal[p[c:]], rank[i], i) for p, i in normal.items()
                       for c in range(1, len(p)) if p[:c] in normal and p[c:] in normal)
        self.pair = np.array([p for p, _, _ in pairs], np.int64)
        self.pair_rank = np.array([r for _, r, _ in pairs], np.int64)
        self.pair_id = np.array([i for _, _, i in pairs], np.int64)
        self.merge = {p: (int(r), i) for p, r, i in pairs}
        # Bytes that an id decodes to.
        out = [b"" if sp.is_control(i) else bytes([int(names[i][3:5], 16)]) if sp.is_byte(i)
               else " ⁇ ".encode() if sp.is_unknown(i) else names[i].replace(MARK, " ").encode() for i in range(n)]
        self.out_off = np.append(0, np.cumsum([len(x) for x in out]))
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.is_byte = np.array([sp.is_byte(i) for i in range(n)])
        self.cache = flat.WordCache()

    def lookup(self, left, right):
        """(rank, merged id) of symbol pairs; NO_RANK where they do not merge.  Symbols >= n are unknown characters."""
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        ok = (self.pair[at] == key) & (left < self.n) & (right < self.n)
        return np.where(ok, self.pair_rank[at], NO_RANK), self.pair_id[at]

    # -- encoding ------------------------------------------------------------

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of words, each with its space marks; every word encodes alone."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        at = np.minimum(np.searchsorted(self.code, points), len(self.code) - 1)
        sym = np.where(self.code[at] == points, self.code_id[at], self.n + points)
        off = np.append(0, np.cumsum(size))
        done_sym, done_word = [], []
        for w in np.flatnonzero(size > LONG):
            s = self._agenda(sym[off[w]:off[w + 1]].tolist())
            done_sym.append(np.array(s, np.int64))
            done_word.append(np.full(len(s), w))
        word = np.repeat(np.arange(len(words)), size)
        live = size[word] <= LONG
        sym, word = sym[live], word[live]
        rank, merged = self._pairs(sym, word)
        while len(sym):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            n = np.diff(np.append(first, len(sym)))
            best = np.minimum.reduceat(rank, first)
            idle = np.repeat(best == NO_RANK, n)
            if idle.any():
                done_sym.append(sym[idle])
                done_word.append(word[idle])
                go = ~idle
                sym, word, rank, merged = sym[go], word[go], rank[go], merged[go]
                best, n = best[best < NO_RANK], n[best < NO_RANK]
                if not len(sym):
                    break
                first = np.append(0, np.cumsum(n)[:-1])
            hit = np.flatnonzero(rank == np.repeat(best, n))
            hit = hit[np.append(True, word[hit][1:] != word[hit][:-1])]      # leftmost of each word
            sym[hit] = merged[hit]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            moved = hit - np.arange(len(hit))                                # places after compaction
            sym, word, rank, merged = sym[stay], word[stay], rank[stay], merged[stay]
            for at in (moved, moved - 1):                                    # only the pairs beside a merge change
                at = at[(at >= 0) & (at < len(sym))]
                nxt = np.minimum(at + 1, len(sym) - 1)
                r, m = self.lookup(sym[at], sym[nxt])
                rank[at] = np.where((nxt > at) & (word[at] == word[nxt]), r, NO_RANK)
                merged[at] = m
        sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
        word = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        sym, word = self._bytes(sym[order], word[order])
        return sym, np.searchsorted(word, np.arange(len(words) + 1))

    def _pairs(self, sym, word):
        rank, merged = np.full(len(sym), NO_RANK), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            r, m = self.lookup(sym[:-1], sym[1:])
            rank[:-1], merged[:-1] = np.where(word[:-1] == word[1:], r, NO_RANK), m
        return rank, merged

    def _bytes(self, sym, word):
        """Unknown characters as byte pieces."""
        odd = np.flatnonzero(sym >= self.n)
        if not len(odd):
            return sym, word
        raw = [chr(int(c)).encode() for c in sym[odd] - self.n]
        times = np.ones(len(sym), np.int64)
        times[odd] = [len(r) for r in raw]
        start = np.cumsum(times) - times
        sym, word = np.repeat(sym, times), np.repeat(word, times)
        for o, r in zip(odd, raw):
            sym[start[o]:start[o] + len(r)] = self.byte_id[list(r)]
        return sym, word

    def _agenda(self, sym: list[int]) -> list[int]:
        """Merges of one long word: pairs by (rank, place) on a heap, neighbours in a linked list."""
        n, top = len(sym), self.n
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        merge = self.merge
        heap = []

        def offer(a, b):
            if sym[a] < top and sym[b] < top and (m := merge.get(sym[a] * top + sym[b])):
                heapq.heappush(heap, (m[0], a, b, sym[a], sym[b], m[1]))

        for a in range(n - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, sa, sb, m = heapq.heappop(heap)
            if sym[a] != sa or nxt[a] != b or sym[b] != sb:
                continue
            sym[a], sym[b] = m, -1
            nxt[a] = nxt[b]
            if nxt[b] < n:
                prv[nxt[b]] = a
            if prv[a] >= 0:
                offer(prv[a], a)
            if nxt[a] < n:
                offer(a, nxt[a])
        return [s for s in sym if s >= 0]

    def encode(self, buf: np.ndarray, off: np.ndarray):
        """(ids, offsets) of all documents, begin and end ids included."""
        n = len(off) - 1
        raw = buf.tobytes()
        if MARK.encode() in raw:                       # a literal mark is a space
            texts = [raw[a:b].replace(MARK.encode(), b" ") for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            off = np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, n)))
            raw = b"".join(texts)
            buf = np.frombuffer(raw, np.uint8)
        space = buf == 32
        cut = np.zeros(len(buf) + 1, bool)
        cut[off[:-1]] = True                           # the first word of a document gets the dummy space
        if len(buf):
            cut[1:-1] |= space[1:] & ~space[:-1]
        starts = np.flatnonzero(cut[:-1])
        ends = np.append(starts[1:], len(buf))[:len(starts)]
        h = flat.hash_pieces(buf, starts, ends)
        first = np.zeros(len(buf) + 1, bool)
        first[off[:-1]] = True
        head = first[starts]
        h = np.where(head, flat.mix(h ^ np.uint64(0x5851F42D4C957F2D)), h)

        def fresh(at):
            return self.encode_words([(MARK if f else "") + raw[a:b].decode().replace(" ", MARK)
                                      for a, b, f in zip(starts[at].tolist(), ends[at].tolist(), head[at].tolist())])

        out, at = self.cache.encode(h, fresh)
        doc_off = at[np.searchsorted(starts, off)]
        full = np.empty(len(out) + 2 * n, np.int64)
        begin = doc_off[:-1] + 2 * np.arange(n)
        end = doc_off[1:] + 2 * np.arange(n) + 1
        body = np.ones(len(full), bool)
        body[begin] = body[end] = False
        full[begin], full[end], full[body] = self.bos, self.eos, out
        return full, np.append(begin, len(full))

    # -- decoding ------------------------------------------------------------

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[str]:
        data, at = flat.gather(self.out_off, self.out, ids)
        raw, texts = data.tobytes(), []
        edge = at[off].tolist()
        is_byte = self.is_byte[ids]
        odd = flat.per_doc(is_byte, off) > 0
        for d, (a, b) in enumerate(zip(edge, edge[1:])):
            if a < b and raw[a] == 32 and not (is_byte[off[d]] or (off[d] + 1 < off[d + 1] and ids[off[d]] == self.bos and is_byte[off[d] + 1])):
                a += 1
            part = raw[a:b]
            texts.append(_decode_bytes(part) if odd[d] else part.decode())
        return texts


def _decode_bytes(part: bytes) -> str:
    """UTF-8 with every byte of a broken character as U+FFFD."""
    try:
        return part.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(part):
            for n in (1, 2, 3, 4):
                try:
                    out.append(part[i:i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


@functools.cache
def model(path: str) -> Model:
    return Model(path)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded (string) of every row."""
    def run(batches):
        m = model(path)
        for b in batches:
            buf, off = flat.texts_of(b.column("text"))
            for i, j in flat.spans(off):
                ids, at = m.encode(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                data = ids.astype("<u4").view(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), pa.array(np.diff(at)), flat.binary_array(data, at * 4),
                     pa.array(m.decode(ids, at), pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return needed(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded string")
