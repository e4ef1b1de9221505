"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

P(token | context) = P(class | context) * P(leaf | class, context) * P(token | leaf).
The ``CLASSES`` classes hold ``LEAVES`` leaves each: the end and the most
frequent tokens are leaves of their own, the other tokens share leaves by how
they end.  Both softmaxes have the same features: a bias, the previous token, the
previous two (n-grams) and the token before the previous one (skip), hashed
into rows of weights; the second factor's rows are hashed with the class.
Inside a leaf a token has its add-one share, with one unknown type per leaf, so
scores are a proper distribution.

Training: the biases are the classes' and leaves' log shares.  In each of
``ROUNDS`` rounds the tasks sum the gradient of the log-likelihood per row of
weights over every token of every training document, and one step is made from
the sums of all tasks, scaled by how often each row was active; the new weights
go out with the next round.  Which documents share a task therefore does not
matter.  The number of rows follows the number of training tokens, from
``LEAST_ROWS`` to ``MOST_ROWS`` (the weights travel as a broadcast of at most
8 MB; beyond that features share rows).

The gradient is what was seen less what the model expects.  The first does not
change and is summed once.  For the second the texts are read once: equal
contexts of a block of tokens (the same active rows, and the same class in the
second factor) become one with a count, and the rounds read these.

Disk: the sums of a task take the same room however little it reads, so small
splits share a task until it has about ``TASK_TOKENS`` tokens.  The sums and the
weights of a round are dropped when its step is made.

Counts: exact over all training tokens.  The ``FREQUENT`` most frequent ones are
broadcast (a fixed number); the others of each document meet their counts in a
join on the token's hash, so nothing that grows with the corpus is sent round.

Defined cases: a null text is empty and has the end token only; without
training rows every count is 0; repeated rows each keep a row; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import cut_lineage, few_rows_at_once, shuffles_dropped

from . import flat
from .common import crc_fold, needed

CLASSES, LEAVES, SINGLES = 16, 16, 64              # SINGLES: the end and the tokens that are leaves by themselves
FREQUENT = 1 << 18
LEAST_ROWS, MOST_ROWS, TOKENS_A_ROW = 1 << 10, 1 << 16, 64
ROUNDS, DAMP, LIMIT = 8, 8.0, 8.0
FEATURES, BATCH = 3, 4096
CHUNK = 1 << 17                                    # contexts whose expectations are held at once
BLOCK = 1 << 10                                    # rows of weights whose gradients travel together
MERGE = 256                                        # gradient sums of tasks added up in one task
TASK_TOKENS = 1 << 22                              # of small splits that share a task, and so its gradient sums
SHARED_TOKENS = 1 << 19                            # whose equal contexts become one
END = np.uint64(0x656E64)
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True


def tokens(buf: np.ndarray, off: np.ndarray):
    """(hash, leaf by ending, document offsets) of all tokens, the end of every document included."""
    low = flat.LOWER[buf]
    ws, we, woff = flat.words_of(low, off)
    h = flat.hash_pieces(low, ws, we)
    leaf = np.zeros(len(ws), np.int64)
    if len(ws):
        stop = _STOP[low[we - 1]] & (we - ws > 1)
        last = np.where(stop, we - 2, we - 1)
        byte = lambda k: np.where(last - k >= ws, low[np.maximum(last - k, 0)], 0).astype(np.uint64)
        first = SINGLES // LEAVES
        cls = first + (flat.mix(byte(0) * np.uint64(256) + byte(1) + np.uint64(7)) % np.uint64(CLASSES - first)).astype(np.int64)
        leaf = cls * LEAVES + (flat.mix(byte(2) * np.uint64(2) + stop.astype(np.uint64) + np.uint64(99)) % np.uint64(LEAVES)).astype(np.int64)
    n = len(off) - 1
    end_at = woff[1:] + np.arange(n)
    body = np.ones(len(h) + n, bool)
    body[end_at] = False
    all_h, all_l = np.full(len(body), END, np.uint64), np.zeros(len(body), np.int64)
    all_h[body], all_l[body] = h, leaf
    return all_h, all_l, woff + np.arange(n + 1)


class Vocabulary:
    """Counts of the frequent tokens in a direct-mapped table, and the tokens that are leaves by themselves."""

    def __init__(self, h: np.ndarray, c: np.ndarray):
        order = np.lexsort((h, -c))
        h, c = h[order], c[order]
        self.mask = np.uint64((1 << 20) - 1)
        self.key, self.count = np.zeros(1 << 20, np.uint64), np.zeros(1 << 20, np.int64)
        at = (h & self.mask)[::-1]                       # the more frequent of two tokens with one place stays
        self.key[at], self.count[at] = h[::-1], c[::-1]
        top = h[h != END][:SINGLES - 1]
        self.single = np.sort(top)
        leaf_of = {int(x): k + 1 for k, x in enumerate(top)}
        self.single_leaf = np.array([leaf_of[int(x)] for x in self.single], np.int64)

    def counts(self, h):
        """(count, found) of tokens; not found: the token's count is not held here."""
        at = h & self.mask
        ok = self.key[at] == h
        return np.where(ok, self.count[at], 0), ok

    def leaves(self, h, leaf):
        if not len(self.single):
            return leaf
        at = np.minimum(np.searchsorted(self.single, h), len(self.single) - 1)
        return np.where(self.single[at] == h, self.single_leaf[at], leaf)


def features(h: np.ndarray, cls: np.ndarray, off: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """[FEATURES, tokens] rows of weights that are active for each token, in the first and in the second factor."""
    n = len(h)
    place = np.arange(n) - np.repeat(off[:-1], np.diff(off))

    def back(k):
        out = np.zeros(n, np.uint64)
        out[k:] = h[:-k] if n > k else h[:0]
        out[place < k] = np.uint64(k)
        return out

    w1, w2 = back(1), back(2)
    last = np.uint64(rows - 1)                           # rows is a power of two
    given = (cls.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    one, two = np.empty((FEATURES, n), np.uint16), np.empty((FEATURES, n), np.uint16)
    for i, k in enumerate((w1 * np.uint64(3) + np.uint64(1), (w1 * np.uint64(31)) ^ flat.mix(w2), w2 * np.uint64(5) + np.uint64(2))):
        k = k + np.uint64(i << 60)
        one[i], two[i] = flat.mix(k) & last, flat.mix(k + given) & last
    return one, two


def contexts(feats: np.ndarray, cls: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different contexts of some tokens: active rows [FEATURES, contexts], class, and how many tokens have each."""
    key = np.zeros(feats.shape[1], np.uint64)
    for f in feats:
        key = (key << np.uint64(16)) | f.astype(np.uint64)
    key = (key << np.uint64(8)) | (np.uint64(0) if cls is None else cls.astype(np.uint64))
    key, times = np.unique(key, return_counts=True)
    return np.stack([(key >> np.uint64(8 + 16 * i)).astype(np.uint16) for i in range(FEATURES - 1, -1, -1)]), key.astype(np.uint8), times.astype(np.uint32)


class Room:
    """Arrays that a task's passes share; fresh ones for every batch would cost more than the sums."""

    def __init__(self, weights: np.ndarray):
        width, kind = weights.shape[1], weights.dtype
        self.z, self.row, self.one = np.empty((BATCH, width), kind), np.empty((BATCH, width), kind), np.ones(width, kind)
        self.expected = np.empty((width, CHUNK))


def scores(bias: np.ndarray, weights: np.ndarray, feats: np.ndarray, cls: np.ndarray | None, room: Room) -> np.ndarray:
    """[at most BATCH contexts, classes] sums of the active rows and the bias (that of ``cls``, if given), in ``room``."""
    n = feats.shape[1]
    z, row = room.z[:n], room.row[:n]
    np.take(weights, feats[0], axis=0, out=z, mode="clip")       # no index is outside; "clip" writes without a copy
    for f in feats[1:]:
        np.take(weights, f, axis=0, out=row, mode="clip")
        z += row
    if cls is None:
        z += bias
    else:
        np.take(bias, cls, axis=0, out=row, mode="clip")
        z += row
    return z


class Model:
    """Biases and weights of both factors; ``mass`` of the leaves."""

    def __init__(self, leaf_counts: np.ndarray, mass: np.ndarray, rows: int):
        by = leaf_counts.reshape(CLASSES, LEAVES)
        total = np.maximum(by.sum(axis=1), 1e-9)
        self.rows, self.log_mass = rows, np.log10(mass)
        self.bias = np.log(total / total.sum()).astype(np.float32), np.log(np.maximum(by, 1e-9) / total[:, None]).astype(np.float32)
        self.weights = np.zeros((rows, CLASSES), np.float32), np.zeros((rows, LEAVES), np.float32)

    def log10(self, h, leaf, off) -> np.ndarray:
        """log10 of P(class) * P(leaf | class) of every token."""
        cls, sub = leaf // LEAVES, leaf % LEAVES
        out = np.zeros(len(h))
        for k, (feats, target) in enumerate(zip(features(h, cls, off, self.rows), (cls, sub))):
            room = Room(self.weights[k])
            for a in range(0, len(h), BATCH):
                z = slice(a, a + BATCH)
                x = scores(self.bias[k], self.weights[k], feats[:, z], cls[z] if k else None, room)
                out[z] += x[np.arange(len(x)), target[z]]
                np.exp(x, out=x)
                out[z] -= np.log(x @ room.one)
        return out / np.log(10)

    def seen(self, k: int, feats: np.ndarray, target: np.ndarray, sums: np.ndarray) -> None:
        """Add to ``sums`` [classes + 1, rows] how often each target met each row, and how often the row was active."""
        width = len(sums) - 1
        for f in feats:
            n = np.bincount(f.astype(np.int64) + target.astype(np.int64) * self.rows, minlength=self.rows * width).reshape(width, -1)
            sums[:-1] += n
            sums[-1] += n.sum(axis=0)

    def expect(self, k: int, feats: np.ndarray, cls: np.ndarray, times: np.ndarray, sums: np.ndarray, room: Room) -> None:
        """Take from ``sums`` [classes, rows] how often the model expects each target to meet each row."""
        for c0 in range(0, len(times), CHUNK):
            n = min(CHUNK, len(times) - c0)
            for a in range(c0, c0 + n, BATCH):
                z = slice(a, min(a + BATCH, c0 + n))
                p = scores(self.bias[k], self.weights[k], feats[:, z], cls[z] if k else None, room)
                np.exp(p, out=p)
                np.multiply(p.T, times[z] / (p @ room.one), out=room.expected[:, a - c0:z.stop - c0])
            for f in feats[:, c0:c0 + n]:
                f = f.astype(np.int64)
                for c in range(len(sums)):
                    sums[c] -= np.bincount(f, weights=room.expected[c, :n], minlength=self.rows)

    def gradient(self, h, leaf, off, sums: list[np.ndarray]) -> None:
        """Add to ``sums`` (per factor [classes + 1, rows]) the gradient of the log-likelihood per row, and how often each was active."""
        cls, sub = leaf // LEAVES, leaf % LEAVES
        for k, (feats, target) in enumerate(zip(features(h, cls, off, self.rows), (cls, sub))):
            self.seen(k, feats, target, sums[k])
            self.expect(k, *contexts(feats, cls if k else None), sums[k][:-1], Room(self.weights[k]))

    def step(self, sums: list[np.ndarray]) -> None:
        """One step along the gradient, for each row by the curvature that its activity lets expect."""
        share = np.exp(self.bias[0].astype(np.float64)), np.full(LEAVES, 2.0 / LEAVES)
        self.weights = tuple(np.clip(w + (s[:-1] / (FEATURES * s[-1] * p[:, None] + DAMP)).T, -LIMIT, LIMIT).astype(np.float32)
                             for w, s, p in zip(self.weights, sums, share))


def fit_counts(train: DataFrame) -> DataFrame:
    """(h, c, grp): exact counts of every training token."""
    def count(batches):
        held, rows = [], 0

        def flush():
            h, c, g = (np.concatenate([x[k] for x in held]) for k in range(3))
            pick, number = flat.unique_pieces(h)
            return h[pick], np.bincount(number, weights=c, minlength=len(pick)).astype(np.int64), g[pick]

        for b in batches:
            buf, off = flat.texts_of(b.column("text"))
            for i, j in flat.spans(off):
                h, g, _ = tokens(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                pick, number = flat.unique_pieces(h)
                held.append((h[pick], np.bincount(number, minlength=len(pick)), g[pick]))
                rows += len(pick)
                if rows > 2_000_000:
                    held = [flush()]
                    rows = len(held[0][0])
                    if rows > 1_000_000:
                        yield _counted(*held[0])
                        held, rows = [], 0
        if held:
            yield _counted(*flush())

    return train.select("text").mapInArrow(count, "h bigint, c bigint, grp int").groupBy("h").agg(F.sum("c").alias("c"), F.min("grp").alias("grp"))


def _counted(h, c, g):
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c), pa.array(g.astype(np.int32))], names=["h", "c", "grp"])


def frequent(vocab: DataFrame, most: int = FREQUENT) -> Vocabulary:
    """The tokens above a count threshold, at most ``most`` of them; the threshold comes from a histogram of at most 2,048 rows."""
    level = F.floor(F.log2("c") * 32).cast("int")
    hist = sorted(((r.l, r["n"]) for r in vocab.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, least = 0, None
    for lev, n in hist:
        total += n
        if total > most:
            break
        least = lev
    got = vocab.where(level >= least if least is not None else F.lit(False)).select("h", "c").toArrow()
    return Vocabulary(got.column("h").to_numpy().view(np.uint64), got.column("c").to_numpy())


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpacked(raw: bytes, kind=np.float32) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def fit_weights(train: DataFrame, vocab: Vocabulary, model: Model, n_all: int) -> Model:
    """``model`` after ``ROUNDS`` steps, each along the gradient over all training documents; ``n_all``: tokens in them."""
    spark = train.sparkSession
    shapes = [w.shape[1] for w in model.weights]
    n_blocks = -(-model.rows // BLOCK)
    most_tasks = -(-n_all // TASK_TOKENS)
    SUMS = "factor int, block int, sums binary"

    def blocks(sums):
        rows = [(k, x, _packed(s[:, x * BLOCK:(x + 1) * BLOCK].astype(np.float32))) for k, s in enumerate(sums) for x in range(n_blocks)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], names=["factor", "block", "sums"])

    def add(key, table):
        total = sum(_unpacked(x).astype(np.float64) for x in table.column("sums").to_pylist()).astype(np.float32)
        return pa.table({"factor": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "sums": pa.array([_packed(total)], pa.binary())})

    def added(rows: DataFrame, tasks: int, heights: list[int]) -> list[np.ndarray]:
        """Sums over ``tasks`` tasks, per factor [height, rows of weights]."""
        while tasks > MERGE:
            tasks = -(-tasks // MERGE)
            rows = rows.groupBy("factor", "block", F.pmod(F.spark_partition_id(), F.lit(tasks)).alias("salt")).applyInArrow(add, SUMS)
        got = rows.groupBy("factor", "block").applyInArrow(add, SUMS).toArrow()     # model.rows rows a factor
        sums = [np.zeros((n, model.rows)) for n in heights]
        for k, x, raw in zip(*[got.column(c).to_pylist() for c in ("factor", "block", "sums")]):
            sums[k][:, x * BLOCK:(x + 1) * BLOCK] = _unpacked(raw).reshape(heights[k], -1)
        return sums

    words = spark.sparkContext.broadcast(vocab)
    empty = spark.sparkContext.broadcast(model)

    def code(batches):
        v, m = words.value, empty.value
        sums, held, n_held = [np.zeros((n + 1, m.rows)) for n in shapes], [], 0

        def flush():
            h, leaf, size = (np.concatenate([x[i] for x in held]) for i in range(3))
            cls = leaf // LEAVES
            for k, feats in enumerate(features(h, cls, np.concatenate([[0], np.cumsum(size)]), m.rows)):
                m.seen(k, feats, leaf % LEAVES if k else cls, sums[k])
                f, c, n = contexts(feats, cls if k else None)
                for a in range(0, len(n), CHUNK):       # a row a record: few of them are held on the way
                    row = zip((k, *[_packed(x[..., a:a + CHUNK]) for x in (f, c, n)]), (pa.int32(), *[pa.binary()] * 3))
                    yield pa.RecordBatch.from_arrays([*[pa.array([x], t) for x, t in row], pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary())],
                                                     names=["factor", "feats", "cls", "times", "block", "sums"])

        for b in batches:
            buf, off = flat.texts_of(b.column("text"))
            for i, j in flat.spans(off, 2_000_000):
                h, leaf, t_off = tokens(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                held.append((h, v.leaves(h, leaf).astype(np.uint8), np.diff(t_off)))
                n_held += len(h)
                if n_held >= SHARED_TOKENS:
                    yield from flush()
                    held, n_held = [], 0
        if n_held:
            yield from flush()
        if sums[0].any():
            out = blocks(sums)
            none = [pa.nulls(out.num_rows, pa.binary())] * 3
            yield pa.RecordBatch.from_arrays([out.column("factor"), *none, out.column("block"), out.column("sums")], names=["factor", "feats", "cls", "times", "block", "sums"])

    docs = train.select("text").coalesce(most_tasks)                        # never more tasks than splits
    tasks = docs.rdd.getNumPartitions()                                     # read off the plan, no job runs
    coded = cut_lineage(docs.mapInArrow(code, "factor int, feats binary, cls binary, times binary, block int, sums binary"))
    words.destroy()
    empty.destroy()
    with shuffles_dropped(spark):
        seen = added(coded.where("block is not null").select("factor", "block", "sums"), tasks, [n + 1 for n in shapes])
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def expected(batches):
            m = shared.value
            sums, room, any_ = [np.zeros((n, m.rows)) for n in shapes], Room(m.weights[0]), False     # both factors are as wide
            for b in batches:
                for row in zip(*[b.column(c) for c in ("factor", "feats", "cls", "times")]):
                    k, f, c, n = (x.as_py() for x in row)
                    m.expect(k, _unpacked(f, np.uint16).reshape(FEATURES, -1), _unpacked(c, np.uint8), _unpacked(n, np.uint32), sums[k], room)
                    any_ = True
            if any_:
                yield blocks(sums)

        with shuffles_dropped(spark), few_rows_at_once(spark):
            some = coded.where("feats is not null").select("factor", "feats", "cls", "times").coalesce(most_tasks)
            less = added(some.mapInArrow(expected, SUMS), some.rdd.getNumPartitions(), shapes)
        shared.destroy()
        model.step([np.vstack([s[:-1] + e, s[-1:]]) for s, e in zip(seen, less)])
    return model


def fit(train: DataFrame) -> tuple[DataFrame, Vocabulary, Model, int, int]:
    """(counts, frequent tokens, model, training tokens, distinct ones)."""
    counts = cut_lineage(fit_counts(train))
    totals = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    n_all, n_types = int(totals[0] or 0), int(totals[1])
    vocab = frequent(counts)
    single = [int(np.uint64(x).view(np.int64)) for x in vocab.single]
    leaf_counts, mass = np.zeros(CLASSES * LEAVES), np.ones(CLASSES * LEAVES)
    leaf_counts[:len(single) + 1] = 0.5
    leaf_counts[SINGLES:] = 0.5
    for r in counts.where(F.col("h").isin([*single, int(END)])).collect():                  # SINGLES rows at most
        leaf_counts[0 if r.h == int(END) else vocab.single_leaf[single.index(r.h)]] += r.c
    for r in counts.where(~F.col("h").isin([*single, int(END)])).groupBy("grp").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        leaf_counts[r.grp] += r.c
        mass[r.grp] = r.c + r.v + 1
    rows = min(MOST_ROWS, max(LEAST_ROWS, 1 << (n_all // TOKENS_A_ROW).bit_length()))
    model = Model(leaf_counts, mass, rows)
    return counts, vocab, fit_weights(train, vocab, model, n_all) if n_all else model, n_all, n_types


def score(docs: DataFrame, train: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10) of every row of ``docs``; learned from ``train``."""
    spark = docs.sparkSession
    counts, vocab, model, n_all, n_types = fit(needed(train, "doc_id", "text"))
    shared = spark.sparkContext.broadcast((vocab, model))

    def run(batches):
        v, m = shared.value
        for b in batches:
            buf, off = flat.texts_of(b.column("text"))
            rest = [b.column(c) for c in ("doc_id", "row")]
            for i, j in flat.spans(off, 2_000_000):
                h, leaf, t_off = tokens(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                leaf = v.leaves(h, leaf)
                lp = m.log10(h, leaf, t_off)
                c, found = v.counts(h)
                grouped = leaf >= SINGLES
                log_c = np.log10(c + 1.0)
                doc = flat.doc_of(t_off)
                n = j - i
                known = np.bincount(doc, weights=c > 0, minlength=n).astype(np.int64)
                held = np.bincount(doc, weights=log_c, minlength=n)
                model_ = np.bincount(doc, weights=lp + np.where(grouped, log_c - m.log_mass[leaf], 0.0), minlength=n)
                # tokens whose count is not held: distinct per document, to be joined
                miss = np.flatnonzero(~found)
                pick, number = flat.unique_pieces(flat.mix(h[miss] ^ flat.mix(doc[miss].astype(np.uint64) + np.uint64(1))))
                tf = np.bincount(number, minlength=len(pick))
                pick_at = miss[pick]
                order = np.argsort(doc[pick_at], kind="stable")
                pick_at, tf = pick_at[order], tf[order]
                r_off = np.searchsorted(doc[pick_at], np.arange(n + 1))
                rare = pa.StructArray.from_arrays([pa.array(h[pick_at].view(np.int64)), pa.array(tf.astype(np.int32)),
                                                   pa.array(grouped[pick_at])], names=["h", "tf", "grouped"])
                yield pa.RecordBatch.from_arrays(
                    [*[x.slice(i, n) for x in rest], pa.array(np.diff(t_off)), pa.array(known), pa.array(held), pa.array(model_), flat.list_array(rare, r_off)],
                    names=["doc_id", "row", "n_tokens", "known", "held", "model", "rare"])

    d = needed(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    t = cut_lineage(d.mapInArrow(run, "doc_id bigint, row bigint, n_tokens bigint, known bigint, held double, model double, "
                                      "rare array<struct<h:bigint,tf:int,grouped:boolean>>"))
    shared.destroy()
    pairs = t.select("row", F.explode("rare").alias("r")).select("row", "r.h", "r.tf", "r.grouped")
    lc = F.col("tf") * F.log10(F.col("c") + 1)
    more = (pairs.join(counts.select("h", "c"), "h").groupBy("row")
            .agg(F.sum("tf").alias("k2"), F.sum(lc).alias("b2"), F.sum(F.when(F.col("grouped"), lc).otherwise(0.0)).alias("m2")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return t.drop("rare").join(more, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + zero("k2")).alias("n_known"), F.lit(n_all).cast("bigint").alias("train_tokens"),
        (F.col("held") + zero("b2") - F.col("n_tokens") * F.log10(F.lit(float(n_all + n_types + 1)))).alias("base_score"),
        (F.col("model") + zero("m2")).alias("score"))


def held_out(doc_id):
    return crc_fold(doc_id, 7) == 2
