"""Phrase collocation mining by dynamic itemset counting.

The documents are dealt into ``shards`` by a hash of their id and scanned
shard by shard in a cycle.  Words are counted from the first scan on.  A
phrase of two or three words becomes active in the scan after the one in which
the last of its two subphrases (all words but the last, all but the first) has
reached the threshold so far; it is counted in the next ``shards`` scans, a
full cycle, and its count is then complete.  So lengths interleave, and
3 * shards scans of one shard each end the count.

Which subphrases have reached the threshold, and in which scan, is kept in two
tables of ``SLOTS`` bytes (two slots per hash, a fixed size) that travel as a
compressed broadcast.  Phrases that share slots can only make a phrase active
although its parts are rare; its count is complete all the same, since every
phrase is counted over one full cycle, and the threshold on the count decides.

Counts are kept by 64-bit hash of language and words.  The frequent phrases'
parts are looked up part by part until all are known, which gives the scores;
a last scan brings the texts of the best.  Both stop with an error if one hash
stands for two phrases.  Tasks count what they read before the shuffle, so a
frequent word is one row per task.

Defined cases: a null text is empty; a null language is ``und``; repeated rows
all count; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import cut_lineage

from . import flat
from .common import needed

SLOTS = 1 << 24
NEVER = 255
LONGEST = 3
_KIND = np.zeros(256, np.uint8)                       # 1: between words, 2: between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*range(0x0A, 0x0E), *b".,;:!?"]] = 2


def words(buf: np.ndarray, off: np.ndarray):
    """(lower-cased bytes, starts, ends, document, whether the next word follows in the same piece) of all words."""
    low = flat.LOWER[buf]
    kind = _KIND[low]
    inside = kind == 0
    n = len(low)
    if not n:
        z = np.zeros(0, np.int64)
        return low, z, z, z, np.zeros(0, bool)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end[:-1] &= ~inside[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    piece = np.cumsum((kind == 2) | edge[:n])[s] if len(s) else s
    return low, s, e, np.searchsorted(off, s, "right") - 1, np.append(piece[1:] == piece[:-1], False)[:len(s)]


def phrase_hashes(low, s, e, doc, follows, lang: np.ndarray):
    """[(start words, hashes)] for phrases of 1 to LONGEST words; ``lang`` has a hash per document."""
    h = flat.mix(flat.hash_pieces(low, s, e) + lang[doc])
    out = [(np.arange(len(h)), h)]
    pair = np.flatnonzero(follows)
    out.append((pair, flat.mix(h[pair] * np.uint64(3) + h[pair + 1]) if len(pair) else h[:0]))
    triple = pair[follows[pair + 1]] if len(pair) else pair
    out.append((triple, flat.mix((h[triple] * np.uint64(3) + h[triple + 1]) * np.uint64(5) + h[triple + 2]) if len(triple) else h[:0]))
    return out


def _slots(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The two slots of each hash in a table of ``n`` slots: by its top and by its low bits."""
    return (h >> np.uint64(64 - (n - 1).bit_length())).astype(np.int64), (h & np.uint64(n - 1)).astype(np.int64)


def _slot_column() -> Column:
    return F.explode(F.array(F.shiftrightunsigned("h", 64 - (SLOTS - 1).bit_length()).cast("int"), F.col("h").bitwiseAND(F.lit(SLOTS - 1)).cast("int")))


def _since(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The scan in which a hash is marked as large; NEVER if one of its slots is free."""
    a, b = _slots(h, len(table))
    return np.maximum(table[a], table[b])


def _wanted(rows: DataFrame) -> bytes:
    """Compressed bit table of the hashes ``h`` of ``rows``; at most SLOTS numbers reach the driver."""
    found = np.zeros(SLOTS, bool)
    found[rows.select(_slot_column().alias("s")).distinct().toArrow().column("s").to_numpy()] = True
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(found).tobytes())


def _bits(raw: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)).astype(bool)


def _hits(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = _slots(h, len(table))
    return np.flatnonzero(table[a] & table[b])


def _lang_hash(names: list[str]) -> np.ndarray:
    raw = [x.encode() for x in names]
    off = np.append(0, np.cumsum([len(x) for x in raw])).astype(np.int64)
    h = flat.hash_pieces(np.frombuffer(b"".join(raw), np.uint8), off[:-1], off[1:]) if names else np.zeros(0, np.uint64)
    return flat.mix(h ^ np.uint64(0x6C616E67)) | np.uint64(1)      # apart from the hash of the same letters as a word


def _runs(batch):
    """(bytes, offsets, language names, their hashes) per run of documents of an Arrow batch(text, lang)."""
    buf, off = flat.texts_of(batch.column("text"))
    langs = batch.column("lang").fill_null("und").dictionary_encode()
    names = langs.dictionary.to_pylist()
    hashes, code = _lang_hash(names), langs.indices.to_numpy()
    for i, j in flat.spans(off):
        yield buf[off[i]:off[j]], off[i:j + 1] - off[i], [names[c] for c in code[i:j]], hashes[code[i:j]]


def _counted(h: np.ndarray):
    """(distinct hashes, how often each occurs)."""
    h = np.sort(h)
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.diff(np.append(first, len(h)))


def _added(parts):
    """One (distinct hashes, counts) pair from many."""
    h, c = (np.concatenate([x[k] for x in parts]) for k in range(2))
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(c[order], first) if len(h) else c


HELD, SENT = 1_500_000, 750_000                       # distinct phrases a task holds before it adds them up; and sends them


def scan(shard: DataFrame, t: int, shards: int, large_words: np.ndarray, large_pairs: np.ndarray) -> DataFrame:
    """(n, act, h, c): what the scan ``t`` counts in this shard; act is the scan in which the phrase became active."""
    tables = shard.sparkSession.sparkContext.broadcast([zstandard.ZstdCompressor(level=1).compress(x.tobytes()) for x in (large_words, large_pairs)])

    def count(batches):
        since_w, since_p = (np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8) for x in tables.value)
        held: dict[tuple[int, int], list] = {}
        rows = 0

        def add(n, since, a, b, h):
            """Count the phrases ``h`` whose subphrases are ``a`` and ``b``, as far as they are active."""
            nonlocal rows
            last = np.maximum(_since(since, a), _since(since, b))
            for z in range(max(0, t - shards), t):             # the scan in which the later subphrase became large
                if len(own := h[last == z]):
                    held.setdefault((n, z + 1), []).append(_counted(own))
                    rows += len(held[n, z + 1][-1][0])

        for b in batches:
            for buf, off, _, lang in _runs(b):
                low, s, e, doc, follows = words(buf, off)
                (_, h1), (p2, h2), (p3, h3) = phrase_hashes(low, s, e, doc, follows, lang)
                if t < shards:
                    held.setdefault((1, 0), []).append(_counted(h1))
                    held.setdefault((0, 0), []).append(_counted(np.repeat(lang, np.bincount(doc, minlength=len(lang)))))     # words of the language
                    rows += len(held[1, 0][-1][0])
                add(2, since_w, h1[p2], h1[p2 + 1], h2)
                if t > 1 and len(p3):
                    at = np.searchsorted(p2, p3)               # a triple's two pairs
                    add(3, since_p, h2[at], h2[at + 1], h3)
                if rows > HELD:
                    held = {k: [_added(x)] for k, x in held.items()}
                    rows = sum(len(x[0][0]) for x in held.values())
                    if rows > SENT:
                        yield from (_batch(*k, *x[0]) for k, x in held.items())
                        held, rows = {}, 0
        yield from (_batch(*k, *_added(x)) for k, x in held.items())

    return shard.mapInArrow(count, "n tinyint, act tinyint, h bigint, c bigint")


def _batch(n, act, h, c):
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), n, np.int8)), pa.array(np.full(len(h), act, np.int8)), pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))],
                                      names=["n", "act", "h", "c"])


def _mark(since: np.ndarray, counted: DataFrame, n: int, least: int, t: int) -> np.ndarray:
    """``since`` with scan ``t`` in the free slots of the phrases that have reached the threshold; at most SLOTS numbers reach the driver."""
    got = counted.where((F.col("n") == n) & (F.col("c") >= least)).select(_slot_column().alias("s")).distinct().toArrow().column("s").to_numpy()
    since = since.copy()
    since[got[since[got] == NEVER]] = t
    return since


SLICES = 4                                            # folders of a shard


def deal(docs: DataFrame, shards: int) -> DataFrame:
    """(text, lang, part), written with a folder per part; a shard is the parts with one remainder modulo ``shards``."""
    part = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(shards * SLICES)), F.lit(0)).cast("int")
    return cut_lineage(docs.select("text", "lang", part.alias("part")), partition_by="part")


def frequent(dealt: DataFrame, least: int = 10, shards: int = 2) -> DataFrame:
    """(n, h, c): all words and phrases of up to three words that occur at least ``least`` times in a language.

    Rows with n = 0 hold the number of words of a language, by the language's hash.
    """
    since = [np.full(SLOTS, NEVER, np.uint8), np.full(SLOTS, NEVER, np.uint8)]
    pending, done = None, None
    for t in range(LONGEST * shards):
        raw = scan(dealt.where(F.col("part") % shards == t % shards).select("text", "lang"), t, shards, *since)
        raw = raw if pending is None else raw.unionByName(pending)
        # tasks have added up what they read, so nothing is left to combine before the shuffle
        sums = raw.repartition("h").groupBy("n", "act", "h").agg(F.sum("c").alias("c"))
        last = F.col("act") + (shards - 1) <= t                 # a full cycle is over
        counted = cut_lineage(sums.where(~last | (F.col("c") >= least)))
        full = counted.where(last).select("n", "h", "c")
        done = full if done is None else done.unionByName(full)
        pending = counted.where(~last)
        since = [_mark(since[0], counted, 1, least, t) if t < shards else since[0], _mark(since[1], counted, 2, least, t)]
    return cut_lineage(done)


PARTS = "n tinyint, h bigint, lh bigint, w1 bigint, w2 bigint, w3 bigint, p1 bigint, p2 bigint"


def parts(dealt: DataFrame, counts: DataFrame, shards: int) -> DataFrame:
    """``counts`` of phrases with the hashes of their language, words and (of three words) pairs.

    Part by part, each time for the phrases not yet known: most are found in the first.
    """
    spark = dealt.sparkSession
    left, found = counts.where("n > 1"), None
    for t in range(shards * SLICES):
        table = spark.sparkContext.broadcast(_wanted(left))

        def run(batches, table=table):
            want = _bits(table.value)
            sent = np.zeros(1 << 20, np.uint64)              # phrases this task has sent, each at one place; it only saves work
            for b in batches:
                for buf, off, _, lang in _runs(b):
                    low, s, e, doc, follows = words(buf, off)
                    (_, h1), *longer = phrase_hashes(low, s, e, doc, follows, lang)
                    pair_at, h2 = longer[0]
                    for n, (p, h) in enumerate(longer, 2):
                        hit = _new(_hits(want, h), h, sent)
                        w = p[hit]
                        none = pa.nulls(len(hit), pa.int64())
                        cols = [h[hit], lang[doc[w]], h1[w], h1[w + 1]]
                        if n == 3:
                            at = np.searchsorted(pair_at, w)
                            cols += [h1[w + 2], h2[at], h2[at + 1]]
                        cols = [pa.array(c.view(np.int64)) for c in cols] + [none] * (7 - len(cols))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), n, np.int8)), *cols], names=[c.split()[0] for c in PARTS.split(", ")])

        rows = dealt.where(F.col("part") == t).select("text", "lang").mapInArrow(run, PARTS)
        same = (F.min("w1") == F.max("w1")) & (F.min("w2") == F.max("w2")) & (F.min("lh") == F.max("lh"))
        one = rows.groupBy("n", "h").agg(F.min("lh").alias("lh"), *[F.min(c).alias(c) for c in ("w1", "w2", "w3", "p1", "p2")], same.alias("same"))
        one = one.withColumn("lh", F.when(F.col("same"), F.col("lh")).otherwise(F.raise_error(F.lit("two phrases have one hash")))).drop("same")
        got = cut_lineage(left.join(one, ["n", "h"]))
        found = got if found is None else found.unionByName(got)
        left = cut_lineage(left.join(got.select("n", "h"), ["n", "h"], "left_anti"))
        if left.isEmpty():
            break
    return found


def _new(hit: np.ndarray, h: np.ndarray, sent: np.ndarray) -> np.ndarray:
    """One of each distinct hash among ``h[hit]`` that the task has not sent; it counts as sent from now on."""
    hit = hit[sent[h[hit] & np.uint64(0xFFFFF)] != h[hit]]
    if len(hit):
        pick, _ = flat.unique_pieces(h[hit])
        hit = hit[pick]
        sent[h[hit] & np.uint64(0xFFFFF)] = h[hit]
    return hit


def texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``chosen``(n, h, ...) with lang and phrase; tasks send phrases whose slots hold a chosen one, the join keeps the chosen."""
    table = docs.sparkSession.sparkContext.broadcast(_wanted(chosen))

    def run(batches):
        want = _bits(table.value)
        sent = np.zeros(1 << 20, np.uint64)
        for b in batches:
            for buf, off, names, lang in _runs(b):
                low, s, e, doc, follows = words(buf, off)
                data = np.append(low, np.uint8(32))
                for n, (p, h) in enumerate(phrase_hashes(low, s, e, doc, follows, lang)[1:], 2):
                    hit = _new(_hits(want, h), h, sent)
                    if not len(hit):
                        continue
                    w = p[hit][:, None] + np.arange(n)
                    start, size = np.full((len(hit), 2 * n - 1), len(low)), np.ones((len(hit), 2 * n - 1), np.int64)     # words and a space between
                    start[:, ::2], size[:, ::2] = s[w], e[w] - s[w]
                    end = np.cumsum(size.ravel())
                    text = data[np.arange(end[-1]) + np.repeat(start.ravel() - (end - size.ravel()), size.ravel())]
                    phrase = flat.binary_array(text, np.append(0, end[2 * n - 2::2 * n - 1])).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), n, np.int8)), pa.array(h[hit].view(np.int64)),
                                                      pa.array([names[d] for d in doc[w[:, 0]].tolist()], pa.string()), phrase], names=["n", "h", "lang", "phrase"])

    rows = docs.select("text", "lang").mapInArrow(run, "n tinyint, h bigint, lang string, phrase string")
    same = F.when(F.min("phrase") == F.max("phrase"), F.min("phrase")).otherwise(F.raise_error(F.lit("two phrases have one hash")))
    return chosen.join(rows.join(chosen.select("n", "h"), ["n", "h"], "left_semi").groupBy("n", "h").agg(F.min("lang").alias("lang"), same.alias("phrase")), ["n", "h"])


def whole(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(15,0)")


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000, shards: int = 2) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of two or three words.

    score is the smallest floor(1000000 * a * a / (l * r)) over the cuts of the
    phrase (ties: the first cut), in 38-digit arithmetic.  A phrase inside a
    longer one that has at least ``share`` percent of its occurrences is dropped.
    """
    d = needed(docs, "doc_id", "text", "lang").withColumn("lang", F.coalesce("lang", F.lit("und")))
    dealt = deal(d, shards)
    counts = frequent(dealt, least, shards)
    cand = parts(dealt, counts, shards).withColumnRenamed("c", "a")

    def with_count(df, part, n, name):
        c = counts.where(F.col("n") == n).select(F.col("h").alias("k"), F.col("c").alias(name))
        return df.join(c, F.col(part) == F.col("k")).drop("k")

    none = F.lit(None).cast("bigint")
    two = with_count(with_count(cand.where("n = 2"), "w1", 1, "l"), "w2", 1, "r")
    longer = (cand.where("n = 3").select(F.explode(F.array("p1", "p2")).alias("k"), F.col("a").alias("f")).groupBy("k").agg(F.max("f").alias("f")))
    two = two.join(longer, F.col("h") == F.col("k"), "left").where(F.col("f").isNull() | (whole("f") * 100 < whole("a") * share))
    three = cand.where("n = 3")
    for part, n, name in (("w1", 1, "l"), ("p2", 2, "r"), ("p1", 2, "l2"), ("w3", 1, "r2")):
        three = with_count(three, part, n, name)
    both = two.select("n", "h", "lh", "a", "l", "r", none.alias("l2"), none.alias("r2")).unionByName(three.select("n", "h", "lh", "a", "l", "r", "l2", "r2"))
    ratio = "cast((1000000BD * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0))) div (cast({l} as decimal(15,0)) * cast({r} as decimal(15,0))) as bigint)"
    first, second = F.expr(ratio.format(a="a", l="l", r="r")), F.expr(ratio.format(a="a", l="l2", r="r2"))
    later = F.col("s2") < F.col("s1")
    scored = (both.withColumn("s1", first).withColumn("s2", second)
              .select("n", "h", "lh", "a", F.when(later, F.col("l2")).otherwise(F.col("l")).alias("l"), F.when(later, F.col("r2")).otherwise(F.col("r")).alias("r"),
                      F.when(later, F.col("s2")).otherwise(F.col("s1")).alias("score")))
    # the best by score and count, all that tie with the last one included; no task ranks a whole language
    ahead = scored.withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(64))).withColumn("place", F.expr("rank() over (partition by lh, salt order by score desc, a desc)"))
    ahead = ahead.where(F.col("place") <= top).withColumn("place", F.expr("rank() over (partition by lh order by score desc, a desc)")).where(F.col("place") <= top)
    chosen = texts(dealt, cut_lineage(ahead.drop("salt", "place")))
    order = F.expr("row_number() over (partition by lang order by score desc, a desc, phrase)").cast("bigint")
    total = counts.where("n = 0").select(F.col("h").alias("k"), F.col("c").alias("total"))
    out = chosen.join(total, F.col("lh") == F.col("k")).withColumn("rank", order).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
