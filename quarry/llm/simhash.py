"""SimHash near-duplicates: fingerprints joined with themselves in binary tries.

Fingerprint: XXH64 (seed 42) of every 4-word shingle votes per bit; a bit is
set when more than half of the shingles set it.  Distinct fingerprints (copies
collapse first) are linked at ``radius`` or fewer differing bits.  Two such
fingerprints agree on at least one of ``radius + 1`` bit blocks, so each block
roots one family of tries: the fingerprints with one value of the block form a
shard, sorted with the block's bits in front.  Inside a shard node pairs are
walked down together, the differing bits add up, and a pair is dropped as soon
as the budget is exceeded.  A shard above ``shard_rows`` fingerprints is cut
into chunks and every pair of its chunks is a work unit of its own, so one hot
block value spreads over many tasks.  A unit returns a spanning forest of its
links (never all pairs); large-star/small-star rounds on written tables turn
the forests into components.

Defined cases: a null or wordless text has fingerprint zero and is linked like
any other; repeated rows each keep a row; a null doc_id never is the smallest
id of a component unless it has no other (then component_id is null); an empty
table gives no rows; other columns are ignored by ``near_duplicates`` and kept
by ``one_of_each``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import cut_lineage

from . import flat
from .common import content_key, free_name, needed
from .lines import map_documents

SEED = 42


def shingle_hashes(buf, off, k: int):
    """XXH64 of every k-word shingle (space-joined, A-Z lowered) of every document, and the document offsets.

    A text of fewer than k words, but one at least, has one shingle: all its words.
    """
    low = flat.LOWER[buf]
    digest, out, counts = xxhash.xxh64_intdigest, [], np.zeros(len(off), np.int64)
    for d in range(len(off) - 1):
        words = low[off[d]:off[d + 1]].tobytes().split()
        n = len(words)
        if n == 0:
            continue
        joined = b" ".join(words)
        if n <= k:
            out.append(np.array([digest(joined, SEED)], np.uint64))
            counts[d + 1] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.append(0, ends[:-1])
        pairs = zip(starts[:n - k + 1].tolist(), (ends[k - 1:] - 1).tolist())
        out.append(np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, n - k + 1))
        counts[d + 1] = n - k + 1
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(counts)


def fingerprints_of(buf, off, k: int) -> np.ndarray:
    h, s_off = shingle_hashes(buf, off, k)
    bits = 2 * flat.bit_votes(h, s_off) > np.diff(s_off)[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """doc_id, key (of the content), fp bigint (the 64 bits) for every row."""
    t = needed(docs, "doc_id", "text", "source").select("doc_id", content_key().alias("key"), "text")
    return map_documents(t, "fp bigint", lambda buf, off: [pa.array(fingerprints_of(buf, off, k).view(np.int64))])


# ---- tries -----------------------------------------------------------------

def trie_pairs(x: np.ndarray, a_lo, a_hi, b_lo, b_hi, depth: int, radius: int, emit) -> None:
    """Walk pairs of trie nodes down together.

    ``x`` holds sorted 64-bit values; a node is a range of it whose values
    share their first ``depth`` bits.  ``emit(i, j)`` gets index arrays of the
    pairs within ``radius`` bits (i != j, every pair once).  Small ranges are
    compared at once; the stack holds blocks of node pairs, so the frontier
    stays bounded.
    """
    stack = [(depth, *(np.asarray(v, np.int64) for v in (a_lo, a_hi, b_lo, b_hi)), np.zeros(len(a_lo), np.int64))]
    while stack:
        d, al, ah, bl, bh, diff = stack.pop()
        if len(al) > 60_000:
            half = len(al) // 2
            stack += [(d, al[:half], ah[:half], bl[:half], bh[:half], diff[:half]), (d, al[half:], ah[half:], bl[half:], bh[half:], diff[half:])]
            continue
        small = ((ah - al) * (bh - bl) <= 16) | (d >= 64)
        if small.any():
            _leaf(x, al[small], ah[small], bl[small], bh[small], radius, emit)
            al, ah, bl, bh, diff = (v[~small] for v in (al, ah, bl, bh, diff))
        if not len(al):
            continue
        bit = np.uint64(1) << np.uint64(63 - d)
        am, bm = _split(x, al, ah, bit), _split(x, bl, bh, bit)
        same = (al == bl) & (ah == bh)
        parts = [(al, am, bl, bm, diff, al == al), (am, ah, bm, bh, diff, al == al),
                 (al, am, bm, bh, diff + 1, al == al), (am, ah, bl, bm, diff + 1, ~same)]
        go = [np.concatenate([p[c][p[5] & (p[0] < p[1]) & (p[2] < p[3]) & (p[4] <= radius)] for p in parts]) for c in range(5)]
        if len(go[0]):
            stack.append((d + 1, *go))


def _split(x, lo, hi, bit):
    """First index in each sorted range whose value has ``bit`` set (all share the bits above)."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        one = np.zeros(len(lo), bool)
        one[open_] = (x[mid[open_]] & bit) != 0
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)


def _leaf(x, al, ah, bl, bh, radius, emit):
    na, nb = ah - al, bh - bl
    n = na * nb
    k = np.repeat(np.arange(len(n)), n)
    off = np.cumsum(n) - n
    r = np.arange(int(n.sum())) - off[k]
    i, j = al[k] + r // nb[k], bl[k] + r % nb[k]
    ok = (i < j) | ((al != bl)[k] & (i != j))
    i, j = i[ok], j[ok]
    ok = np.bitwise_count(x[i] ^ x[j]) <= radius
    emit(i[ok], j[ok])


def forest(n: int, links: list) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of every item that is linked; the root is the smallest index of its component."""
    label = np.arange(n)
    if not links:
        return label[:0], label[:0]
    i, j = np.concatenate([a for a, _ in links]), np.concatenate([b for _, b in links])
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            break
        label = new
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


class Links:
    """Collects links; folds them into a forest whenever many have come, so memory follows the items."""

    def __init__(self, n: int):
        self.n, self.parts, self.held = n, [], 0

    def __call__(self, i, j):
        if len(i):
            self.parts.append((i, j))
            self.held += len(i)
            if self.held > 4 * self.n + 1_000_000:
                self.parts = [forest(self.n, self.parts)]
                self.held = len(self.parts[0][0])


def blocks_of(radius: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of the radius + 1 blocks."""
    edges = [64 * b // (radius + 1) for b in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def join_unit(fp: np.ndarray, side: np.ndarray, start: int, width: int, radius: int):
    """Forest links (fp, fp) of one work unit: rows of side 0 and 1 are paired across, side 2 with itself."""
    rot = (fp << np.uint64(start)) | (fp >> np.uint64((64 - start) % 64)) if start else fp
    got = []
    if (side == 2).any():
        x = np.sort(rot)
        links = Links(len(x))
        trie_pairs(x, [0], [len(x)], [0], [len(x)], width, radius, links)
        member, root = forest(len(x), links.parts)
        got.append((x[member], x[root]))
    else:
        a, b = np.sort(rot[side == 0]), np.sort(rot[side == 1])
        x = np.concatenate([a, b])
        links = Links(len(x))
        if len(a) and len(b):
            trie_pairs(x, [0], [len(a)], [len(a)], [len(x)], width, radius, links)
        member, root = forest(len(x), links.parts)
        got.append((x[member], x[root]))
    u, v = (np.concatenate([g[c] for g in got]) for c in (0, 1))
    back = lambda r: (r >> np.uint64(start)) | (r << np.uint64((64 - start) % 64)) if start else r
    return back(u), back(v)


def links(distinct: DataFrame, radius: int = 4, shard_rows: int = 20_000) -> DataFrame:
    """Spanning links (u, v) of the distinct fingerprints ``fp`` within ``radius`` bits.

    Shards are numbered by a hash into ``buckets`` per block; each bucket is one
    group.  Only the sizes of shards above ``shard_rows`` come back to the
    plan, as a joined table.
    """
    spark = distinct.sparkSession
    blocks = blocks_of(radius)
    value = lambda s, w: F.shiftrightunsigned(F.shiftleft(F.col("fp"), s), 64 - w)
    rows = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), value(s, w).alias("v")) for t, (s, w) in enumerate(blocks)])).alias("b")).select("fp", "b.t", "b.v")
    sizes = rows.groupBy("t", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_rows)
    big = cut_lineage(sizes.select(F.col("t").alias("bt"), F.col("v").alias("bv"), F.ceil(F.col("n") / shard_rows).cast("int").alias("chunks")))
    cut = rows.join(big, (F.col("t") == F.col("bt")) & (F.col("v") == F.col("bv")), "left")
    # A small shard is one unit; of a large one every pair of chunks (c <= e) is a unit.
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    units = F.when(F.col("chunks").isNull(), F.array(F.struct(F.lit(0).alias("c"), F.lit(0).alias("e"), F.lit(2).alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(
            F.least(o, chunk).alias("c"), F.greatest(o, chunk).alias("e"),
            F.when(o == chunk, 2).when(chunk < o, 0).otherwise(1).alias("side"))))
    work = cut.select("fp", "t", "v", "chunks", F.explode(units).alias("u")).select("fp", "t", "v", "u.c", "u.e", "u.side", F.col("chunks").isNull().alias("small"))
    # Small shards of one block share a group: their tries stand side by side under the block's bits.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    work = work.withColumn("g", F.when(F.col("small"), F.pmod(F.xxhash64("t", "v"), F.lit(4 * n))).otherwise(F.xxhash64("t", "v", "c", "e")))

    def join_group(key, df):
        start, width = blocks[int(df["t"].iloc[0])]
        fp, side = df["fp"].to_numpy().view(np.uint64), df["side"].to_numpy()
        if df["small"].iloc[0]:
            u, v = _shards(fp, start, width, radius)
        else:
            u, v = join_unit(fp, side, start, width, radius)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return work.groupBy("t", "small", "g").applyInPandas(join_group, "u bigint, v bigint")


def _shards(fp: np.ndarray, start: int, width: int, radius: int):
    """All shards of one group at once: one pair (root, root) for every value of the block."""
    rot = (fp << np.uint64(start)) | (fp >> np.uint64(64 - start)) if start else fp
    x = np.sort(rot)
    top = x >> np.uint64(64 - width)
    lo = np.flatnonzero(np.append(True, top[1:] != top[:-1]))
    hi = np.append(lo[1:], len(x))
    links_ = Links(len(x))
    trie_pairs(x, lo, hi, lo, hi, width, radius, links_)
    member, root = forest(len(x), links_.parts)
    back = lambda r: (r >> np.uint64(start)) | (r << np.uint64(64 - start)) if start else r
    return back(x[member]), back(x[root])


# ---- components ------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge but the roots: large-star and small-star rounds until all edges lead to roots.

    Every round is written to the shared folder, which cuts the lineage and
    gives the joins two shuffled sides, so that a node with very many
    neighbours is split by the skew join.
    """
    e = cut_lineage(edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).where("u <> v").distinct())
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("k"), F.least("u", "w").alias("m")))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut_lineage(large)
        low = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m"))
        small = (large.join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct())
        e = cut_lineage(small)
        size = e.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
        roots = e.select(F.col("v").alias("r")).distinct()
        if size[0] == size[1] and e.join(roots, F.col("u") == F.col("r"), "left_semi").isEmpty():   # every edge leads to a root
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, k: int = 4, radius: int = 4, shard_rows: int = 20_000) -> DataFrame:
    """doc_id, key, fingerprint (16 hex digits), fp, component_id (smallest doc_id), root (the component's smallest fp) of every row."""
    fps = cut_lineage(fingerprints(docs, k))
    distinct = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    comp = components(links(distinct.select("fp"), radius, shard_rows))
    named = distinct.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = cut_lineage(named)
    ids = cut_lineage(named.groupBy("root").agg(F.min("first_id").alias("component_id")))
    named = cut_lineage(named.join(ids, "root").select(F.col("fp").alias("f"), "component_id", "root"))
    return (fps.join(named, F.col("fp") == F.col("f")).drop("f")
            .select("doc_id", "key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "fp", "component_id", "root"))


def one_of_each(docs: DataFrame, k: int = 4, radius: int = 4) -> DataFrame:
    """The row with the smallest doc_id of every component, with all its columns; of equal doc_ids one row stays."""
    d = near_duplicates(docs, k, radius)
    mine, key, of, n = (free_name(docs, x) for x in ("__key", "__k", "__id", "__n"))
    best = d.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(
        F.min(F.struct("doc_id", "key")).alias("b")).select(F.col("b.doc_id").alias(of), F.col("b.key").alias(key))
    copies = cut_lineage(best.join(d.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias(n)),
                                   F.col(of).eqNullSafe(F.col("doc_id")) & (F.col(key) == F.col("key"))).select(of, key, n))
    named = docs.select(*[F.col(f"`{c}`") for c in docs.columns], content_key().alias(mine))
    hit = named.join(copies, (F.col(mine) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(of)))
    back = [F.col(f"`{c}`") for c in docs.columns]
    single = hit.where(F.col(n) == 1).select(*back)
    repeated = hit.where(F.col(n) > 1).dropDuplicates([of, key]).select(*back)
    return single.unionByName(repeated)
