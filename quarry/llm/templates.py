"""Line dedup by a fixed-depth template tree.

Level one of the tree is a line's token count, the next ``LEAD`` levels are its
leading tokens; a token with a digit is a wildcard everywhere.  A leaf holds the
lines with one count and lead.  In a leaf, a token that at least a ``COMMON``
share of the leaf's different lines have at one place is a constant of the leaf
there, every other token is a variable field.  A line whose constants make up a
``SIMILAR`` share of its tokens after the lead belongs to the template of these
constants; besides, every line is a template of its own (the full path of its
tokens).  A template that recurs in at least ``min_docs`` documents is dropped
from all of them: every line that belongs to it goes, whatever share of its
document it is.  A line of more than ``LONG`` tokens recurs from two documents
on, by its full path.

Copies and near copies of a document count as one document: the documents of a
template are counted by component of their SimHash (4-word windows, ``RADIUS``
differing bits).  So lines that only such copies share stay, for the
near-duplicate stage, and boilerplate goes from the copies as from any other
document.

The tree is never held in one place.  Leaves with too few lines to recur go no
further.  The different lines of the others are dealt by leaf, and by leaf and
salt where a leaf is large; tasks count the tokens of each place and pass on
those with half the share, whose sums over all salts decide.  The constants of a
leaf (a few per place) meet its lines in a join.  Counting is by grouped
aggregates that combine before the shuffle, and no template's lines are gathered.

Defined cases: a null text stays null; lines of fewer than ``MIN_TOKENS`` words
stay; repeated rows each keep a row and are treated alike; an empty table
gives no rows; all columns stay, n_chars follows a changed text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import cut_lineage

from . import flat, simhash
from .lines import distinct_in_doc, keyed, map_documents, normal_lines, remove_hashed

LEAD, MIN_TOKENS, LEAF_TOKENS, LONG = 2, 3, 5, 50       # LEAF_TOKENS: the shortest lines with variable fields
COMMON, SIMILAR = 1 / 3, 1 / 3
SALT_LINES = 100_000                          # lines of a leaf that share a salt
WINDOW, RADIUS = 4, 4                        # of the SimHash
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_WILD = np.uint64(0x57494C44)


def paths(buf: np.ndarray, first: np.ndarray, words: np.ndarray, wh: np.ndarray, ws: np.ndarray, we: np.ndarray):
    """(full path, leaf, token codes) of every line; 0: it has none.  Codes are 16 bits per word of the text, 0 for a wildcard."""
    digits = np.concatenate([[0], np.cumsum(_DIGIT[buf])])
    wild = digits[we] > digits[ws]
    tok = np.where(wild, _WILD, wh)
    size = words.astype(np.uint64)
    full = np.where(words >= MIN_TOKENS, flat.mix(flat.run_hash(tok, first, first + words) + size), np.uint64(0))
    lead = flat.run_hash(tok, first, first + np.minimum(words, LEAD))
    leaf = np.where((words >= LEAF_TOKENS) & (words <= LONG), flat.mix(lead * np.uint64(31) + size) | np.uint64(1), np.uint64(0))
    code = np.where(wild, 0, (flat.mix(tok) >> np.uint64(48)).astype(np.int64) | 1).astype("<u2")
    return full, leaf, code


def fingerprints(buf: np.ndarray, ws: np.ndarray, we: np.ndarray, woff: np.ndarray) -> np.ndarray:
    """64-bit SimHash of every document; one of fewer words than a window has the hash of them all."""
    wh = flat.hash_pieces(buf, ws, we, flat.BYTE_HASH[flat.LOWER])
    win, at = flat.window_hash(wh, woff, WINDOW)
    w_off = np.searchsorted(at, woff)
    fp = np.packbits(2 * flat.bit_votes(win, w_off) > np.diff(w_off)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return np.where(np.diff(woff) < WINDOW, flat.run_hash(wh, woff[:-1], woff[1:]), fp)


def _per_run(buf, off):
    n = len(off) - 1
    doc, number, h, words, first, wh, (ws, we, woff), _ = normal_lines(buf, off)
    full, leaf, code = paths(buf, first, words, wh, ws, we)
    pick, _ = distinct_in_doc(doc, h)
    pick = pick[np.argsort(doc[pick], kind="stable")]
    pick = pick[full[pick] != 0]
    l_off = np.searchsorted(doc[pick], np.arange(n + 1))
    held = np.where(leaf[pick] != 0, words[pick], 0)                  # tokens of lines that have a leaf
    c_off = np.append(0, np.cumsum(held))
    codes = code[np.arange(c_off[-1]) + np.repeat(first[pick] - c_off[:-1], held)]
    item = pa.StructArray.from_arrays(
        [pa.array(h[pick].view(np.int64)), pa.array(words[pick] > LONG), pa.array(full[pick].view(np.int64)), pa.array(leaf[pick].view(np.int64)),
         flat.binary_array(codes.view(np.uint8), 2 * c_off)], names=["h", "long", "path", "leaf", "codes"])
    fp = fingerprints(buf, ws, we, woff)
    return [pa.array(fp.view(np.int64)), pa.array(np.bincount(doc, minlength=n).astype(np.int64)), flat.list_array(item, l_off)]


SCHEMA = "fp bigint, n_lines bigint, `lines` array<struct<h:bigint,long:boolean,path:bigint,leaf:bigint,codes:binary>>"


def _tokens(batch):
    """(line number, place, code) of every token of an Arrow batch(codes), and the lines' token counts."""
    raw, off = flat.texts_of(batch.column("codes").cast(pa.large_binary()))
    n = np.diff(off) // 2
    line = np.repeat(np.arange(len(n)), n)
    return line, np.arange(len(line)) - np.repeat(off[:-1] // 2, n), np.frombuffer(raw.tobytes(), "<u2").astype(np.int64), n


def constants(lines: DataFrame) -> DataFrame:
    """(leaf, place, code) of the tokens that at least a COMMON share of a leaf's different ``lines``(leaf, codes, salts) have at a place."""
    different = cut_lineage(lines.groupBy("leaf", "codes").agg(F.max("salts").alias("salts")))

    def count(batches):
        for b in batches:
            leaf = b.column("leaf").to_numpy()
            line, place, code, _ = _tokens(b)
            start = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1]))
            which = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(leaf))))
            key = (which[line] << 24) | (place << 16) | code
            key.sort()
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            n = np.diff(np.append(first, len(key)))
            key = key[first]
            enough = 2 * n >= COMMON * np.diff(np.append(start, len(leaf)))[key >> 24]
            key, n = key[enough], n[enough]
            yield pa.RecordBatch.from_arrays([pa.array(leaf[start][key >> 24]), pa.array(((key >> 16) & 255).astype(np.int32)), pa.array((key & 65535).astype(np.int32)), pa.array(n)],
                                             names=["leaf", "place", "code", "n"])

    salt = F.pmod(F.xxhash64("codes"), F.col("salts"))
    dealt = different.select("leaf", "codes", salt.alias("salt")).repartition("leaf", "salt").sortWithinPartitions("leaf", "salt")
    seen = dealt.select("leaf", "codes").mapInArrow(count, "leaf bigint, place int, code int, n bigint").groupBy("leaf", "place", "code").agg(F.sum("n").alias("n"))
    size = different.groupBy("leaf").agg(F.count(F.lit(1)).alias("size"))
    return seen.join(size, "leaf").where(F.col("n") >= F.lit(COMMON) * F.col("size")).select("leaf", "place", "code")


def templates(lines: DataFrame, fixed: DataFrame) -> DataFrame:
    """(row, fp, h, path) of the ``lines``(row, fp, h, leaf, codes) that belong to a template of their leaf's ``fixed`` tokens."""
    keep = ("row", "fp", "h")

    def run(batches):
        for b in batches:
            line, place, code, n = _tokens(b)
            own = b.column("fixed")
            size = np.diff(own.offsets.to_numpy())
            of = own.flatten()
            known = (np.repeat(np.arange(len(size)), size) << 24) | (of.field("place").to_numpy().astype(np.int64) << 16) | of.field("code").to_numpy()
            key = (line << 24) | (place << 16) | code
            hit = np.isin(key, known)
            after = np.bincount(line[hit & (place >= LEAD)], minlength=len(n))
            mark = np.where(hit, flat.mix((place.astype(np.uint64) << np.uint64(16)) + code.astype(np.uint64) + np.uint64(1)), np.uint64(0))
            start = np.append(0, np.cumsum(n))[:-1]
            path = flat.mix(np.add.reduceat(mark, start) + b.column("leaf").to_numpy().view(np.uint64)) if len(n) else np.zeros(0, np.uint64)
            at = pa.array(np.flatnonzero(after >= SIMILAR * (n - LEAD)))
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in keep], pa.array(path.view(np.int64)).take(at)], names=[*keep, "path"])

    per = fixed.groupBy("leaf").agg(F.collect_list(F.struct("place", "code")).alias("fixed"))      # at most 1 / COMMON codes a place
    return lines.select(*keep, "leaf", "codes").join(per, "leaf").select(*keep, "leaf", "codes", "fixed").mapInArrow(run, "row bigint, fp bigint, h bigint, path bigint")


def line_verdicts(docs: DataFrame, min_docs: int = 5) -> DataFrame:
    """doc_id, key, n_lines (with a word), n_dropped (distinct ones), common (hashes of the lines to drop; null: none) of every row."""
    t = cut_lineage(map_documents(keyed(docs), SCHEMA, _per_run))
    every = t.select("row", "fp", F.explode("lines").alias("l")).select("row", "fp", "l.*")
    leaves = (every.where("leaf <> 0").groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
              .select("leaf", F.ceil(F.col("n") / SALT_LINES).alias("salts")))
    grown = cut_lineage(every.where("leaf <> 0").select("row", "fp", "h", "leaf", "codes").join(leaves, "leaf"))
    fields = templates(grown, constants(grown)).withColumn("long", F.lit(False))
    lines = cut_lineage(every.select("row", "fp", "h", "path", "long").unionByName(fields))

    def recurring(carriers: DataFrame, by: str) -> DataFrame:
        """The paths that enough different ``by`` carry."""
        per = carriers.groupBy("path", by).agg(F.max("long").alias("long")).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("long").alias("long"))
        return cut_lineage(per.where(F.col("n") >= F.when(F.col("long"), 2).otherwise(min_docs)).select(F.col("path").alias("hot")))

    often = cut_lineage(lines.join(recurring(lines, "fp"), F.col("path") == F.col("hot"), "left_semi"))
    near = simhash.components(simhash.links(t.select("fp").distinct(), RADIUS))
    carriers = often.groupBy("path", "fp").agg(F.max("long").alias("long")).join(near, F.col("fp") == F.col("node"), "left")
    hot = recurring(carriers.select("path", "long", F.coalesce("root", "fp").alias("one")), "one")
    gone = (often.join(hot, F.col("path") == F.col("hot"), "left_semi").select("row", "h").distinct()
            .groupBy("row").agg(F.collect_list("h").alias("common")))
    return (t.select("row", "doc_id", "key", "n_lines").join(gone, "row", "left")
            .select("doc_id", "key", "n_lines", F.coalesce(F.size("common"), F.lit(0)).alias("n_dropped"), "common"))


def dedup_lines(docs: DataFrame, min_docs: int = 5) -> DataFrame:
    """``docs`` without the lines of recurring templates."""
    v = cut_lineage(line_verdicts(docs, min_docs).where("common is not null").select("doc_id", "key", "common"))
    return remove_hashed(docs, v.groupBy("doc_id", "key").agg(F.first("common").alias("common")), "left")
