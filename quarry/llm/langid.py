"""Language identification as mixture inference.

Training counts hashed byte trigrams per language (each letter byte with its
two neighbours; A-Z and Latin-1 capitals lowered, ASCII non-letters are
spaces).  A document is cut into spans of ``span`` words.  Expectation-
maximisation estimates the document's language proportions from the spans'
likelihoods; the language set is the prefix, by estimated proportion, of the
languages that maximises the log-likelihood less ``penalty * log(1 + spans)``
for each language beyond the first.

Defined cases: a null text or one without letters is ``und`` with score 0; with
no labelled training row every text is ``und``; ties go to the language that
sorts first; repeated rows each keep a row; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .common import content_key, crc_fold, free_name, needed

BUCKETS = 1 << 16
MAX_LANGS = 250                          # learned languages; more is an error, never a cut
UND = "und"
_LETTER = re.compile(r"[^\W\d_]")
_ASCII = np.full(256, 32, np.uint8)
_ASCII[65:91], _ASCII[97:123] = np.arange(97, 123), np.arange(97, 123)
_ASCII[128:] = np.arange(128, 256)


def trigrams(buf: np.ndarray, off: np.ndarray):
    """(bucket of each letter byte, its place in a padded text, padded text's word starts and ends, word offsets of documents)."""
    raw, edges = buf.tobytes(), off.tolist()
    pad = np.frombuffer(b" ".join([b"", *[raw[a:b] for a, b in zip(edges, edges[1:])], b""]), np.uint8)
    pad_off = off + 1 + np.arange(len(off))
    b = _ASCII[pad]
    cap = np.flatnonzero((pad[:-1] == 0xC3) & (pad[1:] >= 0x80) & (pad[1:] <= 0x9E) & (pad[1:] != 0x97)) + 1
    b[cap] += 0x20
    letter = b != 32
    at = np.flatnonzero(letter)
    wide = b.astype(np.uint32)
    code = (wide[at - 1] << np.uint32(16)) | (wide[at] << np.uint32(8)) | wide[at + 1]
    bucket = (code * np.uint32(2654435761)) >> np.uint32(16)
    start = np.flatnonzero(~letter[at - 1])                  # index into at: the first letter of every word
    doc_word = np.searchsorted(at[start], pad_off)           # word offset of every document
    return bucket, start, doc_word


def _has_letter(buf, off) -> np.ndarray:
    raw, edges = buf.tobytes(), off.tolist()
    return np.array([any(m[0].isalpha() for m in _LETTER.finditer(raw[a:b].decode())) for a, b in zip(edges, edges[1:])], bool)


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, [buckets, languages] log-probabilities) from the rows of ``docs``(text, lang) with a language.

    Tasks count densely and send their non-zero counts; the driver gets at
    most ``BUCKETS`` sums per language.
    """
    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            buf, off = flat.texts_of(b.column("text"))
            langs = b.column("lang").to_pylist()
            for i, j in flat.spans(off):
                names = sorted(set(langs[i:j]))
                which = np.array([names.index(x) for x in langs[i:j]])
                bucket, start, doc_word = trigrams(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                first = np.append(start, len(bucket))[doc_word]
                code = np.repeat(which, np.diff(first)) * BUCKETS + bucket
                counts = np.bincount(code, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for k, name in enumerate(names):
                    total[name] = total[name] + counts[k] if name in total else counts[k]
        for name, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])],
                                             names=["lang", "bucket", "n"])

    rows = (needed(docs, "text", "lang").where("lang is not null and text is not null")
            .mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    got = rows.toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    if len(langs) > MAX_LANGS:
        raise ValueError(f"{len(langs)} languages; the model holds at most {MAX_LANGS}")
    table = np.full((BUCKETS, len(langs)), 0.5)
    if langs:
        place = {x: k for k, x in enumerate(langs)}
        cols = np.array([place[x] for x in got.column("lang").to_pylist()])
        np.add.at(table, (got.column("bucket").to_numpy(), cols), got.column("n").to_numpy())
        table = np.log(table / table.sum(axis=0))
    return langs, table.astype(np.float32)


def mixture(like: np.ndarray, doc: np.ndarray, weight: np.ndarray, pi: np.ndarray, rounds: int, prior: float = 0.0):
    """EM over spans: (proportions [docs, langs], span responsibilities); ``pi`` is the start, zero entries stay zero."""
    n, k = pi.shape
    total = np.bincount(doc, weights=weight, minlength=n)[:, None]
    part = None
    for _ in range(rounds):
        part = like * pi[doc]
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-30)
        mass = np.stack([np.bincount(doc, weights=part[:, c] * weight, minlength=n) for c in range(k)], axis=1)
        pi = (mass + prior * (pi > 0)) / np.maximum(total + prior * (pi > 0).sum(axis=1, keepdims=True), 1e-30)
    return pi, part


def infer(buf, off, table: np.ndarray, span: int, penalty: float, rounds: int):
    """(proportions over the selected set, share of every language, number of languages chosen, explained, has words) per document.

    explained: the share of words that fall to the selected languages together,
    in spans whose trigrams of three letters these make likelier than evenly
    spread ones are; a span without such a trigram (codes, numbers) counts.
    """
    n, k = len(off) - 1, table.shape[1]
    bucket, start, doc_word = trigrams(buf, off)
    words = np.diff(doc_word)
    share, chosen = np.zeros((n, k)), np.zeros(n, np.int64)
    if not len(start) or not k:
        return share, share, chosen, np.zeros(n), words > 0
    doc = flat.doc_of(doc_word)
    head = np.flatnonzero((np.arange(len(start)) - doc_word[:-1][doc]) % span == 0)      # first word of every span
    first = start[head]
    s_doc = doc[head]
    ll = np.stack([np.add.reduceat(np.ascontiguousarray(table[:, c])[bucket], first) for c in range(k)], axis=1).astype(np.float64)
    weight = np.diff(np.append(head, len(start))).astype(np.float64)
    top = ll.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(ll - top, -80.0))
    base = np.bincount(s_doc, weights=top[:, 0], minlength=n)
    full, part = mixture(like, s_doc, weight, np.full((n, k), 1.0 / k), rounds, 0.1)
    share = np.stack([np.bincount(s_doc, weights=part[:, c] * weight, minlength=n) for c in range(k)], axis=1)
    share /= np.maximum(words, 1)[:, None]
    order = np.argsort(-full, axis=1, kind="stable")
    spans = np.bincount(s_doc, minlength=n)
    best, pick = np.full(n, -np.inf), full
    for size in range(1, k + 1):
        keep = np.zeros((n, k), bool)
        np.put_along_axis(keep, order[:, :size], True, axis=1)
        pi = np.where(keep, full, 0.0)
        pi, _ = mixture(like, s_doc, weight, pi / pi.sum(axis=1, keepdims=True), max(2, rounds // 2))
        fit_ = base + np.bincount(s_doc, weights=np.log(np.maximum((like * pi[s_doc]).sum(axis=1), 1e-300)), minlength=n)
        value = fit_ - penalty * (size - 1) * np.log1p(spans)
        better = value > best + 1e-9
        best = np.where(better, value, best)
        chosen = np.where(better, size, chosen)
        pick = np.where(better[:, None], pi, pick)
        if not (base - penalty * size * np.log1p(spans) > best + 1e-9).any():     # no larger set can be better: no fit exceeds base
            break
    # Trigrams of three letters: only these tell a language from noise, which spreads them evenly.
    inner = np.ones(len(bucket), bool)
    inner[start] = inner[np.append(start[1:], len(bucket)) - 1] = False
    inside = np.stack([np.add.reduceat(np.where(inner, np.ascontiguousarray(table[:, c])[bucket], 0.0), first) for c in range(k)], axis=1).astype(np.float64)
    high = inside.max(axis=1, keepdims=True)
    fit_in = high[:, 0] + np.log(np.maximum((np.exp(np.maximum(inside - high, -80.0)) * pick[s_doc]).sum(axis=1), 1e-300))
    known = fit_in >= -np.add.reduceat(inner.astype(np.int64), first) * np.log(BUCKETS)
    chosen_part = (part * (pick > 0)[s_doc]).sum(axis=1)
    explained = np.bincount(s_doc, weights=known * chosen_part * weight, minlength=n) / np.maximum(words, 1)
    return pick, share, chosen, explained, words > 0


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, span: int = 6, penalty: float = 2.0, rounds: int = 8) -> DataFrame:
    """``docs`` with lang_pred, score, languages and proportions (arrays, largest first) and explained in place of text.

    score is the share of the document's words that fall to the predicted
    language when every language takes part; explained the share that the
    selected languages together account for, 0 for ``und`` (see ``infer``).
    """
    keep = [f for f in docs.schema.fields if f.name != "text"]
    names = [f.name for f in keep]
    out = ["lang_pred", "score", "languages", "proportions", "explained"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep),
                        "lang_pred string, score double, languages array<string>, proportions array<double>, explained double"])
    model = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        t = model.value
        limit = flat.RUN_BYTES * 8 // max(8, t.shape[1])         # spans x languages stay within one size
        for b in batches:
            buf, off = flat.texts_of(b.column("text"))
            for i, j in flat.spans(off, limit):
                rb, ro = buf[off[i]:off[j]], off[i:j + 1] - off[i]
                pi, share, size, known, words = infer(rb, ro, t, span, penalty, rounds)
                ok = words & _has_letter(rb, ro) if langs else np.zeros(j - i, bool)
                top = pi.argmax(axis=1) if langs else np.zeros(j - i, int)
                pred = [langs[c] if g else UND for c, g in zip(top.tolist(), ok.tolist())]
                score = np.where(ok, np.clip(share[np.arange(j - i), top], 0, 1), 0.0) if langs else np.zeros(j - i)
                sets = [[langs[c] for c in np.argsort(-p, kind="stable")[:s]] if g else [] for p, s, g in zip(pi, size.tolist(), ok.tolist())]
                props = [np.sort(p)[::-1][:s].tolist() if g else [] for p, s, g in zip(pi, size.tolist(), ok.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c).slice(i, j - i) for c in names], pa.array(pred, pa.string()), pa.array(score),
                     pa.array(sets, pa.list_(pa.string())), pa.array(props, pa.list_(pa.float64())), pa.array(np.where(ok, known, 0.0))], names=[*names, *out])

    return docs.mapInArrow(run, schema)


def learned_fold(docs: DataFrame) -> DataFrame:
    """The rows to learn from: a known language, and crc32 of the id modulo 3 is not 1."""
    return docs.where(F.col("lang").isNotNull() & (crc_fold(F.col("doc_id"), 3) != 1))


def confident(docs: DataFrame, min_score: float = 0.5, **kw) -> DataFrame:
    """``docs`` without the rows that are undetermined or whose languages together explain less than ``min_score`` of the words.

    A document in several languages counts with all of them; columns as they are.
    Where no row has a language to learn from, nothing can be told and all rows stay.
    """
    langs, table = fit(learned_fold(needed(docs, "doc_id", "text", "lang")))
    if not langs:
        return docs
    slim = needed(docs, "doc_id", "text", "source").select("doc_id", content_key().alias("key"), "text")
    good = predict(slim, langs, table, **kw).where((F.col("lang_pred") != UND) & (F.col("explained") >= min_score))
    mine, key, of = (free_name(docs, x) for x in ("__key", "__k", "__id"))
    good = good.select(F.col("doc_id").alias(of), F.col("key").alias(key)).distinct()
    named = docs.select(*[F.col(f"`{c}`") for c in docs.columns], content_key().alias(mine))
    hit = named.join(good, (F.col(mine) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(of)), "left_semi")
    return hit.select(*[F.col(f"`{c}`") for c in docs.columns])
