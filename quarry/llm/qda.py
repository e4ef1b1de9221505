"""Quality classifier: regularised quadratic discriminant on transformed document statistics.

Each class has a mean and a covariance, shrunk towards its diagonal and, in
part, towards the pooled one.  Their Cholesky factors are computed once and
kept; a score is the logistic of the difference of the classes' log densities
(Mahalanobis distance and log-determinant) and log priors.  The fit needs the
count, the sum and the sum of outer products per class, which tasks add up
over all labelled rows; nothing is sampled.

Defined cases: a null text is empty and scored like any other; labels other
than 0 and 1 or null are left out; with rows of one class only every score is
that class, without labelled rows 0.5; repeated rows each keep a row; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .common import crc_fold, needed
from .quality import base_counts

FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "digits", "stops", "bangs", "wide",
            "distinct", "line_words", "short_words", "odd_ends", "same_ends", "log_lines")


def _flags(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_UPPER, _LOWER = _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123)))
_DIGIT, _STOP, _BANG, _ODD = _flags(b"0123456789"), _flags(b".,;:?"), _flags(b"!"), _flags(b"#*$%&|<>!~^=+@/\\")


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """[n, features]: shares go through a log with a floor that fits the length, so they lie closer to a normal law."""
    n = len(off) - 1
    words, chars, symbols, dup, rep = (x.astype(np.float64) for x in base_counts(buf, off))
    ws, we, woff = flat.words_of(buf, off)
    count = lambda t: flat.per_doc(t[buf], off).astype(np.float64) if len(buf) else np.zeros(n)
    lines = count(_flags(b"\n")) + 1
    share = lambda a, b: np.log((a + 0.5) / (b + 1.0))
    doc = flat.doc_of(woff)
    h = flat.hash_pieces(flat.LOWER[buf], ws, we)
    distinct = np.zeros(n)
    if len(ws):
        pick, _ = flat.unique_pieces(flat.mix(h ^ flat.mix(doc.astype(np.uint64) + np.uint64(1))))
        distinct = np.bincount(doc[pick], minlength=n).astype(np.float64)
    end = buf[we - 1] if len(ws) else np.zeros(0, np.uint8)
    odd = np.bincount(doc[_ODD[end]], minlength=n).astype(np.float64) if len(ws) else np.zeros(n)
    short = np.bincount(doc[(we - ws) <= 2], minlength=n).astype(np.float64) if len(ws) else np.zeros(n)
    twin = (we - ws > 1)
    same = np.zeros(n)
    if len(ws):
        k = np.flatnonzero(twin)
        k = k[buf[we[k] - 1] == buf[we[k] - 2]]
        same = np.bincount(doc[k], minlength=n).astype(np.float64)
    up, low = count(_UPPER), count(_LOWER)
    x = np.stack([
        np.log1p(words), np.log1p(chars / np.maximum(words, 1)), share(symbols, chars), share(dup, lines), share(rep, words),
        share(up, up + low), share(count(_DIGIT), chars), share(count(_STOP), words), share(count(_BANG), words),
        share(flat.per_doc(buf >= 128, off).astype(np.float64) if len(buf) else np.zeros(n), chars),
        share(distinct, words), np.log1p(words / lines), share(short, words), share(odd, words), share(same, words),
        np.log1p(lines)], axis=1)
    return x


class Model:
    """Means, cached inverse Cholesky factors, log-determinants and log priors of classes 0 and 1."""

    def __init__(self, n, total, outer, shrink: float = 0.1, pool: float = 0.1):
        self.n = n
        self.ready = all(n > 0)
        if not self.ready:
            return
        d = total.shape[1]
        mean = total / n[:, None]
        cov = outer / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
        pooled = (cov * n[:, None, None]).sum(axis=0) / n.sum()
        self.mean, self.inverse, self.logdet = mean, [], []
        for c in range(2):
            s = (1 - pool) * cov[c] + pool * pooled
            s = (1 - shrink) * s + shrink * np.diag(np.diag(s)) + 1e-3 * np.eye(d)
            low = np.linalg.cholesky(s)
            self.inverse.append(np.linalg.inv(low))
            self.logdet.append(2 * np.log(np.diag(low)).sum())
        self.prior = np.log(n / n.sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), 0.5 if not self.n.any() else float(self.n[1] > 0))
        log = []
        for c in range(2):
            z = (x - self.mean[c]) @ self.inverse[c].T
            log.append(-0.5 * ((z * z).sum(axis=1) + self.logdet[c]) + self.prior[c])
        return 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and f (the statistics) of every row."""
    def run(batches):
        for b in batches:
            buf, off = flat.texts_of(b.column("text"))
            for i, j in flat.spans(off):
                x = statistics(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), flat.list_array(pa.array(x.ravel()), np.arange(j - i + 1) * x.shape[1])],
                    names=["doc_id", "f"])

    return needed(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, f array<double>")


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(f, quality) to learn from: labelled documents whose id's crc32 modulo 4 is not 2."""
    y = needed(labels, "doc_id", "quality").where((crc_fold(F.col("doc_id"), 4) != 2) & F.col("quality").isin(0, 1)).distinct()
    return rows.join(y, "doc_id").select("f", "quality")


def fit(train: DataFrame, **kw) -> Model:
    """Model from (f, quality); tasks add up, the driver gets the sums of two classes."""
    d = len(FEATURES)

    def sums(batches):
        acc = np.zeros((2, 1 + d + d * d))
        for b in batches:
            x, y = _matrix(b.column("f")), b.column("quality").to_numpy()
            for c in range(2):
                xc = x[y == c]
                acc[c] += np.concatenate([[len(xc)], xc.sum(axis=0), (xc.T @ xc).ravel()])
        k = np.arange(acc.shape[1], dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(2, dtype=np.int32), len(k))), pa.array(np.tile(k, 2)), pa.array(acc.ravel())],
                                         names=["c", "k", "v"])

    rows = train.mapInArrow(sums, "c int, k int, v double").groupBy("c", "k").agg(F.sum("v").alias("v")).toArrow()
    acc = np.zeros((2, 1 + d + d * d))
    if rows.num_rows:
        acc[rows.column("c").to_numpy(), rows.column("k").to_numpy()] = rows.column("v").to_numpy()
    return Model(acc[:, 0], acc[:, 1:1 + d], acc[:, 1 + d:].reshape(2, d, d), **kw)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row of features."""
    m = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = m.value.score(_matrix(b.column("f"))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    return rows.select("doc_id", "f").mapInArrow(run, "doc_id bigint, score double")
