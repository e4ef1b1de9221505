"""Language mixture, maximum-entropy scores and the quality discriminant: definitions, held-out accuracy, odd inputs."""

import math
import os
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from llm_fixtures import SF, make, odd_rows, prose  # noqa: F401
from quarry.llm import langid, maxent, qda, queries


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_language_of_held_out_documents(spark, docs):
    got = {r.doc_id: r for r in queries.op1_language_mixture(spark, "/root/testdata/sf0.01").collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [d for d in truth if crc(d, 3) == 1]
    assert got.keys() == truth.keys() and {d for d in got if got[d].held_out} == set(held)
    assert np.mean([got[d].lang_pred == truth[d] for d in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_mixture_proportions(make, docs, spark):
    langs, table = langid.fit(langid.learned_fold(docs))
    best = {x: docs.where((F.col("lang") == x) & (F.length("text") > 1500)).orderBy("doc_id").first().text for x in langs}
    cut = lambda x, n: " ".join(best[x].split()[:n])
    rows = [(1, cut("de", 150), None), (2, cut("de", 120) + " " + cut("fr", 60), None), (3, "12 34 !!", None), (4, None, None)]
    got = {r.doc_id: r for r in langid.predict(make(rows).select("doc_id", "text"), langs, table).collect()}
    assert got[1].languages == ["de"] and got[1].proportions == [1.0] and got[1].score > 0.95
    assert got[2].languages == ["de", "fr"] and abs(got[2].proportions[0] - 2 / 3) < 0.1 and got[2].lang_pred == "de"
    assert [got[3].lang_pred, got[4].lang_pred, got[3].score] == ["und", "und", 0.0]


def test_mixture_likelihood_never_falls():
    r = np.random.default_rng(0)
    like, doc, w = r.random((50, 3)), np.repeat([0, 1], 25), np.ones(50)
    last = -np.inf
    for rounds in range(1, 8):
        pi, _ = langid.mixture(like, doc, w, np.full((2, 3), 1 / 3), rounds)
        now = np.log((like * pi[doc]).sum(axis=1)).sum()
        assert now >= last - 1e-9 and np.allclose(pi.sum(axis=1), 1)
        last = now


def test_clean_documents_in_several_languages_stay(spark, docs, make):
    langs, table = langid.fit(langid.learned_fold(docs))
    best = [docs.where((F.col("lang") == x) & (F.length("text") > 1500)).orderBy("doc_id").first().text.split()[:50 if x == "de" else 100] for x in langs[:4]]
    rnd = np.random.default_rng(3)
    junk = " ".join("".join(rnd.choice(list("bcdfghjklmnpqrstvwxz"), 8)) for _ in range(120))
    rows = [(1, " ".join(w for b in best[:3] for w in b), None), (2, " ".join(w for b in best for w in b), None), (3, junk, None), (4, "12 34 !!", None)]
    kept = langid.confident(docs.unionByName(make([(-r[0], *r[1:]) for r in rows])), 0.4)
    assert sorted(r.doc_id for r in kept.where("doc_id < 0").collect()) == [-2, -1]
    got = {r.doc_id: r for r in langid.predict(make(rows).select("doc_id", "text"), langs, table).collect()}
    assert len(got[1].languages) == 3 and got[1].score < 0.4 < 0.9 < got[1].explained and got[3].explained < 0.4


def test_codes_and_numbers_stay(spark, docs, make):
    prose_ = docs.where((F.col("lang") == "en") & (F.length("text") > 1500)).orderBy("doc_id").first().text
    rows = [(-1, " ".join(f"w{i} A-{i} {i * 7}" for i in range(2000)), "en", "s"), (-2, prose_ + "\n" + " ".join(f"{i} = {i:x}" for i in range(300)), None, "s"),
            (-3, "\u043f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440 " * 60, None, "s")]
    kept = langid.confident(docs.unionByName(make(rows)), 0.4)
    assert sorted(r.doc_id for r in kept.where("doc_id < 0").collect()) == [-2, -1]
    assert kept.where("doc_id >= 0").count() == docs.where(F.col("text").rlike("[A-Za-z]")).count()


def test_language_sets_do_not_depend_on_the_run():
    """More than eight languages: a document alone gets the set it gets among others."""
    r = np.random.default_rng(1)
    table = np.log(r.dirichlet(np.full(4096, 0.02), 14).T.repeat(16, axis=0) / 16 + 1e-9).astype(np.float32)
    texts = [" ".join("".join(r.choice(list("abcdefghij"), 5)) for _ in range(n)).encode() for n in (20, 60, 100, 150, 200, 300, 40, 80, 120, 500)]
    off = np.append(0, np.cumsum([len(t) for t in texts]))
    whole = langid.infer(np.frombuffer(b"".join(texts), np.uint8), off, table, 6, 2.0, 8)
    alone = [langid.infer(np.frombuffer(t, np.uint8), np.array([0, len(t)]), table, 6, 2.0, 8) for t in texts]
    assert whole[2].tolist() == [a[2][0] for a in alone] and max(whole[2]) > 8
    assert np.allclose(whole[0], [a[0][0] for a in alone])


def test_language_on_odd_rows(make, odd_rows):
    docs = make(odd_rows).withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit(3.0))
    langs, table = langid.fit(langid.learned_fold(docs))
    out = langid.predict(docs.select("doc_id", "text"), langs, table)
    assert out.count() == len(odd_rows)
    kept = langid.confident(docs, 0.0)
    assert kept.columns == docs.columns
    letters = [r for r in odd_rows if r[1] and any(c.isalpha() for c in r[1])]
    assert kept.count() == len(letters)
    assert langid.fit(make([]))[0] == [] and langid.confident(make([])).count() == 0
    none = langid.predict(make([(1, "words here", None)]), *langid.fit(make([])))
    assert [(r.lang_pred, r.score) for r in none.collect()] == [("und", 0.0)]


def _check_base(rows, train, got):
    counts = Counter()
    tok = lambda t: [*brute.words(brute.lower(t)), None]
    for r in train:
        counts.update(tok(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(r[0]), len(tok(r[1])), sum(counts[w] > 0 for w in tok(r[1])), n,
                   round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tok(r[1])), 4)) for r in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want


@pytest.mark.parametrize("held", [1 << 18, 5])
def test_scores_of_every_token_count(make, odd_rows, monkeypatch, held):
    """The base score is exact whether a token's count is broadcast or joined."""
    monkeypatch.setattr(maxent.frequent, "__defaults__", (held,))
    rows = odd_rows + [(100 + i, prose(80, i), "en", "s") for i in range(30)]
    train = [r for r in rows if r[0] is None or crc(r[0], 7) != 2]
    got = maxent.score(make(rows), make(train)).collect()
    _check_base(rows, train, got)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert maxent.score(make([]), make([])).count() == 0
    only = maxent.score(make([(1, "a b", "en", "s")]), make([])).first()
    assert (only.n_tokens, only.n_known, only.train_tokens) == (3, 0, 0) and math.isfinite(only.score)


def _texts(rows):
    from quarry.llm import flat
    import pyarrow as pa
    return flat.texts_of(pa.array(rows, pa.string()))


def test_model_is_a_distribution_and_its_gradient_is_right():
    r = np.random.default_rng(3)
    m = maxent.Model(r.random(maxent.CLASSES * maxent.LEAVES) + 0.1, np.ones(maxent.CLASSES * maxent.LEAVES), 1 << 10)
    m.weights = tuple(r.normal(size=w.shape).astype(np.float32) for w in m.weights)
    h = r.integers(1, 50, 300).astype(np.uint64)
    off = np.array([0, 100, 300])
    leaf = r.integers(0, maxent.CLASSES * maxent.LEAVES, 300)
    every = [m.log10(h, np.where(np.arange(300) == 7, x, leaf), off)[7] for x in range(maxent.CLASSES * maxent.LEAVES)]
    assert abs(sum(10 ** x for x in every) - 1) < 1e-4
    sums = [np.zeros((w.shape[1] + 1, m.rows)) for w in m.weights]
    m.gradient(h, leaf, off, sums)
    feats = maxent.features(h, leaf // maxent.LEAVES, off, m.rows)
    for k in range(2):
        for u, c in ((feats[k][0, 5], leaf[5] // maxent.LEAVES if k == 0 else leaf[5] % maxent.LEAVES), (feats[k][1, 250], 3)):
            def total(d):
                w = [x.astype(np.float64) for x in m.weights]
                w[k][u, c] += d
                moved = maxent.Model.__new__(maxent.Model)
                moved.rows, moved.bias, moved.weights = m.rows, [b.astype(np.float64) for b in m.bias], w
                return moved.log10(h, leaf, off).sum() * np.log(10)
            assert abs((total(1e-4) - total(-1e-4)) / 2e-4 - sums[k][c, u]) < 1e-3


def test_score_equals_a_plain_model_and_does_not_follow_the_split(spark, make):
    r = np.random.default_rng(4)
    rows = [(i, " ".join(r.choice(["der", "die", "und", "haus", "baum"] if i % 2 else ["the", "a", "and", "house", "tree"], 60)) + ".", "en", "s") for i in range(120)]
    train = [x for x in rows if crc(x[0], 7) != 2]
    got = {}
    for n in (1, 8, 32):
        d = make(rows).repartition(n)
        got[n] = {x.doc_id: (x.score, x.base_score) for x in maxent.score(d, make(train).repartition(n)).collect()}
    for n in (8, 32):
        assert all(abs(got[1][k][0] - got[n][k][0]) < 1e-6 * abs(got[1][k][0]) for k in got[1])
    held = [k for k in got[1] if crc(k, 7) == 2]
    assert all(sum(got[n][k][0] for k in held) > sum(got[n][k][1] for k in held) for n in got)
    # the same model, token by token
    counts, vocab, model, n_all, _ = maxent.fit(make(train))
    for k in held[:3]:
        h, leaf, off = maxent.tokens(*_texts([rows[k][1]]))
        leaf, want = vocab.leaves(h, leaf), 0.0
        one, two = maxent.features(h, leaf // maxent.LEAVES, off, model.rows)
        for i in range(len(h)):
            c, s = divmod(int(leaf[i]), maxent.LEAVES)
            z = [model.bias[f][c] if f else model.bias[0] for f in (0, 1)]
            z = [z[f] + sum(model.weights[f][u] for u in (one, two)[f][:, i]) for f in (0, 1)]
            p = [np.exp(x) / np.exp(x).sum() for x in z]
            want += np.log10(p[0][c] * p[1][s])
            if leaf[i] >= maxent.SINGLES:
                want += np.log10(int(vocab.counts(h[i:i + 1])[0][0]) + 1) - model.log_mass[leaf[i]]
        assert abs(want - got[1][k][0]) < 1e-3


def _on_disk(spark):
    """Bytes of every shuffle and broadcast file of the session."""
    sc = spark.sparkContext
    blocks = sc._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    out = {(f := blocks.apply(i)).getPath(): f.length() for i in range(blocks.size())}
    return out | {p: os.path.getsize(p) for p in (os.path.join(sc._temp_dir, x) for x in os.listdir(sc._temp_dir)) if os.path.isfile(p)}


def test_rounds_share_tasks_and_leave_nothing_on_disk(spark, make, monkeypatch):
    """Small splits share a task's gradient sums; sums and weights of a round go with it, whether its sums were shuffled or not."""
    train = make([(i, prose(60, i), "en", "s") for i in range(400)]).repartition(32)
    weights, seen = {}, []
    monkeypatch.setattr(maxent, "ROUNDS", 4)
    step = maxent.Model.step
    monkeypatch.setattr(maxent.Model, "step", lambda self, sums: (seen.append(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds")), step(self, sums))[1])
    for tokens in (maxent.TASK_TOKENS, 500):
        monkeypatch.setattr(maxent, "TASK_TOKENS", tokens)
        seen.clear()
        before = _on_disk(spark)
        spark.sparkContext.setJobGroup("rounds", "rounds")
        try:
            weights[tokens] = maxent.fit(train)[2].weights
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(seen) == 4
        tracker = spark.sparkContext.statusTracker()
        tasks = [max(tracker.getStageInfo(s).numTasks for j in set(b) - set(a) for s in tracker.getJobInfo(j).stageIds) for a, b in zip(seen, seen[1:])]
        assert all(n == 1 for n in tasks) if tokens > 500 else all(n > 1 for n in tasks)
        for _ in range(100):                            # Spark deletes files in the background
            left = sum(n for p, n in _on_disk(spark).items() if p not in before)
            if left < 1 << 20:
                break
            time.sleep(0.1)
        assert left < 1 << 20
    for a, b in zip(*weights.values()):
        assert a.any() and np.allclose(a, b, atol=1e-5)


def test_every_round_reads_every_training_document(make, monkeypatch):
    """A step follows the gradient over all tokens, not over a part of the documents, and equal contexts count as often as they occur."""
    rows = [(i, prose(40 + i % 7, i // 2), "en", "s") for i in range(60)] + [(None, "a b", "en", "s"), (None, None, "en", "s")]
    steps = []
    step = maxent.Model.step
    monkeypatch.setattr(maxent.Model, "step", lambda self, sums: (steps.append((self.weights, sums)), step(self, sums))[1])
    _, vocab, model, n_all, _ = maxent.fit(make(rows).repartition(5))
    assert len(steps) == maxent.ROUNDS
    h, leaf, off = maxent.tokens(*_texts([r[1] for r in rows]))
    assert len(h) == n_all
    for weights, sums in steps:
        assert all(s[-1].sum() == maxent.FEATURES * n_all for s in sums)
        m = maxent.Model.__new__(maxent.Model)
        m.rows, m.bias, m.weights = model.rows, model.bias, weights
        want = [np.zeros((w.shape[1] + 1, m.rows)) for w in weights]
        m.gradient(h, vocab.leaves(h, leaf), off, want)
        assert all(np.allclose(a, b, atol=1e-3) for a, b in zip(sums, want))


def test_score_beats_the_base_on_held_out_documents_and_more_so_with_more(spark):
    gain = {}
    for sf in ("sf0.01", "sf0.1"):
        got = queries.op2_maxent_scores(spark, f"/root/testdata/{sf}").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
        gain[sf] = (got[0] - got[1]) / got[2]
    assert 0 < gain["sf0.01"] < gain["sf0.1"]


def test_quality_of_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op9_quality_qda(spark, d).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(d + "/labels.parquet").collect()}
    held = [x for x in labels if crc(x, 4) == 2]
    good, bad = [got[x].score for x in held if labels[x]], [got[x].score for x in held if not labels[x]]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([got[x].predicted == labels[x] for x in held]) > 0.95
    assert all(r.held_out == (crc(x, 4) == 2) and 0 <= r.score <= 1 for x, r in got.items())


def test_discriminant_is_the_gaussian_log_ratio():
    r = np.random.default_rng(1)
    d = len(qda.FEATURES)
    x = [r.normal(size=(400, d)) @ r.normal(size=(d, d)) + k for k in (0, 2)]
    n = np.array([400.0, 400.0])
    m = qda.Model(n, np.stack([v.sum(axis=0) for v in x]), np.stack([v.T @ v for v in x]), shrink=0.1, pool=0.1)
    cov = [np.cov(v.T, bias=True) for v in x]
    pooled = (cov[0] + cov[1]) / 2
    logs = []
    for k in range(2):
        s = 0.9 * cov[k] + 0.1 * pooled
        s = 0.9 * s + 0.1 * np.diag(np.diag(s)) + 1e-3 * np.eye(d)
        e = x[0][:20] - x[k].mean(axis=0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", e, np.linalg.inv(s), e) + np.linalg.slogdet(s)[1]))
    assert np.allclose(m.score(x[0][:20]), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-6)


def test_quality_on_odd_rows(make, odd_rows, spark):
    rows = qda.features(make(odd_rows))
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in qda.score(rows, qda.fit(qda.labelled(rows, none))).collect()} == {0.5}
    a, b, c = sorted({r[0] for r in odd_rows if r[0] and crc(r[0], 4) != 2})[-3:]
    one = spark.createDataFrame([(a, 1, 0), (a, 1, 0), (None, 0, 0), (b, 7, 0), (c, None, 0)], "doc_id bigint, quality int, toxic int")
    out = qda.score(rows, qda.fit(qda.labelled(rows, one))).collect()
    assert len(out) == len(odd_rows) and {r.score for r in out} == {1.0}
    both = spark.createDataFrame([(a, 1, 0), (b, 0, 0), (c, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in qda.score(rows, qda.fit(qda.labelled(rows, both))).collect())
    empty = qda.features(make([]))
    assert qda.score(empty, qda.fit(qda.labelled(empty, one))).count() == 0
