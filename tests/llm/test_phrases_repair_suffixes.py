"""Phrase mining, conversation repair and suffix dedup against plain-Python versions."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from heapq import heappop, heappush

import numpy as np
import pytest
from llm_fixtures import make, odd_rows, prose  # noqa: F401

from quarry.llm import phrases, repair, suffixes


# ---- phrases ---------------------------------------------------------------

def plain_phrases(rows, least, share, top):
    out = []
    by_lang = defaultdict(list)
    for _, text, lang, *_ in rows:
        by_lang[lang or "und"].append(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    for lang, texts in by_lang.items():
        f = Counter()
        for t in texts:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
                w = re.findall(r"[^\x20\x09]+", piece)
                for n in (1, 2, 3):
                    f.update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
        total = sum(c for p, c in f.items() if len(p) == 1)
        cand = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        found = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * c >= share * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, c in cand.items()):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total, -s))
    return sorted(out)


def phrase_rows():
    r = random.Random(4)
    words = "a b c d en fr und of the New York city é".split()
    rows = []
    for i in range(60):
        text = "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]) for _ in range(r.randint(0, 60)))
        rows.append((i, text, r.choice(["en", "fr", None]), "s"))
    return rows


@pytest.mark.parametrize("shards,slots", [(1, 24), (2, 24), (3, 24), (3, 8)])
def test_phrases_equal_plain_counts_for_any_number_of_shards(spark, make, odd_rows, monkeypatch, shards, slots):  # noqa: F811
    rows = phrase_rows() + odd_rows
    monkeypatch.setattr(phrases, "SLOTS", 1 << slots)                 # 8: nearly every phrase shares its slots with others
    got = sorted(tuple(r) for r in phrases.collocations(make(rows), least=5, share=50, top=40, shards=shards).collect())
    assert got == plain_phrases(rows, 5, 50, 40)


def test_phrases_activate_a_phrase_after_its_parts_and_count_one_cycle(spark, make):  # noqa: F811
    rows = phrase_rows()
    seen = []
    real = phrases.scan

    def spy(shard, t, shards, words, pairs):
        out = real(shard, t, shards, words, pairs)
        seen.append((t, {(r.n, r.act) for r in out.select("n", "act").distinct().collect()}))
        return out

    phrases.scan = spy
    try:
        phrases.frequent(phrases.deal(make(rows).select("doc_id", "text", "lang"), 3), 5, 3)
    finally:
        phrases.scan = real
    for t, kinds in seen:
        assert all(act <= t < act + 3 for _, act in kinds)
        assert all(n <= 1 or act >= n - 1 for n, act in kinds)
    assert all(n for _, kinds in seen[3:] for n, _ in kinds) and any(n == 2 for _, kinds in seen[:3] for n, _ in kinds)     # pairs start before all words are complete


def test_phrases_score_does_not_overflow(spark):
    expr = ("cast((1000000BD * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0))) as bigint)")
    a, left, r = 123_456_789_012, 987_654_321_098, 345_678_901_234
    got = spark.createDataFrame([(a, left, r)], "a bigint, l bigint, r bigint").selectExpr(f"{expr} as s").first().s
    assert got == 1000000 * a * a // (left * r)


def test_phrases_of_an_empty_table(spark, make):  # noqa: F811
    assert phrases.collocations(make([])).collect() == []


# ---- conversation repair ---------------------------------------------------

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def cheapest(codes):
    """Uniform-cost search over (row, state), least (cost, edits) first."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, q = heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(codes) and q in (0, 3):
            return audit, cost
        for role, to in NEXT[q].items():
            if role != "s":
                heappush(heap, (cost + 3, audit + "I", i, to))
        if i < len(codes):
            role, fault = codes[i]
            heappush(heap, (cost + 4, audit + "D", i + 1, q))
            if fault not in "bd":
                extra = 3 * (fault == "t")
                for want, to in NEXT[q].items():
                    if want == role:
                        heappush(heap, (cost + extra, audit + "K", i + 1, to))
                    if want != "s":
                        heappush(heap, (cost + 3 + extra, audit + "R", i + 1, to))
    raise AssertionError


def test_search_gives_the_cheapest_and_least_edits():
    r = random.Random(7)
    for _ in range(4000):
        codes = [(r.choice("suauat "), r.choice("---btd")) for _ in range(r.randint(0, 9))]
        assert repair.search(codes) == cheapest(codes), codes


def test_search_is_quick_on_a_long_conversation():
    r = random.Random(8)
    codes = [(r.choice("suauaua"), r.choice("------btd")) for _ in range(20_000)]
    audit, cost = repair.search(codes)
    assert cost == cheapest_cost(codes) and sum(c != "I" for c in audit) == len(codes)


def cheapest_cost(codes):
    best = {0: 0}
    for role, fault in [*codes, None] if not codes else [*codes]:
        best = with_inserts(best)
        new = {}
        for q, c in best.items():
            new[q] = min(new.get(q, 1e9), c + 4)
            if fault not in "bd":
                for want, to in NEXT[q].items():
                    extra = 3 * (fault == "t")
                    if want == role:
                        new[to] = min(new.get(to, 1e9), c + extra)
                    if want != "s":
                        new[to] = min(new.get(to, 1e9), c + 3 + extra)
        best = new
    best = with_inserts(best)
    return min(best.get(0, 1e9), best.get(3, 1e9))


def with_inserts(best):
    best = dict(best)
    for _ in range(3):
        for q, c in list(best.items()):
            for want, to in NEXT[q].items():
                if want != "s":
                    best[to] = min(best.get(to, 1e9), c + 3)
    return best


def plain_repair(rows):
    text = lambda x: " " if x is None else str(x)
    after = defaultdict(list)
    for conv, turn, role, t in rows:
        k = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        role, t = text(role), text(t)
        t = "" if k == 1 else re.sub("[.!?]", "", t) if k == 2 else t
        after[conv] += [(turn, "user" if k == 4 else role, t)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(after[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        codes, seen = [], set()
        for _, role, t in own:
            bare = re.sub(r"[\x20\x09-\x0D]+$", "", t)
            codes.append((role[:1], "b" if not bare else "d" if (role, t) in seen else "-" if bare[-1] in ".!?" else "t"))
            seen.add((role, t))
        turns = [r[0] for r in own if r[0] is not None]
        audit, cost = cheapest(codes)
        lines, q, i = [], 0, 0
        for e in audit:
            if e == "I":
                lines.append({0: "user:", 1: "user:", 2: "assistant:", 3: "user:"}[q])
                q = 3 if q == 2 else 2
                continue
            _, role, t = own[i]
            i += 1
            if e == "K":
                lines.append(f"{role}:{t}")
                q = NEXT[q][role[0]]
            elif e == "R":
                lines.append(f"{'assistant' if q == 2 else 'user'}:{t}")
                q = 3 if q == 2 else 2
        kinds = [f for _, f in codes]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count("b"), kinds.count("d"), kinds.count("t"),
                    sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def conversation_rows():
    r = random.Random(9)
    rows = []
    for conv in range(120):
        for turn in range(r.randint(1, 9)):
            text = r.choice(["Yes.", "No!", "and then", "", " \n", "Why? ", "é.", prose(30, turn) + "."])
            rows.append((conv, turn * r.choice([1, 1, 2]), r.choice(["system", "user", "assistant", "user", "assistant", "tool"]), text))
    rows += [(None, 1, "user", "Hi."), (None, None, "user", "Hi."), (500, None, None, None), (501, 3, "user", None), (502, 1, "user", "x." * 50_000)]
    rows += [(503, k, "user" if k % 2 else "assistant", f"t{k}.") for k in range(300)] + [rows[0]] * 3
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("parts", [1, 7])
def test_repair_equals_plain_version(spark, parts):
    rows = conversation_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts).selectExpr("*", "1 as kind", "'x' as audit")
    t = repair.conversations(df)
    got = sorted([tuple(x) for x in repair.repair(t, repair.damage(t)).collect()], key=str)
    assert got == plain_repair(rows)


def test_repair_of_an_empty_table(spark):
    t = repair.conversations(spark.createDataFrame([], SCHEMA))
    assert repair.repair(t, repair.damage(t)).collect() == []


# ---- suffix dedup ----------------------------------------------------------

def plain_cut(rows, length):
    least = {}
    big = 2**63
    for d, t, *_ in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            s = raw[p:p + length]
            least[s] = min(least.get(s, big), big - 1 if d is None else d)
    out = []
    for d, t, *_ in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if least[raw[p:p + length]] < (big - 1 if d is None else d):
                gone[p:p + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((d, kept, [m.start() for m in re.finditer(b"\x01+", gone)], [m.end() for m in re.finditer(b"\x01+", gone)]))
    return sorted(out, key=str)


def passage_rows():
    r = random.Random(10)
    passages = [prose(r.randint(8, 40), 1000 + k) for k in range(6)]
    rows = []
    for i in range(80):
        parts = [prose(r.randint(0, 30), i * 31 + k) if r.random() < 0.6 else r.choice(passages)[r.randint(0, 9):] for k in range(r.randint(1, 5))]
        rows.append((i, r.choice([" ", "\n", ""]).join(parts), "en", "s"))
    rows += [(100 + i, rows[i][1], "en", "s") for i in range(10)] + [(200, "ab" * 400, None, None), (201, "ba" * 300, None, None), (202, "a" * 50, None, None),
             (203, "a" * 49, None, None), (204, "x" + "a" * 51 + "y", None, None), (5, rows[7][1], "en", "s"), (None, rows[3][1], "en", "s")]
    return rows


def _cut(spark, make, rows, length, **kw):
    got = suffixes.cut_repeats(make(rows), length, **kw).collect()
    return sorted([(r.doc_id, bytes(r.kept), list(r.starts), list(r.ends)) for r in got], key=str)


@pytest.mark.parametrize("length,kw", [(50, {}), (50, {"shard_chunks": 20}), (12, {"shard_chunks": 500}), (7, {"gram": 7})])
def test_suffix_dedup_equals_plain_version(spark, make, odd_rows, length, kw):  # noqa: F811
    rows = passage_rows() + ([r for r in odd_rows if len(r[1] or "") < 5000] if length == 50 else [])
    assert _cut(spark, make, rows, length, **kw) == plain_cut(rows, length)


def test_suffix_dedup_of_frequent_anchors_and_small_runs(spark, make, monkeypatch):  # noqa: F811
    monkeypatch.setattr(suffixes, "HOT", 3)
    monkeypatch.setattr(suffixes, "RUN", 700)
    monkeypatch.setattr(suffixes, "BLOCK", 64)
    rows = passage_rows()
    assert _cut(spark, make, rows, 50, shard_chunks=50) == plain_cut(rows, 50)


def test_suffix_dedup_takes_odd_and_empty_tables(spark, make, odd_rows):  # noqa: F811
    assert _cut(spark, make, odd_rows, 50) == plain_cut(odd_rows, 50)
    assert _cut(spark, make, [], 50) == []


def test_suffix_order_is_the_order_of_prefixes():
    r = random.Random(11)
    for _ in range(400):
        t = np.array([r.randint(0, 3) for _ in range(r.randint(1, 70))], np.int64)
        need = r.choice([1, 2, 5, 9, 50])
        order = suffixes.suffix_order(t, need).tolist()
        padded = t.tolist() + [0] * 70
        keys = [padded[i:i + need] for i in order]
        assert sorted(order) == list(range(len(t))) and keys == sorted(keys)


def test_equal_windows_have_equal_anchors():
    r = np.random.default_rng(12)
    shared = r.integers(97, 101, 300).astype(np.uint8)
    a, b = (np.concatenate([r.integers(97, 123, k).astype(np.uint8), shared, r.integers(97, 123, 90).astype(np.uint8)]) for k in (41, 77))
    found = []
    for x, at in ((a, 41), (b, 77)):
        first, n, anchor = suffixes.chunks(x, np.array([0, len(x)]))
        per = np.repeat(anchor, n)
        assert len(per) == len(x) - 49 and (np.repeat(first, n) + np.arange(len(per)) - np.repeat(np.cumsum(n) - n, n) == np.arange(len(per))).all()
        found.append(per[at:at + 251].tolist())
    assert found[0] == found[1]


def test_anchors_fill_parts_and_bit_tables_evenly(spark, make):  # noqa: F811
    r = random.Random(13)
    twice, once = ("".join(r.choices("abcdefghij ", k=500_000)) for _ in range(2))
    shared, n_chunks = suffixes.shared_anchors(make([(1, twice, "en", "s"), (2, twice, "en", "s"), (3, once, "en", "s")]), 50, 20)
    mine, other = (suffixes.chunks(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)]))[2] for x in (twice, once))
    assert n_chunks >= 2 * len(np.unique(mine)) and shared.has(mine).all() and not shared.is_hot(mine).any()
    assert shared.has(other).mean() < 0.03                            # one anchor in a hundred passes by chance
    per_part = np.unpackbits(shared.shared).reshape(16, -1).sum(axis=1)
    assert per_part.max() < 1.2 * per_part.mean()


def test_slices_and_comparison_take_little_more_than_their_bytes():
    buf = np.tile(np.arange(97, 123, dtype=np.uint8), 20_000)
    start = np.arange(0, len(buf) - 100, 16)
    size = 50 + start % 31
    tracemalloc.start()
    try:
        got, off = suffixes._slices(buf, start, size)
        of_slices = tracemalloc.get_traced_memory()[1]
        other = np.arange(len(start)) - np.arange(len(start)) % 2
        even = size[other]
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        assert suffixes._equal(buf, np.zeros(len(start), np.int64), even, other)
        of_equal = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert got.tobytes() == b"".join(buf[a:a + n].tobytes() for a, n in zip(start.tolist(), size.tolist())) and off[-1] == len(got)
    assert not suffixes._equal(buf, start, even, other)               # sizes agree, bytes do not
    assert len(got) > 2_000_000 and of_slices < 8 * len(got) and of_equal < 8 * even.sum()


def test_very_frequent_anchors_are_known_by_their_keys(spark, make, monkeypatch):  # noqa: F811
    monkeypatch.setattr(suffixes, "HOT", 3)
    r = random.Random(14)
    often, pair = ("".join(r.choices("abcdefghij ", k=3000)) for _ in range(2))
    shared, _ = suffixes.shared_anchors(make([(k, often, "en", "s") for k in range(6)] + [(k, pair, "en", "s") for k in (7, 8)]), 50, 20)
    a, b = (suffixes.chunks(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)]))[2] for x in (often, pair))
    assert shared.has(a).all() and shared.has(b).all() and shared.is_hot(a).all() and not shared.is_hot(b).any()
    assert len(shared.hot) == len(np.unique(a))                       # a key each, no table
