"""Quality rules, line templates, near duplicates and fingerprints against brute force."""

import hashlib
import random

import numpy as np
import pytest

import brute
from llm_fixtures import make, odd_rows, prose  # noqa: F401
from quarry.llm import fingerprint, flat, quality, simhash, templates
from pyspark.sql import functions as F


def test_base_counts_match_definition(make, odd_rows):
    docs = make(odd_rows + [(20 + i, "\n".join(prose(12, k) for k in range(i)) * 2, "en", "s") for i in range(6)])
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                 for r in quality.line_rules(docs).collect())
    want = sorted((str(r.doc_id), *brute.base_rules(r.text)) for r in docs.collect())
    assert got == want


def _line_docs():
    """A notice pasted into many unrelated documents of one host, copies of one document, and a document made of notices."""
    notice, other = "all rights reserved by the mill 2020", "follow us on the river bank"
    rows = [(i, prose(60, 100 + i) + "\n" + notice + "\n" + other, "en", "host") for i in range(12)]
    rows += [(100 + i, "\n".join([prose(30, 7), prose(30, 8), prose(30, 9)]), "en", "host") for i in range(15)]      # copies
    rows += [(200, "\n".join([notice.replace("2020", "2021"), other] * 4 + [prose(6, 5)]), "en", "host"),
             (201, prose(40, 77) + "\n" + notice, "en", "elsewhere")]
    return rows, notice, other


def test_common_lines_go_and_depleted_documents_are_rejected(make):
    rows, notice, other = _line_docs()
    docs = make(rows)
    v = {r.doc_id: r for r in quality.line_rules(docs, max_docs=10).collect()}
    assert all(v[100 + i].common is None and v[100 + i].kept for i in range(15))      # copies of one document are one document
    assert all(v[i].words_left == 60 and v[i].kept for i in range(12))
    assert not v[200].kept and v[201].kept and v[201].common is None                  # the limit holds per host
    out = {r.doc_id: r for r in quality.clean(docs, max_docs=10).collect()}
    assert set(out) == {r[0] for r in rows} - {200}
    assert out[0].text == rows[0][1].split("\n")[0] and out[0].n_chars == len(out[0].text)
    assert out[201].text == rows[-1][1]


def test_recurring_templates_go_from_all_documents(make):
    rows, notice, other = _line_docs()
    rows += [(300 + i, prose(50, 900 + i) + f"\nuser {i} logged in at the north gate of the mill number {i * 7}\nstart middle "
              f"{prose(2, i)} then the very same words until the end of line", "en", f"s{i % 3}") for i in range(8)]
    docs = make(rows)
    out = {r.doc_id: r for r in templates.dedup_lines(docs, min_docs=5).collect()}
    assert len(out) == len(rows)
    assert all(out[i].text == rows[i][1].split("\n")[0] for i in range(12))           # notice and follow-us line
    assert all(out[300 + i].text.count("\n") == 0 for i in range(8))                  # digits and one varying field
    assert all(out[100 + i].text == rows[12][1] for i in range(15))                   # copies keep their text
    assert all(r.n_chars == len(r.text) for r in out.values())


def test_every_carrier_of_shared_lines_counts(make):
    """Carriers share several lines, or have no other line; all of them count, exact copies once."""
    frame = [prose(5, 4000 + i) + f" frame{chr(97 + i)}" for i in range(10)]
    rows = [(i, "\n".join(frame[:5] + [prose(40, 3000 + i)] + frame[5:]), "en", "host") for i in range(30)]
    rows += [(100 + i, "\n".join(frame + [prose(60, 8000)]), "en", "copies") for i in range(30)]
    docs = make(rows)
    v = {r.doc_id: r for r in quality.line_rules(docs, max_docs=20).collect()}
    assert all(v[i].words_left == 40 and len(v[i].common) == 10 for i in range(30))
    assert all(v[100 + i].common is None for i in range(30))
    passage = [prose(8, 5000 + i) + f" passage{chr(97 + i)}" for i in range(3)]
    rows = [(i, "\n".join([prose(20, 6000 + 2 * i), *passage, prose(20, 6001 + 2 * i)]), "en", f"s{i}") for i in range(5)]
    logs = [(100 + i, f"request {i} served by the north gate of the mill", "en", "log") for i in range(30)]
    lost = {r.doc_id: r.n_dropped for r in templates.line_verdicts(make(rows + logs)).collect()}
    assert all(lost[i] == 3 for i in range(5)) and all(lost[100 + i] == 1 for i in range(30))
    copies = make([(i, "\n".join(frame), "en", f"s{i}") for i in range(9)])             # exact copies on many hosts
    assert all(r.n_dropped == 0 for r in templates.line_verdicts(copies).collect())


def test_recurring_lines_go_whatever_their_share_but_near_copies_stay(make):
    passage, frame, short = prose(55, 70), [f"{prose(6, 80 + i)} frame{chr(97 + i)}" for i in range(4)], prose(40, 90)
    rows = [(i, "\n".join([prose(15, 7000 + i), passage]), "en", f"s{i}") for i in range(6)]          # shorter than what they share
    rows += [(50 + i, "\n".join([*frame, prose(8, 7100 + i)]), "en", f"s{i}") for i in range(6)]      # pages that are mostly frame
    rows += [(60, "\n".join(frame), "en", "s")]                                                       # ... or nothing else
    long = prose(60, 91)
    rows += [(70 + i, "\n".join([prose(30, 7200 + i), long, short]), "en", f"s{i}") for i in range(2)]
    base = prose(1200, 92).split()
    for i in range(8):                                                                                # near copies, one word edited
        w = list(base)
        w[150 * i + 7] = "edited"
        rows.append((100 + i, "\n".join(" ".join(w[k:k + 60]) for k in range(0, 1200, 60)) + "\n" + frame[0], "en", "s"))
    out = {r.doc_id: r.text for r in templates.dedup_lines(make(rows)).collect()}
    text = {r[0]: r[1] for r in rows}
    assert all(out[i] == text[i].split("\n")[0] for i in range(6))
    assert all(out[50 + i] == text[50 + i].split("\n")[-1] for i in range(6)) and out[60] == ""
    assert all(out[70 + i] == text[70 + i].replace("\n" + long, "") for i in range(2))                 # 60 words go, 40 words stay
    assert all(out[100 + i] == text[100 + i].rsplit("\n", 1)[0] for i in range(8))                    # only the frame's line goes


def plain_templates(rows, min_docs):
    """Lines to drop per document by the tree's definition; no two of the documents are near copies."""
    import re
    from collections import Counter, defaultdict
    norm = lambda line: tuple("*" if re.search("[0-9]", w) else brute.lower(w) for w in brute.words(line))
    lines = {k: {norm(x) for x in (r[1] or "").split("\n")} for k, r in enumerate(rows)}
    carriers = defaultdict(list)
    for own in lines.values():
        for x in own:
            if 5 <= len(x) <= 50:
                carriers[len(x), x[:2]].append(x)
    fixed = {}
    for leaf, all_ in carriers.items():
        if len(all_) >= min_docs:
            kinds = set(all_)
            count = Counter((p, w) for x in kinds for p, w in enumerate(x))
            fixed[leaf] = {k for k, n in count.items() if 3 * n >= len(kinds)}
    def keys(x):
        out = [("full", x)] if len(x) >= 3 else []
        const = fixed.get((len(x), x[:2])) if 5 <= len(x) <= 50 else None
        if const is not None:
            own = tuple((p, w) for p, w in enumerate(x) if (p, w) in const)
            if 3 * sum(p >= 2 for p, _ in own) >= len(x) - 2:
                out.append((len(x), x[:2], own))
        return out
    docs = defaultdict(set)
    for k, own in lines.items():
        for x in own:
            for key in keys(x):
                docs[key].add(k)
    gone = lambda x: any(len(docs[key]) >= (2 if key[0] == "full" and len(x) > 50 else min_docs) for key in keys(x))
    return {k: {x for x in own if gone(x)} for k, own in lines.items()}, norm


@pytest.mark.parametrize("salt_lines", [100_000, 3])
def test_template_tree_equals_its_definition(make, monkeypatch, salt_lines):
    monkeypatch.setattr(templates, "SALT_LINES", salt_lines)
    r = random.Random(31)
    names, places = [f"n{chr(97 + k)}{chr(100 + k % 9)}x" for k in range(26)], [f"Pl{chr(97 + k)}q" for k in range(26)]
    kinds = [lambda: f"Posted by {r.choice(names)} {r.choice(names)} in {r.choice(places)} | {r.randint(1, 99)} comments",
             lambda: f"Posted by {r.choice(names)} in {r.choice(places)}", lambda: f"Copyright {r.randint(1990, 2025)} by {r.choice(names)} all rights reserved",
             lambda: "Read more news here", lambda: prose(r.randint(3, 14), r.randint(0, 10**6))]
    rows = [(i, "\n".join([prose(60, 9000 + i)] + [r.choice(kinds)() for _ in range(r.randint(0, 6))]), "en", "s") for i in range(70)]
    want, norm = plain_templates(rows, 5)
    got = {x.doc_id: x.text for x in templates.dedup_lines(make(rows)).collect()}
    for k, row in enumerate(rows):
        assert got[k] == "\n".join(x for x in row[1].split("\n") if norm(x) not in want[k]), k
    assert sum(map(len, want.values())) > 100


def test_lines_with_variable_fields_meet_in_one_template(make):
    people, places = "Anna Bob Carl Dora Emil Fay".split(), "Cooking Travel Music Sport Garden Film".split()
    lines = [(f"Posted by {p} Smith{chr(97 + i)} in {x} | {i + 3} comments", f"Posted by {p} in {x}") for i, (p, x) in enumerate(zip(people, places))]
    rows = [(i, prose(80, 700 + i) + "\n" + "\n".join(x), "en", "s") for i, x in enumerate(lines)]
    got = {x.doc_id: x.text for x in templates.dedup_lines(make(rows)).collect()}
    assert all(got[i] == prose(80, 700 + i) for i in range(6))
    few = {x.doc_id: x.text for x in templates.dedup_lines(make(rows[:4])).collect()}
    assert all(few[i] == rows[i][1] for i in range(4))


def test_line_operators_on_odd_rows(make, odd_rows, spark):
    docs = make(odd_rows).withColumn("row", F.lit(1)).withColumn("key", F.lit("k")).withColumn("lines", F.array(F.lit(2)))
    out = templates.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == len(odd_rows)
    assert sorted(map(str, (r.text for r in out.collect()))) == sorted(map(str, (r[1] for r in odd_rows)))
    cleaned = quality.clean(docs)
    assert cleaned.columns == docs.columns
    assert sorted(str(r.doc_id) for r in cleaned.collect()) == sorted(str(r[0]) for r in odd_rows if not brute.base_rules(r[1])[-1])
    empty = make([])
    assert quality.line_rules(empty).count() == 0 and quality.clean(empty).count() == 0 and templates.dedup_lines(empty).count() == 0


def _near_rows():
    r = random.Random(4)
    base = prose(200, 11).split()
    rows = [(110 + i, prose(r.randint(1, 150), 500 + i), "en", "s") for i in range(60)]
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = f"word{r.randrange(5)}"
        rows.append((1000 + i, " ".join(w), "en", "s"))
    return rows


def test_near_duplicates_match_all_pairs(make, odd_rows):
    rows = _near_rows() + odd_rows
    docs = make(rows)
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    fps = [brute.fingerprint(r[1]) for r in rows]
    comp = brute.components([r[0] for r in rows], fps)
    assert got == sorted((str(r[0]), f"{f:016x}", str(c)) for r, f, c in zip(rows, fps, comp))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(c) for c in comp})
    assert simhash.near_duplicates(make([])).count() == 0 and simhash.one_of_each(make([])).count() == 0


@pytest.mark.parametrize("shard_rows", [3, 40, 20_000])
def test_links_reach_what_all_pairs_reach(spark, shard_rows):
    """Chains within the radius and hot blocks, in one unit or cut into many."""
    r = random.Random(9)
    fps = {r.getrandbits(64) for _ in range(150)}
    seed = r.getrandbits(64)
    for _ in range(200):                                # a crowd around one value: hot blocks
        x = seed
        for _ in range(r.randint(0, 5)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    x = r.getrandbits(64)
    for _ in range(40):                                 # a chain: each 4 bits from the one before
        for b in r.sample(range(64), 4):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps], "fp bigint")
    comp = {x.node % (1 << 64): x.root % (1 << 64) for x in simhash.components(simhash.links(df, 4, shard_rows)).collect()}
    want = brute.components(list(range(len(fps))), fps)
    first = {}
    for f, w in zip(fps, want):
        first.setdefault(w, set()).add(f)
    groups = {}
    for f in fps:
        groups.setdefault(comp.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, first.values()))


def test_trie_finds_every_pair_once():
    r = np.random.default_rng(2)
    x = np.unique(np.concatenate([r.integers(0, 2**64, 300, dtype=np.uint64), np.uint64(77) ^ (np.uint64(1) << r.integers(0, 64, 200, dtype=np.uint64))]))
    found = []
    simhash.trie_pairs(x, [0], [len(x)], [0], [len(x)], 0, 4, lambda i, j: found.extend(zip(i.tolist(), j.tolist())))
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if int(x[i] ^ x[j]).bit_count() <= 4}
    assert {tuple(sorted(p)) for p in found} == want and len(found) == len(want)


def test_edited_fingerprints(make, odd_rows):
    rows = [r for r in odd_rows if r[0] is not None] + [(50 + i, prose(80, i), "en", "s") for i in range(20)]
    rows = list({r[0]: r for r in rows}.values())
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(make(rows)).collect()}
    order = sorted(rows)
    for a, b in zip(order, order[1:] + order[:1]):
        text, nxt = a[1] or "", b[1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + nxt[:half]
        g = got[a[0]]
        assert g.n_chars == len(text) and g.edited_sha == hashlib.sha256(edited.encode()).hexdigest()
        assert (text == nxt) <= (g.near_next == 1.0) and 0 <= g.near_edited <= 1
        assert (text == edited) <= (g.fingerprint == g.edited_fingerprint)
    assert got[5].fingerprint == got[6].fingerprint
    plain = [got[50 + i] for i in range(19)]
    assert np.mean([p.near_edited for p in plain]) > np.mean([p.near_next for p in plain]) + 0.05
    assert fingerprint.edited_fingerprints(make([])).count() == 0
    assert fingerprint.edited_fingerprints(make([(1, "alone here", "en", "s")])).first().near_next == 1.0
    assert fingerprint.edited_fingerprints(make(odd_rows)).count() == len(odd_rows)     # null and repeated ids


@pytest.mark.parametrize("radius", [0, 3, 20])
def test_search_finds_every_near_fingerprint(spark, radius):
    r = random.Random(6)
    base = [r.getrandbits(256) for _ in range(40)]
    for _ in range(120):
        x = r.choice(base[:5])
        for _ in range(r.randint(0, 24)):
            x ^= 1 << r.randrange(256)
        base.append(x)
    base += base[:10]
    df = spark.createDataFrame([(f"{x:064x}",) for x in base], "fingerprint string").repartition(4)
    got = {x.fingerprint: x.n_near for x in fingerprint.search(df, df, radius, salts=3).collect()}
    assert got == {f"{x:064x}": sum((x ^ y).bit_count() <= radius for y in base) for x in base}


def test_hashes_follow_the_bytes():
    r = random.Random(1)
    parts = ["".join(r.choice("ab \n\té") for _ in range(r.randint(0, 30))).encode() for _ in range(300)] + [b"z" * 600_000, b"z" * 600_000]
    buf = np.frombuffer(b"".join(parts), np.uint8)
    off = np.append(0, np.cumsum([len(p) for p in parts]))
    h = flat.hash_pieces(buf, off[:-1], off[1:])
    assert len(set(zip(h.tolist(), parts))) == len(set(parts)) == len(set(h.tolist()))
    s, e, w = flat.words_of(buf, off)
    assert [buf[a:b].tobytes() for a, b in zip(s, e)] == [x for p in parts for x in p.split()]
    assert np.diff(w).tolist() == [len(p.split()) for p in parts]


def test_stages_keep_columns_with_clashing_names(make, odd_rows):
    from quarry.llm import langid
    names = ["__key", "__k", "__id", "__common", "__n", "__llm_key", "key", "common", "row", "fp", "lines", "shard", "path"]
    docs = make(odd_rows + [(100 + i, prose(60, i) + "\nThe same line in all of them", "en", "s") for i in range(8)])
    for c in names:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    for stage in (quality.clean, lambda d: langid.confident(d, 0.4), templates.dedup_lines, lambda d: simhash.one_of_each(d, 4, 4)):
        out = stage(docs)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in rows for c in names)
    upper = make([(1, prose(30, 1), "en", "s")]).withColumnRenamed("text", "Text").withColumnRenamed("doc_id", "DOC_ID")
    assert quality.line_rules(upper).first().n_words == 30
