"""Pieces, packing, page text, the pipeline and the entry point."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from llm_fixtures import SF, make, odd_rows, prose  # noqa: F401
from quarry.llm import htmltext, packing, pieces, queries

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def _texts():
    r = random.Random(3)
    out = ["", " ", "  a  b ", "a\tb\nc", "ﬁ Å ①　x", "▁a ▁", "a b", "<s> </s> <unk> <0x41>", "a\x00b", "é\U0001F600", " " * 300 + "x",
           "ab" * 500, "\n", " \n", "abababab aabb bbaa", " ①", "①a", "x" * 5000, "don't we'll 'll", "a <|endoftext|> b", "a  \n  b ", "　a 　b"]
    for letters in ("abcdeéßñthingon  ▁\n\t.,#①\U0001F600梦日本'1", "the inaon "):
        out += ["".join(r.choice(letters) for _ in range(r.randint(0, 300))) for _ in range(400)]
    return out + [prose(200, i) for i in range(20)]


def test_pieces_equal_the_library(make):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = _texts()
    got = {r.doc_id: r for r in pieces.encode_decode(make([(i, t) for i, t in enumerate(texts)]), PIECES).collect()}
    for i, t in enumerate(texts):
        want = sp.encode(t, add_bos=True, add_eos=True)
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want, t[:80]
        assert got[i].n_tokens == len(want) and got[i].decoded == sp.decode(want), t[:80]


def test_pieces_of_any_ids_decode_like_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    m, r = pieces.model(PIECES), random.Random(8)
    rows = [[1] + [r.choice([r.randrange(3, 259), r.randrange(259, 32000)]) for _ in range(r.randint(0, 12))] + [2] for _ in range(500)]
    rows = [x for x in rows if not any(3 <= i < 259 for i in x)] + [[1, *m.byte_id[list(t.encode())].tolist(), 2] for t in ("é①", "a b", "\n\n")]
    ids, off = np.concatenate([np.array(x) for x in rows]), np.append(0, np.cumsum([len(x) for x in rows]))
    assert m.decode(ids, off) == [sp.decode(x) for x in rows]


def test_pieces_on_odd_rows(make, odd_rows):
    out = pieces.encode_decode(make(odd_rows).withColumn("ids", F.lit(1)), PIECES).collect()
    assert len(out) == len(odd_rows) and {r.n_tokens for r in out if r.doc_id in (1, 2)} == {2}
    assert pieces.encode_decode(make([]), PIECES).count() == 0


def test_byte_ids_equal_the_library():
    import pyarrow as pa
    from quarry.llm import flat
    fast = Tokenizer.from_file(BYTES)
    r = random.Random(21)
    mark = "<|endoftext|>"
    texts = _texts() + [mark, "ab <|endoftext|> cd", mark + mark, " " + mark + " ", "<|endoftext|", "x<|endof", "text|>", "<|<|endoftext|>|>"]
    texts += ["".join(r.choice([mark, " ", "a", "<|", "end", " of", "|>", "\n", "é", "  "]) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    ids, off = packing.tokenizer(BYTES).encode(*flat.texts_of(pa.array(texts, pa.string())))
    want = [e.ids for e in fast.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == want


def _check_packing(rows, placed, size=1024):
    """Every document's ids are covered once, pieces follow the rule, sequences are gapless and within size."""
    fast = Tokenizer.from_file(BYTES)
    ids = {k: fast.encode(r[1] or "", add_special_tokens=False).ids + [2] for k, r in enumerate(rows)}
    by_doc, seqs = defaultdict(list), defaultdict(list)
    for p in placed:
        by_doc[str(p.doc_id)].append((p.piece, p.start, p.length, p.ids_crc32))
        seqs[p.sequence_id].append((p.offset, p.length))
    want = defaultdict(list)
    for k, r in enumerate(rows):
        n, at = len(ids[k]), 0
        while at < n:
            length = (n - at) % size or size if at == 0 else size
            want[str(r[0])].append((0 if at == 0 else 1 + (at - ((n % size) or size)) // size, at, length,
                                    zlib.crc32(np.array(ids[k][at:at + length], "<u4").tobytes())))
            at += length
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    for s in seqs.values():
        at = 0
        for off, length in sorted(s):
            assert off == at
            at += length
        assert at <= size
    return len(seqs), sum(len(v) for v in ids.values())


def test_packing_places_every_piece(make, odd_rows):
    rows = odd_rows + [(100 + i, prose(random.Random(i).randint(1, 900), i) + "<|endoftext|> z" * (i % 3), "en", "s") for i in range(150)]
    n, total = _check_packing(rows, queries.pack_digests(make(rows)).collect())
    assert n <= -(-total // 1024) + 3
    assert queries.pack_digests(make([])).count() == 0
    assert packing.pack(make(rows[-5:]), BYTES).where("length(ids) = 4 * length").count() >= 5


@pytest.mark.parametrize("block_rows", [7, 60, 10_000])
def test_packing_in_several_blocks(spark, block_rows):
    r = random.Random(block_rows)
    parts = spark.createDataFrame([(i, 0, 0, r.randint(1, 1024)) for i in range(300)], "doc_id bigint, piece int, start bigint, length bigint")
    out = packing.place(parts, 1024, block_rows).collect()
    fill = defaultdict(int)
    for p in out:
        fill[p.sequence_id] += p.length
    assert len(out) == 300 and max(fill.values()) <= 1024


def _best_fit(lengths):
    bins = packing.Bins(1024)
    for i in np.lexsort((np.arange(len(lengths)), -lengths)).tolist():
        bins.add((int(lengths[i]), i))
    return bins


def test_local_search_empties_bins():
    """Two of 410 and four of 307 fill two bins; best fit decreasing takes three, exchanges empty one."""
    for times in (1, 10):
        lengths = np.array([410, 410, 307, 307, 307, 307] * times)
        before = len(_best_fit(lengths).items)
        number, offset, fill = packing.pack_block(lengths, 1024)
        assert before > 2 * times and number.max() + 1 == 2 * times and (fill == 1024).all()


def test_local_search_raises_squared_fill_and_loses_nothing():
    r = random.Random(5)
    for k in range(20):
        lengths = np.array([x for _ in range(40) for a, b in [sorted(r.sample(range(1, 1024), 2))] for x in (a, b - a, 1024 - b)])
        bins = _best_fit(lengths)
        squares, before = sum(f * f for f in bins.fill), len(bins.items)
        packing.improve(bins)
        assert sum(f * f for f in bins.fill) > squares and max(bins.fill) <= 1024 and sum(map(bool, bins.items)) <= before
        assert sorted(i for b in bins.items for _, i in b) == list(range(120))
        assert all(sum(s for s, _ in b) == f for b, f in zip(bins.items, bins.fill))


PAGE = """<html><head><title>T</title><script>var a="</p>";</script><style>p{}</style></head><body>
<header><h1>Site</h1><p>Slogan here for all to see</p></header>
<div id="cookie-notice">We use cookies to give you the best experience on our site, please accept them all.</div>
<nav><a href=x>Home</a> <a href=y>News</a></nav>
<div class="wrap"><div class="sidebar"><p>Side text which is long enough to look like an article by its length alone.</p></div>
<%s class="content"><h1>Title &amp; more &eacute;</h1><p>First para with   some <b>wo</b>rds &nbsp; that goes on for long enough, really.</p><p>Short.</p>
<ul><li>Item one of the list with text</li><li>Item two</li></ul><p>Second para with some words that goes on for long enough, really yes.
<div class=ad>Buy now this thing it is great and cheap</div><p>Third<br>para &lt;ok&gt;</p></%s>
<form><p>Name <input></p><button>Send</button></form>
<div class="comments"><p>I liked this article quite a lot, great work, said some reader in a long comment.</p></div></div>
<footer>(c) 2020 all rights reserved by the publisher of this page</footer></body></html>"""
TEXT = ("Title & more é\n\nFirst para with some words that goes on for long enough, really.\n\nShort.\n\nItem one of the list with text\n\n"
        "Item two\n\nSecond para with some words that goes on for long enough, really yes.\n\nThird para <ok>")


@pytest.mark.parametrize("tag", ["article", "main", "div", "section"])
def test_page_text(tag):
    assert htmltext.main_text(PAGE % (tag, tag)) == TEXT


LONG = "Some sentence of the article that is long enough to count, with commas, and more words. "


@pytest.mark.parametrize("page,want", [
    ("<body><article class='post comments-open'><p>%s</p><p>%s</p></article></body>", ["L", "L"]),
    ("<body><div class='content has-sidebar'><p>%s</p><p>%s</p></div><footer>foot</footer></body>", ["L", "L"]),
    ("<body><div id='page' class='menu-open'><article><p>%s</p><p>%s</p></article></div></body>", ["L", "L"]),
    ("<body><form action=x><nav><a href=a>Home</a></nav><article><p>%s</p><p>%s</p></article><input></form></body>", ["L", "L"]),
    ("<body><article><h1><a href=x>Linked headline</a></h1><p>%s</p><p><a href=y>A linked paragraph in it</a></p><p>%s</p></article></body>",
     ["Linked headline", "L", "A linked paragraph in it", "L"]),
    ("<body><main><article><p>%s</p></article><section><p>%s</p></section></main><footer>foot</footer></body>", ["L", "L"]),
    ("<body><article><p>%s</p><p>%s</p></article><!-- oops <p>y", ["L", "L"]),
    ("<p>%s</p><p>hello <b", ["L", "hello"]),
    ("<body><article><p>%s</p><ul><li><a href=a>One link</a></li><li><a href=b>Other link</a></li></ul></article><p class=nav-menu>x y z</p></body>", ["L"]),
    ("<body><article><p>%s</p></article><div id='commentList'><p>%s</p><p>Nice one, thanks a lot for this text.</p></div></body>", ["L"]),
    ("<body><div class='sidebar-left'><p>Side text.</p></div><div class='story'><p>%s</p><p>%s</p></div></body>", ["L", "L"]),
    ("<body><div class='newsletter box'>Sign up</div><header class='site-header'><p>Slogan</p></header><main><header><h1>Title</h1></header><p>%s</p></main></body>",
     ["Title", "L"]),
])
def test_page_text_keeps_the_article_and_drops_what_stands_beside(page, want):
    full = page % ((LONG * 3,) * page.count("%s"))
    assert htmltext.main_text(full) == "\n\n".join((LONG * 3).strip() if w == "L" else w for w in want)


def test_page_text_of_odd_pages(spark):
    assert htmltext.main_text("just text &lt;x&gt;") == "just text <x>"
    assert htmltext.main_text("<p>a<b>b</b> c<p>d") == "ab c\n\nd"
    assert htmltext.main_text("</div></p><p>") == "" and htmltext.main_text("<article><p>x") == "x"
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>hello</p>"), (3, "v", ""), (4, "w", "<p>" + "long " * 50_000 + "</p>"), (5, "x", "<" * 2000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(1))
    got = htmltext.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == len(rows)
    by = {r.page_id: r for r in got.collect()}
    assert by[1].text == "" and by[1].n_chars == 0 and by[None].text == "hello" and by[4].n_chars == 5 * 50_000 - 1
    assert htmltext.extract(df.limit(0)).count() == 0


def test_pages_of_the_table_give_their_article(spark):
    import html
    import re
    pages = {r.page_id: r.html for r in spark.read.parquet(SF + "/pages.parquet").collect()}
    for r in queries.op3_main_text(spark, SF).collect():
        art = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", art)]
        assert r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_pipeline_keeps_one_of_each_and_every_clean_document(spark, make, odd_rows):
    import corpus_pipeline as P
    docs = make(odd_rows + [(100 + i, prose(120, i), "en", "s") for i in range(30)] + [(200 + i, prose(120, 3), "en", "t") for i in range(5)])
    base = [(r.doc_id, r.text) for r in docs.collect()]
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = out
    left = {r.doc_id: r for r in docs.collect()}
    passed = [(k, t) for k, t in base if not brute.base_rules(t)[-1]]
    comp = brute.components([k for k, _ in passed], [brute.fingerprint(t) for _, t in passed])
    assert sorted(map(str, left)) == sorted({str(c) for c in comp})
    placed = P.STAGES[-1][1](spark, docs, SF)
    _check_packing([(r.doc_id, r.text) for r in left.values()], placed.collect())


def test_pipeline_runs_on_tables_and_on_nothing(spark, make):
    import corpus_pipeline as P
    out = P.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
    docs = make([])
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_digests(spark):
    r = queries.op4_pieces(spark, SF).orderBy("doc_id").first()
    text = spark.read.parquet(SF + "/documents.parquet").orderBy("doc_id").first().text
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = sp.encode(text, add_bos=True, add_eos=True)
    assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_every_query_is_registered():
    import __spark_entry__ as E
    names = list(E.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
