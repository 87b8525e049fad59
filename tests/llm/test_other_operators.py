"""Operators over pages, vectors and tokens, and the pipeline."""

import hashlib
import math
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leasewell.llm import html_extract, packing, sentencepiece_fst, vector_search, warc
from leasewell.llm.html_dom import Page, token_groups
from leasewell.llm.html_training import labelled_pages
from tests.llm.conftest import prose
from tests.oracle import connection, same

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
needs_model = pytest.mark.skipif(not os.path.exists(sentencepiece_fst.MODEL), reason="no tokenizer files")


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


# ---- main text


@pytest.fixture(scope="module")
def trees():
    return html_extract.trained()


def test_extraction_of_known_shapes(trees):
    body = "<h1>Title here</h1><p>First <b>bold</b>er part, with words.<p>Of.<p>A &amp; B &eacute;&nbsp;x</p>"
    for shape in ("<article>{}</article>", '<div class="entry-content">{}</div>', "<main>{}</main>", '<div id="page"><div class="post">{}</div></div>'):
        source = f'<!DOCTYPE html><html><head><title>T</title><script>var t="</p>"</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a>More</a></li></ul></nav><!-- c --><div class="ad">Buy this now, it is good.</div>{shape.format(body)}<div class="comments"><h3>Comments</h3><div class="comment"><p>I liked it very much, thank you.</p></div></div><form action="/s"><label>Mail</label><input name="m"><button>Send</button></form><div class="cookie-notice">We use cookies.</div><footer>&copy; 2024 Someone. All rights.</footer></body></html>'
        assert html_extract.main_texts([source], trees) == ["Title here First bolder part, with words. Of. A & B é x"], shape


#: Pages written by hand, most without a name in them, and their main texts.
PLAIN = [
    ('<html><body><div><div><a href="/">Home</a> <a href="/n">News</a> <a href="/c">Contact</a></div><div><h1>Big day</h1><p>The town met on Monday to talk about the new bridge, which will open next year.</p><p>Nobody was late, and the mayor spoke for an hour about the cost.</p></div><div><h3>Comments</h3><div>Bob: I liked this a lot!</div><div>Ann: me too</div></div><div>&copy; 2024 The Town. All rights reserved.</div></div></body></html>', 'Big day The town met on Monday to talk about the new bridge, which will open next year. Nobody was late, and the mayor spoke for an hour about the cost.'),
    ('<div><div>Big day</div><div>The town met on Monday to talk about the new bridge, which will open next year.</div><div>Nobody was late, and the mayor spoke for an hour about the cost of it all.</div></div><div><div>Bob: I liked this a lot!</div><div>Ann: me too</div></div>', 'Big day The town met on Monday to talk about the new bridge, which will open next year. Nobody was late, and the mayor spoke for an hour about the cost of it all.'),
    ('<body><div><a href="/">Start</a> | <a href="/a">Articles</a> | <a href="/l">Log in</a></div><div><div><h1>How to repair a bicycle</h1><p>First turn the bicycle over, so that it rests on saddle and handlebars.</p><p>Then take the wheel out. You need a wrench, a tube and some patience.</p><h2>The tube</h2><p>Look for the hole in a bowl of water: bubbles show where it is.</p><ul><li>wrench</li><li>tube</li></ul></div><div><h3>Related</h3><ul><li><a href="/1">Clean a chain</a></li><li><a href="/2">Buy a saddle</a></li></ul></div></div><div>Copyright 2023 Bicycle Press. Privacy. Terms.</div></body>', 'How to repair a bicycle First turn the bicycle over, so that it rests on saddle and handlebars. Then take the wheel out. You need a wrench, a tube and some patience. The tube Look for the hole in a bowl of water: bubbles show where it is. wrench tube'),
    ('<div>We use cookies to make this site better. <button>Accept</button></div><div><h1>Rain in the north</h1><div>It rained for three days in the north, and rivers rose quickly.</div><div>Farmers hope that the fields will dry before the harvest begins.</div></div><div><input name="mail"><button>Subscribe</button> to our newsletter</div><div><b>Carl</b> says: terrible weather</div><div><b>Dora</b> says: we need it</div>', 'Rain in the north It rained for three days in the north, and rivers rose quickly. Farmers hope that the fields will dry before the harvest begins.'),
    ('<table><tr><td><a href="/">Home</a><br><a href="/b">Books</a><br><a href="/m">Music</a></td><td><h2>A short history of tea</h2><p>Tea came to Europe in the seventeenth century, and was first sold as medicine.</p><p>It took a hundred years until it was drunk every day.</p></td></tr></table>', 'A short history of tea Tea came to Europe in the seventeenth century, and was first sold as medicine. It took a hundred years until it was drunk every day.'),
    ('<main><h1>Notes</h1><p>We accept cookies, the kind you can eat, said the baker, and everyone laughed for a while.</p><p>Home is where the oven is.</p></main><footer>Imprint</footer>', 'Notes We accept cookies, the kind you can eat, said the baker, and everyone laughed for a while. Home is where the oven is.'),
]


def test_extraction_of_plain_pages(trees):
    got = html_extract.main_texts([source for source, _ in PLAIN], trees)
    assert sum(g == text for g, (_, text) in zip(got, PLAIN, strict=True)) >= len(PLAIN) - 1
    assert got[0] == PLAIN[0][1] and not any("me too" in g or "we need it" in g for g in got)


def test_hostile_pages_take_linear_time():
    import time

    for piece in ('<b x ', '<a href="', "<div>", "<p><b>", '<a "> ', "</p>", "<", "<!", "<!--", "<script>", "<title></title ", "&amp", "<td>", "<p><button><div>"):
        times = []
        for n in (1 << 16, 1 << 18):
            begin = time.process_time()
            Page(piece * (n // len(piece)))
            Page(piece * (n // len(piece)) + ">")
            times.append(time.process_time() - begin)
        assert times[1] < 12 * times[0] + 0.3, piece


@needs_data
def test_extraction_of_the_table(spark, trees):
    import html
    import re

    rows = {r.page_id: r for r in html_extract.extracted(table(spark, "pages")).collect()}
    for page in table(spark, "pages").where("html is not null").collect():
        inner = re.sub(r"</?(article|p|h1|br)>", " ", page.html[page.html.index("<article>") : page.html.index("</article>")])
        assert rows[page.page_id].text == " ".join(html.unescape(re.sub(r"<[^>]*>", "", inner)).split())
        assert rows[page.page_id].n_chars == len(rows[page.page_id].text)


def test_held_out_elements(trees):
    pages, labels = labelled_pages(150, seed=3)
    odds = trees.log_odds(html_extract.features(pages))
    assert ((odds > 0) == labels).mean() > 0.97


def test_extraction_of_odd_pages(spark):
    sources = [None, "", "plain text &lt;b", "<p>a<p>b", "<div><p>x</div></div></p>stray</i>", "<" * 50, "<a href='x>y", "<script>never", "<!-- open", "<p>" * 3000 + "deep enough to be read", "<table><tr><td>one<td>two</table>"]
    frame = spark.createDataFrame([(k, "u", s) for k, s in enumerate(sources)], "page_id long, url string, html string").selectExpr("*", "'kept' AS text")
    got = {r.page_id: r.text for r in html_extract.extracted(frame).collect()}
    assert got[0] == got[1] == got[7] == got[8] == "" and got[2] == "plain text <b" and got[3] == "a b" and len(got) == len(sources)
    assert html_extract.extracted(frame.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-3, 3), min_size=1, max_size=9), st.data())
def test_decoding_is_the_best_consistent_choice(odds, data):
    parent = [-1] + [data.draw(st.integers(0, k - 1)) for k in range(1, len(odds))]
    keep = html_extract.decoded(parent, [float(x) for x in odds])
    assert keep[0] and all(not keep[k] or keep[parent[k]] for k in range(1, len(odds)))
    best = max(sum(odds[k] for k in range(1, len(odds)) if mask >> k & 1) for mask in range(1, 2 ** len(odds), 2) if all(not mask >> k & 1 or mask >> parent[k] & 1 for k in range(1, len(odds))))
    assert sum(odds[k] for k in range(1, len(odds)) if keep[k]) == best


def test_attribute_words():
    assert token_groups(' class="site-footer"') & 1 << 5 and token_groups(" id=mainContent") & 1 << 8 and token_groups(' data-id="ad"') == 0
    assert Page("<div class=ad>x</div>").kept_text([True, False]) == ""


# ---- SentencePiece


@needs_model
@needs_data
def test_encoding_equals_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL)
    rows = sentencepiece_fst.encode(table(spark, "documents").select("doc_id", "text")).collect()
    for row in rows:
        assert row.ids == library.encode(row.text) and row.round_trip and row.n_ids == len(row.ids)


@needs_model
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeinrst ▁\n\t.!=0123é漢"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text_equals_the_library(text):
    import sentencepiece

    global _library
    if "_library" not in globals():
        _library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL)
    with open(sentencepiece_fst.MODEL, "rb") as file:
        machine = sentencepiece_fst.compiled(file.read())
    ids = np.frombuffer(machine.encode(text), np.int32)
    assert ids.tolist() == _library.encode(text) and machine.decode(ids) == _library.decode(ids.tolist())


def test_unigram_takes_the_least_weight():
    model = sentencepiece_fst.Model(b"")
    model.pieces, model.scores, model.types = ["<unk>", "▁", "a", "b", "ab", "▁a", "▁ab"], [0, -3.0, -2.0, -2.0, -3.5, -2.5, -6.0], [2, 1, 1, 1, 1, 1, 1]
    model.kind, model.byte_fallback, model.dummy_prefix, model.squeeze, model.escape = sentencepiece_fst.UNIGRAM, False, True, True, True
    machine = sentencepiece_fst.Transducer(model)
    assert np.frombuffer(machine.encode("ab"), np.int32).tolist() == [5, 3]
    assert np.frombuffer(machine.encode("  ab  z"), np.int32).tolist() == [5, 3, 1, 0]


def least_weight(machine, text):
    """The least weight of a path by trying all ways to cut a text."""
    if not text:
        return 0.0
    model = machine.model
    ways = [(model.pieces.index(text[:k]) if text[:k] in machine.lexicon else None, k) for k in range(1, len(text) + 1)]
    return min((machine.unknown_cost if known is None else -model.scores[known]) + least_weight(machine, text[k:]) for known, k in ways if known is not None or (k == 1))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcz ", max_size=9), st.integers(0, 10**6))
def test_unigram_paths_have_the_least_weight(text, seed):
    rng = random.Random(seed)
    model = sentencepiece_fst.Model(b"")
    model.pieces = ["<unk>", "▁", "a", "b", "c", "ab", "▁a", "bc", "abc", "ca", "▁b"]
    model.scores, model.types = [0.0] + [-rng.choice([1.0, 2.0, 3.0, 4.5]) for _ in model.pieces[1:]], [2] + [1] * (len(model.pieces) - 1)
    model.kind, model.byte_fallback, model.dummy_prefix, model.squeeze, model.escape = sentencepiece_fst.UNIGRAM, False, True, False, True
    machine = sentencepiece_fst.Transducer(model)
    ids = np.frombuffer(machine.encode(text), np.int32)
    assert machine.decode(ids) == "".join(" ⁇ " if c == "z" else c for c in text)
    assert abs(sum(machine.unknown_cost if k == 0 else -model.scores[k] for k in ids) - least_weight(machine, machine.normalised(text))) < 1e-9


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 200), unique=True, max_size=120), st.lists(st.integers(0, 200), max_size=60))
def test_tables_hold_their_keys(keys, asked):
    table = sentencepiece_fst.Table(8)
    half = len(keys) // 2
    for part in (keys[:half], keys[half:]):
        table.put(np.array(part, np.int64), np.array(part, np.int32) * 3)
    expected = [3 * k if k in keys else -1 for k in asked]
    assert table.get(np.array(asked, np.int64)).tolist() == expected


@needs_model
def test_encoding_of_odd_rows(spark, odd, odd_rows):
    rows = sentencepiece_fst.encode(odd).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(odd_rows) and by[4].ids is None and by[4].n_ids is None and by[5].ids == [] and by[1].score == "kept"
    back = sentencepiece_fst.decode(sentencepiece_fst.encoded(odd))
    assert {r.doc_id: r.decoded for r in back.collect()} == {i: t for i, t, *_ in odd_rows}
    assert sentencepiece_fst.encoded(odd.limit(0)).count() == 0


# ---- WARC


@needs_data
def test_archive_equals_sql(spark):
    from leasewell.llm import queries

    assert same(queries.op4_warc(spark, DATA), queries.ORACLE_SQL["op4_warc"], connection())


def test_archive_gives_back_the_records(spark, tmp_path):
    big = "é" + "x" * 1200 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a/", big), (2, None, big), (3, "http://b\r\n/", None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (7, "u", big), (None, "u", "x"), (7, "u", big)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'kept' AS digest", "'kept' AS payload")
    path = f"file://{tmp_path}/archive"
    warc.write_archive(frame, path)
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_records(spark, path).collect())
    size, digest = len(big.encode()), hashlib.sha1(big.encode()).hexdigest()
    assert got[0] == (1, "revisit", 7, size, digest) and got[1][1:3] == ("revisit", 7) and got[6] == got[7] == (7, "response", None, size, digest)
    assert [g[1] for g in got[2:6]] == ["response"] * 4 and got[2][3] == got[3][3] == 0
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    records = {r.page_id: r for r in warc.read_archive(spark, path).collect()}
    assert bytes(records[1].payload).decode() == big and bytes(records[7].record).endswith(big.encode()) and b"%0D%0A/" in bytes(records[3].record)
    warc.export_warc(spark, path, f"file://{tmp_path}/files")
    back = warc.import_warc(spark, f"file://{tmp_path}/files").collect()
    assert sorted((r.page_id, bytes(r.record)) for r in back) == sorted((r.page_id, bytes(r.record)) for r in warc.read_archive(spark, path).collect())


def test_records_of_other_writers(spark, tmp_path):
    body = b"HTTP/1.0 200 OK\r\n\r\n<p>x"
    record = lambda kind, own: b"WARC/1.0\r\nwarc-type:" + kind + b"\r\nWARC-Record-ID: <urn:uuid:" + own + b">\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record(b"response", b"1") + record(b"warcinfo", b"2"))
    rows = warc.import_warc(spark, f"file://{tmp_path}").orderBy("record_id").collect()
    assert [(r.record_id, r.page_id, r.record_type) for r in rows] == [("urn:uuid:1", None, "response"), ("urn:uuid:2", None, "warcinfo")]
    assert all(bytes(r.record).endswith(body) for r in rows)


def test_empty_archive(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/archive")
    assert warc.read_records(spark, f"file://{tmp_path}/archive").count() == 0


# ---- packing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_best_fit_decreasing(sizes):
    width, rooms = 32, []
    for size in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= size]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - size)
        else:
            rooms.append(width - size)
    got = packing.best_fit_decreasing(np.array(sizes, np.int64), width)
    used = np.bincount(got, sizes).astype(int) if sizes else []
    assert sorted(width - u for u in used) == sorted(rooms)


@needs_model
@pytest.mark.parametrize("width", [64, 2048])
def test_packed_rows_hold_every_id(spark, odd, odd_rows, width):
    rows = packing.packed(odd, width=width, shard_bytes=50_000)
    with open(packing.RANKS, "rb") as file:
        encoding = packing._encoding(file.read(), packing.PATTERN)
    got = {r.doc_id: r.ids for r in packing.unpacked(rows).drop("key").collect()}
    expected = {i: [*encoding.encode_ordinary(t), packing.END_ID] for i, t, *_ in odd_rows if t is not None and i is not None}
    assert got.pop(None) == expected[1] and got == expected
    for row in rows.collect():
        ids, positions, cumulative = np.frombuffer(row.ids, "<u2"), np.frombuffer(row.position_ids, "<u2"), row.cu_seqlens
        assert len(ids) == len(positions) == width and cumulative[0] == 0 and cumulative[-1] == row.n_ids <= width
        assert len(cumulative) == len(row.doc_ids) + 1 == len(row.pieces) + 1 and (ids[row.n_ids :] == packing.END_ID).all() and not positions[row.n_ids :].any()
        for a, b, doc, piece in zip(cumulative, cumulative[1:], row.doc_ids, row.pieces, strict=False):
            assert positions[a:b].tolist() == list(range(b - a))
            if doc is not None:
                assert ids[a:b].tolist() == expected[doc][piece * width : piece * width + b - a]
    held = rows.select(F.explode("doc_ids").alias("d")).where("d is not null").distinct()
    assert {r.d for r in held.collect()} == set(expected)
    total = rows.agg(F.sum("n_ids")).first()[0]
    assert total == sum(map(len, expected.values())) + len(expected[1])
    assert packing.packed(odd.limit(0)).count() == 0


@needs_model
def test_packing_gives_back_repeated_ids(spark):
    rows = [(1, prose(1, 300)), (1, prose(2, 280)), (1, prose(1, 300)), (2, None), (2, ""), (2, ""), (None, prose(3, 90)), (None, prose(1, 300)), (3, prose(4, 20))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    with open(packing.RANKS, "rb") as file:
        encoding = packing._encoding(file.read(), packing.PATTERN)
    got = sorted(((r.doc_id, list(r.ids)) for r in packing.unpacked(packing.packed(frame, width=64, shard_bytes=2_000)).collect()), key=str)
    assert got == sorted(((i, [*encoding.encode_ordinary(t), packing.END_ID]) for i, t in rows if t is not None), key=str)


# ---- vectors


def brute_top(rows, k=20):
    """{(query_id, rank, vec_id, score)} of rows, in Python's integers."""
    ints = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(64 * x) for x in v)]
    clip = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
    found = {}
    for q, a in ints:
        if q % 20 == 0:
            found.setdefault(q, []).extend((-clip(sum(map(int.__mul__, a, b))), i) for i, b in ints if i != q and len(a) == len(b))
    return sorted((q, n, i, -s) for q, scores in found.items() for n, (s, i) in enumerate(sorted(scores)[:k], 1))


def top(frame, **options):
    rows = vector_search.top_k(frame, F.col("vec_id") % 20 == 0, **options).select("query_id", "rank", "vec_id", "score")
    return sorted(tuple(r) for r in rows.collect())


@pytest.mark.parametrize(("spread", "cells"), [(0.1, 1 << 20), (0.1, 64 * 16), (5.0, 70 * 16), (1e6, 80 * 16), (1e17, 1 << 20)])
def test_top_k_equals_brute_force(spark, spread, cells):
    rng = np.random.default_rng(4)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(0, spread, 16)]) for k in range(200)]
    rows += [(200 + k, rows[20][1]) for k in range(60)] + [(300, None), (301, [None] * 16), (302, [float("nan")] * 16), (303, [float("inf")] * 16), (None, rows[0][1]), (320, []), (340, [1.0, 2.0]), (341, [2.0, -1.0])]
    rows += [(20, rows[40][1]), (7, rows[9][1]), (7, rows[7][1]), (60, rows[60][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS v", "2 AS qb", "3 AS rank", "4 AS row", "5 AS dims")
    assert top(frame, row_cells=cells, query_cells=64 * 16) == brute_top(rows)


def test_top_k_of_little(spark):
    assert top(spark.createDataFrame([], "vec_id long, embedding array<float>")) == []
    rows = [(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [3.0]), (2, [1e300]), (3, [-1e300]), (20, [1e300]), (4, [1e308])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top(frame)
    assert got == brute_top(rows) and (0, 3, 20, 2**63 - 1) in got and (20, 10, 3, -(2**63)) not in got


def test_few_exact_vectors_are_read(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) for x in rng.normal(0, 1, 32)]) for k in range(2_000)] + [(5_000, [1e9] * 32)]
    frame, path = spark.createDataFrame(rows, "vec_id long, embedding array<float>"), f"file://{tmp_path}/files"
    vector_search.write_files(frame, path)
    left = vector_search.candidates(spark, path, F.col("vec_id") % 20 == 0, row_cells=512 * 32)
    assert 100 * 20 <= left.count() < 0.12 * 101 * 2_001
    got = sorted(tuple(r) for r in vector_search.search(spark, path, F.col("vec_id") % 20 == 0).collect())
    assert got == brute_top([(i, [float(np.float32(x)) for x in v]) for i, v in rows])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(0, 40), st.integers(0, 10**6))
def test_bounds_hold(dims, exponent, seed):
    rng = np.random.default_rng(seed)
    q, v = (np.floor(rng.normal(0, 2.0**exponent, (n, dims))) for n in (3, 20))
    shift = np.maximum(np.frexp(np.abs(v).max(axis=1))[1] - (vector_search.CELL_BITS - 1), 0)
    cells = np.floor(np.ldexp(v, -shift[:, None])).astype(np.int8)
    lower, upper = vector_search.bounds(q, cells, shift)
    for i in range(3):
        for j in range(20):
            assert lower[i, j] <= min(max(sum(int(a) * int(b) for a, b in zip(q[i], v[j], strict=True)), -(2**63)), 2**63) <= upper[i, j]


@needs_data
def test_top_k_equals_sql(spark):
    from leasewell.llm import queries

    assert same(queries.op6_exact_top_k(spark, DATA), queries.ORACLE_SQL["op6_exact_top_k"], connection()) == 500


# ---- pipeline


@needs_data
@needs_model
def test_pipeline_stages(spark):
    import corpus_pipeline
    from tests.llm import brute

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, rows = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "SentencePiece encoding"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, DATA)
        assert docs.columns[: len(names)] == names and (k == 4 or docs.columns == names)
        got = {r.doc_id: r.text for r in docs.collect()}
        if k == 1:
            groups = brute.near_duplicates(list(rows.items()))
            assert got == {i: t for i, t in rows.items() if groups[i][0] == i}
        elif k == 2:
            spans = brute.repeats(list(rows.items()))
            assert set(rows) - set(got) <= {i for i, s in spans.items() if s[1]} and all(got[i] == t for i, t in rows.items() if not spans[i][1])
            assert all(len(got[i].encode()) >= spans[i][0] - spans[i][1] for i in got)
        elif k == 3:
            items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
            gone = {i for i, _ in brute.contained(list(rows.items()), items)}
            assert gone and got == {i: t for i, t in rows.items() if i not in gone}
        rows = got
    random.seed(0)
    assert docs.where("not round_trip").count() == 0 and corpus_pipeline.run(spark, DATA).count() == len(rows) and prose(1, 3)


@needs_model
def test_pipeline_of_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline
    from tests.llm import brute
    from tests.llm.conftest import SCHEMA

    line, one = prose(71, 40), prose(72, 300)
    more = [(20, one, "en", "a", 1), (20, line + " " + prose(73, 90), "en", "a", 1), (20, one, "en", "a", 1), (21, line + " " + prose(74, 90), "fr", "b", 1), (20, None, "en", "a", 1), (22, prose(75, 60) + " the test item is here word for word as it was", "en", "a", 1), (None, one, "en", "a", 1)]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = odd.unionByName(spark.createDataFrame(more, SCHEMA), allowMissingColumns=True)
    path = f"file://{tmp_path}"
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "the test item is here word for word as it was"), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, path).collect()
    kept = [(r.doc_id, r.text) for r in rows]
    assert rows and all(r.round_trip and r.n_ids == len(r.ids) for r in rows) and set(columns) <= set(rows[0].asDict())
    assert all(brute.words(t) for _, t in kept) and 22 not in {i for i, _ in kept} and not {2, 3, 4, 5, 6, 13} & {i for i, _ in kept}
    assert kept.count((20, one)) == 1 and (21, prose(74, 90)) in [(i, t.strip()) for i, t in kept]
    empty = tmp_path / "none"
    docs.limit(0).write.parquet(f"file://{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{empty}").count() == 0
