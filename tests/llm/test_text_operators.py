"""Operators over documents: brute force on small tables, and the odd cases."""

import os

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leasewell.llm import decontaminate, language_id, license_scan, near_duplicates, repeats
from leasewell.llm.arrowtext import Words, slices
from leasewell.llm.components import components
from tests.llm import brute
from tests.llm.conftest import SCHEMA, prose

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark, name="documents"):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def pairs(frame, *columns):
    return [tuple(r) for r in frame.select(*columns).collect()]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abÉéß 1_.\n-日ñ", max_size=40), max_size=6))
def test_words_and_shingles(texts):
    w = Words(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        own = [bytes(w.data[a:b]).decode() for a, b in zip(w.begin[w.offsets[k] : w.offsets[k + 1]], w.end[w.offsets[k] : w.offsets[k + 1]], strict=True)]
        assert own == brute.words(text)
    hashes, offsets = w.shingles()
    by_text = {}
    for k, text in enumerate(texts):
        found = brute.words(text)
        expected = [tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))] if found else []
        own = hashes[offsets[k] : offsets[k + 1]].tolist()
        assert len(own) == len(expected)
        for h, s in zip(own, expected, strict=True):
            assert by_text.setdefault(h, s) == s


def test_slices_hold_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["aa", None, "b" * 50, "", "ccc"])], ["text"])
    assert [x for part in slices(batch, "text", 4) for x in part.column("text").to_pylist()] == batch.column("text").to_pylist()


# ---- near duplicates


@needs_data
def test_near_duplicates_equal_brute_force(spark):
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates.near_duplicates(documents(spark)).collect()}
    assert got == brute.near_duplicates(pairs(documents(spark), "doc_id", "text"))


@pytest.mark.parametrize("block", [3, 256])
def test_near_duplicate_group_in_blocks(spark, block):
    base, rows = prose(5, 200).split(), []
    for k in range(24):
        own = list(base)
        for j in range(k % 9):
            own[10 + 20 * j] = f"edit{k}x{j}"
        rows.append((k, " ".join(own)))
    rows += [(100 + k, prose(5, 200)) for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates.near_duplicates(frame, block=block).collect()}
    assert got == brute.near_duplicates(rows)


def test_near_duplicates_of_odd_rows(spark, odd, odd_rows):
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates.near_duplicates(odd).collect()}
    expected = brute.near_duplicates([(i, t) for i, t, *_ in odd_rows if i is not None])
    assert got == expected and got[4] == (4, 0) and got[13][0] == 1
    kept = near_duplicates.one_of_each_group(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (c, _) in expected.items() if i == c} | {None}
    assert near_duplicates.near_duplicates(odd.limit(0)).count() == 0


def test_one_id_with_different_texts_and_copies(spark):
    one, two, three = prose(91, 80), prose(92, 80), prose(93, 60)
    near = lambda t, k: " ".join([*t.split()[:k], "edited", *t.split()[k + 1 :]])
    rows = [(1, one), (1, two), (2, near(one, 30)), (3, near(two, 40)), (1, one), (4, three), (4, three), (5, near(three, 20)), (6, None), (6, None), (6, ""), (7, "a b"), (7, "a b"), (None, one), (4, near(three, 50)), (1, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'kept' AS _stays", "1 AS node", "2 AS key")
    assert sorted(tuple(r) for r in near_duplicates.near_duplicates(frame).collect()) == sorted(brute.near_rows(rows))
    kept = near_duplicates.one_of_each_group(frame)
    assert kept.columns == frame.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    first = min((t for t in (three, near(three, 50))), key=brute.text_key)
    assert got == sorted([(1, one), (1, two), (4, first), (6, None), (6, None), (6, ""), (7, "a b"), (None, one), (1, None)], key=str)


@pytest.mark.parametrize("block", [2, 5])
def test_balls_and_what_is_outside_them(spark, block):
    base, rows = prose(95, 150).split(), []
    for k in range(30):  # near the pivot, at the edge of the threshold, and beyond
        own = list(base)
        for j in range((0, 1, 2, 3, 4, 5)[k % 6]):
            own[8 + 24 * j + k // 6] = f"edit{k}x{j}"
        rows.append((k, " ".join(own)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in near_duplicates.near_duplicates(frame, block=block).collect())
    assert got == sorted(brute.near_rows(rows))


def test_banding_reaches_the_recall():
    bands, rows = near_duplicates.bands_for(0.8, 0.9995)
    assert bands * rows <= near_duplicates.MOST_HASHES and 1 - (1 - 0.8**rows) ** bands >= 0.9995


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 100), (50, 41), (7, 7)] + [(200, 200 + k) for k in range(1, 30)]
    got = {r.node: r.group for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 41: 41, 50: 41, 100: 100, 101: 100, **{200 + k: 200 for k in range(30)}}


# ---- decontamination


@needs_data
def test_decontamination_equals_brute_force(spark):
    got = set(pairs(decontaminate.contained_items(documents(spark), documents(spark, "benchmark")), "doc_id", "item_id"))
    assert got and got == brute.contained(pairs(documents(spark), "doc_id", "text"), pairs(documents(spark, "benchmark"), "item_id", "text"))


def test_decontamination_of_odd_rows(spark, odd, odd_rows):
    long = prose(9, 400)
    items = [(1, " ".join(odd_rows[0][1].split()[10:30])), (2, "two words"), (3, None), (4, "!!"), (5, prose(8, 40)), (6, odd_rows[10][1][5000:9000]), (7, long), (None, "two words"), (8, "Élan çà et là")]
    frame = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'kept' AS doc_id")
    texts = [(i, t) for i, t, *_ in odd_rows if i is not None] + [(50, prose(10, 5000) + " " + " ".join(long.split()[:350]) + " " + prose(11, 5000))]
    docs = odd.select(*COLUMNS).unionByName(spark.createDataFrame([(*texts[-1], "en", "a", 1)], SCHEMA))
    expected = brute.contained(texts, [x for x in items if x[0] is not None])
    assert (50, 7) in expected and (10, 2) in expected
    assert set(pairs(decontaminate.contained_items(docs, frame), "doc_id", "item_id")) == expected
    kept = decontaminate.without_contaminated(odd, frame)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {i for i, *_ in odd_rows} - {i for i, _ in expected}
    assert decontaminate.contained_items(docs.limit(0), frame).count() == 0
    assert decontaminate.contained_items(docs, frame.limit(0)).count() == 0


def test_decontamination_of_repeated_ids_and_items(spark):
    long, short = prose(12, 300), prose(13, 30)
    items = [(1, long), (1, short), (2, long), (3, short), (3, short), (4, "x y"), (5, prose(14, 26))]
    half = " ".join(w if k % 60 else "edit" for k, w in enumerate(long.split()))
    docs = [(1, short), (1, prose(15, 40)), (1, None), (2, prose(16, 900) + " " + half), (2, prose(16, 20) + " x Y " + short), (2, prose(16, 20) + " x Y " + short), (3, " ".join(long.split()[:200]))]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = sorted((i, j) for i, t in docs for j, s in items if (0, 0) in brute.contained([(0, t)], [(0, s)]))
    assert sorted(pairs(decontaminate.contained_items(frame, bench), "doc_id", "item_id")) == expected and (2, 2) in expected
    kept = decontaminate.without_contaminated(frame.selectExpr("*", "1 AS key", "2 AS wanted"), bench)
    assert sorted(pairs(kept, "doc_id", "text"), key=str) == sorted([docs[1], docs[2], docs[6]], key=str)


@settings(max_examples=6, deadline=None)
@given(st.integers(0, 10**6))
def test_decontamination_near_the_threshold(spark, seed):
    rng = np.random.default_rng(seed)
    items = [(k, prose(1000 + k, int(n))) for k, n in enumerate(rng.integers(6, 260, 12))]
    docs = []
    for k in range(40):
        words = items[k % 12][1].split()
        for at in rng.integers(0, len(words), int(rng.integers(0, max(2, len(words) // 18)))):
            words[at] = f"e{k}"
        docs.append((k, " ".join([prose(k, int(rng.integers(0, 300))), *words, prose(k + 99, int(rng.integers(0, 60)))])))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(pairs(decontaminate.contained_items(frame, bench), "doc_id", "item_id")) == sorted(brute.contained(docs, items))


def test_needed_entries_keep_the_miss_rate():
    from math import comb

    need = decontaminate.needed(48, 0.8, 1e-9)
    assert sum(comb(48, k) * 0.8**k * 0.2 ** (48 - k) for k in range(need)) <= 1e-9 and need > 10


# ---- language


@needs_data
def test_languages_on_held_out_documents(spark):
    rows = language_id.language_of(documents(spark)).join(documents(spark).select("doc_id", "lang"), "doc_id")
    held = rows.where("held_out and symbols >= 20").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert held[0] >= 0.97 and held[1] > 30 and 0 <= held[2] <= held[3] <= 1


def test_language_of_odd_rows(spark, odd, odd_rows):
    rows = language_id.language_of(odd).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(odd_rows)
    assert all(by[k].lang_pred == "und" and by[k].score == 0 and by[k].bits is None for k in (4, 5, 6))
    assert {r.lang_pred for r in rows} <= {"und", "en", "fr"} and not by[None].held_out
    assert by[1].lang_pred == by[2].lang_pred
    kept = language_id.accepted(odd)
    assert kept.columns == odd.columns and not {4, 5, 6} & {r.doc_id for r in kept.collect()}
    assert kept.first().score == "kept"
    assert language_id.language_of(odd.limit(0)).count() == 0
    none = language_id.language_of(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_prediction_does_not_see_labels(spark, odd):
    parser = language_id.CrossParser({"a": ["the cat sat on the mat and ran"], "b": ["le chat est dans la maison verte"]})
    frame = spark.createDataFrame([(1, "the mat and the cat"), (2, "la maison est verte")], "doc_id long, text string")
    assert [r.lang_pred for r in language_id.identify(frame, parser).orderBy("doc_id").collect()] == ["a", "b"]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab c", min_size=1, max_size=40), st.text(alphabet="abd c", min_size=1, max_size=60))
def test_automaton_knows_the_substrings(sample, text):
    moves = language_id.suffix_automaton([ord(c) for c in sample])
    for k in range(len(text)):
        state, n = 0, 0
        while k + n < len(text) and ord(text[k + n]) in moves[state]:
            state, n = moves[state][ord(text[k + n])], n + 1
        assert text[k : k + n] in sample and (k + n == len(text) or text[k : k + n + 1] not in sample)


def greedy_bits(sample, symbols, bits):
    """Cost of the parse into longest phrases of the sample, by looking at substrings."""
    cost = at = 0
    while at < len(symbols):
        n = 0
        while at + n < len(symbols) and symbols[at : at + n + 1] in sample:
            n += 1
        cost, at = cost + (bits if n else np.log2(language_id.ALPHABET)), at + max(n, 1)
    return cost


@pytest.mark.parametrize("texts", [[prose(22, 400), "", "ba", prose(23, 25)], ["ab" * 700, "zz" * 300 + prose(21, 90), "x" * 900], [prose(21, 300) * 2, prose(24, 55) + " 日本 " + prose(25, 80)]])
def test_parse_equals_greedy_phrases(texts):
    samples = {"a": [prose(21, 300)], "b": ["ab" * 600 + "x" * 400], "c": ["日本語 ko ri"]}
    parser = language_id.CrossParser(samples)
    low = pa.array(texts).cast(pa.large_string())
    symbols, lengths = parser.symbols("".join(texts), np.array([len(t) for t in texts]))
    end = np.cumsum(lengths)
    assert len(low) == len(lengths)
    found = np.concatenate([c for _, c in parser.group_costs(symbols, lengths)])
    for row, name in enumerate(sorted(samples)):
        known = parser.symbols(samples[name][0])[0].tobytes()
        for k in range(len(texts)):
            assert abs(found[row, k] - greedy_bits(known, symbols[end[k] - lengths[k] : end[k]].tobytes(), parser.bits[row])) < 1e-6


def test_predictions_equal_greedy_parses(spark):
    letters = ["ba ko ri den tal".split(), "zu wy fi ge hop".split(), "mer so vi un eau".split()]
    rows = [(k, prose(k, 3 + 11 * (k % 9), letters[k % 3]), f"l{k % 3}" if k % 4 else None) for k in range(60)] + [(60, None, "l0"), (61, "!!", "l1"), (0, prose(200, 40, letters[1]), "l1"), (0, prose(200, 40, letters[1]), "l1")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = dict(language_id.sampled(frame, "doc_id", "text", "lang", ~language_id.held_out() & F.col("doc_id").isNotNull()))
    parser = language_id.CrossParser(samples)
    known = [parser.symbols(" ".join(samples[name]))[0].tobytes() for name in parser.languages]

    def predicted(text):
        symbols = parser.symbols(text or "")[0].tobytes()
        if not symbols.strip(b"\0"):
            return "und"
        costs = [greedy_bits(sample, symbols, bits) for sample, bits in zip(known, parser.bits, strict=True)]
        return parser.languages[int(np.argmin(costs))]

    got = sorted((r.doc_id, r.lang_pred) for r in language_id.language_of(frame).collect())
    assert got == sorted((i, predicted(t)) for i, t, _ in rows)


def test_sample_is_spread_over_whole_texts(spark):
    long = " ".join(f"w{k}x" for k in range(30_000))
    rows = [(k, long, "a") for k in range(3)] + [(10 + k, "short text", "a") for k in range(5)] + [(20, "one", "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = dict(language_id.sampled(frame, "doc_id", "text", "lang", F.lit(True)))
    assert found["b"] == ["one"] and found["a"].count("short text") == 5
    own = [t for t in found["a"] if t != "short text"]
    assert len(own) == 3 and sum(map(len, found["a"])) <= language_id.SAMPLE_SYMBOLS + 3 * 70
    for t in own:
        places = [int(w[1:-1]) for w in t.split() if w[0] == "w" and w[-1] == "x"]
        assert len(t) > 12_000 and places[0] == 0 and places[-1] == 29_999 and np.diff(places).max() < 1_000


def test_a_label_with_one_short_text_wins_nothing(spark):
    rng = np.random.default_rng(5)
    noise = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzéñß "), 2000))
    letters = {"a": prose(31, 3000), "b": prose(32, 3000, "zu wy fi ge hop jas qin".split())}
    texts = [prose(33, 80), prose(34, 80, "zu wy fi ge hop jas qin".split()), noise]
    for name, short in (("ok", "ok"), ("0", "a"), ("zz", "oh no")):
        parser = language_id.CrossParser({**{k: [v] for k, v in letters.items()}, name: [short]})
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        rows = language_id.identify(frame, parser).orderBy("doc_id").collect()
        assert [r.lang_pred for r in rows[:2]] == ["a", "b"]
        assert rows[2].bits > language_id.REJECT_BITS


def test_languages_in_other_scripts(spark, monkeypatch):
    latin = [chr(c) for c in (*range(97, 123), *range(0xE0, 0xF7), *range(0xF8, 0xFF))]
    han, hangul = [[chr(c) for c in range(first, first + 150)] for first in (0x4E00, 0xAC00)]
    greek, russian = [[chr(c) for c in range(first, first + 25)] for first in (0x3B1, 0x430)]
    kinds = {"a": greek, "b": han, "c": hangul, "d": latin, "e": russian, "f": han[::-1][:75]}
    samples = {name: [prose(k, 2500, letters)] for k, (name, letters) in enumerate(kinds.items())}
    samples["d"] = [prose(40, 15_000, latin)]
    frame = spark.createDataFrame([(k, prose(50 + k, 60, letters)) for k, letters in enumerate(kinds.values())], "doc_id long, text string")
    rows = language_id.identify(frame, language_id.CrossParser(samples)).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows] == sorted(kinds)
    monkeypatch.setattr(language_id, "TABLE_CELLS", 1)
    parts = language_id.CrossParser(samples)
    assert len(parts.groups) == len(kinds)
    assert rows == language_id.identify(frame, parts).orderBy("doc_id").collect()


def test_every_label_is_a_language(spark):
    late = prose(61, 400, "zu wy fi ge hop jas qin".split())
    labels = [(3 * k, f"l{k:03}", prose(k, 5)) for k in range(250)] + [(3 * k, "zz", late) for k in range(1000, 1010)]
    labels += [(5000, None, prose(62, 60, "zu wy fi ge hop jas qin".split()))]
    docs = spark.createDataFrame(labels, "doc_id long, lang string, text string")
    parser = language_id.CrossParser(language_id.sampled(docs, "doc_id", "text", "lang", F.lit(True)))
    assert parser.languages == [f"l{k:03}" for k in range(250)] + ["zz"]
    assert [r.lang_pred for r in language_id.identify(docs.where("doc_id = 5000"), parser).collect()] == ["zz"]


# ---- repeats


@needs_data
def test_repeats_equal_brute_force(spark):
    got = {r[0]: r[1:] for r in pairs(repeats.repeat_report(documents(spark)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
    assert got == brute.repeats(pairs(documents(spark), "doc_id", "text"))


def test_repeats_of_odd_rows(spark, odd, odd_rows):
    got = {r[0]: r[1:] for r in pairs(repeats.repeat_report(odd), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
    expected = brute.repeats([(i, t) for i, t, *_ in odd_rows if i is not None])
    assert got.pop(None)[1] == 0 and got == expected and expected[2][1] == expected[1][0] and expected[14][1] > 0
    kept = repeats.without_repeats(odd)
    assert kept.columns == odd.columns
    by = {r.doc_id: r for r in kept.collect()}
    assert 2 not in by and by[4].text is None and by[1].text == odd_rows[0][1] and by[8].n_chars == len(by[8].text) < 800
    assert repeats.repeat_report(odd.limit(0)).count() == 0


def spans_of(frame, **options):
    return sorted((tuple(r) for r in repeats.repeat_report(frame, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize("group", [1, 2, 7, 3_000])
def test_common_line_before_different_texts(spark, group):
    line = prose(50, 14)
    rows = [(k, (line + "\n" if k % 3 else "") + prose(60 + k % 37, 40) + (" " + line if k % 5 else "") + prose(200 + k % 11, 30)) for k in range(150)]
    long = prose(51, 60)
    rows += [(500 + k, prose(300 + k, 3) + long + prose(400 + k, 3)) for k in range(40)] + [(600 + k, chr(97 + k) + "é" * 49 + chr(107 + k)) for k in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert spans_of(frame, group=group) == brute.repeat_rows(rows)


def test_one_id_with_different_texts(spark, odd, odd_rows):
    line, base = prose(70, 30), prose(71, 60)
    rows = [(2, base), (2, line + prose(72, 30)), (2, None), (2, ""), (2, base), (1, line), (3, base + line), (3, prose(73, 20_000) + base), (3, line * 3), (None, base), (None, None), (1, None)]
    rows += [(9, prose(80 + k, 4) + line + prose(120 + k, 4)) for k in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = spans_of(frame)
    assert got == brute.repeat_rows(rows) and all(r[2] <= r[1] for r in got)
    kept = repeats.without_repeats(frame.selectExpr("*", "1 AS key", "2 AS _key0", "3 AS gram", "4 AS n_chars"))
    assert kept.columns == ["doc_id", "text", "key", "_key0", "gram", "n_chars"]
    gone = sum(r[1] == r[2] > 0 for r in got)
    assert kept.count() == len(rows) - gone


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 40), st.integers(90, 260), st.sampled_from(["", "x", "é", "zz"])), min_size=2, max_size=14))
def test_shared_passages(spark, parts):
    sources = [prose(30 + k, 60) for k in range(4)]
    rows = [(k, "".join(t for s, a, n, edit in parts[k % len(parts) :: 3] for t in (sources[s][a : a + n], edit))) for k in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: r[1:] for r in pairs(repeats.repeat_report(frame), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
    assert got == brute.repeats(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=110, max_size=600), st.integers(0, 2**31))
def test_merged_transforms_find_equal_strings(values, seed):
    data = np.tile(np.array(values, np.uint8), 2)[: len(values) + 150]
    rng = np.random.default_rng(seed)
    sizes = []
    while sum(sizes) < len(data) - 230:
        sizes.append(int(rng.integers(100, 130)))
    sizes.append(len(data) - sum(sizes))
    sizes = np.array(sizes)
    place = np.cumsum(sizes) - sizes
    old, repeats.SHARD_BYTES = repeats.SHARD_BYTES, 150
    try:
        again = repeats.repeated_starts(data, sizes, place)
    finally:
        repeats.SHARD_BYTES = old
    seen = set()
    for begin, size in zip(place, sizes, strict=True):
        for k in range(begin, begin + size):
            s = data[k : k + 100].tobytes()
            if k + 100 <= begin + size:
                assert again[k] == (s in seen)
                seen.add(s)
            else:
                assert not again[k]


def test_common_prefixes_of_the_merge():
    text = [np.array(list(b"abcabcaabcaabb" * 12), np.int64), np.array(list(b"aabcabcbbacab" * 13), np.int64)]
    built = [repeats.shard_transform(t) for t in text]
    shard, common = repeats.interleaved([t for _, t in built], 5)
    key = lambda s, k: tuple(int(text[s][(k + repeats.WORD * j) % len(text[s])]) for j in range(5))
    used, keys = [0, 0], []
    for s in shard:
        keys.append(key(s, built[s][0][used[s]]))
        used[s] += 1
    assert keys == sorted(keys)
    for a, b, c in zip(keys, keys[1:], common[1:], strict=False):
        assert c == next((k for k in range(5) if a[k] != b[k]), 5)


# ---- licenses


def test_patience():
    assert license_scan.patience(list("abcxdef"), list("abcdef")) == [(0, 0), (1, 1), (2, 2), (4, 3), (5, 4), (6, 5)]
    assert license_scan.patience([], list("ab")) == [] and license_scan.patience(list("aa"), list("bb")) == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdef", max_size=30), st.text(alphabet="abcdef", max_size=30))
def test_alignment_is_increasing_and_equal(a, b):
    found = license_scan.patience(list(a), list(b))
    assert all(a[i] == b[j] for i, j in found)
    assert all(i < k and j < m for (i, j), (k, m) in zip(found, found[1:], strict=False))


def test_licenses_in_texts(spark, odd):
    mit = license_scan.TEMPLATES["MIT"]
    edited = mit.replace("free of charge, ", "").replace("Software", "Program")
    texts = [prose(1, 3000) + "\n" + mit + "\n" + prose(2, 3000), edited, "Released under the MIT License. " * 3, prose(3, 200), mit[:200], "LICENSED   under the\nApache License -- version 2.0!", None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS license")
    got = pairs(license_scan.license_matches(frame), "doc_id", "license", "coverage")
    assert (0, "MIT", 1.0) in got and any(i == 1 and name == "MIT" for i, name, _ in got)
    assert [i for i, name, _ in got if name == "MIT line"] == [2, 2, 2]
    assert (5, "Apache-2.0 line", 1.0) in got and not {3, 4, 6, 7} & {i for i, *_ in got}
    row = license_scan.license_matches(frame).where("doc_id = 0 and license = 'MIT'").first()
    assert row.begin_word == 3000 and row.excerpt.startswith("permission is hereby granted")
    assert license_scan.license_matches(odd).count() == 0 and license_scan.license_matches(frame.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcdefghxyz"), max_size=120), st.lists(st.sampled_from("abcdefgh"), min_size=3, max_size=25), st.integers(0, 80), st.sampled_from([0.6, 0.75, 0.9]))
def test_scan_equals_sliding_alignment(words, template, place, coverage):
    words = [*words[:place], *template[:-1], *words[place:]]
    scanner = license_scan.Scanner({"t": " ".join(template)}, coverage)
    found = list(scanner.matches(Words(pa.array([" ".join(words)]))))
    window, need = int(np.ceil(license_scan.SPREAD * len(template))), coverage * len(template) - 1e-9
    starts = [k for k, w in enumerate(words) if w in template and len(license_scan.patience(words[k : k + window], template)) >= need]
    assert bool(found) == bool(starts)
    for _, _, share, begin, end in found:
        assert coverage - 1e-9 <= share <= 1 and 0 <= begin <= end < len(words)
    # every window that matches on its own overlaps a match that was reported
    assert all(any(begin < k + window and k <= end for _, _, _, begin, end in found) for k in starts)


def test_whole_licenses_are_found(spark):
    texts = {name: prose(k, 400) + "\n# " + text.replace("\n", "\n# ") + "\n" + prose(99 - k, 300) for k, (name, text) in enumerate(license_scan.TEMPLATES.items())}
    frame = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    got = set(pairs(license_scan.license_matches(frame), "doc_id", "license"))
    assert {(k, name) for k, name in enumerate(texts)} <= got
    other = license_scan.templates_from(spark.createDataFrame([("own", "one two three four five"), (None, "x")], "license string, text string"))
    assert other == {"own": "one two three four five"}


@needs_data
def test_license_lines_are_all_found(spark):
    lines = documents(spark).where("lower(text) rlike '(licensed under (the apache license, version 2.0|cc by-nc 4.0|the gnu general public license, version 3))|released under the mit license'").select("doc_id").distinct()
    found = license_scan.license_matches(documents(spark)).select("doc_id").distinct()
    assert {r[0] for r in lines.collect()} <= {r[0] for r in found.collect()}
