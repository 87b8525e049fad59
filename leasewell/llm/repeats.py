"""Removal of byte strings that repeat an earlier passage, by merging Burrows-Wheeler transforms of shards.

Every byte covered by a ``LENGTH``-byte string that also starts earlier (smaller id, or same text and earlier start)
is repeated.  Strings are judged on the input.

1. *Anchors.*  Every string of LENGTH bytes picks the 24-byte gram of least hash in it (leftmost on ties), so equal
   strings pick equal grams at equal places.  Neighbouring strings that pick the same gram are one *fragment*; a text
   of n bytes is about n / 39 fragments, each known by the hash of its gram and of its bytes.
2. *Equal fragments* meet by the hash of their bytes: all but the first repeat it as a whole.  A slice of texts settles
   its own beforehand, so a text that makes up a third of the corpus is a few rows a slice.  Only the first ones go on.
3. *Groups.*  Fragments of one gram are a group; its size is a pre-aggregated count.  A fragment alone in its group
   shares no string.  The others fetch their bytes.
4. *Shards.*  Groups are dealt to tasks.  A task cuts their fragments into shards and builds the Burrows-Wheeler
   transform of each, over the alphabet of 20-byte words read at every byte.
5. *Merge.*  All shards of a batch are merged by iterative interleave refinement: the interleave of shards ordered by
   the first k words is turned into the one ordered by k + 1 words by dealing the transforms' symbols in its order,
   without touching suffixes.  Boundaries that appear in round k mark a common prefix of k - 1 words; after five
   rounds the intervals without a boundary hold the suffixes that share 100 bytes.  All but the first string of an
   interval are repeated.
6. *Large groups* (a common line before different texts) are dealt more finely, never merged whole: strings of a group
   in which the gram lies at about the same place share more than the gram, namely the bytes around it that each of
   them must hold.  So the strings of a fragment are cut by the gram's place into half as wide ranges, and each part
   belongs to the group of those shared bytes.  Steps 2 to 5 apply to the parts as they do to fragments; groups that
   are still large are cut again.  A range of one place shares all 100 bytes, so seven cuts always suffice, and each
   costs its fragments no more than two rows.
7. The spans of each text are collected (bounded by its length) and joined to it.

Grams, fragments and words are compared by 64-bit hashes (equal fragments by two of them).

Defined cases: a null or short text has no repeats; a row with a null id takes no part and keeps all; rows that share
an id but not the text are different texts, in the order of a hash of them (``xxhash64``); rows that repeat id and text
count as one text; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leasewell.llm.arrowtext import mix, prefix_hash, range_hash, slices, utf8
from leasewell.llm.session import deleted, dropped, freed, scratch, written

LENGTH = 100
GRAM = 24
#: Bytes in a symbol of the transforms; LENGTH is a multiple.
WORD = 20
SHARD_BYTES = 1 << 16
BATCH_BYTES = 1 << 19
#: Fragments of a group that a task merges; larger groups are dealt more finely.
GROUP_FRAGMENTS = 1_000
_SLICE = 1 << 18


def anchored(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Fragments of a slice of texts: hash of gram, hash of bytes, text, first start, number of starts, and the place of
    the gram in the first string."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4))
    if len(data) < LENGTH:
        return none
    prefix = prefix_hash(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = range_hash(prefix, at, at + GRAM)
    least, span, width = (gram & ~np.uint64(0xFFFFFFFF)) | at.astype(np.uint64), 1, LENGTH - GRAM + 1
    while span * 2 <= width:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    picked = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = np.diff(offsets)
    begin = np.ones(len(picked) + 1, bool)
    begin[1:-1] = picked[1:] != picked[:-1]
    begin[offsets[:-1][size >= LENGTH]] = True
    ends = np.minimum(offsets[1:], len(picked))
    dead = np.zeros(len(picked) + 1, np.int32)  # starts whose string would leave its text
    np.add.at(dead, np.clip(np.maximum(offsets[1:] - LENGTH + 1, offsets[:-1]), 0, len(picked)), 1)
    np.add.at(dead, ends, -1)
    live = np.cumsum(dead)[:-1] == 0
    edge = live.copy()
    edge[1:] &= begin[1:-1] | ~live[:-1]
    last = live.copy()
    last[:-1] &= begin[1:-1] | ~live[1:]
    first, last = np.flatnonzero(edge), np.flatnonzero(last)
    text = np.searchsorted(offsets, first, "right") - 1
    whole = range_hash(prefix, first, last + LENGTH)
    at = picked[first] - first
    return gram[picked[first]], mix(whole ^ at.astype(np.uint64)), text, first - offsets[text], last - first + 1, at


#: Fragments between the steps; bytes are null until they are needed.
_FRAGMENTS = "gram long, whole long, doc_id long, key long, start int, n int, at int, bytes binary"
_PLACE = ("doc_id", "key", "start")


def _places(ids: np.ndarray, keys: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Numbers in the order of id, key and start; equal places have equal numbers."""
    order = np.lexsort((keys, ids))
    new = np.ones(len(ids), bool)
    new[1:] = (ids[order[1:]] != ids[order[:-1]]) | (keys[order[1:]] != keys[order[:-1]])
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.cumsum(new)
    return (rank << 32) + start


def _batch(columns: dict[str, np.ndarray], data: pa.Array | None = None, again: np.ndarray | None = None) -> pa.RecordBatch:
    kinds = {"start": np.int32, "n": np.int32, "at": np.int32}
    out = {} if again is None else {"again": pa.array(again)}
    out |= {c: pa.array(v.view(np.int64) if v.dtype == np.uint64 else v.astype(kinds.get(c, np.int64))) for c, v in columns.items()}
    out["bytes"] = pa.nulls(len(columns["start"]), pa.binary()) if data is None else data
    return pa.RecordBatch.from_arrays(list(out.values()), list(out))


def _settled_inside(columns: dict[str, np.ndarray], data: pa.Array | None = None) -> pa.RecordBatch:
    """Fragments with ``again``: True for all but the first of equal ones among them.  A place that is there twice is
    kept once."""
    place = _places(columns["doc_id"], columns["key"], columns["start"])
    order = np.lexsort((place, columns["gram"], columns["whole"]))
    same = np.zeros(len(order), bool)
    same[1:] = (columns["whole"][order[1:]] == columns["whole"][order[:-1]]) & (columns["gram"][order[1:]] == columns["gram"][order[:-1]])
    twice = np.zeros(len(order), bool)
    twice[1:] = same[1:] & (place[order[1:]] == place[order[:-1]])
    order, same = order[~twice], same[~twice]
    back = np.argsort(order)  # in the order of the texts, which compresses well
    order, same = order[back], same[back]
    return _batch({c: v[order] for c, v in columns.items()}, None if data is None else data.take(pa.array(order)), same)


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", _SLICE):
            gram, whole, text, start, n, at = anchored(*utf8(part.column("text")))
            if len(gram):
                ids, keys = (part.column(c).to_numpy()[text] for c in ("doc_id", "key"))
                yield _settled_inside({"gram": gram, "whole": whole, "doc_id": ids, "key": keys, "start": start, "n": n, "at": at})


def _first_of_equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A stream sorted by fragment and place -> the first of equal fragments, and the others with a null gram."""
    names = ["gram", "whole", *_PLACE, "n", "at", "bytes"]
    empty = {"gram": pa.int64(), "whole": pa.int64(), "bytes": pa.binary()}
    group = before = None  # fragment and place of the last row
    for batch in batches:
        again = batch.column("again").to_numpy(zero_copy_only=False)
        rows = batch.filter(pa.array(~again))
        old = np.zeros(len(rows), bool)
        if len(rows):
            column = {c: rows.column(c).to_numpy() for c in ("gram", "whole", *_PLACE)}
            new, moved = np.ones(len(rows), bool), np.ones(len(rows), bool)
            new[1:] = (column["whole"][1:] != column["whole"][:-1]) | (column["gram"][1:] != column["gram"][:-1])
            moved[1:] = np.any([column[c][1:] != column[c][:-1] for c in _PLACE], axis=0)
            at = lambda k, of: tuple(column[c][k] for c in of)  # noqa: B023, E731
            new[0], moved[0] = at(0, ("whole", "gram")) != group, at(0, _PLACE) != before
            group, before = at(-1, ("whole", "gram")), at(-1, _PLACE)
            old = ~new & moved
            yield rows.select(names).filter(pa.array(new))
        for some in (batch.filter(pa.array(again)), rows.filter(pa.array(old))):
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(some), empty[c]) if c in empty else some.column(c) for c in names], names)


def _settled(found: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Fragments with ``again`` -> the repeated ones, and the first of equal ones in groups of several with the size of
    their group.  The tables on both sides of the join are written, so that adaptive execution can split a group with a
    third of all fragments; those that are alone are deleted."""
    spark, path = found.sparkSession, scratch(found.sparkSession, name)
    own = F.when(F.col("again"), F.xxhash64(*_PLACE)).otherwise(F.col("whole"))
    marks = found.repartition(own).sortWithinPartitions("whole", "gram", *_PLACE).mapInArrow(_first_of_equal, _FRAGMENTS)
    marks.withColumn("first", F.col("gram").isNotNull()).drop("whole").write.partitionBy("first").parquet(path)
    marks = spark.read.schema(f"{_FRAGMENTS}, first boolean").parquet(path).drop("whole")
    firsts, repeated = (marks.where(F.col("first") == value).drop("first") for value in (True, False))
    sizes = written(firsts.groupBy("gram").agg(F.count("*").alias("size")).where("size > 1"), f"{name}-sizes")
    freed(spark)
    several = written(firsts.join(sizes.hint("merge"), "gram"), f"{name}-several")
    dropped(spark, sizes)
    deleted(spark, f"{path}/first=true")
    return repeated.select(*_PLACE, "n"), several


def _parts(level: int):
    """Fragments -> their strings cut by the place of the gram into ranges of 77 / 2**level places; the gram of a part
    becomes the hash of the bytes that all strings of the range share."""
    width = -(-(LENGTH - GRAM + 1) >> level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "bytes", _SLICE):
                data, offsets = utf8(rows.column("bytes"))
                ids, keys, start, n, at = (rows.column(c).to_numpy().astype(np.int64) for c in (*_PLACE, "n", "at"))
                top = at // width
                many = top - (at - n + 1) // width + 1
                owner = np.repeat(np.arange(len(many)), many)
                low = (top[owner] - (np.arange(len(owner)) - (np.cumsum(many) - many)[owner])) * width
                high = np.minimum(low + width - 1, LENGTH - GRAM)
                begin, end = np.maximum(at[owner] - high, 0), np.minimum(at[owner] - low, n[owner] - 1)
                base, prefix = offsets[:-1][owner], prefix_hash(data)
                core = range_hash(prefix, base + at[owner] - low, base + at[owner] - high + LENGTH)
                whole = range_hash(prefix, base + begin, base + end + LENGTH)
                inside = at[owner] - begin
                size = end - begin + LENGTH
                text = data[np.repeat(base + begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                pieces = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32).tobytes()), pa.py_buffer(text.tobytes())])
                yield _settled_inside({"gram": mix(core ^ low.astype(np.uint64)), "whole": mix(whole ^ inside.astype(np.uint64)), "doc_id": ids[owner], "key": keys[owner], "start": start[owner] + begin, "n": end - begin + 1, "at": inside}, pieces)

    return run


def shard_transform(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a shard by its words and its transform (the word before each suffix).

    words: for every position the symbol of the WORD bytes from there; positions wrap around.
    """
    at, n, top = np.arange(len(words)), len(words), np.int64(words.max()) + 1
    after = lambda x, by: x[(at + by) % n]
    rank, held, width = words.astype(np.int64), 1, top
    while held * 2 * WORD <= LENGTH:
        pair = rank * width + after(rank, held * WORD)
        rank, held = np.unique(pair, return_inverse=True)[1].astype(np.int64), held * 2
        width = np.int64(n)
    for k in range(held, LENGTH // WORD):
        rank = np.unique(rank * top + after(words, k * WORD), return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank * n + at)
    return order, words[(order - WORD) % n]


def interleaved(transforms: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge transforms: the shard of each place of the merged order, and the common prefix (in words, up to
    ``rounds``) of each place with the one before it."""
    sizes = np.array([len(t) for t in transforms])
    symbols = np.concatenate(transforms).astype(np.int64)
    shard = np.repeat(np.arange(len(sizes)), sizes).astype(np.uint16)
    total = len(symbols)
    common = np.full(total, rounds)
    block = np.zeros(total, np.int64)
    at = np.arange(total)
    for k in range(rounds):
        dealt = np.empty(total, np.int64)
        dealt[np.argsort(shard, kind="stable")] = symbols  # each shard's transform, in the order of the interleave
        order = np.argsort(dealt * total + at)
        shard, symbol, block = shard[order], dealt[order], block[order]
        fresh = np.ones(total, bool)
        fresh[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(fresh)
        common[fresh & (common == rounds)] = k  # boundaries stay where they are: later rounds move places within blocks
    return shard, common


def repeated_starts(data: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For the starts of all fragments (sizes - LENGTH + 1 each): True if an equal string has a lesser place.

    place: (fragments,) rank of the fragment's text, shifted, plus its first start.
    """
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    padded = np.concatenate([data, data[:WORD]])
    prefix = prefix_hash(padded)
    at = np.arange(len(data))
    words = np.unique(range_hash(prefix, at, at + WORD), return_inverse=True)[1]
    cuts, first = [0], 0
    for k in range(1, len(bounds)):
        if bounds[k] - bounds[first] >= SHARD_BYTES or k == len(bounds) - 1:
            cuts.append(int(bounds[k]))
            first = k
    built = [shard_transform(words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    shard, common = interleaved([t for _, t in built], LENGTH // WORD)
    suffix = np.empty(len(data), np.int64)
    suffix[np.argsort(shard, kind="stable")] = np.concatenate([a + order for a, (order, _) in zip(cuts, built, strict=False)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = at - bounds[owner]
    real = (inside <= sizes[owner] - LENGTH)[suffix]  # starts whose string lies in the fragment
    suffix, group = suffix[real], np.cumsum(common < LENGTH // WORD)[real]
    key = place[owner[suffix]] + inside[suffix]
    least = np.minimum.reduceat(key, np.flatnonzero(np.diff(group, prepend=-1)))
    again = np.zeros(len(data), bool)
    again[suffix] = key > least[np.cumsum(np.diff(group, prepend=group[0]) > 0)]
    return again


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A stream of fragments sorted by gram -> repeated spans (doc_id, key, start, n)."""
    held: list[pa.RecordBatch] = []
    total = 0

    def finish(rows: pa.Table) -> pa.RecordBatch | None:
        rows = rows.combine_chunks()
        data = pc.cast(rows.column("bytes").combine_chunks(), pa.large_binary())
        offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        joined, ids, keys, start = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], *(rows.column(c).to_numpy() for c in _PLACE)
        sizes = np.diff(offsets)
        again = repeated_starts(joined, sizes, _places(ids, keys, start))
        base = np.cumsum(sizes) - sizes
        edge = np.diff(again.astype(np.int8), prepend=0, append=0)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(first):
            return None
        owner = np.searchsorted(base, first, "right") - 1
        return pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(keys[owner]), pa.array((start[owner] + first - base[owner]).astype(np.int32)), pa.array((last - first).astype(np.int32))], [*_PLACE, "n"])

    for batch in batches:
        held.append(batch)
        total += pc.sum(pc.binary_length(batch.column("bytes"))).as_py() or 0
        if total >= BATCH_BYTES:
            rows = pa.Table.from_batches(held)
            gram = rows.column("gram").to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))  # the last gram may go on
            if cut:
                for piece in _pieces(rows.slice(0, cut)):
                    if (out := finish(piece)) is not None:
                        yield out
                held = rows.slice(cut).combine_chunks().to_batches()
                total = pc.sum(pc.binary_length(rows.slice(cut).column("bytes"))).as_py() or 0
    if held:
        for piece in _pieces(pa.Table.from_batches(held)):
            if len(piece) and (out := finish(piece)) is not None:
                yield out


def _pieces(rows: pa.Table) -> Iterator[pa.Table]:
    """Cut at grams into pieces of about BATCH_BYTES."""
    gram = rows.column("gram").to_numpy()
    size = np.cumsum(pc.binary_length(rows.column("bytes")).to_numpy())
    starts = np.flatnonzero(np.diff(gram, prepend=~gram[:1]))
    begin = 0
    for k in [*starts[1:], len(rows)]:
        if size[k - 1] - (size[begin - 1] if begin else 0) >= BATCH_BYTES or k == len(rows):
            yield rows.slice(begin, k - begin)
            begin = k


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their wanted fragments -> those with their bytes and the size of their group."""
    for batch in batches:
        texts, offsets = utf8(batch.column("text"))
        wanted = batch.column("wanted")
        values, many = wanted.flatten(), np.diff(wanted.offsets.to_numpy())
        owner = np.repeat(np.arange(len(batch)), many)
        gram, start, n, at, size = (values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("gram", "start", "n", "at", "size"))
        for first in range(0, len(owner), 4096):
            part = slice(first, first + 4096)
            length = n[part] + LENGTH - 1
            base = offsets[:-1][owner[part]] + start[part]
            end = np.cumsum(length)
            data = texts[np.repeat(base - (end - length), length) + np.arange(end[-1])]
            pieces = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(np.concatenate([[0], end]).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
            ids, keys = (batch.column(c).to_numpy()[owner[part]] for c in ("doc_id", "key"))
            one = _batch({"gram": gram[part], "doc_id": ids, "key": keys, "start": start[part], "n": n[part], "at": at[part]}, pieces)
            yield one.append_column("size", pa.array(size[part]))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, key, text): a text is known by its id and a hash."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", group: int = GROUP_FRAGMENTS) -> DataFrame:
    """(doc_id, key, spans) of the texts with repeats, key being xxhash64 of the text: unsorted, overlapping starts and
    numbers of repeated strings."""
    rows = _keyed(docs, doc_id, text).where(f"doc_id is not null and octet_length(text) >= {LENGTH}")
    repeated, several = _settled(rows.mapInArrow(_fragments, f"again boolean, {_FRAGMENTS}"), "fragments")
    wanted = several.groupBy("doc_id", "key").agg(F.collect_set(F.struct("gram", "start", "n", "at", "size")).alias("wanted"))
    freed(docs.sparkSession)
    texts = rows.join(wanted, ["doc_id", "key"]).select("doc_id", "key", "text", "wanted")
    held = written(texts.mapInArrow(_cut_out, "gram long, doc_id long, key long, start int, n int, at int, bytes binary, size long"), "bytes")
    dropped(docs.sparkSession, several)
    spans = [repeated]
    for level in range(1, 9):
        small = held.where(F.col("size") <= group).repartition("gram").sortWithinPartitions("gram").select("gram", *_PLACE, "bytes")
        spans.append(small.mapInArrow(_merged, "doc_id long, key long, start int, n int"))
        large = held.where(F.col("size") > group)
        if large.isEmpty():
            break
        repeated, held = _settled(large.mapInArrow(_parts(level), f"again boolean, {_FRAGMENTS}"), f"parts-{level}")
        spans.append(repeated)
    union = reduce(DataFrame.unionByName, spans)
    return union.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def merged_spans(spans: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal repeated runs of bytes."""
    if not spans.is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = spans.values.field("start").to_numpy().astype(np.int64)
    end = start + spans.values.field("n").to_numpy() + LENGTH - 1
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def repeat_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", group: int = GROUP_FRAGMENTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                data = memoryview(value.as_buffer()) if value.is_valid else memoryview(b"")
                begin, end = merged_spans(spans)
                kept, at = hashlib.sha256(), 0
                for a, b in zip(begin, end, strict=True):
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                out.append((len(data), int((end - begin).sum()), len(begin), kept.hexdigest()))
            size, removed, n, sha = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = _keyed(docs, doc_id, text).join(repeated_spans(docs, doc_id, text, group), ["doc_id", "key"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents with repeated passages cut from their texts (whole characters only) and ``n_chars`` to match;
    those of which nothing is left go."""
    names = docs.columns
    found, own = (next(f"_{c}{k}" for k in range(len(names) + 1) if f"_{c}{k}" not in names) for c in ("spans", "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for value, spans in zip(batch.column(text), batch.column(found), strict=True):
                begin, end = merged_spans(spans)
                if not value.is_valid or not len(begin):
                    texts.append(value.as_py())
                    keep.append(True)
                    continue
                data, kept, at = value.as_buffer().to_pybytes(), [], 0
                for a, b in zip(begin, end, strict=True):
                    while a < b and data[a] & 0xC0 == 0x80:  # a character that began before the run stays
                        a += 1
                    while b > a and b < len(data) and data[b] & 0xC0 == 0x80:  # and one that ends after it
                        b -= 1
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                texts.append(b"".join(kept).decode())
                keep.append(bool(texts[-1].strip()))
            cut = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else batch.column(c) for c in names], names)
            yield cut.filter(pa.array(keep, pa.bool_()))

    spans = repeated_spans(docs, doc_id, text).withColumnsRenamed({"doc_id": doc_id, "key": own, "spans": found})
    schema = docs.schema
    cut = docs.withColumn(own, F.xxhash64(text)).join(spans, [doc_id, own], "left").select(*names, found).mapInArrow(run, schema)
    return cut.withColumn(n_chars, F.length(text).cast(schema[n_chars].dataType)) if n_chars in names else cut
