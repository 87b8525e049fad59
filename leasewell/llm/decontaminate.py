"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

A test item is short and a document may be long, so their Jaccard similarity says little; what matters is the share of
the item's shingles that the document holds.

1. *Sketches.*  Items are partitioned by their number of shingles into classes of doubling size.  The sketch of an item
   are its ``SKETCH`` shingles of least hash; the largest hash in the sketches of a class is the bound of the class.  The
   sketch of a document for a class are its shingles up to that bound, so an item's sketch meets all that the document
   holds of it, however long the document is, and classes of larger items need a smaller part of the document.
2. *Search.*  Document sketches are sifted by a bitmap of all sketches (a fixed ``FILTER_BITS`` bits, the only thing that
   is broadcast besides one bound for each class) and joined with item sketches on class and hash.  The number of hits
   asked for follows from the binomial tail: an item at the threshold is missed with probability at most ``MISS``, and
   items with no more shingles than a sketch are never missed.  A document only meets classes it is large enough for.
3. *Verification.*  Candidates are verified by exact containment of the item's distinct shingles.  The list of a
   document's candidates is bounded by what it holds, as equal items are one until the end.

Neither items nor documents pass through the driver.

Defined cases: a null or word-less document or item matches nothing; an item of fewer than five words is one
shingle of all its words and is looked for as that run; repeated rows each give their rows, also where they share an id
but not the text; null ids give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leasewell.llm.arrowtext import SHINGLE_WORDS, Words, mix, slices
from leasewell.llm.session import written

THRESHOLD = 0.8
#: Shingles in the sketch of an item, and the chance of missing an item at the threshold.
SKETCH = 24
MISS = 1e-9
#: Size of the bitmap, as a power of two.
FILTER_BITS = 23

_SEED = np.uint64(0xA24BAED4963EE407)


def needed(sketch: int, threshold: float, miss: float) -> int:
    """The most sketch entries that may be asked for when an item at the threshold may be missed so rarely."""
    tail, k = 0.0, 0
    while (tail := tail + comb(sketch, k) * threshold**k * (1 - threshold) ** (sketch - k)) <= miss:
        k += 1
    return max(1, k)


def hashed(shingles: np.ndarray) -> np.ndarray:
    """The order of shingles in a sketch: 63-bit hashes."""
    return (mix(shingles ^ _SEED) >> np.uint64(1)).astype(np.int64)


def _bits(hashes: np.ndarray, part: int) -> np.ndarray:
    """The places of sketch entries of a class in the bitmap."""
    return (mix(hashes.astype(np.uint64) ^ np.uint64(part << 40)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def part_of(width: int, size: int) -> int:
    """The class of items of so many shingles of so many words."""
    return 100 * width + max(size - 1, 0).bit_length()


def item_shingles(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, width, n, shingles) of every item with words; shingles: distinct 64-bit hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                shingles, offsets = words.shingles()
                n = np.diff(words.offsets)
                sets = [np.unique(shingles[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.array(np.minimum(n, SHINGLE_WORDS), pa.int32()), pa.array([len(x) for x in sets], pa.int32()), pa.array([x.tobytes() for x in sets], pa.binary())], ["item_id", "width", "n", "shingles"])

    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("item_id is not null and text is not null")
    return rows.mapInArrow(run, "item_id long, width int, n int, shingles binary").where("n > 0")


def item_sketches(sets: DataFrame, threshold: float) -> DataFrame:
    """(part, hash, bit, content, need, n): the sketch entries of distinct items (content, width, n, shingles)."""
    names = ["part", "hash", "bit", "content", "need", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = needed(SKETCH, threshold, MISS)
        for batch in batches:
            out: list[tuple] = []
            for content, width, data in zip(*(batch.column(c).to_pylist() for c in ("content", "width", "shingles")), strict=True):
                hashes = np.sort(hashed(np.frombuffer(data, np.uint64)))
                part, need = part_of(width, len(hashes)), least if len(hashes) > SKETCH else max(1, int(np.ceil(threshold * len(hashes) - 1e-9)))
                out += [(part, h, b, content, need, len(hashes)) for h, b in zip(hashes[:SKETCH].tolist(), _bits(hashes[:SKETCH], part).tolist(), strict=True)]
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return sets.mapInArrow(run, "part int, hash long, bit long, content string, need int, n int")


def _sketched(parts: dict[int, int], words: list[tuple[int, int]], threshold: float):
    """Documents -> the entries of their sketches that pass the bitmap: (doc_id, key, part, hash, most shingles)."""
    bitmap = np.zeros(1 << FILTER_BITS >> 6, np.uint64)
    for k, value in words:
        bitmap[k] = np.int64(value).astype(np.uint64)
    smallest = {part: threshold * (1 << max(part % 100 - 1, 0)) - 1e-9 for part in parts}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(bitmap.view(np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            for rows in slices(batch, "text"):
                text = Words(rows.column("text"))
                for width in sorted({p // 100 for p in parts}):
                    shingles, offsets = text.shingles(width, whole_short=False)
                    many, hashes = np.diff(offsets), hashed(shingles)
                    for part in (p for p in parts if p // 100 == width):
                        at = np.flatnonzero(hashes <= parts[part])
                        at = at[held[_bits(hashes[at], part)]]
                        own = np.searchsorted(offsets, at, "right") - 1
                        large = many[own] >= smallest[part]
                        pair = np.unique(np.stack([own[large], hashes[at[large]]]), axis=1)
                        if pair.shape[1]:
                            own = pa.array(pair[0])
                            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(own), rows.column("key").take(own), pa.array(np.full(pair.shape[1], part), pa.int32()), pa.array(pair[1]), pa.array(many[pair[0]], pa.int64())], ["doc_id", "key", "part", "hash", "most"])

    return run


def candidates(rows: DataFrame, items: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, wanted) of the documents (doc_id, key, text) with candidates, and (content, item_id) of all items."""
    named = written(item_shingles(items).withColumn("content", F.concat_ws("-", F.md5("shingles"), "width")), "items")
    sets = named.dropDuplicates(["content"]).select("content", "width", "n", "shingles")
    sketches = written(item_sketches(sets, threshold), "sketches")
    # bounded, whatever the number of items: a number for each class, and the words of the bitmap
    parts = {r.part: r.bound for r in sketches.groupBy("part").agg(F.max("hash").alias("bound")).collect()}
    mask = F.expr("shiftleft(1L, int(bit % 64))")
    words = [(r.word, r.mask) for r in sketches.groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(mask).alias("mask")).collect()]
    found = rows.mapInArrow(_sketched(parts, words, threshold), "doc_id long, key long, part int, hash long, most long").distinct()
    hits = found.join(sketches.hint("merge"), ["part", "hash"]).where(F.col("most") >= threshold * F.col("n") - 1e-9)
    hits = hits.groupBy("doc_id", "key", "content").agg(F.count("*").alias("hits"), F.min("need").alias("need")).where("hits >= need")
    listed = hits.select("doc_id", "key", "content").join(sets.hint("merge"), "content")
    wanted = listed.groupBy("doc_id", "key").agg(F.collect_list(F.struct("content", "width", "shingles")).alias("wanted"))
    return written(wanted, "wanted"), named.select("content", "item_id")


def _shared(words: Words, row: int, wanted: list[dict]) -> Iterator[tuple[str, int, int]]:
    """(content, shared, all shingles) of the wanted items of a text."""
    own: dict[int, np.ndarray] = {}
    for item in wanted:
        width = item["width"]
        if width not in own:
            shingles, offsets = words.shingles(width, whole_short=False)
            own[width] = np.unique(shingles[offsets[row] : offsets[row + 1]])
        need = np.frombuffer(item["shingles"], np.uint64)
        yield item["content"], int(np.isin(need, own[width], assume_unique=True).sum()), len(need)


def _verified(threshold: float):
    names = ["doc_id", "content", "containment", "shared_shingles", "item_shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, (doc_id, wanted) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("wanted").to_pylist(), strict=True)):
                words = Words(batch.column("text").slice(k, 1))
                out += [(doc_id, c, shared / n, shared, n) for c, shared, n in _shared(words, 0, wanted) if shared >= threshold * n - 1e-9]
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, key, text): a text is known by its id and a hash."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).alias("text")).where("doc_id is not null and text is not null")


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, containment, shared_shingles, item_shingles) for each document and item whose shingles the
    document holds to ``threshold`` at least."""
    rows = _keyed(docs, doc_id, text)
    wanted, named = candidates(rows, items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), threshold)
    held = rows.join(wanted.hint("merge"), ["doc_id", "key"]).select("doc_id", "text", "wanted")
    found = held.mapInArrow(_verified(threshold), "doc_id long, content string, containment double, shared_shingles long, item_shingles long")
    return found.join(named.hint("merge"), "content").select("doc_id", "item_id", "containment", "shared_shingles", "item_shingles")


def without_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain no test item, with all their columns."""
    names, taken = docs.columns, set(docs.columns)
    key, own = (next(f"_{c}{k}" for k in range(len(names) + 1) if f"_{c}{k}" not in taken) for c in ("key", "wanted"))
    wanted, _ = candidates(_keyed(docs, doc_id, text), items, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(len(batch), bool)
            for k in np.flatnonzero(batch.column(own).is_valid().to_numpy(zero_copy_only=False)):
                words = Words(batch.column(text).slice(k, 1))
                keep[k] = all(shared < threshold * n - 1e-9 for _, shared, n in _shared(words, 0, batch.column(own)[k].as_py()))
            yield batch.select(names).filter(pa.array(keep))

    held = docs.withColumn(key, F.xxhash64(text)).join(wanted.withColumnsRenamed({"doc_id": doc_id, "key": key, "wanted": own}).hint("merge"), [doc_id, key], "left")
    return held.select(*names, own).mapInArrow(run, docs.schema)
