"""N-gram Jaccard join by MinHash banding, with links counted and groups formed without listing all pairs.

1. Every text becomes its sequence of five-word shingles (64-bit hashes).  Texts with the same word sequence are
   one *class*: they are collapsed by a pre-aggregated group-by before anything else, so a text that makes up a
   third of the corpus is one row from then on.
2. Each class gets a MinHash signature cut into bands; ``bands_for`` picks the number of rows and bands from the
   similarity threshold and the target recall.  Band hashes are shuffled; buckets with the same members are kept
   once, under their first band.
3. *Balls.*  The Jaccard distance obeys the triangle inequality, so classes within (1 - threshold) / 2 of one pivot are
   all linked to each other, and one comparison for each decides all their pairs.  The pivot of a class is the least
   member of most of its buckets; a class is in at most one ball.
4. *Pairs* that share a bucket, but no ball, are verified on their full shingle sets.  A bucket of one ball needs
   nothing.  Else it is cut into blocks, those of its largest ball apart, and a task takes two blocks, never two of
   that ball: what is shuffled grows with the members of a bucket times those outside its largest ball, divided by
   ``BLOCK``.  Pairs stay inside the task, which emits for each class the number of linked documents and the root of
   its local link tree.  A pair counts only in its first common band.
5. Link trees of all buckets and balls meet in connected components (alternating large-star and small-star steps on
   DataFrames, checkpointed in the shared folder).

A bucket of n texts that are neither copies of each other nor close to one pivot has n * n pairs to compare; as the exact
number of links is asked for, this is not avoided, only dealt to tasks of bounded size.

Output: ``doc_id, class_id, n_links``: class_id is the least doc_id of the connected group, n_links the number of
other documents whose similarity is at least the threshold, exact copies included.

Defined cases: null and word-less texts link to nothing, are a group of their own and have no links; rows with a
null id give no row; every other row is a document, also if it repeats the id, or the id and text, of another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasewell.llm.arrowtext import Words, mix, per_text, powers, slices
from leasewell.llm.components import components
from leasewell.llm.session import written

THRESHOLD = 0.8
#: Chance that a pair exactly at the threshold shares a band.
RECALL = 0.9995
#: Most hash functions in a signature.
MOST_HASHES = 128
#: Classes of a bucket that a task holds on either side.
BLOCK = 256


def bands_for(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding that reaches the recall within so many hash functions."""
    best = (most, 1)
    for rows in range(1, 17):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, key, k1, k2, bands) of every row: k1, k2 identify the word sequence, bands are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.arange(1, bands * rows + 1, dtype=np.uint64)
        flip, factor = mix(n * np.uint64(0xA0761D6478BD642F)), mix(n * np.uint64(0xE7037ED1A0B428DB)) | np.uint64(1)
        most = np.iinfo(np.uint64).max
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                shingles, offsets = words.shingles()
                at = np.arange(len(words.hash)) - np.repeat(words.offsets[:-1], np.diff(words.offsets))
                power = powers(len(at) + 1)[0][at]
                keys = [per_text(mix(words.hash ^ np.uint64(salt)) * power, words.offsets, np.add, 0).view(np.int64) for salt in (1, 2)]
                out = np.zeros((len(part), bands), np.int64)
                for band in range(bands):
                    acc = np.full(len(part), band + 1, np.uint64)
                    for k in range(band * rows, (band + 1) * rows):
                        least = per_text((shingles ^ flip[k]) * factor[k], offsets, np.minimum, most)
                        acc = mix((acc ^ least) * np.uint64(0x9FB21C651E98DF25))
                    out[:, band] = acc.view(np.int64)
                some = np.diff(offsets) > 0
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * bands)]), pa.int32()), pa.array(out[some].ravel()), mask=pa.array(~some))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(keys[0]), pa.array(keys[1]), lists], ["doc_id", "key", "k1", "k2", "bands"])

    return docs.mapInArrow(run, "doc_id long, key long, k1 long, k2 long, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(node, shingles): the sorted distinct shingle hashes of each row as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                shingles, offsets = Words(part.column("text")).shingles()
                sets = [np.unique(shingles[a:b]).tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    return docs.mapInArrow(run, "node long, shingles binary")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of common shingles of each left and each right set."""
    if len(left) * len(right) <= 4:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left], np.int64)
    sizes = [len(x) for x in (*left, *right)]
    value, inverse, many = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    keep = many[inverse] > 1
    column = (np.cumsum(many > 1) - 1)[inverse[keep]]
    rows, out = rows[keep], np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    step = max(256, (1 << 21) // len(sizes))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [first, first + step])
        held = np.zeros((len(sizes), step), np.float32)
        held[rows[a:b], column[a:b] - first] = 1
        out += held[: len(left)] @ held[len(left) :].T
    return out.astype(np.int64)


def _near_pivot(threshold: float):
    """Members of a group with its pivot (side 0) -> those within half the distance of the threshold: (node, ball)."""

    def run(key, table):
        side, node = table.column("side").to_numpy(), table.column("node").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        if side.min():
            return pa.table({"node": pa.array([], pa.int64()), "ball": pa.array([], pa.int64())})
        pivot, members = sets[int(np.argmin(side))], np.flatnonzero(side)
        shared = np.array([np.isin(sets[k], pivot, assume_unique=True).sum() for k in members])
        union = np.array([len(sets[k]) for k in members]) + len(pivot) - shared
        near = members[shared >= (1 + threshold) / 2 * union - 1e-9] if len(members) else members
        return pa.table({"node": pa.array(node[near]), "ball": pa.array(np.full(len(near), key[0].as_py(), np.int64))})

    return run


def _verified(threshold: float):
    """Links within a pair of blocks of a bucket, but for those within a ball: (node, root, links) with the root of its
    local tree."""

    def run(key, table):
        band, one_block = key[2].as_py(), key[0].as_py() == key[1].as_py()
        side = table.column("side").to_numpy()
        order = np.argsort(side, kind="stable")
        table = table.take(pa.array(order))
        cut = len(table) if one_block else int((side == 0).sum())
        if not one_block and not 0 < cut < len(table):  # a hash may leave a block empty
            return pa.table({c: pa.array([], pa.int64()) for c in ("node", "root", "links")})
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        bands = np.array(table.column("bands").to_pylist(), np.int64).reshape(len(table), -1)
        node, copies, size = table.column("node").to_numpy(), table.column("copies").to_numpy(), np.array([len(x) for x in sets])
        ball = table.column("ball").to_numpy()
        a, b = (slice(0, cut), slice(0, cut)) if one_block else (slice(0, cut), slice(cut, None))
        shared = shared_counts(sets[a], sets[b])
        done = ball[a][:, None] == ball[b][None, :]
        for k in range(band):
            done |= bands[a, k][:, None] == bands[b, k][None, :]
        link = (shared >= threshold * (size[a][:, None] + size[b][None, :] - shared) - 1e-9) & ~done
        links = np.zeros(len(table), np.int64)
        links[a] += link @ copies[b]
        if not one_block:
            links[b] += link.T @ copies[a]
        shift = 0 if one_block else cut
        root = np.arange(len(table))
        for i, j in zip(*np.nonzero(link), strict=True):
            i, j = _find(root, i), _find(root, j + shift)
            if i != j:
                root[j if node[i] < node[j] else i] = i if node[i] < node[j] else j
        tops = np.array([_find(root, i) for i in range(len(table))], np.int64)
        some = links > 0
        return pa.table({"node": node[some], "root": node[tops[some]], "links": links[some]})

    return run


def _find(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return int(i)


def _block_of(node: str, count: Column, block: int) -> tuple[Column, Column]:
    """The number of blocks of so many rows, and the block of a row."""
    blocks = F.ceil(count / block).cast("int")
    return blocks, F.pmod(F.xxhash64(node, F.lit(7)), F.greatest(blocks, F.lit(1))).cast("int")


def balls_of(member: DataFrame, sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """(node, ball) of the classes near the pivot of most of their buckets; the pivot itself is near."""
    shared = member.groupBy("node", "pivot").agg(F.count("*").alias("n"))
    chosen = written(shared.groupBy("node").agg(F.max(F.struct("n", (-F.col("pivot")).alias("minus"))).alias("best")).select("node", (-F.col("best.minus")).alias("pivot")), "pivots")
    sizes = chosen.groupBy("pivot").agg(F.count("*").alias("n"))
    blocks, own = _block_of("node", F.col("n"), block)
    dealt = chosen.join(sizes, "pivot").select("pivot", own.alias("part"), "node", F.lit(1).alias("side"))
    heads = sizes.select("pivot", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("part"), F.col("pivot").alias("node"), F.lit(0).alias("side"))
    return dealt.unionByName(heads).join(sets.select("node", "shingles"), "node").groupBy("pivot", "part").applyInArrow(_near_pivot(threshold), "node long, ball long")


def near_classes(docs: DataFrame, threshold: float, recall: float, block: int) -> tuple[DataFrame, DataFrame]:
    """The rows of docs (doc_id, key, text) as signed, and (k1, k2, group, class_id, n_links) of every class of texts with words.

    A class is known by the number of one of its rows (``node``).
    """
    bands, rows = bands_for(threshold, recall)
    signed = written(signatures(docs, bands, rows).withColumn("row", F.monotonically_increasing_id()), "signed")
    wordy = signed.where("bands is not null")
    classes = written(wordy.groupBy("k1", "k2").agg(F.min_by("row", "doc_id").alias("node"), F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    banded = wordy.select(F.col("row").alias("node"), "doc_id", "key", "bands").join(classes.select("node", "copies"), "node")

    entry = banded.select("node", F.posexplode("bands").alias("band", "hash"))
    bucket = entry.groupBy("band", "hash").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("members"), F.min("node").alias("pivot")).where("n > 1")
    kept = bucket.groupBy("members", "n", "pivot").agg(F.min(F.struct("band", "hash")).alias("b")).select("b.band", "b.hash", "pivot")
    member = written(entry.join(kept, ["band", "hash"]).select("node", "band", "hash", "pivot"), "members")
    needed = banded.join(member.select("node").distinct(), "node", "left_semi").select("doc_id", "key", "node", "copies", "bands")
    texts = docs.join(needed.select("doc_id", "key", "node").hint("merge"), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"])
    sets = written(shingle_sets(texts.select("node", "text")).join(needed.drop("doc_id", "key"), "node"), "sets")

    balls = written(balls_of(member, sets, threshold, block).join(classes.select("node", "copies"), "node"), "balls")
    total = balls.groupBy("ball").agg(F.sum("copies").alias("total"))
    inside = balls.join(total, "ball").select("node", F.col("ball").alias("root"), (F.col("total") - F.col("copies")).alias("links"))

    # a class without a ball is a ball of its own, under a negative number
    placed = member.drop("pivot").join(balls.select("node", "ball"), "node", "left").withColumn("ball", F.coalesce("ball", -1 - F.col("node")))
    placed = written(placed, "placed")
    parts = placed.groupBy("band", "hash", "ball").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("band", "hash").agg(F.sum("n").alias("n"), F.max(F.struct("n", "ball")).alias("top")).where("n > top.n")
    mixed = mixed.select("band", "hash", F.col("top.ball").alias("largest"), F.col("top.n").alias("inner"), (F.col("n") - F.col("top.n")).alias("outer"))
    outer_blocks, outer_own = _block_of("node", F.col("outer"), block)
    inner_blocks, inner_own = _block_of("node", F.col("inner"), block)
    whole, of_largest = F.col("inner") + F.col("outer") <= block, F.col("ball") == F.col("largest")
    own = F.when(whole, 0).when(of_largest, outer_blocks + inner_own).otherwise(outer_own)
    others = F.when(whole, 1).when(of_largest, outer_blocks).otherwise(outer_blocks + inner_blocks)
    dealt = placed.join(mixed, ["band", "hash"]).select("node", "ball", "band", "hash", own.alias("own"), others.alias("others"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    pairs = pairs.select("node", "ball", "band", "hash", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    found = written(pairs.join(sets, "node").groupBy("lo", "hi", "band", "hash").applyInArrow(_verified(threshold), "node long, root long, links long"), "links").unionByName(inside)

    group = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(links, "node", "left").join(group, "node", "left").withColumn("group", F.coalesce("group", "node"))
    named = written(named.select("k1", "k2", "rep", "group", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    least = named.groupBy("group").agg(F.min("rep").alias("class_id"))
    return signed, written(named.join(least, "group").select("k1", "k2", "group", "class_id", "n_links"), "named")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, key, text): a text is known by its id and a hash."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).alias("text")).where("doc_id is not null")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_links) of every row with an id."""
    signed, named = near_classes(_keyed(docs, doc_id, text), threshold, recall, block)
    out = signed.where("bands is not null").select("doc_id", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", "class_id", "n_links")
    alone = signed.where("bands is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone)


def one_of_each_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The documents without those of a group but one, the first by id and hash of the text, with all their columns.

    Of rows that repeat id and text one stays; rows without words or id all stay.
    """
    signed, named = near_classes(_keyed(docs, doc_id, text), threshold, recall, BLOCK)
    own = signed.where("bands is not null").select("doc_id", "key", "k1", "k2").join(named, ["k1", "k2"]).groupBy("doc_id", "key", "group", "class_id").agg(F.count("*").alias("n"))
    own = written(own, "grouped")
    first = own.where("doc_id = class_id").groupBy("group").agg(F.min("key").alias("least"))
    stays = (F.col("doc_id") == F.col("class_id")) & (F.col("key") == F.col("least"))
    key = next(f"_key{k}" for k in range(len(docs.columns) + 1) if f"_key{k}" not in docs.columns)
    acted = written(own.join(first, "group").where(~stays | (F.col("n") > 1)).select(F.col("doc_id").alias(doc_id), F.col("key").alias(key), stays.alias("_stays")), "acted")
    keyed, on = docs.withColumn(key, F.xxhash64(text)), [doc_id, key]
    alone = keyed.join(acted.hint("merge"), on, "left_anti").select(docs.columns)
    repeated = acted.where("_stays").drop("_stays")
    if repeated.isEmpty():
        return alone
    return alone.unionByName(keyed.join(repeated.hint("merge"), on).dropDuplicates(on).select(docs.columns))
