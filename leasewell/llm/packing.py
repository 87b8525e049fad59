"""Token ids packed into matrices of fixed width by best-fit decreasing.

Texts are tokenised (byte-level BPE ranks of a public tokenizer file, or ids given in a column) and each ends in the
end id.  Documents longer than a row are split without loss into pieces of at most ``width`` ids.  Pieces are dealt
to shards by a hash; each shard is packed by best-fit decreasing: pieces from long to short, each into the row of
least sufficient room, found in a segment tree over room sizes in O(log width) steps.

A packed row holds the ids as little-endian integers (2 bytes if all ids fit, else 4), padded to the full width, the
cumulative segment lengths (0, ..., number of ids), the position of each id in its segment (positions start again
at 0 with every segment; padding is 0), and the document, text key (``xxhash64`` of the text) and piece of every segment.
``unpacked`` gives back the ids of every input row.

The number of shards follows the bytes of text (a text has no more ids than bytes, and one end id), so a shard has a
bounded size and one shard loses at most one half-empty row.

Defined cases: a null text has no ids and is in no row; an empty text is its end id; repeated rows are packed each, and
rows that share an id but not the text are told apart by the key; rows with a null id are packed under a null id.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leasewell.llm.arrowtext import slices

#: Where the installed public tokenizers are.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-token pattern of that tokenizer (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_ID = 50256
WIDTH = 2048
SHARD_BYTES = 2 << 20

SCHEMA = "shard int, row int, n_ids int, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, keys array<long>, pieces array<int>"

_encodings: dict[int, object] = {}


def _encoding(data: bytes, pattern: str):
    import tiktoken

    key = hash((data, pattern))
    if key not in _encodings:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}
        _encodings[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def pieces_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str = RANKS, pattern: str = PATTERN, end_id: int = END_ID, width: int = WIDTH) -> DataFrame:
    """(doc_id, key, copy, piece, n, ids): the ids of every text with its end id, in pieces of at most ``width``, as
    32-bit little-endian bytes; copy numbers equal rows of a slice."""
    with open(ranks, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(shared.value, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [np.array([*encoding.encode_ordinary(t), end_id], np.uint32) for t in part.column("text").to_pylist()]
                rows = np.repeat(np.arange(len(ids)), [-(-len(x) // width) for x in ids])
                cut = [x[k : k + width] for x in ids for k in range(0, len(x), width)]
                number = np.concatenate([np.arange(-(-len(x) // width)) for x in ids]) if ids else np.zeros(0, int)
                seen: dict = {}
                copy = [seen.update({row: seen.get(row, -1) + 1}) or seen[row] for row in zip(part.column("doc_id").to_pylist(), part.column("key").to_pylist(), strict=True)]
                of_row = [x.take(pa.array(rows)) for x in (part.column("doc_id"), part.column("key"), pa.array(copy, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*of_row, pa.array(number, pa.int32()), pa.array([len(x) for x in cut], pa.int32()), pa.array([x.tobytes() for x in cut], pa.binary())], ["doc_id", "key", "copy", "piece", "n", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).alias("text")).where("text is not null")
    return rows.mapInArrow(run, "doc_id long, key long, copy int, piece int, n int, ids binary")


class RoomTree:
    """A segment tree over room sizes: how many open rows have each room."""

    def __init__(self, width: int):
        self.leaves = 1 << (width + 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return a row of the least room of at least ``least``: (row, room)."""
        count, node = self.count, least + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # up to the first sibling on the right with rows
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not count[node]:
                    node += 1
        room = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return self.rows[room].pop(), room


def best_fit_decreasing(sizes: np.ndarray, width: int) -> np.ndarray:
    """The row of each piece; sizes are at most ``width``, in any order (equal sizes in the order given)."""
    out, rows, tree = np.zeros(len(sizes), np.int64), 0, RoomTree(width)
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        found = tree.take(size)
        if found is None:
            found, rows = (rows, width), rows + 1
        out[k] = found[0]
        if found[1] > size:
            tree.add(found[1] - size, found[0])
    return out


def _packer(width: int, pad_id: int, wide: bool):
    kind = np.dtype("<u4" if wide else "<u2")
    schema = pa.schema([("shard", pa.int32()), ("row", pa.int32()), ("n_ids", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_ids", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32()))])

    def run(key, table):
        table = table.sort_by([("n", "descending"), ("doc_id", "ascending"), ("key", "ascending"), ("piece", "ascending"), ("copy", "ascending")]).combine_chunks()
        sizes = table.column("n").to_numpy()
        row = best_fit_decreasing(sizes, width)
        order = np.argsort(row, kind="stable")
        bounds = np.flatnonzero(np.diff(row[order], prepend=-1, append=row.max() + 1))
        ids = table.column("ids").combine_chunks()
        docs, keys, pieces = (table.column(c).to_pylist() for c in ("doc_id", "key", "piece"))
        out = {c: [] for c in schema.names}
        for a, b in zip(bounds, bounds[1:], strict=False):
            own = order[a:b].tolist()
            length = sizes[own]
            cumulative = np.concatenate([[0], np.cumsum(length)])
            matrix, position = np.full(width, pad_id, kind), np.zeros(width, kind)
            matrix[: cumulative[-1]] = np.concatenate([np.frombuffer(ids[k].as_buffer(), np.uint32) for k in own])
            position[: cumulative[-1]] = np.arange(cumulative[-1]) - np.repeat(cumulative[:-1], length)
            for c, v in zip(schema.names, (key[0].as_py(), int(row[own[0]]), int(cumulative[-1]), matrix.tobytes(), cumulative.tolist(), position.tobytes(), [docs[k] for k in own], [keys[k] for k in own], [pieces[k] for k in own]), strict=True):
                out[c].append(v)
        return pa.table(out, schema)

    return run


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, ranks: str = RANKS, end_id: int = END_ID, pad_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The packed rows of all texts."""
    total = docs.agg(F.sum(F.octet_length(text).cast("long") + 1)).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    pieces = pieces_of(docs, doc_id, text, ranks, PATTERN, end_id, width).withColumn("shard", F.pmod(F.xxhash64("doc_id", "key", "piece", "copy"), F.lit(shards)).cast("int"))
    return pieces.groupBy("shard").applyInArrow(_packer(width, pad_id, max(end_id, pad_id) > 0xFFFF), SCHEMA)


def write_packed(rows: DataFrame, path: str) -> None:
    """Write packed rows as Parquet, a matrix row in each record."""
    rows.write.parquet(path)


def unpacked(rows: DataFrame, id_bytes: int = 2) -> DataFrame:
    """(doc_id, key, ids) of packed rows: a row for each packed text, its pieces in order as one array of ids.

    Copies of a text (same id and key) are equal, so their pieces are counted and the text is given as often.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for ids, cumulative, docs, keys, pieces in zip(*(batch.column(c).to_pylist() for c in ("ids", "cu_seqlens", "doc_ids", "keys", "pieces")), strict=True):
                matrix = np.frombuffer(ids, f"<u{id_bytes}")
                out += [(d, k, p, matrix[a:b].astype(np.int32)) for d, k, p, a, b in zip(docs, keys, pieces, cumulative, cumulative[1:], strict=False)]
            doc, key, piece, ids = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(piece, pa.int32()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "key", "piece", "ids"])

    pieces = rows.mapInArrow(run, "doc_id long, key long, piece int, ids array<int>")
    counted = pieces.groupBy("doc_id", "key", "piece").agg(F.first("ids").alias("ids"), F.count("*").cast("int").alias("copies"))
    ordered = F.array_sort(F.collect_list(F.struct("piece", "ids")))
    texts = counted.groupBy("doc_id", "key").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"), F.min("copies").alias("copies"))
    return texts.select("doc_id", "key", "ids", F.explode(F.sequence(F.lit(1), "copies"))).drop("col")
