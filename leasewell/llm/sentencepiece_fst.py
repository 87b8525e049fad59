"""SentencePiece encoding and decoding as shortest paths in a weighted finite-state transducer.

A model file is compiled into three machines over the tropical semiring (weights add along a path, the least wins):

* the *normaliser*, a transducer of one state, writes the word mark for a space and copies other characters; its initial
  arc writes a mark before the text, as the model asks.  With one arc that rewrites, running it is one replacement.
* the *lexicon* reads normalised characters and writes piece ids.  Its states are the prefixes of pieces, compiled to a
  trie of arcs; where a piece ends, an arc writes its id at its cost and leads back to the start.  A character that no
  piece covers has a path that writes its UTF-8 bytes (byte fallback) or the unknown id.
* the *adjacency* acceptor reads piece ids; its state is the last id.  For unigram models all its weights are 0 and pieces
  cost ``-score``.  For BPE models pieces cost nothing, and a pair of neighbours has weight 0 if merging their characters
  by rank leaves exactly this pair, else infinity.  A sequence is what BPE yields if and only if all its pairs are: a
  boundary that no merge crosses separates merges left and right of it, so whether one survives depends on the two
  pieces at it.  Its arcs are expanded when first met and kept.

Inputs are composed with them on the fly, many at once: a state of the composition is a place in the text, a state of the
lexicon and the last id.  numpy follows the arcs of the lexicon from all places of all inputs, then relaxes the shortest
distances place by place, with the weights of the adjacency; at a place between two pieces one last id suffices, the one of least weight, because with BPE a prefix has a single path of finite weight, and with unigram models the
last id does not matter.  The path back from the end gives the ids.

Between characters that no piece joins (before a word mark, around characters that stand alone in the vocabulary) all paths
meet, so these stretches are solved once and kept in a bounded table.  Whole texts are encoded.

Defined cases: a null text has null ids; an empty text has none; repeated rows each give a row.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leasewell.llm.arrowtext import slices

#: Where the installed public tokenizers are; any SentencePiece model file will do.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Solved stretches in each of two generations that a process keeps.
KEPT_STRETCHES = 150_000
#: Size of the table of expanded adjacency arcs, as a power of two (12 bytes each).
PAIR_BITS = 21
MARK = "▁"
#: Model types and piece types of the file format (fixed values).
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


class Model:
    """Pieces and settings of a SentencePiece model file."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.types = [], [], []
        trainer, normalizer = {}, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.kind, self.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        self.dummy_prefix, self.squeeze, self.escape = (bool(normalizer.get(k, 1)) for k in (3, 4, 5))
        if normalizer.get(2) or trainer.get(24) or self.kind not in (UNIGRAM, BPE) or {USER, UNUSED} & set(self.types):
            raise ValueError("only unigram and BPE models without character map, suffix marks and user-defined pieces can be compiled")


class Table:
    """Numbers by non-negative 64-bit keys: open addressing over arrays, for many keys at once."""

    def __init__(self, bits: int):
        self.bits, self.size = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for keys that are not there."""
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[left]]
            hit = held == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that are not there; the table must keep free places."""
        self.size += len(keys)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            taken = free[first]
            self.keys[slot[taken]], self.values[slot[taken]] = keys[taken], values[taken]
            left = np.ones(len(keys), bool)
            left[taken] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & (len(self.keys) - 1)


class Transducer:
    """The compiled machines of a model."""

    def __init__(self, model: Model):
        self.model = model
        self.lexicon = {p: k for k, (p, t) in enumerate(zip(model.pieces, model.types, strict=True)) if t == NORMAL}
        self.bytes = {int(p[1:-1], 16): k for k, (p, t) in enumerate(zip(model.pieces, model.types, strict=True)) if t == BYTE}
        self.unknown = next((k for k, t in enumerate(model.types) if t == UNKNOWN), 0)
        self.bpe = model.kind == BPE
        self.unknown_cost = 10.0 - min((model.scores[k] for k in self.lexicon.values()), default=0.0)
        merges = sorted((p for p in self.lexicon if len(p) > 1), key=lambda p: -model.scores[self.lexicon[p]])
        self.rank = {p: k for k, p in enumerate(merges)}
        self.split: dict[str, tuple[str, str] | None] = {}
        #: arcs of the lexicon: state and character to state; the id written where a piece ends, else -1
        states, self.ends, usable = {"": 0}, [-1], [p for p in self.lexicon if not self.bpe or len(p) == 1 or self.halves(p)]
        for piece in usable:
            for k in range(1, len(piece) + 1):
                if states.setdefault(piece[:k], len(states)) == len(self.ends):
                    self.ends.append(-1)
            self.ends[states[piece]] = self.lexicon[piece]
        chars = sorted({c for p in usable for c in p})
        self.chars = {c: k for k, c in enumerate(chars)}
        self.code = np.full(0x110000, len(chars), np.int32)
        self.code[[ord(c) for c in chars]] = np.arange(len(chars))
        self.many_chars, arcs = len(chars) + 1, [(states[p[:-1]] * (len(chars) + 1) + self.chars[p[-1]], k) for p, k in states.items() if p]
        self.arcs, self.table = dict(arcs), Table(max(10, (8 * len(arcs)).bit_length()))
        self.table.put(np.array([k for k, _ in arcs], np.int64), np.array([v for _, v in arcs], np.int32))
        self.end_ids = np.array(self.ends)
        self.cost = np.array([0.0 if self.bpe else -x for x in model.scores])
        #: arcs of the adjacency acceptor that have been expanded: 1 for weight 0, 0 for infinity
        self.adjacent = Table(PAIR_BITS)
        #: solved stretches in two generations: what is used again outlives the full table it was in
        self.solved: dict[str, bytes] = {}
        self.solved_before: dict[str, bytes] = {}
        joined = {c for p in self.lexicon if len(p) > 1 for c in p}
        alone = "".join(re.escape(c) for c in "\n\r\t" if c not in joined)
        marks_first = all(MARK not in p.lstrip(MARK) for p in self.lexicon)
        self.stretch = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+|(?s:.)" if marks_first else "(?s:.+)")
        self.output = [b"" if t == CONTROL else bytes([int(p[1:-1], 16)]) if t == BYTE else " ⁇ ".encode() if t == UNKNOWN else p.replace(MARK, " ").encode() for p, t in zip(model.pieces, model.types, strict=True)]

    def normalised(self, text: str) -> str:
        if self.model.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        text = (" " if self.model.dummy_prefix else "") + text
        return text.replace(" ", MARK) if self.model.escape else text

    def fallback(self, char: str) -> list[int]:
        """Ids of a character that no piece covers."""
        return [self.bytes[b] for b in char.encode()] if self.model.byte_fallback else [self.unknown]

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts of the last merge that makes a piece of its characters; None if merging by rank never
        makes it."""
        if piece not in self.split:
            parts, rank = list(piece), self.rank
            before = None
            while len(parts) > 1:
                order = [(found, k) for k in range(len(parts) - 1) if (found := rank.get(parts[k] + parts[k + 1])) is not None]
                if not order:
                    break
                k = min(order)[1]
                before = parts[k], parts[k + 1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self.split[piece] = before if len(parts) == 1 else None
        return self.split[piece]

    def may_follow(self, left: str, right: str) -> bool:
        """Adjacency weight of a pair: True for 0, False for infinity.

        Undo the merges at the boundary from the last to the first; the pair fails if at some moment the parts at
        the boundary would have been merged before (or, on the right, at) the next merge that took place.
        """
        rank, limit = self.rank, np.inf
        while True:
            if rank.get(left + right, limit) < limit:
                return False
            first, second = (rank[left] if len(left) > 1 else -1), (rank[right] if len(right) > 1 else -1)
            if first > second:
                limit, left = first, self.halves(left)[1]
            elif second >= 0:
                limit, right = second + 1, self.halves(right)[0]
            else:
                return True

    def follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether pairs of ids have adjacency weight 0; a left id below 0 is none."""
        pair = np.maximum(left, 0) * len(self.cost) + right
        fits = self.adjacent.get(pair)
        new = np.unique(pair[(fits < 0) & (left >= 0)])
        if len(new):
            if self.adjacent.size + len(new) > len(self.adjacent.keys) // 2:
                self.adjacent = Table(max(PAIR_BITS, (4 * len(new)).bit_length()))
            pieces = self.model.pieces
            self.adjacent.put(new, np.array([self.may_follow(pieces[p // len(self.cost)], pieces[p % len(self.cost)]) for p in new.tolist()], np.int32))
            return self.follows(left, right)
        return (fits == 1) | (left < 0)

    def shortest_paths(self, texts: list[str]) -> list[bytes]:
        """Ids (32-bit little-endian) on the path of least weight through the composition with each stretch."""
        if not texts:
            return []
        size = np.array([len(t) for t in texts])
        joined = "".join(texts)
        code = self.code[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        text = np.repeat(np.arange(len(size)), size)
        first = np.cumsum(size) - size
        inside, total = np.arange(len(code)) - first[text], len(code)
        # arcs of the composition with the lexicon: begin and end (as places in all texts, a place more for each), and id
        begin, end, ids = [], [], []
        state, at, reach = np.zeros(total, np.int64), np.arange(total), np.arange(total)
        while len(at):
            state = self.table.get(state * self.many_chars + code[reach])
            live = state >= 0
            state, at, reach = state[live], at[live], reach[live] + 1
            piece = self.end_ids[state]
            found = piece >= 0
            begin.append(at[found])
            end.append(reach[found])
            ids.append(piece[found])
            more = reach < (first + size)[text[at]]
            state, at, reach = state[more], at[more], reach[more]
        single = self.table.get(code.astype(np.int64))
        alone = np.flatnonzero((single < 0) | (self.end_ids[single] < 0))  # characters that no piece covers
        begin, end, ids = (np.concatenate(x) for x in ([*begin, alone], [*end, alone + 1], [*ids, np.full(len(alone), -1)]))
        order = np.lexsort((end, inside[begin]))
        begin, end, ids = begin[order], end[order], ids[order]
        step = np.searchsorted(inside[begin], np.arange(size.max(initial=0) + 1))
        spaced = begin + text[begin], end + text[begin]
        weight, last, back = np.full(total + len(size), np.inf), np.full(total + len(size), -1), np.zeros(total + len(size), np.int64)
        weight[first + np.arange(len(size))] = 0
        for a, b in zip(step, step[1:], strict=False):
            source, target, known = spaced[0][a:b], spaced[1][a:b], ids[a:b]
            reached = weight[source] + np.where(known >= 0, self.cost[known], self.unknown_cost)
            better = np.flatnonzero(reached < weight[target])
            if self.bpe:
                fits, piece = known[better] < 0, np.flatnonzero(known[better] >= 0)
                fits[piece] = self.follows(last[source[better[piece]]], known[better[piece]])
                better = better[fits]
            weight[target[better]], last[target[better]], back[target[better]] = reached[better], known[better], source[better]
        place, start = first + size + np.arange(len(size)), first + np.arange(len(size))
        on_path = np.zeros(total + len(size), bool)
        while len(place):
            on_path[place] = True
            place = back[place]
            going = place != start
            place, start = place[going], start[going]
        where = np.flatnonzero(on_path)
        owner = np.searchsorted(first + np.arange(len(size)), where, "right") - 1
        out, bounds, path = last[where].astype(np.int32), np.searchsorted(owner, np.arange(len(size) + 1)) * 4, []
        data = out.tobytes()
        path = [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        for k in np.unique(owner[out < 0]).tolist():  # texts with characters that no piece covers
            own = where[owner == k]
            path[k] = array("i", [x for p in own.tolist() for x in ([int(last[p])] if last[p] >= 0 else self.fallback(joined[back[p] - k : p - k]))]).tobytes()
        return path

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as little-endian 32-bit integers."""
        stretches = [self.stretch.findall(self.normalised(t)) for t in texts]
        young, before = self.solved, self.solved_before
        new = []
        for stretch in {x for own in stretches for x in own}:
            if stretch not in young:
                ids = before.get(stretch)
                if ids is None:
                    new.append(stretch)
                else:
                    young[stretch] = ids
        young.update(zip(new, self.shortest_paths(new), strict=True))
        out = [b"".join([young[x] for x in own]) for own in stretches]
        for stretch in [x for x in new if len(x) > 64]:
            del young[stretch]
        if len(young) >= KEPT_STRETCHES:
            self.solved_before, self.solved = young, {}
        return out

    def encode(self, text: str) -> bytes:
        """Ids of one text."""
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        output = self.output
        text = b"".join([output[k] for k in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


_compiled: dict[int, Transducer] = {}


def compiled(data: bytes) -> Transducer:
    """The transducer of a model, compiled once in a process."""
    key = hash(data)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Transducer(Model(data))
    return _compiled[key]


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """docs with ids (array of piece ids), n_ids and round_trip (whether decoding the ids gives the text again), in
    the place of columns of these names.

    The model file is read by the driver and sent to the tasks; its size does not depend on the data.
    """
    docs = docs.drop("ids", "n_ids", "round_trip")
    shared = docs.sparkSession.sparkContext.broadcast(_model_bytes(model))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(shared.value)
        for batch in batches:
            for part in slices(batch, text):
                values = part.column(text).to_pylist()
                found = iter(machine.encode_all([v for v in values if v is not None]))
                ids = [None if v is None else next(found) for v in values]
                flat = np.frombuffer(b"".join(x for x in ids if x), np.int32)
                size = np.array([0 if x is None else len(x) // 4 for x in ids], np.int64)
                missing = np.array([x is None for x in ids], bool)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat), mask=pa.array(missing))
                same = [None if v is None else machine.decode(np.frombuffer(x, np.int32)) == v for v, x in zip(values, ids, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), lists, pa.array(size, mask=missing), pa.array(same, pa.bool_())], [*names, "ids", "n_ids", "round_trip"])

    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def decode(rows: DataFrame, ids: str = "ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """rows with the text of their ids."""
    rows = rows.drop(out)
    shared = rows.sparkSession.sparkContext.broadcast(_model_bytes(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(shared.value)
        for batch in batches:
            texts = [None if x is None else machine.decode(np.array(x, np.int32)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """(doc_id, n_ids, ids, round_trip) of every row."""
    return encode(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", model).select("doc_id", "n_ids", "ids", "round_trip")
