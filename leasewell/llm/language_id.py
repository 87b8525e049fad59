"""Language identification by cross-parsing entropy against suffix automata of labelled text.

For every language a suffix automaton is built over a bounded sample of its labelled texts.  A text is parsed
greedily into the longest phrases that occur in that sample; a language whose sample explains the text needs few
phrases.  A phrase is one of the N places of the sample or one of the A symbols of the alphabet, which the sample may
lack, so the phrases of a language cost ``c * log2(N + A)`` bits: a sample of a few symbols still costs log2(A) bits for
each symbol that it does not explain.  The language with the least cost per symbol wins (ties: the lesser name).

Texts are lower-cased and turned into symbols: each letter of any script is its UTF-8 bytes, and every run of anything
else is one space.  A symbol that a language's sample lacks costs log2(A) bits.  The automata travel as lists of
transitions and are spread to dense transition tables, one column a byte of the sample, in groups of ``TABLE_CELLS``
cells.  A missing transition already holds the state after a new phrase has begun, so a parse is one table lookup per
symbol, and numpy walks many stretches of ``STRETCH`` symbols side by side.  A phrase does not end with its stretch: a
walk goes on for ``OVERLAP`` symbols into the next stretch, and where both walks begin a phrase at the same place they
are the same from there, so the phrases of the whole text are counted exactly.  Stretches whose walks do not meet are
joined and walked again.  Every symbol of every text is parsed.

The sample is bounded by parameters: at most ``SAMPLE_ROWS`` rows a language, in the order of a hash of the id, and
``SAMPLE_SYMBOLS`` characters, shared by all these rows: each gives the same number (shorter texts are taken whole, and
what they leave goes to the others), in excerpts of ``EXCERPT`` characters spread evenly over the whole text.  Every
label with a letter in its sample is a language; their number is not bounded, and the time of a parse grows with it.

Defined cases: a null text or one without a letter is ``und`` with score 0 and null bits; without any labelled text
everything is ``und``; every input row gives one row, repeated ones too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leasewell.llm.arrowtext import slices
from leasewell.llm.session import written

SAMPLE_ROWS = 200
SAMPLE_SYMBOLS = 40_000
#: Characters of an excerpt of a text that is too long for its share of the sample.
EXCERPT = 200
STRETCH, OVERLAP = 1024, 64
#: Symbols that a sample may lack: the bytes.
ALPHABET = 256
#: Cells of the tables that a task holds at once (four bytes each).
TABLE_CELLS = 24_000_000
UNKNOWN = "und"
#: A parse that costs more bits a symbol than this has found no language (random letters cost about 5.5).
REJECT_BITS = 5.2
#: Symbols a text needs before its cost can reject it.
REJECT_SYMBOLS = 100

_MISS, _UNSEEN = np.uint32(1 << 31), np.uint32(1 << 30)
_LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the start."""
    moves, link, length, last = [{}], [-1], [0], 0
    for symbol in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in moves[at]:
            moves[at][symbol] = new
            at = link[at]
        if at >= 0:
            to = moves[at][symbol]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(moves)
                moves.append(dict(moves[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and moves[at].get(symbol) == to:
                    moves[at][symbol] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return moves


class CrossParser:
    """Suffix automata of all languages."""

    def __init__(self, samples: dict[str, list[str]] | Iterable[tuple[str, list[str]]]):
        """samples: texts by language, in the order in which they are to be used; as pairs, in the order of the names."""
        self.languages, self.moves, cells, sizes = [], [], [], []
        for name, texts in sorted(samples.items()) if isinstance(samples, dict) else samples:
            symbols = self.symbols(" ".join(texts))[0]
            if not symbols.any():
                continue
            moves = suffix_automaton(symbols.tolist())
            source = np.repeat(np.arange(len(moves), dtype=np.uint32), [len(own) for own in moves])
            symbol = np.fromiter((c for own in moves for c in own), np.uint8, len(source))
            target = np.fromiter((to for own in moves for to in own.values()), np.uint32, len(source))
            self.languages.append(name)
            self.moves.append((len(moves), source, symbol, target))
            cells.append(len(moves) * (len(np.unique(symbols)) + 1))
            sizes.append(len(symbols) + ALPHABET)
        self.bits = np.log2(sizes) if sizes else np.zeros(0)
        self.groups, held = [], TABLE_CELLS
        for k, size in enumerate(cells):
            if held + size > TABLE_CELLS:
                self.groups.append([])
                held = 0
            self.groups[-1].append(k)
            held += size
        self.spread: list = [None, None]  # the group last used and its tables

    def __getstate__(self) -> dict:
        return {**self.__dict__, "spread": [None, None]}

    def tables(self, group: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tables of a group in one (a state is the place of its row), the start states, and the columns of the bytes."""
        if self.spread[0] == group:
            return self.spread[1]
        self.spread = [None, None]
        tables, first, columns, base = [], [], np.zeros((len(self.groups[group]), 256), np.uint32), 0
        for row, k in enumerate(self.groups[group]):
            states, source, symbol, target = self.moves[k]
            known = np.unique(symbol)
            columns[row, known] = np.arange(1, len(known) + 1)
            column, width = columns[row, symbol], len(known) + 1
            to = np.uint32(base) + target * np.uint32(width)
            start = np.full(width, np.uint32(base) | _MISS | _UNSEEN)
            start[column[source == 0]] = to[source == 0] | _MISS
            table = np.tile(start, (states, 1))
            table[source, column] = to
            table[0] |= _MISS  # what follows an unseen symbol begins a phrase
            first.append(base)
            tables.append(table.ravel())
            base += table.size
        self.spread = [group, (np.concatenate(tables), np.array(first, np.uint32), columns)]
        return self.spread[1]

    def symbols(self, text: str, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of lower-cased texts joined, runs of spaces as one, and the number of symbols of each."""
        text = text.lower() if lengths is None else text
        code = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        begin = np.flatnonzero((code & 0xC0) != 0x80)
        letter = _LETTER[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        code = np.where(np.repeat(letter, np.diff(np.append(begin, len(code)))), code, np.uint8(0))
        lengths = np.array([len(begin)]) if lengths is None else lengths
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] > 0) | (code[:-1] > 0)
        edge = np.append(begin, len(code))[np.concatenate([[0], np.cumsum(lengths)])]
        keep[edge[:-1][lengths > 0]] = True
        total = np.concatenate([[0], np.cumsum(keep)])
        return code[keep], np.diff(total[edge])

    def costs(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Bits of each text (columns) under each language (rows)."""
        return np.concatenate([np.zeros((0, len(lengths))), *(cost for _, cost in self.group_costs(symbols, lengths))])

    def group_costs(self, symbols: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The first language of each group of languages, and the bits of each text under the languages of the group."""
        text = np.repeat(np.arange(len(lengths)), lengths)
        first = np.cumsum(lengths) - lengths
        for group, members in enumerate(self.groups):
            known = self.tables(group)[2] > 0
            phrases = self.phrases(group, symbols, first, lengths, STRETCH)
            cost = np.empty(phrases.shape)
            for row, k in enumerate(members):
                unseen = np.bincount(text, ~known[row, symbols], len(lengths))
                cost[row] = (phrases[row] - unseen) * self.bits[k] + unseen * np.log2(ALPHABET)
            yield members[0], cost

    def phrases(self, group: int, symbols: np.ndarray, first: np.ndarray, lengths: np.ndarray, stretch: int) -> np.ndarray:
        """Phrases of each text (columns) under the languages of a group (rows)."""
        pieces = -(-lengths // stretch)
        owner = np.repeat(np.arange(len(lengths)), pieces)
        at = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * stretch
        left = lengths[owner] - at
        begin, size = first[owner] + at, np.minimum(left, stretch)
        count, head, tail = self.walked(group, symbols, begin, size, left)
        while True:
            after = np.flatnonzero(np.diff(owner, prepend=-1) == 0)  # stretches with one before them in their text
            common = tail[:, after - 1] & head[:, after]
            ends = (common == 0) & (left[after] <= OVERLAP)  # the last phrases of the text began in the stretch before
            apart = after[((common == 0) & ~ends).any(axis=0)]
            if not len(apart):
                break
            lead = np.ones(len(owner), bool)
            lead[apart] = False
            kept = np.flatnonzero(lead)
            again = np.diff(np.append(kept, len(owner))) > 1  # those that are joined with what follows
            owner, begin, left, size = owner[kept], begin[kept], left[kept], np.add.reduceat(size, kept)
            count, head, tail = count[:, kept], head[:, kept], tail[:, kept]
            count[:, again], head[:, again], tail[:, again] = self.walked(group, symbols, begin[again], size[again], left[again])
        if len(after):
            below = (common & (~common + np.uint64(1))) - np.uint64(1)  # places before the one where both begin a phrase
            count[:, after] -= np.where(ends, count[:, after], np.bitwise_count(head[:, after] & below))
            count[:, after - 1] += np.bitwise_count(tail[:, after - 1] & below)
        return np.stack([np.bincount(owner, row, len(lengths)) for row in count])

    def walked(self, group: int, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of walks over stretches of their texts: the phrases that begin in each, and the places (bits) of those that
        begin in its first OVERLAP symbols and in the OVERLAP symbols after it."""
        table, start, columns = self.tables(group)
        reach = np.minimum(left, size + OVERLAP)
        order = np.argsort(-reach, kind="stable")
        begin, size, reach = begin[order], size[order], reach[order]
        active = np.searchsorted(-reach, -np.arange(1, reach.max(initial=0) + 1), "right")
        state = np.repeat(start[:, None], len(size), 1)
        count, head, tail = np.zeros(state.shape, np.int64), np.zeros(state.shape, np.uint64), np.zeros(state.shape, np.uint64)
        keep, shortest = ~(_MISS | _UNSEEN), np.minimum.accumulate(size)
        for k, n in enumerate(active.tolist()):
            to = table[state[:, :n] + columns[:, symbols[begin[:n] + k]]]
            state[:, :n] = to & keep
            fresh = to >= _MISS if k else np.ones(to.shape, bool)
            if k < OVERLAP:
                head[:, :n] |= fresh.astype(np.uint64) << np.uint64(k)
            if k < shortest[n - 1]:
                count[:, :n] += fresh
                continue
            inside = k < size[:n]
            count[:, :n] += fresh & inside
            over = np.flatnonzero(~inside)
            tail[:, over] |= fresh[:, over].astype(np.uint64) << (k - size[over]).astype(np.uint64)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return count[:, back], head[:, back], tail[:, back]


def sampled(docs: DataFrame, doc_id: str, text: str, lang: str, learn: Column) -> Iterator[tuple[str, list[str]]]:
    """Every language, in the order of the names, with its texts: a bounded sample of the rows to learn from."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(lang).alias("_l"), F.xxhash64(text).alias("_h"), F.col(text).alias("_t"))
    ids = rows.select("_id", "_l", "_h", F.length("_t").cast("long").alias("_size")).withColumn("_n", F.row_number().over(Window.partitionBy("_l").orderBy(F.xxhash64("_id"), "_id", "_h"))).where(F.col("_n") <= SAMPLE_ROWS)
    # the level up to which every text is taken: what shorter texts leave is shared by those that are longer
    by_size, whole = Window.partitionBy("_l").orderBy("_size", "_n"), Window.partitionBy("_l")
    before, rest = F.sum("_size").over(by_size) - F.col("_size"), F.count("*").over(whole) - F.row_number().over(by_size) + 1
    levels = ids.withColumn("_level", F.floor((SAMPLE_SYMBOLS - before) / rest))
    levels = levels.withColumn("_share", F.max(F.when(F.col("_size") > F.col("_level"), F.col("_level"))).over(whole))
    share = F.greatest(F.coalesce("_share", "_size"), F.lit(1))
    pieces = F.ceil(share / EXCERPT).cast("int")
    room = F.floor(share / pieces).cast("int")
    first = lambda k: F.floor(k * (F.col("_size") - room) / F.greatest(pieces - 1, F.lit(1))).cast("int") + 1
    excerpts = F.when(F.col("_size") <= share, F.col("_t")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), pieces - 1), lambda k: F.substring(F.col("_t"), first(k), room)), " "))
    levels = written(levels.dropDuplicates(["_id", "_l", "_h"]), "sampled")  # its size decides how it is joined
    found = written(rows.join(levels, ["_id", "_l", "_h"]).select("_l", "_n", excerpts.alias("_t")).where("_n is not null"), "sample")
    found = found.dropDuplicates(["_l", "_n"]).orderBy("_l", "_n").toLocalIterator()
    for name, group in groupby(found, lambda r: r[0]):
        yield name, [r[2] for r in group]


#: What ``identify`` adds.
ADDED = ("lang_pred", "score", "bits", "symbols")


def identify(docs: DataFrame, parser: CrossParser, text: str = "text", added: tuple[str, ...] = ADDED, keep_text: bool = False) -> DataFrame:
    """docs (without the text unless it is to be kept) with lang_pred, score (0 to 1: by how much the best language
    undercuts the next), bits (per symbol) and symbols, under the names ``added`` and in the place of such columns."""
    docs = docs.drop(*added)
    shared = docs.sparkSession.sparkContext.broadcast(parser)
    kept = [f for f in docs.schema.fields if keep_text or f.name != text]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, text):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *_predict(own, part.column(text))], [*names, *added])

    found = [T.StructField(name, kind) for name, kind in zip(added, (T.StringType(), T.DoubleType(), T.DoubleType(), T.LongType()), strict=True)]
    return docs.mapInArrow(run, T.StructType([*kept, *found]))


def _predict(own: CrossParser, texts: pa.Array) -> list[pa.Array]:
    low = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    symbols, lengths = own.symbols("".join(low.to_pylist()), pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64))
    edge = np.concatenate([[0], np.cumsum(symbols > 0)])
    end = np.cumsum(lengths)
    known = (edge[end] - edge[end - lengths] > 0) & (len(own.languages) > 0)
    if not known.any():
        return [pa.array([UNKNOWN] * len(texts)), pa.array(np.zeros(len(texts))), pa.array([None] * len(texts), pa.float64()), pa.array(lengths)]
    best, least, second = np.zeros(len(texts), np.int64), np.full(len(texts), np.inf), np.full(len(texts), np.inf)
    for first, cost in own.group_costs(symbols, lengths):
        top, low = cost.argmin(axis=0), cost.min(axis=0)
        cost[top, np.arange(len(top))] = np.inf
        second = np.minimum(np.maximum(least, low), np.minimum(second, cost.min(axis=0)))
        best = np.where(low < least, first + top, best)
        least = np.minimum(least, low)
    score = np.where(np.isfinite(second) & known, 1 - least / np.maximum(second, 1e-9), known * 1.0)
    names = np.array(own.languages, object)[best]
    names[~known] = UNKNOWN
    return [pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(least / np.maximum(lengths, 1), mask=~known), pa.array(lengths)]


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits, symbols) of every row."""
    parser = CrossParser(sampled(docs, doc_id, text, lang, ~held_out(doc_id) & F.col(doc_id).isNotNull()))
    out = identify(docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text")), parser)
    return out


def accepted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents in a learned language, with all their columns: those without letters go, and those whose
    parse costs more than ``REJECT_BITS`` a symbol over at least ``REJECT_SYMBOLS`` symbols."""
    parser = CrossParser(sampled(docs, doc_id, text, lang, ~held_out(doc_id) & F.col(doc_id).isNotNull()))
    added = next(names for k in range(len(docs.columns) + 1) if not set(names := tuple("_" * k + c for c in ADDED)) & set(docs.columns))
    rows = identify(docs, parser, text, added, keep_text=True)
    language, _, bits, symbols = map(F.col, added)
    return rows.where((language != UNKNOWN) & ~((bits > REJECT_BITS) & (symbols >= REJECT_SYMBOLS))).select(docs.columns)
