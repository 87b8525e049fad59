"""License scan by patience alignment.

Each license template is a list of words.  A text is searched for regions in which enough words belong to the
template's vocabulary: a match with coverage c has c * n template words within ``SPREAD`` * n words, so a sliding
count over the hashed words of all texts at once finds every region that can match.  In a region, the words that a window
has in common with the template (each as often as both have it) bound what any alignment can cover, and as a step
changes them by one, windows that fall short by d let the next d - 1 be skipped.  Other windows, one for each word of the
template's vocabulary, are aligned with the template: words unique to both sides anchor the alignment, the longest increasing subsequence of
their places is kept, and the gaps between anchors are aligned in the same way after equal words at their ends have
been taken.  Coverage is the share of the template's words aligned; a match reaches ``COVERAGE``.

Defined cases: null and word-less texts match nothing; a text that holds a license twice gives two rows; templates
that contain each other each give a row; repeated rows each give their rows; rows with a null id give none.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leasewell.llm.arrowtext import Words, slices
from leasewell.llm.license_texts import LICENSES, LINES, NOTICES

COVERAGE = 0.75
#: A match lies within so many times the template's words.
SPREAD = 1.5

#: What is looked for unless a caller names templates, such as those that ``templates_from`` reads.
TEMPLATES = LINES | NOTICES | LICENSES

SCHEMA = "doc_id long, license string, coverage double, begin_word long, end_word long, excerpt string"


def unique_anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Places of the words that occur once in a and once in b, on the longest increasing subsequence."""
    where: dict = {}
    for k, word in enumerate(a):
        where[word] = -1 if word in where else k
    seen: dict = {}
    for k, word in enumerate(b):
        seen[word] = -1 if word in seen else k
    pairs = [(where[word], k) for word, k in seen.items() if k >= 0 and where.get(word, -1) >= 0]
    pairs.sort(key=lambda p: p[1])
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for k, (place, _) in enumerate(pairs):
        at = bisect_left(tops, place)
        before.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(place)
            piles.append(k)
        else:
            tops[at], piles[at] = place, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of equal words of a and b, increasing on both sides."""
    out, open_gaps = [], [(0, len(a), 0, len(b))]
    while open_gaps:
        a0, a1, b0, b1 = open_gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        anchors = [(a0 + i, b0 + j) for i, j in unique_anchors(a[a0:a1], b[b0:b1])]
        if not anchors:
            continue
        out += anchors
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            open_gaps.append((i + 1, k, j + 1, m))
    return sorted(out)


class Scanner:
    """Templates as word hashes with their vocabulary masks."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE, spread: float = SPREAD):
        self.names, self.coverage = list(templates), coverage
        words = Words(pa.array(list(templates.values()), pa.string()))
        self.words = [words.hash[a:b] for a, b in zip(words.offsets, words.offsets[1:], strict=False)]
        self.window = [int(np.ceil(spread * len(w))) for w in self.words]
        self.need = [max(1, int(np.ceil(coverage * len(w) - 1e-9))) for w in self.words]
        self.key = np.unique(np.concatenate(self.words))
        self.mask = np.zeros((len(self.words), len(self.key)), bool)
        for k, w in enumerate(self.words):
            self.mask[k, np.searchsorted(self.key, w)] = True
        self.often = [np.bincount(np.searchsorted(self.key, w), minlength=len(self.key)) for w in self.words]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.key >> np.uint64(44)).astype(np.int64)] = True

    def matches(self, words: Words) -> Iterator[tuple[int, int, float, int, int]]:
        """(row, template, coverage, first and last word) of every match."""
        h, offsets = words.hash, words.offsets
        hits = np.flatnonzero(self.sieve[(h >> np.uint64(44)).astype(np.int64)])
        entry = np.minimum(np.searchsorted(self.key, h[hits]), len(self.key) - 1)
        real = self.key[entry] == h[hits]
        hits, entry = hits[real], entry[real]
        row_of = np.searchsorted(offsets, hits, "right") - 1
        for t in range(len(self.words)):
            own = self.mask[t, entry]
            at, row, word, need, window = hits[own], row_of[own], entry[own], self.need[t], self.window[t]
            if len(at) < need:
                continue
            ahead = np.arange(len(at) - need + 1) + need - 1
            dense = np.flatnonzero((at[ahead] - at[: len(ahead)] < window) & (row[ahead] == row[: len(ahead)]))
            done = -1
            for first in dense:
                if at[first] > done:
                    last = np.searchsorted(at, min(at[first] + window, offsets[row[first] + 1]))
                    common = int(np.minimum(np.bincount(word[first:last], minlength=len(self.key)), self.often[t]).sum())
                    if common < need:
                        done = at[first] + need - common - 1
                        continue
                    found = self._aligned(h, t, int(at[first]), int(offsets[row[first]]), int(offsets[row[first] + 1]))
                    if found:
                        share, begin, end = found
                        if begin > done:
                            yield int(row[first]), t, share, begin - int(offsets[row[first]]), end - int(offsets[row[first]])
                            done = end

    def _aligned(self, h: np.ndarray, t: int, begin: int, low: int, high: int) -> tuple[float, int, int] | None:
        template, window, best = self.words[t].tolist(), self.window[t], None
        for start in (begin, None):
            if start is None:  # once more, with room for words before the first aligned one
                if best is None:
                    return None
                start = max(low, best[1] - best[3])
            stop = min(high, start + window)
            pairs = patience(h[start:stop].tolist(), template)
            if pairs and (best is None or len(pairs) > best[0]):
                best = len(pairs), start + pairs[0][0], start + pairs[-1][0], pairs[0][1]
        share = best[0] / len(template)
        return (share, best[1], best[2]) if share >= self.coverage - 1e-9 else None


def templates_from(rows: DataFrame, name: str = "license", text: str = "text") -> dict[str, str]:
    """Templates of a table of license texts, a list that a person keeps: refuses more than 10,000."""
    found = rows.where(F.col(name).isNotNull() & F.col(text).isNotNull()).select(name, text).limit(10_001).collect()
    if len(found) > 10_000:
        raise ValueError("more than 10,000 license templates")
    return {r[0]: r[1] for r in found}


def license_matches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """A row for each license found in a text: words begin_word to end_word of it (from 0, both included)."""
    templates = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                found = list(scanner.matches(words))
                if not found:
                    continue
                row, license_, share, begin, end = zip(*found, strict=True)
                first = words.offsets[list(row)]
                excerpt = [re.sub(r"\s+", " ", bytes(words.data[words.begin[a] : words.end[b]]).decode("utf-8", "replace")) for a, b in zip(first + begin, first + end, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array([scanner.names[k] for k in license_]), pa.array(share), pa.array(begin), pa.array(end), pa.array(excerpt)], ["doc_id", "license", "coverage", "begin_word", "end_word", "excerpt"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    return rows.mapInArrow(run, SCHEMA)
