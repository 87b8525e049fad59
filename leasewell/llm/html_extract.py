"""Main text of web pages: gradient-boosted trees over DOM elements and hierarchical decoding.

Every element gets features of its own (tag, words in its attributes, depth, place among its siblings and beside the
largest of them), of its subtree (text, density of text and links, punctuation, form controls, what boilerplate says and
names before a colon) and of what stands above, before and after it.  Pages without any names are among those the trees
are trained on.  Boosted trees
give the log-odds that it belongs to the article.  Decoding then chooses the set of elements of largest total
log-odds in which no element is kept below one that is not: an element's best total is its own log-odds plus the
positive totals of its children, so one pass up and one down decide the page without contradictions.

The trees are trained here, on ``TRAINING_PAGES`` generated pages (``html_training``) whose boilerplate is known; no
row of the table is learned from, and the bound does not depend on the data.  Training takes the driver about a
second and the model is a few kilobytes.

Defined cases: null or empty html has an empty text; text outside any element is kept; pages without tags are their
own text; every row gives one row, repeated ones too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leasewell.llm.arrowtext import slices
from leasewell.llm.html_dom import CUE_GROUPS, TAG_GROUPS, TOKEN_GROUPS, Page
from leasewell.llm.html_training import labelled_pages

TRAINING_PAGES = 1500
TREES, DEPTH, RATE, BINS = 100, 5, 0.2, 16


def features(pages: list[Page]) -> np.ndarray:
    """A row of features for every element of the pages."""
    get = lambda name: np.concatenate([np.array(getattr(p, name)) for p in pages])
    sizes = np.array([len(p.parent) for p in pages])
    base = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at, end = np.arange(len(base)), get("end") + base
    parent = np.maximum(get("parent"), 0) + base

    def below(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return (total[end] - total[at]).astype(float)

    tag, tokens, above, above_tags, cues = get("tag"), get("tokens"), get("above"), get("above_tags"), get("cues")
    own, elements, children, index = get("chars"), (end - at).astype(float), get("children"), get("index")
    chars, linked, marks, controls, speakers, digits = (below(get(c)) for c in ("chars", "linked", "marks", "controls", "speakers", "digits"))
    paragraphs, items, headings = below(tag == 9), below(tag == 12), below(tag == 10)
    siblings, whole = np.maximum(children[parent], 1), np.maximum(chars[base], 1)
    ahead = np.cumsum(own) - own  # characters of the page before the element
    ahead = (ahead - ahead[base]) / whole
    largest = np.zeros(len(base))
    np.maximum.at(largest, parent[at != base], chars[at != base])
    first_largest = np.full(len(base), len(base))
    top = (at != base) & (chars == largest[parent])
    np.minimum.at(first_largest, parent[top], at[top])
    before = np.where(get("before") >= 0, get("before") + base, at)
    after = at.copy()
    after[before[before != at]] = at[before != at]
    near = lambda values, to: np.where(to == at, 0, values[to])
    columns = [tag == k for k in range(len(TAG_GROUPS))]
    columns += [tokens >> k & 1 for k in range(len(TOKEN_GROUPS))]
    columns += [above >> k & 1 for k in range(len(TOKEN_GROUPS))]
    columns += [above_tags >> k & 1 for k in range(7)]
    columns += [np.minimum(below(cues >> k & 1), 4) for k in range(len(CUE_GROUPS))]
    columns += [near(below(cues & 1), before) > 0, near(cues >> 5 & 1, before)]
    columns += [get("depth"), np.log1p(chars), linked / np.maximum(chars, 1), np.log1p(elements), np.log1p(chars / elements), marks / np.maximum(chars, 1), controls, np.log1p(paragraphs), np.log1p(items), own / np.maximum(chars, 1), index / siblings, np.log1p(siblings), chars / whole, np.log1p(chars[parent] / siblings)]
    columns += [speakers, speakers / elements, near(speakers, before), near(speakers, after), digits, np.log1p(near(chars, before)), np.log1p(near(chars, after)), chars / np.maximum(largest[parent], 1), np.sign(at - first_largest[parent]), ahead, headings, near(headings, before), near(controls, before), near(linked / np.maximum(chars, 1), after)]
    return np.stack(columns, axis=1).astype(np.float32)


class BoostedTrees:
    """Complete binary trees of one depth, as arrays: feature, threshold (inner nodes) and value (leaves)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS):
        cuts = [(f, c) for f, column in enumerate(x.T) for c in np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[:-1])) if c < column.max()]
        low = np.stack([x[:, f] <= c for f, c in cuts]).astype(float)  # a row for each cut
        self.depth, self.start = depth, float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        self.feature, self.threshold, self.value = np.zeros((trees, 2**depth - 1), np.int32), np.full((trees, 2**depth - 1), np.inf, np.float32), np.zeros((trees, 2**depth), np.float32)
        total, rows = np.full(len(y), self.start), np.arange(len(y))
        for t in range(trees):
            p = 1 / (1 + np.exp(-total))
            gradient, weight, node = np.round(2**20 * (y - p)) / 2**20, np.round(2**20 * p * (1 - p)) / 2**20, np.zeros(len(y), int)  # sums are exact
            for level in range(depth):
                first, many = 2**level - 1, 2**level
                held = np.zeros((len(y), 2 * many))
                held[rows, node - first], held[rows, many + node - first] = gradient, weight
                left, whole = low @ held, held.sum(axis=0)
                g, w, g_all, w_all = left[:, :many], left[:, many:], whole[:many], whole[many:]
                gain = g**2 / (w + 1) + (g_all - g) ** 2 / (w_all - w + 1) - g_all**2 / (w_all + 1)
                best = gain.argmax(axis=0)
                for k in np.flatnonzero(gain[best, np.arange(many)] > 1e-9):
                    self.feature[t, first + k], self.threshold[t, first + k] = cuts[best[k]]
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
            leaf = node - (2**depth - 1)
            self.value[t] = rate * np.bincount(leaf, gradient, 2**depth) / (np.bincount(leaf, weight, 2**depth) + 1)
            total = total + self.value[t, leaf]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - len(feature)]
        return out


def decoded(parent: list[int], log_odds: list[float]) -> list[bool]:
    """The elements to keep: largest total log-odds with every kept element below kept ones only.

    Element 0 (the page) is always kept; parents come before their children.
    """
    best = list(log_odds)
    for k in range(len(best) - 1, 0, -1):
        if best[k] > 0:
            best[parent[k]] += best[k]
    keep = [True] * len(best)
    for k in range(1, len(best)):
        keep[k] = keep[parent[k]] and best[k] > 0
    return keep


def main_texts(sources: list[str | None], model: BoostedTrees) -> list[str]:
    """The main text of each page."""
    pages = [Page(s or "") for s in sources]
    if not pages:
        return []
    odds, out, at = model.log_odds(features(pages)), [], 0
    for page in pages:
        out.append(page.kept_text(decoded(page.parent, odds[at : at + len(page.parent)].tolist())))
        at += len(page.parent)
    return out


@cache
def trained(pages: int = TRAINING_PAGES) -> BoostedTrees:
    """Trees fitted to generated pages, once in a process."""
    read, labels = labelled_pages(pages)
    return BoostedTrees(features(read), labels.astype(float))


def main_text(pages: DataFrame, html: str = "html", out: str = "text", model: BoostedTrees | None = None) -> DataFrame:
    """pages without their html, with their main text."""
    pages = pages.drop(out) if out != html else pages
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())
    names = [c for c in pages.columns if c != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, html):
                texts = main_texts(part.column(html).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(texts, pa.string())], [*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != html)
    return pages.mapInArrow(run, f"{schema}, `{out}` string")


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return main_text(rows).withColumn("n_chars", F.length("text").cast("long"))
