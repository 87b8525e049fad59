"""Plain versions of the operators, for small tables."""

import hashlib
import re

import xxhash

WORD = re.compile(r"\w+")


def words(text):
    return WORD.findall((text or "").lower())


def shingles(text, width=5):
    w = words(text)
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def near_rows(rows, threshold=0.8):
    """[(doc_id, class_id, links)] of every row with an id, by comparing all pairs of rows."""
    rows = [r for r in rows if r[0] is not None]
    sets, links, up = [shingles(t) for _, t in rows], [0] * len(rows), list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
                links[a] += 1
                links[b] += 1
                up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(i, least.get(top(k), i))
    return [(i, least[top(k)], links[k]) for k, (i, _) in enumerate(rows)]


def near_duplicates(rows, threshold=0.8):
    """{doc_id: (class_id, links)} of rows with one text an id."""
    return {i: (group, links) for i, group, links in near_rows(rows, threshold)}


def contained(docs, items, threshold=0.8):
    """{(doc_id, item_id)} by comparing all pairs."""
    out = set()
    for i, t in docs:
        for j, s in items:
            w = len(words(s))
            need, have = shingles(s), shingles(t, min(5, w)) if w and len(words(t)) >= min(5, w) else frozenset()
            if need and len(need & have) >= threshold * len(need) - 1e-9:
                out.add((i, j))
    return out


def text_key(text):
    """Spark's xxhash64 of a string (42 for null)."""
    value = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def repeat_rows(rows, length=100):
    """Sorted (doc_id, n_bytes, n_removed, n_spans, sha256) of every row, by looking at every string in the order of ids,
    hashes of texts and starts; rows with a null id stand apart."""
    seen, found = set(), {}
    for i, t in sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], text_key(r[1]))) + [r for r in rows if r[0] is None]:
        data = (t or "").encode()
        mark = bytearray(len(data))
        for k in range(len(data) - length + 1) if i is not None else ():
            s = data[k : k + length]
            if s in seen:
                mark[k : k + length] = b"\1" * length
            seen.add(s)
        kept = bytes(x for x, gone in zip(data, mark, strict=True) if not gone)
        found[i, t] = (i, len(data), sum(mark), len([r for r in bytes(mark).split(b"\0") if r]), hashlib.sha256(kept).hexdigest())
    return sorted((found[r] for r in rows), key=str)


def repeats(rows, length=100):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)} of rows with one text an id."""
    return {r[0]: r[1:] for r in repeat_rows(rows, length)}
