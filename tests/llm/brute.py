"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import collections
import fractions
import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6 and m[1].isascii()]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def repeats(texts, length=200):
    bodies = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i:i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def shingles(text, width=4):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(words[i:i + width]) for i in range(len(words) - width + 1)] or ([tuple(words)] if words else []))


def components(rows, width=4, percent=85):
    """Set size and component id per row (id, text), by comparing all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = root(i)
        if doc_id is not None and (r not in least or doc_id < least[r]):
            least[r] = doc_id
    return [(len(s), least.get(root(i)) if s else rows[i][0]) for i, s in enumerate(sets)]


def distance(a, b, most=None):
    """Edit distance; with ``most``, cells further from the diagonal count as one more than that."""
    far = len(a) + len(b) if most is None else most + 1
    row = {j: j for j in range(min(len(b), far) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - far), min(len(b), i + far) + 1):
            new[j] = i if j == 0 else min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (x != b[j - 1]))
        row = new
    return row.get(len(b), far)


def line_states(docs, edits, least, allowed=None):
    """States of the lines of documents (id, text), in document order; ``allowed`` gives the edits by the shorter line's length."""
    most = allowed or (lambda n: edits)
    first = {}
    for doc_id, text in docs:
        for place, line in enumerate((text or "").split("\n")):
            if WORD.search(line):
                first.setdefault(line, (doc_id, place))
    near = set()
    long = sorted((line for line in first if len(line) >= least), key=len)
    letters = [collections.Counter(line) for line in long]
    for i, a in enumerate(long):
        for j in range(i - 1, -1, -1):
            b = long[j]
            t = most(len(b))
            if len(a) - len(b) > max(t, len(a) // 10 + 2):
                break
            # An edit changes the counts of two letters at most.
            apart = sum(((letters[i] - letters[j]) + (letters[j] - letters[i])).values())
            if len(a) - len(b) <= t and apart <= 2 * t and distance(a, b, t) <= t:
                near.add(max(a, b, key=lambda x: first[x]))
    return {doc_id: [(p, "exact" if first[x] != (doc_id, p) else "near" if x in near else "first")
                     for p, x in enumerate((text or "").split("\n")) if WORD.search(x)] for doc_id, text in docs}


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen, covered = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def runs(words):
    """Runs (start, length, period) of at least 24 words and three periods."""
    out = []
    for q in range(1, len(words) // 3 + 1):
        i = q
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            stretch = words[start:j]
            if length >= max(24, 3 * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                out.append((start, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(doc_id, text):
    """A row of the query on periodic runs: counts, the best run and both digests."""
    words, h = [w.decode() for w in (text or "").encode().split()], zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-fractions.Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    return (doc_id, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{length},{q}\n" for s, length, q in found)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def hard_negatives(rows, every, k=5, low=80, high=100):
    """Rows of (vec_id, label, whole numbers): (anchor, positive, rank, negative, positive score, negative score), by scores of all pairs."""
    out = []
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for i, (anchor, label, v) in enumerate(rows):
        if anchor is None or anchor % every:
            continue
        scores = [(sum(a * b for a, b in zip(v, w)), j, other) for n, (j, other, w) in enumerate(rows) if n != i]
        for score, positive, _ in sorted((s for s in scores if s[2] == label), key=order)[:k]:
            fits = sorted((s for s in scores if s[2] != label and low * score <= 100 * s[0] <= high * score), key=order)[:k]
            out += [(anchor, positive, rank, s[1], score, s[0]) for rank, s in enumerate(fits, 1)]
    return out


def fewest_bins(sizes, capacity):
    """The least number of bins, by trying all ways."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for b in {x: n for n, x in enumerate(bins) if x + sizes[i] <= capacity}.values():
            put(i + 1, [*bins[:b], bins[b] + sizes[i], *bins[b + 1:]])
        put(i + 1, [*bins, sizes[i]])

    put(0, [])
    return best


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
