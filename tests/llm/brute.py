"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import collections
import re
from hashlib import sha256

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = (1 << 63) - 1


def order(doc_id):
    return LAST if doc_id is None else doc_id


def cut(raw: bytes, spans) -> tuple:
    gone = bytearray(len(raw))
    for a, b in spans:
        gone[a:b] = b"\1" * (min(b, len(raw)) - a)
    kept = bytes(c for c, g in zip(raw, gone) if not g)
    runs = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
    return len(raw), sum(gone), runs, sha256(kept).hexdigest()


def suffix(rows, length=50):
    docs = [(order(d), (t or "").encode()) for d, t in rows]
    least = {}
    for d, b in docs:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            least[w] = min(least.get(w, d), d)
    return [cut(b, [(i, i + length) for i in range(len(b) - length + 1) if least[b[i : i + length]] < d]) for d, b in docs]


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) >= 5:
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return frozenset({tuple(words)}) if words else frozenset()


def groups(rows):
    """For each row the least place of its group of linked rows."""
    sets = [shingles(t) for _, t in rows]
    by_gram = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by_gram[g].append(i)
    shared = collections.Counter((a, b) for at in by_gram.values() for k, b in enumerate(at) for a in at[:k])
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    return components(range(len(rows)), links)


def jaccard_groups(rows):
    """For each row n_shingles and component_id."""
    root, sets = groups(rows), [shingles(t) for _, t in rows]
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root[i]].append(d)
    return [(len(s), (min(ids[root[i]], default=None) if s else rows[i][0])) for i, s in enumerate(sets)]


def line_spans(text: str):
    """start, end, bytes of each line."""
    raw, at = (text or "").encode(), 0
    for line in raw.split(b"\n"):
        yield at, at + len(line), line
        at += len(line) + 1


def fuzzy_lines(rows, k, similarity):
    """For each row n_bytes, n_removed, n_spans, kept digest."""
    return [cut((t or "").encode(), spans) for (_, t), spans in zip(rows, line_cuts(rows, k, similarity))]


def line_cuts(rows, k, similarity):
    """For each row the spans of its repeated lines. Lines of k characters or more are sets of
    shingles, shorter ones their own shingle; blank ones are left alone."""
    places = [(order(d), s, e, line, i) for i, (d, t) in enumerate(rows) for s, e, line in line_spans(t) if line.strip(b" \t\n\v\f\r")]
    different = sorted({p[3] for p in places})
    grams = {x: {c[i : i + k] for i in range(len(c) - k + 1)} or {c} for x in different for c in [x.decode()]}
    links = [(a, b) for i, a in enumerate(different) for b in different[:i] if len(grams[a] & grams[b]) >= similarity * len(grams[a] | grams[b])]
    root = components(different, links)
    first = {}
    for d, s, _, line, _ in places:
        r = root[line]
        first[r] = min(first.get(r, (d, s)), (d, s))
    spans = collections.defaultdict(list)
    for d, s, e, line, i in places:
        if (d, s) > first[root[line]]:
            spans[i].append((s, e + 1))
    return [spans[i] for i in range(len(rows))]


def gear_chunks(raw: bytes, values, reach, longest):
    h, v = 0, []
    for c in raw:
        h = ((h << 1) + int(values[c])) & 0xFFFFFFFF
        v.append(h)
    v = [0 if i + 1 < len(raw) and raw[i + 1] & 0xC0 == 0x80 else x for i, x in enumerate(v)]
    ends = [i + 1 for i, x in enumerate(v) if i == len(v) - 1 or (x > max([0, *v[max(0, i - reach) : i]]) and x >= max(v[i + 1 : i + 1 + reach], default=0))]
    out, at = [], 0
    for e in ends:
        cuts = list(range(at + longest, e, longest))
        for c in cuts:
            while raw[c] & 0xC0 == 0x80:
                c -= 1
            out.append((at, c))
            at = c
        out.append((at, e))
        at = e
    return out


def substring(rows, values, reach, longest):
    docs = [(order(d), (t or "").encode()) for d, t in rows]
    parts = [gear_chunks(b, values, reach, longest) for _, b in docs]
    first = {}
    for (d, b), cs in zip(docs, parts):
        for s, e in cs:
            first[b[s:e]] = min(first.get(b[s:e], (d, s)), (d, s))
    return [cut(b, [(s, e) for s, e in cs if (d, s) > first[b[s:e]]]) for (d, b), cs in zip(docs, parts)]
