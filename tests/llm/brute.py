"""The operators again, one text after the other, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

SPACE_RUN = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = SPACE_RUN.findall(text)
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def near_duplicates(rows, k, top, bottom):
    """{row number: (shingles, component, kept)} for rows of (doc_id, text)."""
    sets = [shingles(t, k) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        if rows[i][0] is not None:
            for g in s:
                holders[g].append(i)
    common = Counter(p for h in holders.values() for p in ((a, b) for j, a in enumerate(h) for b in h[:j]))
    links = [
        (rows[a][0], rows[b][0])
        for (a, b), c in common.items()
        if bottom * c >= top * (len(sets[a]) + len(sets[b]) - c)
    ]
    group = roots(links, {i for i, _ in rows if i is not None})
    out = []
    for (i, _), s in zip(rows, sets, strict=True):
        own = None if i is None else group[i] if s else i
        out.append((i, len(s), own, i is None or own == i))
    return out


def repeats(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(t) else 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((doc, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def token_ids(library, text, end_id=1):
    return [*library.encode(text or "", add_special_tokens=False).ids, end_id]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def secret_spans(text, rules):
    found = []
    for order, (kind, pattern, group, least) in enumerate(rules):
        for m in re.finditer(pattern, text or ""):
            if len(m[group]) >= least:
                found.append((m.start(), order, m.end(), kind))
    return sorted(found)


def smith_waterman(a, b, match, mismatch, gap):
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (match if x == y else mismatch), above[j + 1] + gap, row[j] + gap))
        best, above = max(best, *row), row
    return best
