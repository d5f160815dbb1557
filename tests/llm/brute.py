"""Plain statements of what the operators must give."""

import re
from collections import Counter


def words(text, lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def shingles(text, size):
    w = words(text, lower=True)
    if len(w) >= size:
        return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    return frozenset([tuple(w)] if w else [])


def jaccard_links(rows, size, num, den):
    """(sets, links) of rows (id, text) with ids."""
    sets = {i: shingles(t, size) for i, t in rows if i is not None}
    at = {}
    for i in sets:
        for g in sets[i]:
            at.setdefault(g, []).append(i)
    links = set()
    for i in sets:
        for j, n in Counter(j for g in sets[i] for j in at[g] if j > i).items():
            if den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                links.add((i, j))
    return sets, links


def components(ids, links):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def repeats(rows, window):
    """id -> (words, kept words); ids are distinct or null."""
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            if i is not None:
                g = tuple(w[k : k + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), [x for k, x in enumerate(w) if k not in gone]))
    return out
