"""Plain Python versions of the operators, for small tables."""

import re
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def shingle_set(text, width=5):
    w = words(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def near_duplicates(rows, up=75, down=100):
    """{key: (n_shingles, component)} by comparing all pairs that share a shingle."""
    sets = {k: shingle_set(t) for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    holders = {}
    for k, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(k)
    seen = {p for ks in holders.values() for p in combinations(sorted(set(ks)), 2)}
    for a, b in seen:
        shared = len(sets[a] & sets[b])
        if down * shared >= up * (len(sets[a]) + len(sets[b]) - shared):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}
