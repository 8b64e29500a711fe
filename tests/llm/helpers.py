"""Plain versions of the operators' definitions, for comparison."""

import re
from collections import Counter

LOW = str.maketrans({c: c.lower() for c in map(chr, range(65, 91))})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def shingles(text, width=5):
    w = words(text)
    if len(w) >= width:
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    return frozenset([tuple(w)] if w else [])


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_components(texts, percent=85):
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return components(ids, edges)


def held_items(text, items, percent=80):
    """Items of five words or more that some window of their size holds."""
    w, out = [x.lower() for x in WORD.findall(text or "")], set()
    for item_id, item in items.items():
        v = [x.lower() for x in WORD.findall(item or "")]
        own = Counter(tuple(v[i : i + 5]) for i in range(len(v) - 4))
        for start in range(max(1, len(w) - len(v) + 1)):
            window = w[start : start + len(v)]
            here = Counter(tuple(window[i : i + 5]) for i in range(len(window) - 4))
            both = sum((own & here).values())
            if own and here and 100 * both >= percent * sum((own | here).values()):
                out.add(item_id)
                break
    return out


def prose(draw, n, vocabulary=400):
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))
