"""Plain Python that the operators are held against."""

import random
import re
import string

WORDS = ["".join(random.Random(i).choices(string.ascii_lowercase, k=2 + i % 6)) for i in range(400)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


SPACE = r"[\x20\x09-\x0D]+"


def split(text):
    return [w for w in re.split(SPACE, text or "") if w]


def shingle_set(text):
    w = split(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if s and t and i is not None and j is not None and 100 * len(s & t) >= 90 * len(s | t):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in parent}
