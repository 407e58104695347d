"""Plain versions of the two dedup stages."""
import re
from itertools import combinations

import xxhash


def exact_keep(rows):
    seen = {}
    for i, t in rows:
        seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return sorted(min(v) for v in seen.values())


def simhash(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = [0] * 64
    for i in range(n):
        h = xxhash.xxh64_intdigest(b" ".join(words[i:i + width]), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if ones[b] * 2 > n)


def near_keep(rows, radius=4):
    fps, root = [simhash(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= radius:
            root[find(i)] = find(j)
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), doc_id), doc_id)
    return sorted(best.values())
