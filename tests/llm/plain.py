"""Plain Python versions of the text operators, for comparison on small inputs."""
from __future__ import annotations

import re

import xxhash


def components_of(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, distance=3):
    """prints: id -> fingerprint. id -> smallest id reachable over links."""
    first = {}
    for i in sorted(prints):
        first.setdefault(prints[i], i)
    values = sorted(first)
    pairs = [(first[a], first[b]) for k, a in enumerate(values) for b in values[:k] if (a ^ b).bit_count() <= distance]
    found = components_of(pairs, sorted(first.values()))
    return {i: found[first[p]] for i, p in prints.items()}
