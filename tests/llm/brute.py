"""Plain Python versions of the operators' definitions, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict


def fold(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def components(ids, links) -> dict:
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_duplicates(docs: list[tuple[int, str | None]], k: int, percent: int = 80):
    sets = {}
    for d, t in docs:
        w = words(fold(t or ""))
        sets[d] = {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    c = components(ids, links)
    return {d: (len(sets[d]), c[d], c[d] == d) for d in ids}


def repeats(rows: list, width: int) -> list[set[int]]:
    """For each symbol sequence, the places covered by a window that also starts elsewhere."""
    seen = Counter(tuple(r[i:i + width]) for r in rows for i in range(len(r) - width + 1))
    return [{j for i in range(len(r) - width + 1) if seen[tuple(r[i:i + width])] > 1 for j in range(i, i + width)} for r in rows]


def runs(places: set[int]) -> int:
    return sum(p - 1 not in places for p in places)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def contamination(docs, items, width: int = 10):
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", fold(t or ""))
    phrases = defaultdict(set)
    for item, t in items:
        w = split(t)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            phrases[tuple(w[i:i + width])].add(str(item))
    out = []
    for _, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(p) for p in phrases}:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i:i + n])) in phrases:
                    hit |= set(range(i, i + n))
                    found |= phrases[p]
        out.append((len(w), hit, sorted(found)))
    return out


def exponent(shares: list[float], entropy: float, repeats_at_most: float, budget_share: float = 1.0) -> float:
    def weights(a):
        q = [p ** a for p in shares]
        return [x / sum(q) for x in q]

    def flat(a):
        return -sum(w * math.log(w) for w in weights(a)) >= entropy * math.log(len(shares))

    def rare(a):
        return max(w / p for w, p in zip(weights(a), shares, strict=True)) * budget_share <= repeats_at_most

    low, high = 0.0, 1.0
    if flat(1.0):
        low = 1.0
    else:
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if flat(mid) else (low, mid)
    if rare(low):
        return low
    high = 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if rare(mid) else (mid, high)
    return high
