"""Plain statements of what the operators should say, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def contamination(text, items, width=13):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, body in items:
        w = WORD.findall((body or "").translate(LOWER))
        k = min(width, len(w))
        for window in {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else ():
            for i in range(len(words) - k + 1):
                if tuple(words[i : i + k]) == window:
                    hit |= set(range(i, i + k))
                    found.add(str(item))
    return len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(words)


def shingles(text, n):
    w = BLANK.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(rows, n, share):
    """[(n_shingles, component)] of [(key, text)]; links by exact Jaccard similarity."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and share[1] * len(sets[i] & sets[j]) >= share[0] * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        least[root(i)].append(k)
    best = {r: min((k for k in ks if k is not None), default=None) for r, ks in least.items()}
    return [(len(sets[i]), best[root(i)]) for i in range(len(rows))]


def repeats(texts, width=35):
    words = [BLANK.findall(t or "") for t in texts]
    count = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {k for i in range(len(w) - width + 1) if count[tuple(w[i : i + width])] > 1 for k in range(i, i + width)}
        out.append((len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def spans(text, pattern, group, least):
    return [m.span() for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
