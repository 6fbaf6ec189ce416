"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections import Counter, defaultdict

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def equal_texts(rows, keep=max):
    groups = defaultdict(list)
    for i, text in rows:
        groups[(text or "").translate(LOWER)].append(i)
    best = {k: keep([i for i in v if i is not None], default=None) for k, v in groups.items()}
    out = []
    seen = set()
    for i, text in rows:
        k = (text or "").translate(LOWER)
        first = (i, k) not in seen
        seen.add((i, k))
        out.append((i, best[k], len(groups[k]), i == best[k] and first, sha(k.encode())))
    return out


def similar(rows, n=5, t=0.8):
    """{id: (class, links)} for rows with distinct ids."""
    sets = []
    for i, text in rows:
        w = words(text)
        sets.append((i, {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()))
    parent, links = {i: i for i, _ in sets}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, r in sets[:a]:
            common = len(s & r)
            if common and common >= t * (len(s) + len(r) - common) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i, _ in sets}


def contamination(rows, items, window=13):
    windows = defaultdict(set)
    for i, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[k : k + window])].add(str(i))
    out = []
    for d, text in rows:
        w = words(text)
        hit, found = [False] * len(w), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    found |= windows[tuple(w[k : k + size])]
                    hit[k : k + size] = [True] * size
        n = sum(hit)
        out.append((d, len(w), n, len(found), sha(",".join(sorted(found)).encode()), n > 0 and 20 * n >= len(w)))
    return out


def repeats(rows, length=400):
    count = Counter()
    bodies = [(d, (t or "").encode()) for d, t in rows]
    for _, b in bodies:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, b in bodies:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((d, len(b), sum(gone), runs, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return out


def longest_match(run: bytes, pieces: set[bytes]) -> int:
    """Greedy longest-match pieces of a run; 1 if it can't be spelled."""
    longest = max(map(len, pieces), default=0)
    i = n = 0
    while i < len(run):
        for j in range(min(len(run), i + longest), i, -1):
            if run[i:j] in pieces:
                break
        else:
            return 1
        i, n = j, n + 1
    return n


def smallest_capacity(sizes: list[int], shards: int) -> int:
    def fits(c):
        n, held = 1, 0
        for s in sizes:
            if s > c:
                return False
            if held + s > c:
                n, held = n + 1, 0
            held += s
        return n <= shards

    lo, hi = 0, sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    return lo


def toxicity_features(text: str, odds, insults, second, near: int) -> list[float]:
    """The 16 features of one text; ``odds`` gives a lower-case word's log-odds, or 0."""
    data = text.encode()
    spans = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", data)]
    own = [data[a:b] for a, b in spans]
    low = [w.decode().translate(LOWER) for w in own]
    n, size = max(1, len(low)), max(1, len(data))
    found = [odds(w) for w in low]
    bad = [o > 0 or w in insults for o, w in zip(found, low, strict=True)]
    close = [any(low[j] in second for j in range(max(0, i - near), min(len(low), i + near + 1))) for i in range(len(low))]
    both = sum(b and c for b, c in zip(bad, close, strict=True))
    letter = [bytes([c]).isalpha() or c >= 128 for c in data]
    sign = [not (bytes([c]).isalnum() or c >= 128) and c > 32 for c in data]
    masked = sum(sign[i] and letter[i - 1] and letter[i + 1] for i in range(1, len(data) - 1))
    three = sum(letter[i] and data[i] == data[i - 1] == data[i - 2] for i in range(2, len(data)))
    mixed = sum(0 < sum(bytes([c]).isdigit() for c in w) < len(w) for w in own)
    shout = sum(len(w) >= 2 and all(65 <= c <= 90 for c in w) for w in own)
    hits = sum(o > 0 for o in found)
    return [
        math.log1p(hits), hits / n, max(found, default=0), sum(found) / n, len({w for w, b in zip(low, bad, strict=True) if b}), sum(w in insults for w in low) / n,
        math.log1p(both), both / max(1, sum(bad)), sum(w in second for w in low) / n, sum(65 <= c <= 90 for c in data) / size, shout / n, data.count(b"!") / size,
        sum(sign) / size, mixed / n + masked / n, three / size, math.log1p(len(low)),
    ]
