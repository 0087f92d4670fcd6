"""Plain versions of the corpus operators, for small inputs."""

import hashlib
import re
from collections import Counter

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def near(rows):
    """(id, set size, least id reachable) of each (id, text)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def repeats(rows, span=400):
    """(id, bytes, removed, spans, sha256 of what is left) of each (id, text)."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i : i + span] for _, t in texts for i in range(len(t) - span + 1))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                gone[i : i + span] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        left = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


LETTERS = {c: f"[{c}{c.upper()}]" for c in "abcdefghijklmnopqrstuvwxyz"}
NAMES = "|".join("".join(LETTERS.get(c, c) for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
BASE = [
    ("assign", re.compile(rf"""(?:{NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 6),
    ("access", re.compile("(AKIA[A-Z0-9]+)"), 20),
    ("hex", re.compile("([0-9a-f]+)"), 24),
]


def secrets(text):
    """(counts per base kind, sha256 of the base spans)."""
    spans = [[(m.start(), i, m.end()) for m in p.finditer(text or "") if len(m[1]) >= least] for i, (_, p, least) in enumerate(BASE)]
    joined = ",".join(f"{BASE[i][0]}:{a}:{b}" for a, i, b in sorted(sum(spans, [])))
    return [len(s) for s in spans], hashlib.sha256(joined.encode()).hexdigest()


def top(rows, k=5):
    """(query, rank, id, score) for queries whose id is divisible by 50; rows are (id, integers)."""
    out = []
    for q, x in rows:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q and len(x) == len(y))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def held_share(item, text, k=5):
    """The largest weighted share of an item's shingles found around any one place of a text: every place is tried."""
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.translate(LOWER))
    grams = lambda w: {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}
    own, here = words(item), words(text)
    n, weight = len(own), {g: sum(len(x.encode()) for x in g) for g in grams(own)}
    best = 0.0
    for begin in range(-n, len(here)):
        near = here[max(0, begin - n // 4) : max(0, begin + n + n // 4)]
        if near:
            best = max(best, sum(w for g, w in weight.items() if g in grams(near)) / sum(weight.values()))
    return best
