"""Plain versions of the operators' results, over lists of rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(docs, width=13):
    words = [(d, WORDS.findall(t or "")) for d, t in docs]
    first = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - width + 1):
                key = tuple(w[i : i + width])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if d is not None and first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out, key=str)


def maximal_repeats(docs, width):
    """(words, occurrences, first document, word there) of sequences of several documents that no way of going on shares."""
    found = {}
    for d, t in docs:
        w = WORDS.findall(t or "")
        for i in range(len(w)):
            for j in range(i + width, len(w) + 1):
                found.setdefault(tuple(w[i:j]), []).append((d, i, w[i - 1] if i else None, w[j] if j < len(w) else None))
    several = lambda x: len(set(x)) > 1 or None in x
    return sorted((len(k), len(o), *min(o)[:2]) for k, o in found.items() if len({x[0] for x in o}) > 1 and several([x[2] for x in o]) and several([x[3] for x in o]))


def decontaminate(docs, items, width=10):
    windows = {}
    for i, t in items:
        w = ALNUM.findall(lower(t))
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w = ALNUM.findall(lower(t))
        hit, found = [False] * len(w), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (of := windows.get(tuple(w[k : k + n]))) is not None:
                    hit[k : k + n] = [True] * n
                    found |= of
        out.append((d, len(w), sum(hit), len(found), sha(",".join(sorted(found)))))
    return sorted(out, key=str)


def shingles(text, width=5):
    w = ALNUM.findall(lower(text))
    return Counter(tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))) if w else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / max(sum(a.values()) + sum(b.values()) - both, 1)


def near_classes(docs, threshold=0.8):
    bags = {d: shingles(t) for d, t in docs}
    root = {d: d for d in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(bags)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bags[a] and bags[b] and similarity(bags[a], bags[b]) >= threshold:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((d, find(d)) for d in bags)


def base_scores(docs):
    tokens = {d: [*WORDS.findall(lower(t)), None] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    count = Counter()
    for d, w in tokens.items():
        if not held[d]:
            count.update(w)
    n, v = sum(count.values()), len(count)
    return {d: (held[d], len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)) for d, w in tokens.items()}
