"""The operators' contracts, restated plainly in Python over lists of rows."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def without_repeats(sequences, length):
    """(places, removed, runs, kept) of each sequence."""
    seen = Counter(s[i : i + length] for s in sequences for i in range(len(s) - length + 1))
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - length + 1):
            if seen[s[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        yield len(s), sum(gone), runs, [x for x, g in zip(s, gone, strict=True) if not g]


def substrings(texts):
    for n, removed, _, kept in without_repeats([tuple(SPACED.findall(t or "")) for t in texts], 35):
        yield n, removed, hashlib.sha256(" ".join(kept).encode()).hexdigest()


def byte_strings(texts):
    for n, removed, runs, kept in without_repeats([(t or "").encode() for t in texts], 200):
        yield n, removed, runs, hashlib.sha256(bytes(kept)).hexdigest()


def contamination(texts, items):
    windows = defaultdict(set)
    for item, text in items:
        words = LETTERED.findall(lower(text or ""))
        n = min(10, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[i : i + n])].add(str(item))
    for text in texts:
        words = LETTERED.findall(lower(text or ""))
        hit, found = set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                held = windows.get(tuple(words[i : i + n]))
                if held:
                    found |= held
                    hit |= set(range(i, i + n))
        yield len(words), len(hit), sorted(found)


def quality_counts(text):
    words = SPACED.findall(text or "")
    lines = [line for line in (text or "").split("\n") if SPACED.search(line)]
    threes = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {j for i in range(len(words) - 2) if threes[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    counts = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)
    return (*counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0])


def bag(text):
    words = LETTERED.findall(lower(text or ""))
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else Counter({("", text or ""): 1})


def near_duplicate_classes(rows):
    """The least id and the least row number of each row's class, by all pairs."""
    bags = [bag(text) for _, text in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        common = sum((bags[i] & bags[j]).values())
        if common and common >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - common) - 1e-9:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        known = least.get(root(i))
        least[root(i)] = doc if known is None or (doc is not None and doc < known) else known
    return [(least[root(i)], root(i)) for i in range(len(rows))]


def components(edges):
    least = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def without_frequent_lines(rows):
    """For each (text, host): its text without the lines that too many texts of the host hold, and whether enough is left."""

    def key(line):
        return " ".join(lower(w) for w in SPACED.findall(line))

    texts = defaultdict(set)
    for text, host in rows:
        texts[host].add(text)
    frequent = {}
    for host, held in texts.items():
        counts = Counter(k for t in held for k in {key(x) for x in (t or "").split("\n")} if k)
        frequent[host] = {k for k, n in counts.items() if n >= 5 and (n > 50 or 2 * n > len(held))}
    out = []
    for text, host in rows:
        left = [x for x in (text or "").split("\n") if key(x) not in frequent[host]]
        words = len(SPACED.findall(text or ""))
        out.append(("\n".join(left), sum(len(SPACED.findall(x)) for x in left) >= 0.3 * words))
    return out
