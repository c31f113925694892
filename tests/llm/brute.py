"""Plain Python versions of the operators, for small inputs."""

import re
from collections import Counter, defaultdict

SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())


def line_key(line):
    return line.strip(SPACES).translate(LOWER)


def dedup_lines(rows):
    """(id, kept text, number of lines, dropped) of (id, text) rows."""
    owners, held = {}, defaultdict(set)
    for ident, text in rows:
        for line in (text or "").split("\n"):
            key = line_key(line)
            if ident is not None and len(key) >= 10:
                owners[key] = min(owners.get(key, ident), ident)
                held[key].add(ident)
    out = []
    for ident, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if ident is None or len(held[line_key(x)]) < 2 or owners[line_key(x)] == ident]
        out.append((ident, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def remove_repeats(texts, size):
    """Kept bytes and removed runs of each text."""
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - size + 1):
            if counts[d[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        runs = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((bytes(c for c, g in zip(d, gone) if not g), runs))
    return out


def components(nodes, links):
    lowest = {n: n for n in nodes}

    def find(x):
        while lowest[x] != x:
            x = lowest[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        lowest[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def near_documents(rows):
    """{id: (number of shingles, component)} of (id, text) rows with unique ids."""
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    found = components(ids, links)
    return {i: (len(sets[i]), found[i]) for i in ids}


def padding(histogram, bounds):
    return sum(n * (min(b for b in bounds if b >= length) - length) for length, n in histogram.items())
