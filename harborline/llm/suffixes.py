"""Suffix arrays by induced sorting, and common prefixes in text order, with array operations."""

from __future__ import annotations

import numpy as np

from harborline.llm.shingles import mixed, powers

def hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which ``span_hash`` gives the hash of any span in constant time."""
    up, down = powers(len(text) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:-1])]), down


def span_hash(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((sums[0][end] - sums[0][start]) * sums[1][start] + (end - start).astype(np.uint64))


def classify(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are smaller than the next one, and the leftmost of each run of those (without the first suffix)."""
    n = len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])
    at = differs[np.searchsorted(differs, np.arange(n - 1))]  # the last two differ: the end mark is unique
    smaller = np.concatenate([text[at] < text[at + 1], [True]])
    leftmost = np.concatenate([[False], smaller[1:] & ~smaller[:-1]])
    return smaller, leftmost


def _ranks(symbols: np.ndarray) -> tuple[np.ndarray, ...]:
    """A stable order by symbol, the symbols in it, each one's rank among its equals, and distinct symbols with counts."""
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    counts = np.diff(np.append(first, len(ranked)))
    return order, ranked, np.arange(len(ranked)) - np.repeat(first, counts), ranked[first], counts


def induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, sigma: int) -> np.ndarray:
    """The order of all suffixes from that of the leftmost-smaller ones (``seeds``, in order).

    Scanning the buckets upwards puts every larger suffix behind those already in its bucket; scanning downwards does the
    same for the smaller suffixes from the end. A step scans as many buckets as it can without putting a suffix into one of
    them; a bucket that receives suffixes from itself is scanned alone, in runs. Steps work on arrays, whatever the
    size of the alphabet.
    """
    starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
    order = np.full(len(text), -1, np.int64)
    by, symbols, rank, used, counts = _ranks(text[seeds])
    seeded = starts[symbols.astype(np.int64) + 1] - np.repeat(counts, counts) + rank
    order[seeded] = seeds[by]

    head = starts[:-1].copy()

    def put_up(entries: np.ndarray) -> None:
        by, symbols, rank, used, counts = _ranks(text[entries])
        order[head[symbols] + rank] = entries[by]
        head[used] += counts

    def larger_before(entries: np.ndarray) -> np.ndarray:
        before = entries[entries > 0] - 1
        return before[~smaller[before]]

    c, room = 0, 1024
    while c < sigma:
        d = min(sigma, max(c + 1, int(np.searchsorted(starts, starts[c] + room, "right")) - 1))
        entries = order[starts[c] : starts[d]]
        before = larger_before(entries[entries >= 0])
        if not len(before):
            c = d
            continue
        e = min(d, int(text[before].min()))
        if e > c:
            if e < d:
                before = before[text[before + 1] < e]
                room = max(256, int(starts[e] - starts[c]) * 2)
            else:
                room = min(1 << 16, room * 2)
            if len(before):
                put_up(before)
            c = e
            continue
        low = int(starts[c])
        while low < head[c]:
            high = int(head[c])
            before = larger_before(order[low:high])
            if len(before):
                put_up(before)
            low = high
        entries = order[low : starts[c + 1]]
        before = larger_before(entries[entries >= 0])
        if len(before):
            put_up(before)
        c += 1

    order[seeded] = -1
    tail = starts[1:].copy()
    tail[text[-1]] -= 1
    order[tail[text[-1]]] = len(text) - 1

    def put_down(entries: np.ndarray) -> None:
        by, symbols, rank, used, counts = _ranks(text[entries])
        order[tail[symbols] - 1 - rank] = entries[by]
        tail[used] -= counts

    def smaller_before(entries: np.ndarray) -> np.ndarray:
        before = entries[entries > 0] - 1
        return before[smaller[before]]

    c, room = sigma, 1024
    while c > 0:
        d = max(0, min(c - 1, int(np.searchsorted(starts, starts[c] - room, "left"))))
        entries = order[starts[d] : starts[c]][::-1]
        before = smaller_before(entries[entries >= 0])
        if not len(before):
            c = d
            continue
        e = max(d, int(text[before].max()) + 1)
        if e < c:
            if e > d:
                before = before[text[before + 1] >= e]
                room = max(256, int(starts[c] - starts[e]) * 2)
            else:
                room = min(1 << 16, room * 2)
            if len(before):
                put_down(before)
            c = e
            continue
        high = int(starts[c])
        while high > tail[c - 1]:
            low = int(tail[c - 1])
            before = smaller_before(order[low:high][::-1])
            if len(before):
                put_down(before)
            high = low
        entries = order[starts[c - 1] : high][::-1]
        before = smaller_before(entries[entries >= 0])
        if len(before):
            put_down(before)
        c -= 1
    return order


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """Order of all suffixes. ``text`` holds numbers below ``sigma`` and ends with 0, which is nowhere else."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    text = text.astype(np.uint16 if sigma <= 1 << 16 else np.int64)
    smaller, leftmost = classify(text)
    at = np.flatnonzero(leftmost)
    order = induce(text, smaller, at, sigma)
    order = order[leftmost[order]]
    if len(order) > 1:
        # Leftmost-smaller substrings now stand in order; equal ones get equal names.
        end = np.append(at[1:], n - 1) + 1
        names_of = span_hash(hashes(text), at, np.minimum(end, n))
        size = end - at
        slot = np.searchsorted(at, order)
        new = (names_of[slot[1:]] != names_of[slot[:-1]]) | (size[slot[1:]] != size[slot[:-1]])
        names = np.concatenate([[0], np.cumsum(new)])
        if names[-1] + 1 < len(order):
            reduced = np.empty(len(at), np.int64)
            reduced[slot] = names
            order = at[suffix_array(reduced, int(names[-1]) + 1)]
    return induce(text, smaller, order, sigma)


def common_prefixes(text: np.ndarray, order: np.ndarray, least: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """In text order, the suffix before each one in sorted order, and the length of their common prefix.

    Permuted to text order the lengths need no inverse array. Lengths below ``least`` are given as 0, which takes one
    comparison of span hashes; longer ones are found up to ``limit`` by halving steps.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    sums, out = hashes(text), np.zeros(n, np.int64)
    here = np.flatnonzero(before >= 0)
    here = here[np.maximum(here, before[here]) + least <= n]
    there = before[here]
    same = span_hash(sums, here, here + least) == span_hash(sums, there, there + least)
    here, there = here[same], there[same]
    length, step = np.full(len(here), least), 1 << max(0, (limit - least).bit_length() - 1)
    while step and limit > least:
        fits = np.flatnonzero((length + step <= limit) & (np.maximum(here, there) + length + step <= n))
        a, b = here[fits] + length[fits], there[fits] + length[fits]
        longer = span_hash(sums, a, a + step) == span_hash(sums, b, b + step)
        length[fits[longer]] += step
        step >>= 1
    out[here] = length
    return before, out


def repeated_starts(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Per text the starts of its strings of ``size`` bytes that start anywhere else in these texts."""
    if not texts:
        return []
    joined = np.frombuffer(b"\0".join(texts) + b"\0\0", np.uint8).astype(np.int64) + 2
    lengths = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    joined[starts + lengths] = 1
    joined[-1] = 0
    order = suffix_array(joined, 258)
    before, prefix = common_prefixes(joined, order, size, size)
    whole = np.zeros(len(joined), bool)
    for start, length in zip(starts, lengths):
        whole[start : start + max(0, length - size + 1)] = True
    hit = (prefix >= size) & whole
    hit[before[np.flatnonzero(hit)]] = True
    return [np.flatnonzero(hit[start : start + max(0, length - size + 1)]) for start, length in zip(starts, lengths)]
