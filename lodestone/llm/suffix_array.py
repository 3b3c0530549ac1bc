"""Suffix arrays of many small texts at once, by linear grouping construction (no recursion, no renaming).

Phase 1 keeps the suffixes grouped by their Lyndon prefix so far. The not yet processed positions of a text form a linked
list in which each position's prefix reaches to the next one, so that the left neighbour of a suffix is its previous smaller
one. Groups are taken in descending order: every run of k members is joined to the prefix of the position left of it, which
moves to the rear of its own group, in order of k. Phase 2 goes through the suffixes in ascending order and puts each one
whose prefix ends there next in its group.

All texts advance in lock step, so that numpy works on one group of each text at a time; the steps taken are as many as the
longest text has groups.
"""

from __future__ import annotations

import numpy as np


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + size), one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def group_suffixes(symbols: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 1. Text i is symbols[base[i]:base[i + 1]] and ends in its only smallest symbol.

    Returns positions in order of their groups, each position's group (its first slot) and where its Lyndon prefix ends.
    """
    n, texts = len(symbols), len(base) - 1
    owner = np.repeat(np.arange(texts), np.diff(base))
    key = owner * (int(symbols.max()) + 1) + symbols
    order = np.argsort(key, kind="stable")
    slot = np.empty(n, np.int64)
    slot[order] = np.arange(n)
    ranked = key[order]
    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    sizes = np.diff(np.r_[starts, n])
    group = np.empty(n, np.int64)
    group[order] = np.repeat(starts, sizes)
    held = np.zeros(n + 1, np.int64)  # members of the group that starts in a slot
    held[starts] = sizes
    left, right = np.arange(-1, n), np.arange(1, n + 2)
    left[base[:-1]] = -1
    right[base[1:] - 1] = n
    ends = np.empty(n, np.int64)
    joined = np.zeros(n, bool)
    top, low = base[1:].copy(), base[:-1]
    while True:
        open_ = np.flatnonzero(top > low)
        if not len(open_):
            return order, group, ends
        stop = top[open_]
        start = group[order[stop - 1]]
        top[open_] = start
        if len(open_) == int((stop - start).sum()):
            first = last = order[start]
            times = np.ones(len(first), np.int64)
            ends[first] = right[first]
        else:
            members = np.sort(order[spread(start, stop - start)])
            after = right[members]
            ends[members] = after
            new = np.r_[True, after[:-1] != members[1:]]
            at = np.flatnonzero(new)
            first, times = members[at], np.diff(np.r_[at, len(members)])
            last = members[at + times - 1]
        smaller, after = left[first], right[last]
        left[after] = smaller
        there = smaller >= 0
        smaller, times = smaller[there], times[there]
        right[smaller] = after[there]
        if not len(smaller):
            continue
        own = group[smaller]
        by = np.lexsort((times, own))
        moved, own, times = smaller[by], own[by], times[by]
        new = np.r_[True, own[1:] != own[:-1]]
        at = np.flatnonzero(new)
        groups, counts = own[at], np.diff(np.r_[at, len(own)])
        tails = groups + held[groups] - counts
        to = spread(tails, counts)
        was = slot[moved]
        joined[moved] = True
        there_now = order[to]
        aside = there_now[~joined[there_now]]
        free = was[was < np.repeat(tails, counts)]
        order[free], slot[aside] = aside, free
        order[to], slot[moved] = moved, to
        joined[moved] = False
        held[groups] -= counts
        new |= np.r_[True, times[1:] != times[:-1]]
        at = np.flatnonzero(new)
        counts = np.diff(np.r_[at, len(own)])
        held[to[at]] = counts
        group[moved] = np.repeat(to[at], counts)


def suffix_arrays(symbols: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Positions in suffix order: those of text i in slots base[i] to base[i + 1]."""
    order, group, ends = group_suffixes(symbols, base)
    n = len(symbols)
    by_end = np.argsort(ends, kind="stable")
    first = np.searchsorted(ends[by_end], np.arange(n + 1))
    sizes = np.diff(first)
    out = np.full(n, -1, np.int64)
    out[base[:-1]] = base[1:] - 1
    next_free = np.arange(n)
    lengths = np.diff(base)
    for i in range(int(lengths.max(initial=0))):
        at = out[base[:-1][lengths > i] + i]
        count = sizes[at]
        at, count = at[count > 0], count[count > 0]
        if len(at):
            children = by_end[spread(first[at], count)]
            groups = group[children]
            out[next_free[groups]] = children
            next_free[groups] += 1
    return out


def repeated_starts(buckets: list[list[bytes]], width: int) -> list[list[np.ndarray]]:
    """For each string of each bucket, where in it a ``width``-byte string starts that also starts elsewhere in its bucket."""
    if not buckets:
        return []
    out: list[list[np.ndarray]] = [[] for _ in buckets]
    order = sorted(range(len(buckets)), key=lambda i: sum(map(len, buckets[i])) + len(buckets[i]))
    at = 0
    while at < len(order):
        take, total, longest = [], 0, 0
        while at < len(order):
            size = sum(map(len, buckets[order[at]])) + len(buckets[order[at]])
            if take and (total + size > 600_000):
                break
            take.append(order[at])
            total, longest, at = total + size, size, at + 1
        _repeated([buckets[i] for i in take], width, [out[i] for i in take])
    return out


def _repeated(buckets: list[list[bytes]], width: int, out: list[list[np.ndarray]]) -> None:
    sizes = np.array([len(x) + 1 for b in buckets for x in b])
    counts = np.array([len(b) for b in buckets])
    text = np.frombuffer(b"".join(x + b"\0" for b in buckets for x in b), np.uint8)
    stops = np.cumsum(sizes)
    symbols = text.astype(np.int64) + int(counts.max())
    symbols[stops - 1] = spread(np.zeros(len(counts), np.int64), counts)
    symbols[stops - 1] = np.repeat(counts, counts) - 1 - symbols[stops - 1]  # no two ends are equal and a bucket's last one is smallest
    base = np.r_[0, stops[np.cumsum(counts) - 1]]
    order = suffix_arrays(symbols, base)
    room = np.repeat(stops - 1, sizes) - np.arange(len(text)) >= width
    ok = room[order[:-1]] & room[order[1:]]
    ok[base[1:-1] - 1] = False
    pairs = np.flatnonzero(ok)
    marked = np.zeros(len(text), bool)
    if len(pairs):
        windows = np.lib.stride_tricks.sliding_window_view(text, width)
        for k in range(0, len(pairs), 20_000):
            a, b = order[pairs[k : k + 20_000]], order[pairs[k : k + 20_000] + 1]
            near = (text[a] == text[b]) & (text[a + width - 1] == text[b + width - 1]) & (text[a + width // 2] == text[b + width // 2])
            a, b = a[near], b[near]
            same = (windows[a] == windows[b]).all(axis=1)
            marked[a[same]] = True
            marked[b[same]] = True
    found = np.flatnonzero(marked)
    cuts = np.searchsorted(found, np.r_[0, stops])
    i = 0
    for bucket, to in zip(buckets, out, strict=True):
        for _ in bucket:
            to.append(found[cuts[i] : cuts[i + 1]] - (stops[i] - sizes[i]))
            i += 1
