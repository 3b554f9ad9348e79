"""Suffix array by linear grouping construction (Baier 2016), on integer symbols.

Phase 1 refines groups of suffixes that share a Lyndon prefix. Groups are visited from the greatest to
the smallest; every suffix of a group points to the nearest earlier suffix of a smaller group (its
previous-smaller pointer), and pointed-to suffixes leave their group for a new, greater one right after
it, ordered by how many pointers they got. Phase 2 walks the pointers once and emits the final order.
Nothing is renamed or recursed into. The work is linear in the number of symbols.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``symbols``; a shorter suffix sorts before its own extensions.

    Any integers (ties, negatives and an empty array included) are accepted.
    """
    s = np.asarray(symbols)
    if len(s) == 0:
        return np.zeros(0, np.int64)
    n = len(s) + 1
    order = np.empty(n, np.int64)
    order[0] = n - 1  # the implied end, smaller than all symbols
    order[1:] = np.argsort(s, kind="stable")
    ranked = s[order[1:]]
    start = np.empty(n, np.int64)
    start[:2] = 0, 1
    start[2:] = np.where(ranked[1:] != ranked[:-1], np.arange(2, n), 0)
    start = np.maximum.accumulate(start)
    group = np.empty(n, np.int64)
    group[order] = start
    ends = np.zeros(n, np.int64)
    last = np.flatnonzero(np.append(start[1:] != start[:-1], True))
    ends[start[last]] = last + 1
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return np.array(_emit(*_groups(order.tolist(), group.tolist(), ends.tolist(), place.tolist())), np.int64)[1:]


def _groups(order: list, group: list, ends: list, place: list) -> tuple[list, list]:
    """Phase 1: each suffix's final group, named by its first place, and its previous-smaller pointer."""
    n = len(order)
    prev = [-1] * n
    top = n
    while top > 0:
        first = group[order[top - 1]]
        if top - first == 1:
            i = order[first]
            j = i - 1
            while j >= 0 and group[j] >= first:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                g = group[j]
                end = ends[g] - 1
                if end > g:  # else it is alone there already
                    p, other = place[j], order[end]
                    order[p], order[end] = other, j
                    place[other], place[j] = p, end
                    ends[g] = end
                    group[j] = end
                    ends[end] = end + 1
        else:
            counts: dict = {}
            for i in sorted(order[first:top]):
                j = i - 1
                while j >= 0 and group[j] >= first:
                    j = prev[j]
                prev[i] = j
                if j >= 0:
                    counts[j] = counts.get(j, 0) + 1
            if counts:
                by_count: dict = {}
                for j, c in counts.items():
                    by_count.setdefault(c, []).append(j)
                for c in sorted(by_count, reverse=True):
                    moved = by_count[c]
                    took: dict = {}
                    for j in moved:
                        g = group[j]
                        end = ends[g] - took.get(g, 0) - 1
                        took[g] = ends[g] - end
                        p, other = place[j], order[end]
                        order[p], order[end] = other, j
                        place[other], place[j] = p, end
                    for g, k in took.items():
                        end = ends[g]
                        begin = end - k
                        if begin > g:
                            ends[g] = begin
                            ends[begin] = end
                            for q in range(begin, end):
                                group[order[q]] = begin
        top = first
    return group, prev


def _emit(group: list, prev: list) -> list:
    """Phase 2: the order within each group follows from the suffixes already emitted."""
    n = len(group)
    free = list(range(n))
    placed = bytearray(n)
    out = [0] * n
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = prev[j]
    return out
