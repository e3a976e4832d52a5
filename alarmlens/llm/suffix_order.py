"""Suffix sorting by grouping, in linear steps and without recursive renaming."""
from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start places of the suffixes of ``text`` (non-negative integers) in order; an ended suffix is the smaller one.

    First phase: suffixes stand in groups by their first symbol. Groups are taken from the highest down. Each member
    points at its previous smaller suffix, the nearest place to the left in a lower group, found by following the pointers
    of the members in between. The places pointed at have their Lyndon prefix extended by this group's, so they leave
    their group and form a new one right above it; those pointed at more often stand higher. At the end, groups
    hold the suffixes with one Lyndon prefix.

    Second phase: from the lowest suffix up, the place to the left and its chain of previous smaller
    suffixes are next in order within their groups and are emitted there.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    order = np.argsort(text, kind="stable")
    symbols = text[order]
    first = np.concatenate(([True], symbols[1:] != symbols[:-1]))
    starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    group_of = np.empty(n, np.int64)
    group_of[order] = starts
    placed: list[int] = order.tolist()  # suffix at each place of the grouped order
    place: list[int] = rank.tolist()
    group: list[int] = group_of.tolist()  # first place of a suffix's group
    sizes = [0] * (n + 1)
    edges = np.flatnonzero(first)
    for start, size in zip(edges.tolist(), np.diff(np.append(edges, n)).tolist()):
        sizes[start] = size
    previous = [-1] * n

    end = n
    while end > 0:
        start = group[placed[end - 1]]
        if end - start == 1:  # one suffix points at one place: the same steps without tables
            i = placed[start]
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = previous[j]
            previous[i] = j
            end = start
            if j >= 0 and sizes[group[j]] > 1:
                old = group[j]
                sizes[old] -= 1
                last = old + sizes[old]
                at, other = place[j], placed[last]
                placed[at], placed[last] = other, j
                place[other], place[j] = at, last
                sizes[last] = 1
                group[j] = last
            continue
        pointed: dict[int, int] = {}
        for i in sorted(placed[start:end]):
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        end = start
        if not pointed:
            continue
        by_count: dict[int, list[int]] = {}
        for j, count in pointed.items():
            by_count.setdefault(count, []).append(j)
        for count in sorted(by_count, reverse=True):
            moved: dict[int, list[int]] = {}
            for j in by_count[count]:
                moved.setdefault(group[j], []).append(j)
            for old, members in moved.items():
                if len(members) == sizes[old]:
                    continue  # the whole group has the longer prefix and stays where it is
                last = old + sizes[old] - 1
                for j in members:
                    at, other = place[j], placed[last]
                    placed[at], placed[last] = other, j
                    place[other], place[j] = at, last
                    last -= 1
                sizes[old] -= len(members)
                new = last + 1
                sizes[new] = len(members)
                for j in members:
                    group[j] = new

    result = [-1] * n
    filled = sizes  # reused: next free place of each group, relative to its first
    for start in range(n):
        filled[start] = 0
    done = [False] * n

    def emit(j: int) -> None:
        while j >= 0 and not done[j]:
            start = group[j]
            result[start + filled[start]] = j
            filled[start] += 1
            done[j] = True
            j = previous[j]

    emit(n - 1)
    for i in range(n):
        emit(result[i] - 1)
    return np.array(result, np.int64)
