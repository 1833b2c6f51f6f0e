"""Suffix arrays by linear grouping (Baier's construction), and common prefixes of neighbours."""

from __future__ import annotations

from collections import defaultdict

import numpy as np


def ascending(x: list[int]) -> list[int]:
    """x in order: by two stable passes of 16 bits each, which count and don't compare; few numbers are compared."""
    if len(x) < 64:
        return sorted(x)
    a = np.array(x, np.uint32)
    for shift in (0, 16):
        a = a[np.argsort((a >> np.uint32(shift)).astype(np.uint16), kind="stable")]
    return a.tolist()


def suffix_array(text: list[int]) -> list[int]:
    """Order of the suffixes of text (symbols below 2^32), whose last symbol must be its only least one.

    Groups: suffixes start in a group for each first symbol. Groups are processed in descending order. A member points to the
    nearest position to its left that lies in a lower group (previous smaller); the positions pointed to are split
    off their groups, those with most pointers first, each into a group right above the old one. In the end a group holds the
    suffixes with one longest Lyndon prefix, and the pointers lead to the previous smaller suffix.

    Order: read from the least suffix up, a suffix at s places s - 1 and what its pointers lead to, each at the next
    free place of its group, until a suffix that has its place. Nothing is renamed and no recursion is needed.
    """
    n = len(text)
    # Symbols of 16 bits are ordered by counting, larger ones by comparing. Positions ascend in a group.
    order = np.argsort(np.array(text, np.uint16 if max(text) < 1 << 16 else np.uint32), kind="stable").tolist()
    place = [0] * n
    start = [0] * n  # of the group of a position; names the group
    size = [0] * n  # of the group that starts here
    first = 0
    for i, p in enumerate(order):
        if text[p] != text[order[first]]:
            first = i
        place[p], start[p] = i, first
        size[first] += 1
    previous = [-1] * n
    end = n
    while end > 0:
        low = start[order[end - 1]]
        pointers: dict[int, int] = defaultdict(int)
        for i in ascending(order[low:end]):
            p = i - 1
            while p >= 0 and start[p] >= low:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                pointers[p] += 1
        end = low
        if not pointers:
            continue
        split: dict[tuple[int, int], list[int]] = defaultdict(list)
        for p, k in pointers.items():
            split[-k, start[p]].append(p)
        for key in sorted(split):  # most pointers first
            members, old = split[key], key[1]
            count = size[old]
            if count == len(members):
                continue  # the whole group moves: it stays what it is
            top = old + count - 1
            new = top - len(members) + 1
            for p in members:
                q, at = order[top], place[p]
                order[at], place[q] = q, at
                order[top], place[p] = p, top
                top -= 1
            for p in members:
                start[p] = new
            size[old], size[new] = count - len(members), len(members)
    out = [0] * n
    free = list(range(n))  # next place of the group that starts here
    placed = [False] * n
    out[0], placed[n - 1] = n - 1, True
    free[start[n - 1]] += 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = start[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = True
            s = previous[s]
    return out


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """For each place in the order, the common prefix with the suffix before it (0 at the first)."""
    n = len(text)
    before = [-1] * n
    for i in range(1, n):
        before[order[i]] = order[i - 1]
    at = [0] * n
    k = 0
    for i in range(n):
        j = before[i]
        if j < 0:
            k = 0
            continue
        most = n - max(i, j)
        while k < most and text[i + k] == text[j + k]:
            k += 1
        at[i] = k
        if k:
            k -= 1
    return [at[s] for s in order]
