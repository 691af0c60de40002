"""Karmarkar-Karp multiway differencing over partial partitions."""

from __future__ import annotations

import heapq

import numpy as np


def difference(parts: np.ndarray) -> np.ndarray:
    """Combine partial partitions into one; the final slot of every slot of every part.

    ``parts`` has a row for each partial partition and a column for each of its slots, holding the sum
    put there so far (a single item: its size, then zeros). Again and again the two with the largest
    spread are combined, the one's largest slots with the other's smallest. Ties go by age, so equal
    input gives equal output. Row i of the result maps the slots of part i to final slots."""
    n, k = parts.shape
    final = np.empty((n, k), np.int64)
    if not n:
        return final
    order = np.argsort(-parts, axis=1, kind="stable")
    sums = list(np.take_along_axis(parts, order, axis=1))
    heap = [(int(s[-1] - s[0]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    joined: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = sums[a] + sums[b][::-1]
        o = np.argsort(-total, kind="stable")
        total = total[o]
        sums[a] = sums[b] = None
        heapq.heappush(heap, (int(total[-1] - total[0]), len(sums)))
        sums.append(total)
        joined.append((a, b, o))
    place: dict[int, np.ndarray] = {len(sums) - 1: np.arange(k)}
    for made in range(len(joined) - 1, -1, -1):
        a, b, o = joined[made]
        at = place.pop(n + made)
        place[a], place[b] = np.empty(k, np.int64), np.empty(k, np.int64)
        place[a][o] = at
        place[b][k - 1 - o] = at
        for x in (a, b):
            if x < n:
                final[x, order[x]] = place.pop(x)
    if n == 1:
        final[0, order[0]] = place[0]
    return final


def items(sizes: np.ndarray, k: int) -> np.ndarray:
    """The slot of each single item among k."""
    parts = np.zeros((len(sizes), k), np.int64)
    parts[:, 0] = sizes
    return difference(parts)[:, 0]
