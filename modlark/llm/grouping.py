"""A grouping genetic algorithm for bins of one capacity: what an island computes.

A solution is a list of bins, a bin a list of item numbers.  Crossover copies
a parent, injects whole well-filled bins of the other, and takes out the bins
that hold an injected item twice; a mutation takes out the emptiest bins and a
few others.  Displaced items first change places with one or two items of a
bin that they fill better, and what is displaced then goes by best fit.
Solutions with fewer, then with more unevenly filled bins are fitter.
"""

from __future__ import annotations

import bisect
import random

import numpy as np

Bins = list[list[int]]
#: One bin in so many is emptied by a mutation: the emptiest ones, and some at random.
EMPTIEST, ANY = 50, 100


def best_fit(items: list[int], size: list[int], capacity: int, bins: Bins, left: list[int]) -> None:
    """Put ``items``, in their order, into the fullest bins that take them;
    ``left`` has what each of ``bins`` can still take."""
    open_bins = sorted((room, b) for b, room in enumerate(left) if room)
    for item in items:
        at = bisect.bisect_left(open_bins, (size[item], -1))
        if at < len(open_bins):
            room, b = open_bins.pop(at)
            bins[b].append(item)
        else:
            room, b = capacity, len(bins)
            bins.append([item])
            left.append(capacity)
        left[b] = room - size[item]
        if left[b]:
            bisect.insort(open_bins, (left[b], b))


def exchange(displaced: list[int], size: list[int], bins: Bins, left: list[int]) -> list[int]:
    """Once for each bin with room, put a displaced item in the place of one or
    two items there, where that fills the bin best; returns what is displaced now."""
    free = sorted((size[item], item) for item in displaced)
    for b, one in enumerate(bins):
        room = left[b]
        if not room or not free:
            continue
        gain, swap = 0, None
        for x in range(len(one)):
            for y in range(x, len(one)):
                out = size[one[x]] + (size[one[y]] if y > x else 0)
                at = bisect.bisect_left(free, (out + room + 1, -1)) - 1
                if at >= 0 and free[at][0] - out > gain:
                    gain, swap = free[at][0] - out, (x, y, at)
        if swap:
            x, y, at = swap
            _, item = free.pop(at)
            for k in {x, y}:
                bisect.insort(free, (size[one[k]], one[k]))
            bins[b] = [i for k, i in enumerate(one) if k not in (x, y)] + [item]
            left[b] -= gain
    return [item for _, item in free]


def _fill(one: list[int], size: list[int]) -> int:
    return sum(map(size.__getitem__, one))


def fitness(bins: Bins, size: list[int], capacity: int) -> tuple[int, float]:
    """Higher is better: fewer bins, then the mean squared fill."""
    return -len(bins), sum((_fill(b, size) / capacity) ** 2 for b in bins) / max(1, len(bins))


def least_bins(size: list[int], capacity: int) -> int:
    """A number of bins that no solution can go below.

    For every border a: items above capacity - a share their bin with none of
    size a or more, those above half with no other of these; what room the
    latter leave, items between a and half can use."""
    s = np.sort(np.asarray(size, np.int64))
    if not len(s):
        return 0
    total = np.concatenate([[0], np.cumsum(s)])
    half = np.searchsorted(s, capacity // 2, side="right")
    border = np.unique(np.append(s[:half], 0))
    alone, low = np.searchsorted(s, capacity - border, side="right"), np.searchsorted(s, border, side="left")
    room = (alone - half) * capacity - (total[alone] - total[half])
    rest = np.maximum(total[half] - total[low] - room, 0)
    most = int(np.searchsorted(total, capacity, side="right")) - 1
    return int(max(-(-total[-1] // capacity), -(-len(s) // max(1, most)), (len(s) - half + -(-rest // capacity)).max()))


def crossover(a: Bins, b: Bins, size: list[int], capacity: int, rng: random.Random, share: float = 0.3) -> Bins:
    full = sorted(b, key=lambda x: -_fill(x, size))[: max(1, len(b) // 2)]
    injected = rng.sample(full, max(1, int(len(full) * share)))
    placed = {item for one in injected for item in one}
    bins, displaced = [list(one) for one in injected], []
    for one in a:
        if placed.isdisjoint(one):
            bins.append(list(one))
        else:
            displaced += [item for item in one if item not in placed]
    left = [capacity - _fill(one, size) for one in bins]
    emptied = set(sorted(range(len(bins)), key=lambda k: -left[k])[: 1 + len(bins) // EMPTIEST]) | set(rng.sample(range(len(bins)), len(bins) // ANY))
    displaced += [item for k in emptied for item in bins[k]]
    stay = [k for k in range(len(bins)) if k not in emptied]
    bins, left = [bins[k] for k in stay], [left[k] for k in stay]
    displaced = exchange(displaced, size, bins, left)
    displaced.sort(key=lambda item: (-size[item], item))
    best_fit(displaced, size, capacity, bins, left)
    return bins


def founders(size: list[int], capacity: int, n: int, rng: random.Random) -> list[Bins]:
    """Best fit decreasing, and best fit in more and more disturbed orders."""
    out = []
    for k in range(n):
        noise = 0.15 * k * capacity
        order = sorted(range(len(size)), key=lambda i: (-(size[i] + (rng.uniform(-noise, noise) if k else 0)), i))
        bins: Bins = []
        best_fit(order, size, capacity, bins, [])
        out.append(bins)
    return out


def evolve(population: list[Bins], size: list[int], capacity: int, generations: int, rng: random.Random) -> list[Bins]:
    """The population after some generations, fittest first.  It ends early
    where no solution can have fewer bins."""
    least = least_bins(size, capacity)
    ranked = sorted(((fitness(bins, size, capacity), bins) for bins in population), key=lambda x: x[0], reverse=True)
    for _ in range(generations):
        if len(ranked[0][1]) <= least:
            break
        a, b = rng.sample(range(len(ranked)), 2) if len(ranked) > 1 else (0, 0)
        child = crossover(ranked[a][1], ranked[b][1], size, capacity, rng, rng.choice((0.1, 0.3, 0.5)))
        rank = fitness(child, size, capacity)
        if rank > ranked[-1][0] and all(rank != other for other, _ in ranked):
            ranked[-1] = (rank, child)
            ranked.sort(key=lambda x: x[0], reverse=True)
    return [bins for _, bins in ranked]
