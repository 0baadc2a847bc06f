"""BagMinHash: signatures whose registers agree with the probability of the weighted Jaccard similarity.

Every element of a bag stands for a Poisson process in time over the weight axis. The axis is discretised into the
levels [0, 1), [1, 2), [2, 4), ...; each level of an element has a process of its own, with a rate of the level's width and seeded by element and level
alone, and every point has a place on the axis and falls on a random register. A bag of weight w sees the points below w, and a
register keeps the earliest point it sees. Two bags agree on a register exactly when the earliest point of both together
lies below both weights, which has the probability sum of minima over sum of maxima. A process is left as soon as its time
passes the latest register, so a bag of n elements costs about n + m log m points, not n * m.
"""

from __future__ import annotations

import numpy as np

_A, _B, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, a bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def _level(h: np.ndarray, latest: np.ndarray, bag: np.ndarray, seed: np.ndarray, m: int, width: float, place=None) -> None:
    """Runs the processes of one level to their ends. A point's upper half is its time, its lower half its register; place(live, point) says which points lie below
    the weight, where not all do."""
    bags, t, base = len(latest), np.zeros(len(bag)), bag * m
    own, turn, due = np.arange(len(bag) if place else 0), 0, 1
    low, regs = np.uint64(0xFFFFFFFF), np.uint64(m)
    with np.errstate(over="ignore"):
        while len(bag):
            turn += 1
            seed = seed + _G
            r = mix(seed)
            step = np.log(((r >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32)
            t = t - (step if width == 1 else step / width)
            live = np.flatnonzero(t < latest[bag])
            if len(live) < 0.9 * len(bag) or not len(live):  # later points than the latest register change nothing
                bag, seed, t, r, base = bag[live], seed[live], t[live], r[live], base[live]
                own = own[live] if place else own
            at = base + ((r & low) * regs >> np.uint64(32)).astype(np.int64)
            if place is None:
                np.minimum.at(h, at, t)
            else:
                ok = place(own, r)
                np.minimum.at(h, at[ok], t[ok])
            if turn >= due:  # else latest stays too late, which costs points, not truth
                due = turn + 1 + turn // 8 + 2 * (turn > 2)
                np.max(h.reshape(bags, m), axis=1, out=latest)


def signatures(bag: np.ndarray, element: np.ndarray, weight: np.ndarray, bags: int, m: int) -> np.ndarray:
    """Registers (bags x m). bag: number of the bag of each element; element: its 64-bit hash; weight: positive.
    A bag without elements has infinite registers."""
    h, latest = np.full(bags * m, np.inf), np.full(bags, np.inf)
    bag, weight = bag.astype(np.int64), weight.astype(np.float64)
    level, low, width = 0, 0.0, 1.0
    keep = np.flatnonzero(weight > 0)
    while len(keep):
        seed, w = mix(element[keep] + np.uint64((level + 1) * int(_G) % 2**64)), weight[keep]
        part = w < low + width  # the weight lies inside this level
        if part.any():
            share = (w - low) / width
            within = lambda own, r: ~part[own] | (mix(r + _A).astype(np.float64) * 2.0**-64 < share[own])  # noqa: B023, E731
            _level(h, latest, bag[keep], seed, m, width, within)
        else:
            _level(h, latest, bag[keep], seed, m, width)
        low, width, level = low + width, low + width, level + 1
        keep = keep[w > low]
    return h.reshape(bags, m)


def bands(sig: np.ndarray, rows: int, salt: int = 0) -> np.ndarray:
    """One 64-bit hash (as int64) for each bag and band of `rows` registers; the band's number is hashed in."""
    n, m = sig.shape
    b = m // rows
    v = sig[:, : b * rows].reshape(n, b, rows).view(np.uint64)
    with np.errstate(over="ignore"):
        acc = np.broadcast_to(mix((np.arange(b, dtype=np.uint64) + np.uint64(salt * 100_003 + 1)) * _G), (n, b)).copy()
        for k in range(rows):
            acc = mix(acc + v[:, :, k] * _A + _G)
    return acc.view(np.int64)
