"""The E8 lattice: nearest points, and the points next to them."""

from __future__ import annotations

import itertools

import numpy as np


def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [[(s if k == i else t if k == j else 0) for k in range(8)] for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    half = [[x / 2 for x in signs] for signs in itertools.product((1, -1), repeat=8) if signs.count(-1) % 2 == 0]
    return np.array(whole + half)


NEIGHBOURS = _neighbours()


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(axis=1)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    at = worst[odd]
    near[odd, at] += np.where(off[odd, at] >= 0, 1, -1)
    return near


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest lattice point of each row of eight numbers."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def cells(x: np.ndarray, probes: int) -> np.ndarray:
    """(rows, 1 + probes, 8): the nearest point and those of its neighbours that come next."""
    home = nearest(x)
    reach = (x - home) @ NEIGHBOURS.T
    best = np.argpartition(-reach, probes - 1, axis=1)[:, :probes] if probes else np.empty((len(x), 0), int)
    return np.concatenate([home[:, None], home[:, None] + NEIGHBOURS[best]], axis=1)
