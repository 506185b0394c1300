"""Exact tail of a sum of ranks that are each taken with chance one half.

The distribution of n ranks has about n * n / 2 values, too many to list for large n. Its tail is
a Fourier sum instead, over the transform of the tilted distribution: weights exp(theta * value) move its mean
to the value asked for, so a tail far below double precision keeps its relative accuracy. The period of the sum
is so wide that what wraps around is below 1e-18 (Bernstein's bound). Most frequencies contribute nothing: the
transform's size is at most exp(S(t) - S(0)) with S(t) = sum of v * cos(rank * t), v the variance of taking a rank, and S comes from one
FFT of the ranks' histogram; between its points S moves by at most degree * S(0) * distance. What is left is
halved further, each block bounded by slope and curvature, and only frequencies not ruled out are summed.
"""

from __future__ import annotations

import math

import numpy as np

#: Up to so many ranks the distribution is built by folding in one rank after the other.
FOLD = 300
#: Log of what is left out at either end.
NOTHING = math.log(2e18)
#: Cosines worked out at once.
CELLS = 1 << 20
#: Blocks of fewer frequencies are summed without a further bound.
NARROW = 4


def folded_tail(ranks: np.ndarray, counts: np.ndarray, w: int) -> float:
    """P(sum <= w), the ranks folded in one by one: n * n values in memory."""
    prob = np.ones(1)
    for step in np.repeat(ranks, counts):
        grown = np.zeros(len(prob) + step)
        grown[:len(prob)] += prob / 2
        grown[step:] += prob / 2
        prob = grown
    return float(prob[:w + 1].sum())


def _tilt(ranks: np.ndarray, counts: np.ndarray, w: float) -> float:
    """theta <= 0 that makes w the mean; the mean falls with theta, so halving finds it."""

    def mean(theta: float) -> float:
        return float((counts * ranks / (1 + np.exp(np.minimum(-theta * ranks, 700.0)))).sum())

    low, high = -1.0 / float(ranks.max()), 0.0
    while mean(low) > w:
        low *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if mean(mid) > w else (mid, high)
    return high


def fourier_tail(ranks: np.ndarray, counts: np.ndarray, w: int) -> float:
    """P(sum <= w) for w up to half of the greatest sum: memory in proportion to the greatest rank."""
    g = int(np.gcd.reduce(ranks))
    ranks, w = (ranks // g).astype(np.int64), w // g
    n = int(counts.sum())
    if w < int(ranks.min()):
        return math.exp(-n * math.log(2))
    r, c = ranks.astype(np.float64), counts.astype(np.float64)
    theta = _tilt(r, c, w)
    # log of the tilted total, and the chance to take each rank under the tilt
    scale = float((c * np.log1p(np.exp(theta * r))).sum()) - n * math.log(2) - theta * w
    if scale < -745:
        return 0.0
    p = np.exp(theta * r) / (1 + np.exp(theta * r))
    v = c * p * (1 - p)
    top, var = int(ranks.max()), float((v * r * r).sum())
    far = top * NOTHING / 3
    half = math.ceil(far + math.sqrt(far * far + 2 * var * NOTHING)) + 1
    period = 2 * half
    # which frequencies may matter: j of 0..half, t = 2 pi j / period
    grid = 8 << max(top - 1, 1).bit_length()
    spectrum = np.fft.rfft(np.bincount(ranks, weights=v, minlength=grid)).real
    total = float(v.sum())
    near = total - spectrum - total * top * math.pi / grid <= NOTHING + math.log(period)
    at = np.flatnonzero(near)
    # each point of the grid stands for the frequencies nearest to it; blocks of them are halved while the bound allows them
    first = np.ceil((at - 0.5) * period / grid).astype(np.int64).clip(0)
    last = np.ceil((at + 0.5) * period / grid).astype(np.int64).clip(max=half + 1) - 1
    moment = v * r
    square = float((moment * r).sum())
    limit = NOTHING + math.log(period)

    def angles(j: np.ndarray):
        """Parts of j and rank * t for them, from exact integers modulo the period; so many that they stay in memory."""
        for part in np.array_split(j, max(1, -(-len(j) * len(r) // CELLS))):
            yield part, 2 * math.pi * ((part[:, None] * ranks[None, :]) % period) / period

    while len(first) and (last - first).max() >= NARROW:
        use = last - first >= NARROW
        lo, hi = first[use], last[use]
        mid = (lo + hi) // 2
        reach = 2 * math.pi * np.maximum(hi - mid, mid - lo) / period
        fall = np.concatenate([np.stack([(v * (1 - np.cos(x))).sum(1), np.abs((moment * np.sin(x)).sum(1))], 1) for _, x in angles(mid)])
        open_ = fall[:, 0] - fall[:, 1] * reach - square * reach * reach / 2 <= limit
        lo, mid, hi = lo[open_], mid[open_], hi[open_]
        first, last = np.concatenate([first[~use], lo, mid + 1]), np.concatenate([last[~use], mid, hi])
    sum_ = 0.0
    many = np.maximum(last - first + 1, 0)
    j = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    for part, x in angles(j) if len(j) else ():
        with np.errstate(divide="ignore"):
            size = 0.5 * (c * np.log1p(np.maximum(-2 * (p * (1 - p)) * (1 - np.cos(x)), -1.0))).sum(1)
        turn = (c * np.arctan2(p * np.sin(x), 1 - p + p * np.cos(x))).sum(1) - 2 * math.pi * ((part * w) % period) / period
        z = np.exp(theta + 2j * math.pi * part / period)
        steps = np.where(z == 1, half + 1.0, (1 - z ** (half + 1)) / np.where(z == 1, 2, 1 - z))
        weight = np.where((part == 0) | (part == half), 1.0, 2.0)
        sum_ += float((weight * np.exp(size) * (np.exp(1j * turn) * steps).real).sum())
    return math.exp(scale) * max(sum_, 0.0) / period


def two_sided(ranks: np.ndarray, counts: np.ndarray, w: int) -> float:
    """Twice the smaller tail of the sum w, w included, at most 1. The distribution is symmetric."""
    ranks, counts = np.asarray(ranks, np.int64), np.asarray(counts, np.int64)
    w = min(w, int((ranks * counts).sum()) - w)
    tail = folded_tail if int(counts.sum()) <= FOLD else fourier_tail
    return min(1.0, 2 * tail(ranks, counts, w))
