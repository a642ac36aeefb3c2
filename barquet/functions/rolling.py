"""Order statistics of the last values of a series, and a window that forgets by itself."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque

import numpy as np


def conformal_rank(n: int, alpha: float) -> int:
    """Which of ``n`` scores in order is the conformal quantile, from 1; beyond n it is infinite."""
    return math.ceil((n + 1) * (1 - alpha) - 1e-9)


class RankTree:
    """A Fenwick tree of counts over ranks: adding, removing and finding the k-th take a logarithm of steps."""

    def __init__(self, size: int) -> None:
        self.counts, self.top = [0] * (size + 1), 1 << max(0, size.bit_length() - 1)

    def add(self, rank: int, by: int) -> None:
        at, counts = rank + 1, self.counts
        while at < len(counts):
            counts[at] += by
            at += at & -at

    def kth(self, k: int) -> int:
        """The rank of the k-th value, k from 1."""
        at, step, counts = 0, self.top, self.counts
        while step:
            if at + step < len(counts) and counts[at + step] < k:
                at += step
                k -= counts[at]
            step >>= 1
        return at


def rolling_conformal(scores: np.ndarray, n: int, alpha: float) -> np.ndarray:
    """For each place the conformal quantile of the scores at the ``n`` places before it; a score that is nan counts for none."""
    known = ~np.isnan(scores)
    order = np.sort(scores[known])
    ranks = np.full(len(scores), -1)
    ranks[known] = np.argsort(np.argsort(scores[known], kind="stable"), kind="stable")  # ties apart, so that each can be taken out
    tree, held, out = RankTree(len(order)), 0, np.full(len(scores), np.inf)
    for i, rank in enumerate(ranks.tolist()):
        k = conformal_rank(held, alpha)
        if 1 <= k <= held:
            out[i] = order[tree.kth(k)]
        if rank >= 0:
            tree.add(rank, 1)
            held += 1
        if i >= n and ranks[i - n] >= 0:
            tree.add(int(ranks[i - n]), -1)
            held -= 1
    return out


class LastScores:
    """The last ``most`` scores, also in order of size."""

    def __init__(self, most: int, scores: list[float] = ()) -> None:
        self.most, self.ring, self.order = most, deque(scores), sorted(scores)

    def push(self, score: float) -> None:
        self.ring.append(score)
        insort(self.order, score)
        if len(self.ring) > self.most:
            del self.order[bisect_left(self.order, self.ring.popleft())]

    def conformal(self, alpha: float) -> float:
        k = conformal_rank(len(self.order), alpha)
        return self.order[k - 1] if 1 <= k <= len(self.order) else math.inf


class AdwinHistogram:
    """A window of recent values that drops its older part when the means of two parts differ too much.

    Values are kept as an exponential histogram: buckets of 1, 2, 4, ... values, at most ``each`` of a size,
    oldest first, each with sum, least and greatest value. A window of n values takes about each * log2(n / each)
    buckets, and cuts are tried between buckets. With ``each`` above the window's size, every cut is tried.
    Beyond ``most`` values the oldest bucket goes.
    """

    def __init__(self, delta: float = 0.002, most: int = 2048, least: int = 16, each: int = 5, buckets: list[tuple[int, float, float, float]] = ()) -> None:
        self.delta, self.most, self.least, self.each = delta, most, least, each
        self.buckets = [tuple(b) for b in buckets]  # (values, sum, least, greatest)

    def __len__(self) -> int:
        return sum(b[0] for b in self.buckets)

    def push(self, x: float) -> bool:
        own = self.buckets
        own.append((1, x, x, x))
        size, end = 1, len(own)
        while True:  # two of the oldest of a size become one of the next
            first = end
            while first and own[first - 1][0] == size:
                first -= 1
            if end - first <= self.each:
                break
            (n, s, lo, hi), (m, t, low, high) = own[first : first + 2]
            own[first : first + 2] = [(n + m, s + t, min(lo, low), max(hi, high))]
            size, end = 2 * size, first + 1
        n = len(self)
        while n > self.most:
            n -= own.pop(0)[0]
        return self._cut(n)

    def _cut(self, n: int) -> bool:
        if n < 2 * self.least:
            return False
        spread = max(b[3] for b in self.buckets) - min(b[2] for b in self.buckets)
        total, term = sum(b[1] for b in self.buckets), math.log(4 * n / self.delta) / 2
        before, sums = 0, 0.0
        for k, (m, s, _, _) in enumerate(self.buckets):
            before += m
            sums += s
            if before > n - self.least:
                return False
            if before >= self.least and abs(sums / before - (total - sums) / (n - before)) > spread * math.sqrt(term * (1 / before + 1 / (n - before))):
                self.buckets = self.buckets[k + 1 :]
                return True
        return False


def psi(baseline: np.ndarray, live: np.ndarray, bins: int = 10, eps: float = 1e-6) -> float:
    """Population stability index over equal-frequency bins of the baseline, repeated edges once; nan without values."""
    if not len(baseline) or not len(live):
        return math.nan
    order = np.sort(baseline)
    edges = np.unique(order[[int(b / bins * len(order)) for b in range(1, bins)]])
    p, q = (np.bincount(np.searchsorted(edges, x, "left"), minlength=len(edges) + 1) / len(x) + eps for x in (baseline, live))
    return float(((q - p) * np.log(q / p)).sum())
