"""An inverted index with block maxima, for the searches of this subpackage.

Postings are in the order of entries; entries are dealt into blocks of ``BLOCK``, and each term
knows its largest weight in each block. A query sums these maxima to bound every block's scores and
scores only the blocks whose bound reaches the threshold, or the k-th best score so far, exactly.
"""

from __future__ import annotations

import numpy as np

BLOCK = 32


class BlockMaxIndex:
    """Weights of terms (0 to n_terms - 1) in entries (0 to n_entries - 1)."""

    def __init__(self, terms: np.ndarray, entries: np.ndarray, weights: np.ndarray, n_terms: int, n_entries: int) -> None:
        order = np.lexsort((entries, terms))
        self.terms, self.entries, self.weights = terms[order], entries[order], weights[order].astype(float)
        self.n_entries, self.n_blocks = n_entries, -(-n_entries // BLOCK)
        self.start = np.searchsorted(self.terms, np.arange(n_terms + 1))
        key = self.terms.astype(np.int64) * max(1, self.n_blocks) + self.entries // BLOCK
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.block_max = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        self.block, self.block_first = (key[first] % max(1, self.n_blocks)), np.append(first, len(key))
        self.block_start = np.searchsorted(key[first], np.arange(n_terms + 1) * max(1, self.n_blocks))
        self.term_max = np.zeros(n_terms)
        np.maximum.at(self.term_max, self.terms, self.weights)

    def _bounds(self, query: list[tuple[int, float]]) -> np.ndarray:
        bounds = np.zeros(self.n_blocks)
        for t, q in query:
            a, b = self.block_start[t], self.block_start[t + 1]
            bounds[self.block[a:b]] += q * self.block_max[a:b]
        return bounds

    def _scores(self, query: list[tuple[int, float]], blocks: np.ndarray) -> np.ndarray:
        """Exact scores of the entries of the blocks that ``blocks`` (a mask) names; zero elsewhere."""
        scores = np.zeros(self.n_entries)
        for t, q in query:
            a, b = self.start[t], self.start[t + 1]
            own = self.entries[a:b]
            wanted = blocks[own // BLOCK]
            scores[own[wanted]] += q * self.weights[a:b][wanted]
        return scores

    def above(self, query: list[tuple[int, float]], threshold: float) -> list[tuple[int, float]]:
        """All (entry, score) of at least ``threshold``, a positive number."""
        blocks = self._bounds(query) >= threshold - 1e-9
        if not blocks.any():
            return []
        scores = self._scores(query, blocks)
        return [(int(k), float(scores[k])) for k in np.flatnonzero(scores >= threshold - 1e-9)]

    def top(self, query: list[tuple[int, float]], k: int) -> list[tuple[int, float]]:
        """The ``k`` best (entry, score) with a score above zero; ties go to the first entry."""
        bounds = self._bounds(query)
        if not self.n_blocks or bounds.max() <= 0:
            return []
        blocks = np.zeros(self.n_blocks, bool)
        blocks[np.argsort(-bounds, kind="stable")[: 2 + k // BLOCK]] = True  # the most promising blocks set the bar
        scores = self._scores(query, blocks)
        bar = max(1e-12, np.partition(scores, -k)[-k] if len(scores) >= k else 0.0)
        rest = ~blocks & (bounds >= bar - 1e-12)
        if rest.any():
            scores += self._scores(query, rest)
        found = np.flatnonzero(scores > 0)
        found = found[np.argsort(-scores[found], kind="stable")][:k]
        return [(int(e), float(scores[e])) for e in found]
