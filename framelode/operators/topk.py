"""The best few of many scores, inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def order_of(ids: np.ndarray) -> np.ndarray:
    """Numbers that order as ``ids`` do: themselves, or the ranks of other values."""
    return ids if ids.dtype.kind in "iuf" else pc.rank(pa.array(ids), tiebreaker="dense").to_numpy()


def best(ids: np.ndarray, scores: np.ndarray, k: int, digits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest scores, best first; ties, of scores as rounded to ``digits``, to the smaller id."""
    rank = scores if digits is None else np.round(scores, digits)
    if len(scores) > k:
        some = np.flatnonzero(rank >= np.partition(rank, len(rank) - k)[len(rank) - k])
        ids, scores, rank = ids[some], scores[some], rank[some]
    first = np.lexsort((order_of(ids), -rank))[:k]
    return ids[first], scores[first]


class Leaders:
    """The ``k`` best rows of each of ``n`` queries so far, or of those that reach ``least``, if given."""

    #: Pieces of a query's rows that are held before they become one.
    PIECES = 8

    def __init__(self, n: int, k: int, digits: int | None = None, least: np.ndarray | None = None):
        self.k, self.digits, self.held, self.least = k, digits, {}, np.full(n, -np.inf) if least is None else least.copy()

    def add(self, ids: np.ndarray, scores: np.ndarray, numbers: np.ndarray | None = None) -> None:
        """Scores (queries, rows), those of the queries ``numbers`` (all, if not given); minus infinity and NaN are no scores."""
        numbers = np.arange(len(scores)) if numbers is None else numbers
        if not scores.size:
            return
        least = self.least[numbers]
        if scores.shape[1] >= 32 * self.k:  # the k-th of some of the rows is a bound that leaves few of the others
            some = scores[:, : max(16 * self.k, scores.shape[1] // 16)]
            at = np.flatnonzero(np.isneginf(least))
            if len(at):
                some = np.where(np.isnan(some[at]), -np.inf, some[at])
                kth = np.partition(some, some.shape[1] - self.k, axis=1)[:, some.shape[1] - self.k]
                least[at] = kth - (0 if self.digits is None else 10.0**-self.digits)
        row, column = np.divmod(np.flatnonzero(scores >= np.maximum(least, np.finfo(np.float64).min)[:, None]), scores.shape[1])
        cuts = np.searchsorted(row, np.arange(len(scores) + 1))
        found = scores[row, column]
        for at in np.flatnonzero(np.diff(cuts)).tolist():
            self.one(int(numbers[at]), ids[column[cuts[at] : cuts[at + 1]]], found[cuts[at] : cuts[at + 1]])

    def one(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Some rows of query ``i``."""
        held = self.held.setdefault(i, [])
        held.append((ids, scores))
        n = sum(len(x) for x, _ in held)
        if n > 2 * self.k or len(held) > self.PIECES or (n >= self.k and self.least[i] == -np.inf):
            self._settle(i)

    def _settle(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        ids, scores = best(*(np.concatenate(x) for x in zip(*self.held[i], strict=True)), self.k, self.digits)
        self.held[i] = [(ids, scores)]
        if len(ids) == self.k:
            self.least[i] = max(self.least[i], scores[-1] - (0 if self.digits is None else 10.0**-self.digits))
        return ids, scores

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, id, score) of all."""
        if not self.held:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        at = sorted(self.held)
        rows = [self._settle(i) for i in at]
        return np.repeat(np.array(at, dtype=np.int64), [len(x) for x, _ in rows]), *(np.concatenate(x) for x in zip(*rows, strict=True))
