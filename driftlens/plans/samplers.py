"""Samplers: which paths each resample compares. Draws follow NumPy's generator, in stream order, so they repeat."""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Sampler(ABC):
    """Draws path ids of the real corpus."""

    @abstractmethod
    def pool(self, rng: np.random.Generator) -> np.ndarray | int:
        """The ids, or the number of ids from 0, that the next draw takes from."""

    def __init__(self, most: int | None = None):
        if most is not None and most < 1:
            raise ValueError("paths per half must be at least 1")
        self.most = most

    def _draw(self, n: int, halves: int, rng: np.random.Generator) -> np.ndarray:
        if self.most is not None and n > self.most:
            raise ValueError(f"{n} paths asked for, the sampler was made for {self.most}")
        pool = self.pool(rng)
        have = pool if isinstance(pool, int) else len(pool)
        if n * halves > have:
            raise ValueError(f"{n * halves} different paths asked for, {have} there")
        return rng.choice(pool, size=n * halves, replace=False)

    def draw_pair(self, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        both = self._draw(n, 2, rng)
        return both[:n], both[n:]

    def draw_single(self, n: int, rng: np.random.Generator) -> np.ndarray:
        return self._draw(n, 1, rng)


class PooledSampler(Sampler):
    """The whole corpus of n paths."""

    def __init__(self, n: int):
        super().__init__()
        if n < 2:
            raise ValueError("a corpus of at least 2 paths is needed")
        self.n = int(n)

    def pool(self, rng):
        return self.n


class WithinTickerSampler(Sampler):
    """One ticker, picked anew for each draw among those with at least 2 * most paths."""

    def __init__(self, pools: dict[str, np.ndarray], most: int):
        super().__init__(most)
        self.pools = {t: np.asarray(p) for t, p in sorted(pools.items()) if len(p) >= 2 * most}
        if not self.pools:
            largest = sorted(((len(p), t) for t, p in pools.items()), reverse=True)[:3]
            raise ValueError(f"no ticker has {2 * most} paths; the largest: {largest}")
        self.eligible_tickers = np.array(list(self.pools))

    def pool(self, rng):
        return self.pools[self.eligible_tickers[rng.integers(len(self.eligible_tickers))]]

    @classmethod
    def of(cls, corpus: DataFrame, most: int) -> WithinTickerSampler:
        """Pools of the tickers with enough paths, found by a grouping; only their ids come to the driver."""
        enough = corpus.groupBy("ticker").agg(F.sort_array(F.collect_list("path_id")).alias("ids")).filter(F.size("ids") >= 2 * most)
        return cls({r.ticker: np.array(r.ids) for r in enough.toLocalIterator()}, most)


class WithinRegimeSampler(Sampler):
    """One fixed regime."""

    def __init__(self, ids: np.ndarray, regime: int, most: int):
        super().__init__(most)
        if len(ids) < 2 * most:
            raise ValueError(f"regime {regime} has {len(ids)} paths, {2 * most} are needed")
        self.ids, self.target_regime = np.asarray(ids), int(regime)

    @property
    def pool_size(self) -> int:
        return len(self.ids)

    def pool(self, rng):
        return self.ids

    @classmethod
    def of(cls, corpus: DataFrame, regime: int, most: int) -> WithinRegimeSampler:
        ids = corpus.filter(F.col("regime") == regime).select("path_id").orderBy("path_id")
        return cls(np.array([r.path_id for r in ids.toLocalIterator()]), regime, most)


def paired_draws(sampler: Sampler, n_syn: int, n: int, resamples: int, rng: np.random.Generator) -> list[tuple[int, str, int, int]]:
    """Rows (resample, side, pos, path_id): sides a and b real and disjoint, s synthetic, with replacement if it has no more than n."""
    rows = []
    for i in range(resamples):
        a, b = sampler.draw_pair(n, rng)
        s = rng.choice(n_syn, size=n, replace=n_syn <= n)
        rows += [(i, side, k, int(p)) for side, ids in (("a", a), ("b", b), ("s", s)) for k, p in enumerate(ids)]
    return rows


def unpaired_draws(sampler: Sampler, n_syn: int | None, n: int, resamples: int, rng: np.random.Generator) -> list[tuple[int, str, int, int]]:
    """Real against real (sides a, b) or, with n_syn, real against synthetic (a, s) by a draw of its own."""
    rows = []
    for i in range(resamples):
        if n_syn is None:
            sides = zip("ab", sampler.draw_pair(n, rng), strict=True)
        else:
            sides = zip("as", (sampler.draw_single(n, rng), rng.choice(n_syn, size=n, replace=n_syn <= n)), strict=True)
        rows += [(i, side, k, int(p)) for side, ids in sides for k, p in enumerate(ids)]
    return rows
