"""What a pool of tails keeps while it is packed."""

from __future__ import annotations

import numpy as np
from loomspark.llm.packing import Pool, fill


def test_scores_of_used_tails_are_not_kept_up():
    """A cut renews the scores of seeds that are still to come alone."""
    rng = np.random.default_rng(3)
    tails = [[k, 0, rng.integers(0, 300, int(rng.integers(5, 60))).astype(np.uint32), 60] for k in range(400)]
    pool = Pool(tails, np.linspace(1, 4, 300), 30.0)
    held = 0
    for parts in fill(pool, 128):
        if pool.tails[parts[-1][0]][1]:  # the last one was cut
            held = max(held, sum(not pool.unused[s] for s in pool._scored))
    assert held == 0


def test_columns_of_used_tails_go():
    """Later seeds are scored against what is left, with the scores of a pool that has only that."""
    rng = np.random.default_rng(5)
    idf = np.linspace(1, 4, 900)
    tails = [[k, 0, rng.integers(0, 900, int(rng.integers(5, 60))).astype(np.uint32), 60] for k in range(600)]
    pool = Pool([list(t) for t in tails], idf, 30.0)
    seen = {len(pool.scores(np.array([0]))[0])}
    for _ in fill(pool, 128):
        free = np.flatnonzero(pool.unused)
        if not len(free) or not (pool._column[free] >= 0).all():
            break
        seen.add(len(pool.scores(free[:1])[0]))
        fresh = Pool([list(pool.tails[k]) for k in free], idf, 30.0)
        assert np.allclose(pool.scores(free[:20])[:, pool._column[free]], fresh.scores(np.arange(len(free[:20]))), atol=1e-4)
    assert min(seen) < 100 < 600 == max(seen)


def test_a_cut_renews_the_scores_of_a_block_at_once(monkeypatch):
    rng = np.random.default_rng(7)
    pool = Pool([[k, 0, rng.integers(0, 300, 60).astype(np.uint32), 60] for k in range(200)], np.linspace(1, 4, 300), 60.0)
    next(pool.neighbours(0))
    seeds = len(pool._scored)
    sums = []
    monkeypatch.setattr("loomspark.llm.packing.np", Counted(sums))
    _, start, ids, n = pool.tails[150]
    pool.cut(150, [150, start + 9, ids[9:], n])
    assert seeds > 30 and len(sums) == 1


class Counted:
    """numpy, with a record of sums that are made."""

    def __init__(self, sums: list) -> None:
        self.add = self
        self._sums = sums

    def reduce(self, *args):
        self._sums.append("reduce")
        return np.add.reduce(*args)

    def reduceat(self, *args):
        self._sums.append("reduceat")
        return np.add.reduceat(*args)

    def __getattr__(self, name: str):
        return getattr(np, name)
