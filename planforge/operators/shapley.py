"""Exact Shapley values of boosted trees, by the polynomial of each leaf's path, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planforge.operators.boosting import Ensemble, number


class LeafTable:
    """The leaves of one tree: the splits of their paths, and what each pattern of satisfied features contributes.

    A leaf's part of the game over subsets is its value times, for each distinct feature of its path,
    1 or 0 (known: its splits hold or not) or the share of cover that the path keeps (unknown).
    The Shapley sum over subsets of the others is then read off the coefficients of the product
    of (share + y * holds) by y. All 2**d patterns of d features are worked out once per tree.
    """

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, cover: np.ndarray):
        paths = [[(0, [])]]
        leaves = []
        while paths[-1]:
            below = []
            for node, steps in paths[-1]:
                if feature[node] < 0:
                    leaves.append((node, steps))
                    continue
                for side, child in ((0, 2 * node + 1), (1, 2 * node + 2)):
                    below.append((child, [*steps, (node, side)]))
            paths.append(below)
        depth = max(len(s) for _, s in leaves)
        n = len(leaves)
        self.depth, self.value = depth, value[[node for node, _ in leaves]]
        self.node, self.side, self.slot = (np.zeros((n, depth), np.int64) for _ in range(3))
        self.real = np.zeros((n, depth), bool)
        self.feature, share = np.full((n, depth), -1), np.ones((n, depth))
        for i, (_, steps) in enumerate(leaves):
            place: dict[int, int] = {}
            for j, (node, side) in enumerate(steps):
                at = place.setdefault(int(feature[node]), len(place))
                self.node[i, j], self.side[i, j], self.slot[i, j], self.real[i, j] = node, side, at, True
                self.feature[i, at] = feature[node]
                child = 2 * node + 1 + side
                share[i, at] *= cover[child] / cover[node] if cover[node] else 0.5
        self.mean = float((self.value * share.prod(axis=1)).sum())
        self.inner, self.at = np.flatnonzero(feature >= 0), np.zeros(len(feature), np.int64)
        self.at[self.inner] = np.arange(len(self.inner))
        self.split_on, self.cut = feature[self.inner], threshold[self.inner]
        self.table = np.ascontiguousarray(np.moveaxis(self._table(share), 2, 0)).reshape(depth, n << depth)
        self.some = [np.flatnonzero(self.feature[:, u] >= 0) for u in range(depth)]

    def _table(self, share: np.ndarray) -> np.ndarray:
        """[leaf, pattern, slot]: contributions; empty slots count as features that always hold with share 1, which give 0."""
        n, depth = share.shape
        size = (self.feature >= 0).sum(axis=1)
        holds = (np.arange(1 << depth)[:, None] >> np.arange(depth)) & 1
        weight = np.zeros((n, depth))  # of the k-th coefficient, for a leaf of d features
        for i, d in enumerate(size):
            weight[i, :d] = [factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)]
        out = np.zeros((n, 1 << depth, depth))
        for u in range(depth):
            poly = np.zeros((n, 1 << depth, depth))
            poly[..., 0] = 1
            for v in range(depth):
                if v == u:
                    continue
                there = (self.feature[:, v] >= 0)[:, None]
                z, o = np.where(there, share[:, v : v + 1], 1.0), np.where(there, holds[:, v], 0)
                poly[..., 1:] = poly[..., 1:] * z[..., None] + poly[..., :-1] * o[..., None]
                poly[..., 0] *= z
            inner = np.einsum("npk,nk->np", poly, weight)
            known = (self.feature[:, u] >= 0)[:, None]
            out[..., u] = np.where(known, self.value[:, None] * (holds[:, u] - share[:, u : u + 1]) * inner, 0.0)
        return out

    def add_to(self, out: np.ndarray, x: np.ndarray) -> None:
        """Add the contributions of this tree to out [row, feature]."""
        if not self.depth:
            return
        right = x[:, self.split_on] > self.cut
        n, fails = len(self.value), np.zeros((len(x), len(self.value)), np.int32)
        for j in range(self.depth):
            fail = right[:, self.at[self.node[:, j]]] != self.side[:, j].astype(bool)
            fails |= np.where(fail & self.real[:, j], np.int32(1) << self.slot[:, j].astype(np.int32), np.int32(0))
        at = (np.arange(n) << self.depth) + ((1 << self.depth) - 1 - fails)  # places of leaf and pattern in a slot's table
        rows = np.arange(len(x))[:, None] * out.shape[1]
        for u, some in enumerate(self.some):
            add = self.table[u].take(at if len(some) == n else at[:, some])
            out += np.bincount((rows + self.feature[some, u]).ravel(), add.ravel(), out.size).reshape(out.shape)


def shapley_values(x: np.ndarray, tables: list[LeafTable], chunk: int = 256) -> np.ndarray:
    """[row, feature]: with the mean of all trees they sum to the margin."""
    out = np.zeros(x.shape)
    for at in range(0, len(x), chunk):
        for t in tables:
            t.add_to(out[at : at + chunk], x[at : at + chunk])
    return out


def mean_margin(e: Ensemble) -> float:
    """The margin over the rows that the trees were fitted on, weighed by cover."""
    return e.base + sum(t.mean for t in leaf_tables(e))


def leaf_tables(e: Ensemble) -> list[LeafTable]:
    return [LeafTable(*t) for t in zip(e.feature, e.threshold, e.value, e.cover, strict=True)]


def tasks_for(n: int, cores: int) -> int:
    """A task for 4,096 rows, but no more than cores until each has 65,536: each task works the leaf tables out, which takes as long as some thousand rows."""
    return max(1, min(n // 4096, max(cores, n // 65_536)))


def attributions(df: DataFrame, ensemble: Ensemble, key: str, columns: list[str], n: int = 10) -> DataFrame:
    """key, feature, contribution, rank: the n features of the largest exact Shapley values of each row.

    Trees of bounded depth are broadcast; a task works its leaf tables out once. The n best of a row
    are chosen where it is, so only they leave the task. Null features count as 0, as in the fit.
    """
    shared = df.sparkSession.sparkContext.broadcast(ensemble)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables, names = None, np.array(columns)
        for pdf in batches:
            if not len(pdf):
                continue
            tables = tables or leaf_tables(shared.value)
            c = shapley_values(pdf[columns].to_numpy(float), tables)
            order = np.lexsort((np.broadcast_to(names, c.shape), -np.abs(c)), axis=1)[:, :n]
            yield pd.DataFrame({
                key: np.repeat(pdf[key].to_numpy(), order.shape[1]), "feature": names[order].ravel(), "contribution": np.take_along_axis(c, order, axis=1).ravel(),
                "rank": np.tile(np.arange(1, order.shape[1] + 1, dtype=np.int32), len(pdf)),
            })

    kind = dict(df.dtypes)[key]
    return df.select(key, *[number(c) for c in columns]).mapInPandas(explain, f"{key} {kind}, feature string, contribution double, rank int")
