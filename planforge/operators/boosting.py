"""Second-order histogram boosting over a binned feature table: one histogram aggregate a level, for several models side by side.

Rows stay where Spark put them, as blocks of binned features with the margin of each model. A level is
one job: each block sums gradients by (model, node, feature, bin), blocks are summed pairwise by a tree
shuffle, where the task that holds a node's whole histogram finds its best split: the driver sees
splits, never histograms. Gradients are rounded to binary fractions, so sums don't depend on their order and a run gives the same trees on any partitions.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planforge.sources import io


@dataclass(frozen=True)
class Params:
    """trees, learning rate, greatest depth and number of leaves (0: as many as the depth allows), shares of rows and columns a tree sees, least hessian of a child, L1 and L2."""

    trees: int = 300
    rate: float = 0.05
    depth: int = 6
    leaves: int = 0
    rows: float = 0.8
    columns: float = 0.8
    child_weight: float = 3.0
    l1: float = 0.1
    l2: float = 1.0
    positive_weight: float = 1.0
    seed: int = 42


@dataclass
class Ensemble:
    """Trees as rows of arrays; node i has the children 2i + 1 (value <= threshold) and 2i + 2. feature is -1 at leaves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    logistic: bool = False

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                step = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
                node = np.where(inner, step, node)
            out += value[node]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(x)
        return 1 / (1 + np.exp(-m)) if self.logistic else m


def bin_edges(df: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    """At most bins - 1 upper ends of bins per column, from one mergeable quantile sketch each (exact up to 10,000 rows)."""
    share = [(i + 1) / bins for i in range(bins - 1)]
    row = df.agg(*[F.percentile_approx(F.col(c), share, 10_000).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    return [np.unique(np.array(q if q is not None else [], float)) for q in row]


def _blocks(df: DataFrame, key: list[str], columns: list[str], label: str, uses: list[str], edges: list[np.ndarray], block_rows: int | None) -> tuple[RDD, int]:
    """One element per block of about ``block_rows``: a dict of arrays. Without it four blocks a core, of 12,288 rows at least."""
    rows = df.select(F.xxhash64(*key).alias("_h"), F.col(label).cast("double").alias("_y"), *[F.col(u).cast("double").alias(f"_w{i}") for i, u in enumerate(uses)], *[F.col(c).alias(f"_x{i}") for i, c in enumerate(columns)])
    n = df.count()
    block_rows = block_rows or max(12_288, n // (4 * df.sparkSession.sparkContext.defaultParallelism))
    rows = rows.repartition(max(1, math.ceil(n / block_rows)), "_h")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b in batches:
            of = lambda c, b=b: b.column(c).to_numpy(zero_copy_only=False)
            x = np.stack([np.searchsorted(e, of(f"_x{i}"), "left") for i, e in enumerate(edges)]).astype(np.uint8)
            parts.append((of("_h").astype(np.uint64), of("_y"), np.stack([of(f"_w{i}") for i in range(len(uses))]), x))
        if parts:
            h, y, w, x = (np.concatenate(p, axis=-1) for p in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps({"h": h, "y": y, "w": w, "x": x})], pa.binary())], ["block"])

    return rows.mapInArrow(pack, "block binary").rdd.map(lambda r: pickle.loads(r["block"])), n


def _drawn(h: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """Rows that a tree sees, by a hash of the row's key."""
    z = h + np.uint64((seed * 0x9E3779B97F4A7C15 + tree * 0xD1B54A32D192ED03) & (2**64 - 1))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
    return (z ^ (z >> np.uint64(31))) >> np.uint64(11) < np.uint64(int(share * (1 << 53)))


def _gradients(block: dict, m: int, rows: np.ndarray, logistic: bool, positive: float, scale: float) -> tuple[np.ndarray, np.ndarray]:
    y, margin = block["y"][rows], block["margin"][m, rows]
    if not logistic:
        return np.rint((margin - y) * scale), np.ones(len(rows))
    p, w = 1 / (1 + np.exp(-margin)), np.where(y > 0, positive, 1.0)
    return np.rint((p - y) * w * scale), np.rint(p * (1 - p) * w * scale) / scale


def _node_of(x: np.ndarray, rows: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The node each row has come to after ``depth`` levels; rows in a leaf above stay there."""
    node = np.zeros(len(rows), np.int64)
    for _ in range(depth):
        f = feature[node]
        node = np.where(f >= 0, 2 * node + 1 + (x[np.maximum(f, 0), rows] > cut[node]), node)
    return node


def _soft(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def best_split(s: np.ndarray, p: Params) -> tuple:
    """Of a node's sums [column, bin, 2]: its gradient and hessian, and (gain, column, cut, left and right gradient and hessian) of its best split, or None."""
    left = s.cumsum(axis=1)
    total = left[:1, -1:, :]
    g, h = left[..., 0], left[..., 1]
    rest_g, rest_h = total[..., 0] - g, total[..., 1] - h
    score = lambda g, h: _soft(g, p.l1) ** 2 / (h + p.l2 + 1e-300)
    gain = score(g, h) + score(rest_g, rest_h) - score(total[..., 0], total[..., 1])
    gain = np.where((h >= p.child_weight) & (rest_h >= p.child_weight), gain, -np.inf).ravel()
    at = int(gain.argmax())
    column, cut = divmod(at, s.shape[1])
    split = None if gain[at] <= 1e-9 else (float(gain[at]), column, cut, *(float(v[column, cut]) for v in (g, h, rest_g, rest_h)))
    return float(total[0, 0, 0]), float(total[0, 0, 1]), split


class _Growing:
    """One tree of one model while it grows: the splits found so far."""

    def __init__(self, p: Params, n_columns: int, tree: int):
        size = 2 ** (p.depth + 1) - 1
        rng = np.random.default_rng([p.seed, tree])
        self.columns = np.sort(rng.permutation(n_columns)[: max(1, round(p.columns * n_columns))])
        self.p, self.feature, self.cut = p, np.full(size, -1), np.zeros(size, np.int64)
        self.g, self.h, self.gain = np.zeros(size), np.zeros(size), np.zeros(size)
        self.asked = [0]

    def split(self, found: dict[int, tuple]) -> None:
        """found: asked node -> ``best_split`` of its histogram; the children are asked for next."""
        self.asked = []
        for node, (g, h, best) in sorted(found.items()):
            self.g[node], self.h[node] = g, h
            if best is None:
                continue
            gain, column, cut, *sides = best
            self.feature[node], self.cut[node], self.gain[node] = self.columns[column], cut, gain
            for child, (a, b) in ((2 * node + 1, sides[:2]), (2 * node + 2, sides[2:])):
                self.g[child], self.h[child] = a, b
                self.asked.append(child)

    def finish(self) -> np.ndarray:
        """Best first, splits up to the number of leaves; the values of what are leaves then."""
        keep, todo = set(), [(-self.gain[0], 0)] if self.feature[0] >= 0 else []
        while todo and (not self.p.leaves or len(keep) < self.p.leaves - 1):
            _, node = heapq.heappop(todo)
            keep.add(node)
            for child in (2 * node + 1, 2 * node + 2):
                if self.feature[child] >= 0:
                    heapq.heappush(todo, (-self.gain[child], child))
        self.feature[[i for i in range(len(self.feature)) if i not in keep]] = -1
        value = -_soft(self.g, self.p.l1) / (self.h + self.p.l2 + 1e-300) * self.p.rate
        return np.where(self.feature < 0, value, 0.0)


def fit(
    df: DataFrame, key: list[str], columns: list[str], label: str, models: dict[str, tuple[str, Params]], logistic: bool = False, bins: int = 64, block_rows: int | None = None, cut_every: int = 20
) -> dict[str, Ensemble]:
    """Models by name, each (column that is true or 1 where a row is trained on, parameters), fitted side by side.

    Columns are numbers without nulls or NaN; ``bins`` is at most 256. A level of all models is one
    job, so folds cost no more jobs than one model. Blocks are cut off their lineage every
    ``cut_every`` trees in the checkpoint folder. Rows with a null label take no part. A model
    without rows predicts 0.
    """
    df = df.where(F.col(label).isNotNull())
    names, params = list(models), [p for _, p in models.values()]
    uses = [u for u, _ in models.values()]
    edges = bin_edges(df, columns, bins)
    blocks, n = _blocks(df, key, columns, label, uses, edges, block_rows)
    io.checkpoint_dir(df.sparkSession)
    used = [F.col(u).cast("double") > 0 for u in uses]
    stats = df.agg(*[F.avg(F.when(u, F.col(label))).alias(f"a{i}") for i, u in enumerate(used)], F.max(F.abs(label)).alias("most")).first()
    mean = [round(stats[f"a{i}"] or 0.0, 9) for i in range(len(uses))]  # sums of doubles depend on their order
    base = [math.log(min(max(m, 1e-6), 1 - 1e-6) / (1 - min(max(m, 1e-6), 1 - 1e-6))) if logistic else m for m in mean]
    reach = max(2.0 * float(stats["most"] or 0.0), 1.0) * max(p.positive_weight for p in params)
    scale = 2.0 ** math.floor(51 - math.log2(reach * max(n, 1)))
    blocks = blocks.map(lambda b: b | {"margin": np.repeat(np.array(base)[:, None], len(b["y"]), axis=1)}).persist(StorageLevel.MEMORY_AND_DISK)
    spark = df.sparkSession.sparkContext
    # a task takes eight blocks of one model, or fewer of several: one for less costs more than it saves, and with one task no stage of summing tasks follows
    tasks = min(blocks.getNumPartitions(), spark.defaultParallelism, math.ceil((n * len(names) + 1) / (8 * (block_rows or 12_288))))
    grown, before = [[] for _ in names], None

    for tree in range(max(p.trees for p in params)):
        now = [_Growing(p, len(columns), tree) if tree < p.trees else None for p in params]
        for depth in range(max(p.depth for p in params)):
            asked = [g.asked if g and depth < g.p.depth else [] for g in now]
            if not any(asked):
                break
            job = [(m, g.columns, g.feature, g.cut, g.asked, g.p) for m, g in enumerate(now) if asked[m]]

            def level(part: Iterator[dict], job=job, tree=tree, depth=depth) -> Iterator[tuple[int, tuple]]:
                sums = [np.zeros((len(a), len(c), bins, 2)) for _, c, _, _, a, _ in job]
                for b in part:
                    for out, (m, c, feature, cut, a, p) in zip(sums, job, strict=True):
                        rows = np.flatnonzero((b["w"][m] > 0) & _drawn(b["h"], p.seed, tree, p.rows))
                        slot = np.full(len(feature), -1)
                        slot[a] = np.arange(len(a))
                        slot = slot[_node_of(b["x"], rows, feature, cut, depth)]
                        rows, slot = rows[slot >= 0], slot[slot >= 0]
                        g, h = _gradients(b, m, rows, logistic, p.positive_weight, scale)
                        at = slot * bins
                        for j, f in enumerate(c):
                            cell = at + b["x"][f, rows]
                            out[:, j, :, 0] += np.bincount(cell, g, len(a) * bins).reshape(len(a), bins)
                            out[:, j, :, 1] += np.bincount(cell, h if logistic else None, len(a) * bins).reshape(len(a), bins)
                i = 0
                for out, (m, _, _, _, a, p) in zip(sums, job, strict=True):
                    for node, s in zip(a, out, strict=True):
                        yield i, (m, node, p, s)
                        i += 1

            def splits(part: Iterator[tuple[int, tuple]]) -> Iterator[tuple]:
                whole: dict[int, list] = {}
                for i, (m, node, p, s) in part:
                    if i in whole:
                        whole[i][3] += s
                    else:
                        whole[i] = [m, node, p, s]
                for m, node, p, s in whole.values():
                    s[..., 0] /= scale
                    yield m, node, best_split(s, p)

            # several blocks a task, and as many summing tasks as there is work for: what is sent grows with neither rows nor blocks
            done = blocks.coalesce(tasks).mapPartitions(level)
            if tasks > 1:
                done = done.partitionBy(min(tasks, sum(map(len, asked))), lambda i: i)
            found: list[dict[int, tuple]] = [{} for _ in names]
            for m, node, best in done.mapPartitions(splits).collect():
                found[m][node] = best
            for m, *_ in job:
                now[m].split(found[m])
        step = []
        for m, g in enumerate(now):
            if g:
                value = g.finish()
                threshold = np.array([edges[f][c] if f >= 0 else 0.0 for f, c in zip(g.feature, g.cut, strict=True)])
                grown[m].append((g.feature, threshold, value, g.h))
                step.append((m, g.feature, g.cut, value, g.p.depth))

        def moved(b: dict, step=step) -> dict:
            margin = b["margin"].copy()
            for m, feature, cut, value, depth in step:
                margin[m] += value[_node_of(b["x"], np.arange(len(b["y"])), feature, cut, depth)]
            return b | {"margin": margin}

        # the first level of the next tree fills the new blocks, and only then those before them go
        if before is not None:
            before.unpersist()
        before, blocks = blocks, blocks.map(moved).persist(StorageLevel.MEMORY_AND_DISK)
        if (tree + 1) % cut_every == 0:
            blocks.checkpoint()
            blocks.count()
    for left in (before, blocks):
        left.unpersist()
    return {name: _ensemble(b, trees, logistic) for name, b, trees in zip(names, base, grown, strict=True)}


def _ensemble(base: float, trees: list[tuple], logistic: bool) -> Ensemble:
    feature, threshold, value, cover = (np.stack(x) for x in zip(*trees, strict=True))
    return Ensemble(base, feature.astype(np.int64), threshold, value, cover, logistic)


def scored(df: DataFrame, ensembles: dict[str, Ensemble], columns: list[str]) -> DataFrame:
    """df with a column of predictions per ensemble; ensembles of parameters' size are broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(list(ensembles.values()))

    @F.pandas_udf(", ".join(f"m{i} double" for i in range(len(ensembles))))
    def predict(x: pd.DataFrame) -> pd.DataFrame:
        v = x.to_numpy(float)
        return pd.DataFrame({f"m{i}": e.predict(v) for i, e in enumerate(shared.value)})

    out = df.withColumn("_scores", predict(F.struct(*[number(c) for c in columns])))
    return out.withColumns({name: F.col(f"_scores.m{i}") for i, name in enumerate(ensembles)}).drop("_scores")


def number(name: str) -> Column:
    """A feature as a double; NULL and NaN as 0."""
    return F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(name)


def as_table(spark, ensembles: dict[str, Ensemble], columns: list[str]) -> DataFrame:
    """A row per node: model, tree, node, feature (its name; null at leaves), threshold, value, cover, base, logistic."""
    rows = []
    for name, e in ensembles.items():
        for t in range(len(e.feature)):
            there = np.flatnonzero((e.feature[t] >= 0) | (e.value[t] != 0) | (np.arange(e.feature.shape[1]) == 0))
            for n in there.tolist():
                f = int(e.feature[t, n])
                rows.append((name, t, n, columns[f] if f >= 0 else None, float(e.threshold[t, n]), float(e.value[t, n]), float(e.cover[t, n]), e.base, e.logistic))
    schema = "model string, tree int, node int, feature string, threshold double, value double, cover double, base double, logistic boolean"
    return spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]), schema)


def from_table(df: DataFrame, columns: list[str]) -> dict[str, Ensemble]:
    """Ensembles of such a table, whose size the parameters fix."""
    place, out = {c: i for i, c in enumerate(columns)}, {}
    for name, rows in df.toPandas().groupby("model"):
        size = 2 ** (int(rows["node"].max() + 1).bit_length()) - 1
        e = Ensemble(float(rows["base"].iloc[0]), np.full((rows["tree"].max() + 1, size), -1), *(np.zeros((rows["tree"].max() + 1, size)) for _ in range(3)), bool(rows["logistic"].iloc[0]))
        at = (rows["tree"].to_numpy(), rows["node"].to_numpy())
        e.feature[at] = [place[f] if isinstance(f, str) else -1 for f in rows["feature"]]
        e.threshold[at], e.value[at], e.cover[at] = rows["threshold"], rows["value"], rows["cover"]
        out[name] = e
    return out
