"""Exact nearest neighbours of the rows of one table, by cells of a median split and their boxes."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planforge.sources import io

FOUND = "id long, other long, distance double"


class Cells:
    """A tree of median splits over a sample: where a point belongs, and which cells' boxes are within its reach."""

    def __init__(self, sample: np.ndarray, most: int):
        self.axis, self.cut, self.kids, self.cell = [], [], [], []
        self.n = 0
        self._split(np.unique(sample, axis=0), most)

    def _split(self, x: np.ndarray, most: int) -> int:
        node = len(self.axis)
        self.axis.append(-1)
        self.cut.append(0.0)
        self.kids.append((-1, -1))
        self.cell.append(-1)
        if most < 2 or len(x) < 2 or not x.shape[1]:
            self.cell[node] = self.n
            self.n += 1
            return node
        a = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
        cut = float(np.sort(x[:, a])[len(x) // 2])
        if not (x[:, a] < cut).any():
            cut = float(x[:, a].max())  # more than half are the least value: they go to one side
        self.axis[node], self.cut[node] = a, cut
        low = x[:, a] < cut
        self.kids[node] = (self._split(x[low], most // 2), self._split(x[~low], most - most // 2))
        return node

    def place(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.axis[node] < 0:
                out[rows] = self.cell[node]
            elif len(rows):
                low = x[rows, self.axis[node]] < self.cut[node]
                todo += [(self.kids[node][0], rows[low]), (self.kids[node][1], rows[~low])]
        return out

    def with_boxes(self, boxes: dict[int, tuple[np.ndarray, np.ndarray]]) -> Cells:
        """Tight boxes of the cells, and of every node above; a cell without points has none."""
        self.low, self.high = [None] * len(self.axis), [None] * len(self.axis)
        for node in reversed(range(len(self.axis))):  # children come after their parent
            if self.axis[node] < 0:
                self.low[node], self.high[node] = boxes.get(self.cell[node], (None, None))
                continue
            kids = [k for k in self.kids[node] if self.low[k] is not None]
            if kids:
                self.low[node] = np.min([self.low[k] for k in kids], axis=0)
                self.high[node] = np.max([self.high[k] for k in kids], axis=0)
        return self

    def reached(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every cell whose box is no further from the row than its reach."""
        rows_out, cells_out = [], []
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.low[node] is None or not len(rows):
                continue
            gap = np.zeros(len(rows))
            for j in range(x.shape[1]):  # summed in the order of `distances`, so rounding can't put a box beyond its points
                v = x[rows, j]
                d = np.maximum(np.maximum(self.low[node][j] - v, v - self.high[node][j]), 0.0)
                gap += d * d
            rows = rows[gap <= reach[rows]]
            if self.axis[node] < 0:
                rows_out.append(rows)
                cells_out.append(np.full(len(rows), self.cell[node]))
            else:
                todo += [(k, rows) for k in self.kids[node]]
        return np.concatenate([np.empty(0, np.int64), *rows_out]).astype(np.int64), np.concatenate([np.empty(0, np.int64), *cells_out]).astype(np.int64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared, one column after the other: no products that would round apart what is equal."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = a[:, j, None] - b[None, :, j]
        out += d * d
    return out


def _search(k: int, block: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"id": [], "other": [], "distance": []}).astype({"id": "int64", "other": "int64", "distance": "float64"})
        if not len(points) or not len(queries):
            return empty
        points = points.sort_values("id", kind="stable")
        p, ids = np.stack(points["x"].to_numpy()), points["id"].to_numpy()
        q, own = np.stack(queries["x"].to_numpy()), queries["id"].to_numpy()
        out = []
        for at in range(0, len(q), block):
            mine = slice(at, at + block)
            best_d, best_i = np.empty((len(own[mine]), 0)), np.empty((len(own[mine]), 0), np.int64)
            for start in range(0, len(p), 4096):  # a matrix of block x 4096 at most, whatever the cell holds
                some = slice(start, start + 4096)
                d = distances(q[mine], p[some])
                d[own[mine][:, None] == ids[None, some]] = np.inf
                d = np.concatenate([best_d, d], axis=1)
                i = np.concatenate([best_i, np.broadcast_to(ids[some], (len(d), len(ids[some])))], axis=1)
                order = np.argsort(d, axis=1, kind="stable")[:, :k]  # ids ascend, so equal distances go to the smaller
                best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
            row, col = np.nonzero(best_d < np.inf)
            out.append(pd.DataFrame({"id": own[mine][row], "other": best_i[row, col], "distance": best_d[row, col]}))
        return pd.concat(out) if out else empty

    return run


def nearest(df: DataFrame, id_col: str, columns: list[str], k: int, cell_rows: int = 2048, most_cells: int = 16384, sample: int = 65536) -> DataFrame:
    """id, rank (from 1), other, distance (squared): the k nearest other rows of each row, ties by the smaller id.

    ``id_col`` is a long and unique; nulls in ``columns`` count as 0. Equal points are searched once: of each, the k + 1
    smallest ids stand for all copies, found in salts of the id first, so a point that a third of the rows share is no group.
    Distinct points go to cells of about ``cell_rows`` by median splits, which a sample of ``sample`` points shapes (it
    decides on speed alone). A point first searches its own cell; the distance of its k-th there is its reach, and only
    cells whose boxes are within reach get it. Trees and boxes are bounded by ``most_cells`` and broadcast.
    """
    spark = df.sparkSession
    x = F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) + F.lit(0.0) for c in columns])
    rows = df.select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
    few = lambda d, *by: d.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy("id"))).where(F.col("_r") <= k + 1).drop("_r")
    copies = few(few(rows.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(64))), "x", "_s"), "x")
    copies = io.overwrite(copies.groupBy("x").agg(F.array_sort(F.collect_list("id")).alias("ids")), io.scratch(spark, "neighbour-points"))  # k + 1 ids at most
    n = copies.count()
    drawn = copies.orderBy(F.xxhash64("x")).limit(sample).select("x").collect() if n else []  # a bounded sample
    tree = Cells(np.array([r["x"] for r in drawn], float).reshape(-1, len(columns)), min(most_cells, max(1, math.ceil(n / cell_rows))))
    shared = spark.sparkContext.broadcast(tree)

    @F.pandas_udf("long")
    def cell(x: pd.Series) -> pd.Series:
        return pd.Series(shared.value.place(np.stack(x.to_numpy()).astype(float)) if len(x) else [], dtype="int64")

    placed = io.overwrite(copies.select(F.col("ids")[0].alias("id"), "x", "ids", cell("x").alias("cell")), io.scratch(spark, "neighbour-cells"))
    ends = [f(F.col("x")[j]).alias(f"{name}{j}") for j in range(len(columns)) for name, f in (("l", F.min), ("h", F.max))]
    boxes = {r["cell"]: tuple(np.array([r[f"{e}{j}"] for j in range(len(columns))]) for e in "lh") for r in placed.groupBy("cell").agg(*ends).collect()}  # a row a cell
    boxed = spark.sparkContext.broadcast(tree.with_boxes(boxes))

    points = placed.select("cell", "id", "x")

    def searched(q: DataFrame) -> DataFrame:
        q = q.select(*[F.col(c).alias(c) for c in q.columns])  # columns of its own, apart from the points'
        return points.groupBy("cell").cogroup(q.groupBy("cell")).applyInPandas(_search(k, 256), FOUND)

    home = io.overwrite(searched(points), io.scratch(spark, "neighbour-home"))
    # copies are neighbours at distance 0, so k of them leave nothing to look for
    reach = home.groupBy("id").agg(F.count("*").alias("found"), F.max("distance").alias("far"))
    asks = placed.where(F.size("ids") <= k).join(reach, "id", "left").select("id", "x", "cell", F.when(F.col("found") >= k, F.col("far")).otherwise(float("inf")).alias("reach"))

    def spread(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 2048):
                some = pdf.iloc[at : at + 2048]
                row, to = boxed.value.reached(np.stack(some["x"].to_numpy()).astype(float), some["reach"].to_numpy(float))
                away = to != some["cell"].to_numpy()[row]
                row, to = row[away], to[away]
                yield pd.DataFrame({"id": some["id"].to_numpy()[row], "x": some["x"].to_numpy()[row], "cell": to})

    found = home.unionByName(searched(asks.mapInPandas(spread, "id long, x array<double>, cell long")))
    found = found.withColumn("_r", F.row_number().over(W.partitionBy("id").orderBy("distance", "other"))).where(F.col("_r") <= k)
    # of points back to rows: the ids of a near point in turn, then the row's own point with its other copies
    ids = placed.select(F.col("id").alias("other"), F.col("ids").alias("others"))
    near = found.join(ids, "other").groupBy("id").agg(F.collect_list(F.struct("distance", "others")).alias("near"))  # k lists of k + 1
    near = placed.select("id", "x", "ids").join(near, "id", "left")
    near = near.withColumn("near", F.concat(F.array(F.struct(F.lit(0.0).alias("distance"), F.col("ids").alias("others"))), F.coalesce("near", F.array().cast("array<struct<distance:double,others:array<bigint>>>"))))
    flat = F.flatten(F.transform("near", lambda g: F.transform(g["others"], lambda o: F.struct(g["distance"].alias("distance"), o.alias("other")))))
    lists = near.select("x", F.slice(F.array_sort(flat), 1, k + 1).alias("list"))
    mine = rows.join(lists, "x").select("id", F.slice(F.filter("list", lambda e: e["other"] != F.col("id")), 1, k).alias("list"))
    return mine.select("id", F.posexplode("list").alias("_p", "e")).select("id", (F.col("_p") + 1).alias("rank"), F.col("e.other").alias("other"), F.col("e.distance").alias("distance"))
