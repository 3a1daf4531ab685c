"""Hard-negative mining (12): the threshold algorithm over sorted lists of each dimension, per shard."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from planforge.llm.common import Tables, read
from planforge.llm.kdtree_search import integer_vectors

FOUND = "asked long, part int, row long, vec_id long, score long"
ANY = (-(2**62), 2**62)


class SortedLists:
    """Vectors of a shard, and for each dimension their numbers in the order of that component."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.v, self.ids = vectors, ids
        self.order = np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T)  # [dimension, place]

    def search(self, anchor: np.ndarray, own: int, windows: list[tuple[int, int]], k: int, step: int = 16) -> list[tuple[int, int, int]]:
        """(window, number, score) of the k best rows of each window of scores; ties go to the smaller id, then to the smaller number.

        Lists are read from the end that the anchor's sign asks for, ``step`` entries at a time and
        then twice as many; what is met is scored whole. The threshold is the score of a row that
        stands at the present depth in each list. The search ends when it is strictly below each
        window's k-th score, or below the window itself.
        """
        dims = np.flatnonzero(anchor)
        up, down = dims[anchor[dims] < 0], dims[anchor[dims] > 0]
        n = len(self.v)
        seen, met_now = np.zeros(n, bool), np.zeros(n, bool)
        seen[self.ids == own] = True
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth = 0
        while depth < n:
            to = min(n, depth + step)
            if len(dims):
                met_now[:] = False
                met_now[self.order[up, depth:to]] = True
                met_now[self.order[down, n - to : n - depth]] = True
                met = np.flatnonzero(met_now & ~seen)
            else:
                met = np.flatnonzero(~seen)
            seen[met] = True
            rows, scores = np.concatenate([rows, met]), np.concatenate([scores, self.v[met] @ anchor])
            if not len(dims) or seen.all():
                break  # all scores are 0, or nothing is left to be met
            threshold = int(self.v[self.order[up, to - 1], up] @ anchor[up] + self.v[self.order[down, n - to], down] @ anchor[down])
            depth, step = to, step * 2
            if all(threshold < lo or threshold < self.kth(scores, lo, hi, k) for lo, hi in windows):
                break
        out = []
        for j, (lo, hi) in enumerate(windows):
            least = max(lo, self.kth(scores, lo, hi, k))
            hit = np.flatnonzero((scores >= least) & (scores <= hi))
            if len(hit) > k:  # ties at the k-th score, of which there may be any number
                hit = hit[np.lexsort((rows[hit], self.ids[rows[hit]], -scores[hit]))[:k]]
            out += zip([j] * len(hit), rows[hit].tolist(), scores[hit].tolist())
        return out

    @staticmethod
    def kth(scores: np.ndarray, lo: int, hi: int, k: int) -> int:
        """The k-th score inside a window; without so many, below all scores."""
        inside = scores[(scores >= lo) & (scores <= hi)]
        return int(np.partition(inside, len(inside) - k)[len(inside) - k]) if len(inside) >= k else ANY[0]


def _searches(k: int, key: list[str], most_found: int = 1 << 16):
    """Of rows in order of shard, its vectors before the anchors asked of it: one shard is held at a time, and what is asked and found in batches."""
    schema = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32()}[c.split()[1]]) for c in FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, lists, out = None, [], None, []
        for batch in batches:
            col = {c: batch.column(c) for c in ("row", "vec_id", "asked", "parts", "least", "most")}
            v, cuts = batch.column("v").values.to_numpy(zero_copy_only=False), batch.column("v").offsets.to_numpy()
            vector = lambda i, v=v, cuts=cuts: v[cuts[i] : cuts[i + 1]].astype(np.int64)
            places = zip(*[batch.column(c).to_pylist() for c in key], col["asked"].is_valid().to_pylist(), range(batch.num_rows), strict=True)
            for (*at, is_asked), run in groupby(places, key=lambda p: p[:-1]):
                numbers = [p[-1] for p in run]
                if at != shard:
                    shard, held, lists = at, [], None
                if not is_asked:
                    some = slice(numbers[0], numbers[-1] + 1)
                    held.append((np.stack([vector(i) for i in numbers]), *(col[c][some].to_numpy() for c in ("vec_id", "row"))))
                    continue
                if lists is None and held:
                    vectors, ids, rows = (np.concatenate(x) for x in zip(*held, strict=True))
                    lists, held = SortedLists(vectors, ids), []
                for i in numbers if lists else ():
                    asked, own = col["asked"][i].as_py(), col["vec_id"][i].as_py()
                    parts, windows = col["parts"][i].as_py(), list(zip(col["least"][i].as_py(), col["most"][i].as_py(), strict=True))
                    out += [(asked, parts[j], int(rows[r]), int(ids[r]), s) for j, r, s in lists.search(vector(i), own, windows, k)]
                    if len(out) >= most_found:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each (asked, part): higher scores, then smaller vec_id, then the order of reading."""
    order = W.partitionBy("asked", "part").orderBy(F.col("score").desc(), F.col("vec_id"), F.col("row"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, shard_rows: int = 4096, block_anchors: int = 256
) -> DataFrame:
    """vectors: vec_id, label, v (integers). For each anchor and each of its positives the hardest negatives.

    An anchor's positives are the ``positives`` rows of its label with the largest inner products;
    the negatives of the pair are the ``negatives`` best rows of other labels whose score s has
    low * positive_score <= 100 * s <= high * positive_score. Columns: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score.

    Rows of one length and label are dealt by hash to shards of about ``shard_rows``, so a label with
    a third of all rows has as many shards as it needs. Positives are searched in the shards of the
    anchor's label, then negatives in those of all others: first in one shard, whose k-th score in a
    window raises the window's lower end for the rest, which may end at once. Each shard keeps a
    box of its vectors; an anchor is not sent where the box's bound is below all its windows.
    Inside a shard the threshold algorithm reads sorted lists of each dimension. A task holds one shard;
    the anchors asked of it, of which there may be any number, pass by a batch at a time, and each leaves
    ``negatives`` rows a window at most, however many tie.

    Ties go to the smaller vec_id, then to the row read first. Rows with the anchor's own id are
    never its positives or negatives; otherwise each row stands for itself, repeated or not, as an
    anchor, positive or negative. Rows with a null id, label or vector take no part. Fewer rows than
    asked for give all there are; a negative positive_score has an empty window. Only vectors of one
    length are compared. An empty table gives an empty result. Scores are 64-bit: components
    should stay below 2**28.
    """
    keep = Tables()
    base = vectors.where("vec_id is not null and label is not null and v is not null").withColumn("dim", F.size("v"))
    base = keep(base.withColumns({"row": F.monotonically_increasing_id(), "is_anchor": F.coalesce(is_anchor, F.lit(False))}), "mine-rows")
    sizes = base.groupBy("dim", "label").agg(F.ceil(F.count("*") / shard_rows).alias("shards"))  # a row per label
    rows = keep(base.join(sizes, ["dim", "label"]).withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards"))), "mine-shards")
    key = ["dim", "label", "shard"]
    boxes = rows.select(*key, F.posexplode("v").alias("i", "x")).groupBy(*key, "i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    boxes = boxes.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("i", "lo", "hi"))).alias("box"))  # dim entries each
    boxes = keep(boxes, "mine-boxes")
    anchors = rows.where("is_anchor").select(F.col("row").alias("asked"), F.col("dim").alias("own_dim"), F.col("label").alias("own_label"), *[F.col(c).alias(c) for c in ("vec_id", "v")])

    none = {"asked": "bigint", "parts": "array<int>", "least": "array<bigint>", "most": "array<bigint>"}
    held = rows.select(*key, "row", "vec_id", "v", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])

    def searched(asked: DataFrame, k: int) -> DataFrame:
        asked = asked.select(*key, F.lit(None).cast("bigint").alias("row"), "vec_id", "v", *[F.col(c).cast(t).alias(c) for c, t in none.items()])
        dealt = held.union(asked).repartition(*key).sortWithinPartitions(*key, F.col("asked").isNotNull(), "row")
        return dealt.mapInArrow(_searches(k, key), FOUND)

    everything = {"parts": F.array(F.lit(0)), "least": F.array(F.lit(ANY[0])), "most": F.array(F.lit(ANY[1]))}
    own = anchors.join(boxes.select(*key), (F.col("dim") == F.col("own_dim")) & (F.col("label") == F.col("own_label"))).withColumns(everything)
    first = _best(searched(own.select("asked", "vec_id", "v", *key, *everything), positives), positives)
    pairs = keep(first.select("asked", F.col("rank").alias("part"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "mine-positives")

    # windows in integers: ceil(low * p / 100) to floor(high * p / 100)
    percent = lambda f: f"({f} * positive_score - pmod({f} * positive_score, 100)) div 100"
    windows = pairs.selectExpr("asked", "part", f"-({percent(-low)}) AS lo", f"{percent(high)} AS hi").where("lo <= hi")
    blocks = max(1, math.ceil(anchors.count() / block_anchors))
    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("asked"), F.lit(blocks)))
    copied = boxes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    reach = F.aggregate(F.zip_with("v", "box", lambda x, b: F.greatest(x * b["lo"], x * b["hi"])), F.lit(0).cast("long"), lambda a, b: a + b)
    places = copied.join(dealt, "block").where("dim = own_dim and label <> own_label").select("asked", *key, reach.alias("reach"))
    turn = F.row_number().over(W.partitionBy("asked").orderBy(F.col("reach").desc(), "label", "shard"))
    places = keep(places.withColumn("turn", turn), "mine-places")

    def windowed(places: DataFrame, windows: DataFrame) -> DataFrame:
        """Each anchor with its windows that a shard's box reaches, at that shard."""
        lists = windows.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("part", "lo", "hi"))).alias("w"))  # as many as positives
        w = places.join(lists, "asked").withColumn("w", F.filter("w", lambda x: x["lo"] <= F.col("reach"))).where("size(w) > 0")
        w = w.join(anchors.select("asked", "vec_id", "v"), "asked")
        return w.select("asked", "vec_id", "v", *key, F.col("w.part").alias("parts"), F.col("w.lo").alias("least"), F.col("w.hi").alias("most"))

    home = keep(_best(searched(windowed(places.where("turn = 1"), windows), negatives), negatives), "mine-home")
    kth = home.where(F.col("rank") == negatives).select("asked", "part", F.col("score").alias("kth"))
    raised = windows.join(kth, ["asked", "part"], "left").withColumn("lo", F.greatest("lo", "kth")).drop("kth")
    away = searched(windowed(places.where("turn > 1"), raised), negatives)
    best = _best(home.drop("rank").unionByName(away), negatives)
    ids = anchors.select("asked", F.col("vec_id").alias("anchor_id"))
    out = best.join(pairs, ["asked", "part"]).join(ids, "asked")
    out = keep(out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "mine-found")
    keep.release_all_but(out)
    return out


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").where("label is not null")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    keyed = rows.where("vec_id is not null").select(F.struct("vec_id", label.alias("label")).alias("key"), "embedding")
    vectors = integer_vectors(keyed, "key", "embedding").select("vec_id.vec_id", "vec_id.label", "v")
    return mine_negatives(vectors, F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, c.r, c.vec_id, a.label = c.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT a, anchor_id, r AS p, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, r) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.a, p ORDER BY score DESC, vec_id, r) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.a = p.a AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
