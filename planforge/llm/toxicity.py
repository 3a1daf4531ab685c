"""Toxicity (5): the nearest labelled examples by exact TF-IDF cosine, found with block-max inverted indexes."""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planforge.llm.common import crc_fold, materialize, read

WORD = re.compile(r"\w+")


def term_counts(text: str | None) -> Counter:
    """Counts of the lower-cased words of a whole text."""
    return Counter(WORD.findall(text.lower())) if text else Counter()


class BlockMaxIndex:
    """Unit vectors of labelled examples over all their terms, in blocks; each term knows its largest weight in each block.

    ``examples``: doc_id, label, numbers of terms in the order of sorted(weights) and how often each is there.
    Terms that one in ``dense`` examples holds have a row of weights, the others lists of postings by block.
    """

    def __init__(self, weights: dict[str, float], examples: list[tuple[int, int, np.ndarray, np.ndarray]], block: int = 32, dense: int = 16):
        self.vocabulary = frozenset(weights)
        self.terms = {t: i for i, t in enumerate(sorted(weights))}
        self.weights = np.array([weights[t] for t in sorted(weights)])
        vectors = [(doc, label, *self.weighed(at, n)) for doc, label, at, n in examples]
        # alike examples share blocks, which keeps the block maxima tight
        vectors = sorted((v for v in vectors if len(v[2])), key=lambda v: (int(v[2][v[3].argmax()]), v[1], v[0]))
        self.docs = np.array([v[0] for v in vectors], dtype=np.int64)
        self.labels = np.array([v[1] for v in vectors], dtype=float)
        self.blocks, self.size = -(-len(vectors) // block), block
        sizes = [len(v[2]) for v in vectors]
        of = np.repeat(np.arange(len(vectors)), sizes)
        term, w = (np.concatenate([v[i] for v in vectors]) if vectors else np.zeros(0, kind) for i, kind in ((2, np.int64), (3, float)))
        self.term, self.w_of, self.at = term, w, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        df = np.bincount(term, minlength=len(self.terms))
        self.row = np.where(df * dense >= len(vectors), np.cumsum(df * dense >= len(vectors)) - 1, -1)
        self.rows = np.zeros((int(self.row.max(initial=-1)) + 1, self.blocks * block), dtype=np.float32)
        often = self.row[term] >= 0
        self.rows[self.row[term[often]], of[often]] = w[often]
        cell = term * self.blocks + of // block
        order = np.argsort(cell, kind="stable")
        self.example, self.w = of[order].astype(np.int32), w[order]
        counts = np.bincount(cell, minlength=len(self.terms) * self.blocks)
        self.starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        full = np.flatnonzero(counts)
        self.upper = np.zeros(len(counts), dtype=np.float32)
        if len(full):
            self.upper[full] = np.maximum.reduceat(self.w, self.starts[full]) * (1 + 1e-6)  # 32 bits may round down
        self.upper = self.upper.reshape(len(self.terms), self.blocks)
        self.query = np.zeros(len(self.terms))

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and weights of the terms of a text, of length 1."""
        at = np.array([self.terms.get(t, -1) for t in counts], dtype=np.int64)
        return self.weighed(at[at >= 0], np.array(list(counts.values()))[at >= 0])

    def weighed(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = (1 + np.log(n.astype(float))) * self.weights[at]
        norm = np.sqrt((raw * raw).sum())
        return (at, raw / norm) if norm else (at[:0], raw[:0])

    def sums(self, terms: np.ndarray, q: np.ndarray, blocks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Examples of some blocks (of all for None) and their cosines to about 1e-6."""
        row = self.row[terms]
        often, rare, w = row >= 0, terms[row < 0], q[row < 0]
        if blocks is None:
            lo, hi = self.starts[rare * self.blocks], self.starts[(rare + 1) * self.blocks]
            scores = np.einsum("t,te->e", q[often].astype(np.float32), np.take(self.rows, row[often], axis=0)).astype(float)  # not BLAS: a task has one core
        else:
            cells = (rare[:, None] * self.blocks + blocks).ravel()
            lo, hi, w = self.starts[cells], self.starts[cells + 1], np.repeat(w, len(blocks))
            scores = np.einsum("t,tbe->be", q[often], self.rows.reshape(len(self.rows), self.blocks, self.size)[row[often][:, None], blocks]).ravel()
        n = hi - lo
        lo, w, n = lo[n > 0], w[n > 0], n[n > 0]
        posting = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        example, add = self.example[posting], self.w[posting] * np.repeat(w, n)
        if blocks is None:
            scores += np.bincount(example, add, len(scores))
            return np.arange(len(self.docs)), scores[: len(self.docs)]
        rank = np.zeros(self.blocks, np.int64)
        rank[blocks] = np.arange(len(blocks))
        scores += np.bincount(rank[example // self.size] * self.size + example % self.size, add, len(scores))
        examples = (blocks[:, None] * self.size + np.arange(self.size)).ravel()
        return examples[examples < len(self.docs)], scores[examples < len(self.docs)]

    def nearest(self, counts: dict[str, int], k: int, other_than: int | None = None) -> list[tuple[float, int]]:
        """The k largest cosines and their examples, exactly.

        The blocks of the largest bounds give a k-th cosine; only blocks whose bound reaches it are
        summed. Sums are of 32 bits, so whatever could be among the k is then summed anew in 64.
        """
        terms, q = self.vector(counts)
        if not len(terms) or not len(self.docs):
            return []
        bounds = np.einsum("t,tb->b", q, self.upper[terms])
        order = np.argsort(-bounds, kind="stable")
        examples, scores = self.sums(terms, q, order[:4])
        kth = np.partition(scores, -k - 1)[-k - 1] if len(scores) > k else 0.0  # one more: one of them may be left out
        more = order[4:][bounds[order[4:]] >= kth - 1e-5]
        if 2 * len(more) > self.blocks:
            examples, scores = self.sums(terms, q, None)
        elif len(more):
            also, sums = self.sums(terms, q, more)
            examples, scores = np.concatenate([examples, also]), np.concatenate([scores, sums])
        if other_than is not None:
            examples, scores = examples[self.docs[examples] != other_than], scores[self.docs[examples] != other_than]
        if len(scores) > k:
            examples = examples[scores >= np.partition(scores, -k)[-k] - 1e-5]
        self.query[terms] = q
        spans = [(self.at[e], self.at[e + 1]) for e in examples.tolist()]
        exact = np.array([round(float((self.w_of[a:b] * self.query[self.term[a:b]]).sum()), 12) for a, b in spans])
        self.query[terms] = 0
        best = np.lexsort((self.docs[examples], -exact))[:k]
        return [(float(exact[i]), int(examples[i])) for i in best if exact[i] > 0]


def class_weights(n: int, p: int, df: np.ndarray, a: np.ndarray, base: float = 0.05) -> np.ndarray:
    """How much a term tells of the label: base + phi, phi-square less what chance gives in a sample of n. df: examples with the term, a: toxic ones."""
    spread = df * (n - df) * float(p) * (n - p)
    phi2 = np.divide((a * float(n) - df * float(p)) ** 2, spread, out=np.zeros(len(df)), where=spread > 0)
    return base + np.sqrt(np.maximum(0.0, phi2 - 8.0 / n))


def logistic(raw: np.ndarray, labels: np.ndarray, rounds: int = 25) -> tuple[float, float]:
    """Slope and shift of a logistic calibration, by Newton steps with a small ridge; the slope is not negative."""
    x = np.stack([raw, np.ones(len(raw))], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (p - labels) + 1e-3 * (beta - [1.0, 0.0])
        beta = beta - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), slope)
    return (float(beta[0]), float(beta[1])) if beta[0] >= 0 else (0.0, float(np.log(labels.mean() / (1 - labels.mean()))))


def vote(index: BlockMaxIndex, counts: dict[str, int], prior: float, k: int, weight_of_prior: float, other_than: int | None = None) -> tuple[float, list[int]]:
    """Log odds of the k nearest examples' vote, each weighed by cosine / (0.02 + distance ** 2), drawn to the prior; and their doc_ids."""
    near = index.nearest(counts, k, other_than)
    w = np.array([s / (0.02 + max(0.0, 1 - s) ** 2) for s, _ in near])
    y = index.labels[[i for _, i in near]]
    p = float((w @ y + weight_of_prior * prior) / (w.sum() + weight_of_prior)) if near else prior
    return float(np.log(p / (1 - p))), [int(index.docs[i]) for _, i in near]


_INDEXES: dict[str, tuple[BlockMaxIndex, dict]] = {}


def worker_index(key: str, shared) -> tuple[BlockMaxIndex, dict]:
    """The index of a model and the answers given so far, made once for each Python worker."""
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = (BlockMaxIndex(shared.value["weights"], shared.value["examples"]), {})
    return _INDEXES[key]


def fit(docs: DataFrame, labelled: DataFrame, k: int = 15, weight_of_prior: float = 2.0) -> dict:
    """labelled: doc_id, text, toxic, a bounded sample of labelled rows. Their terms, weights and the calibration.

    All terms of the examples are in the index. A term weighs (1 + log count) * idf * class weight:
    idf is counted over the texts of all of ``docs``, the class weight (see ``class_weights``) on the
    examples. The driver gets the examples' counts and one number for each of their terms. The
    calibration is logistic on the vote that each example gets from the others, which runs on the executors.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, t, c) for d, t, x in zip(pdf["doc_id"], pdf["toxic"], pdf["text"], strict=True) if (c := term_counts(x))]
            if rows:  # an empty column has no list type
                yield pd.DataFrame({"doc_id": [r[0] for r in rows], "toxic": [r[1] for r in rows], "terms": [list(r[2]) for r in rows], "counts": [list(r[2].values()) for r in rows]})

    sizes = labelled.select(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("p")).first()
    n, p = sizes["n"], sizes["p"] or 0
    if p in (0, n):
        return {"weights": {}, "examples": [], "prior": p / n if n else 0.0, "calibration": None}
    got = labelled.mapInPandas(counted, "doc_id long, toxic int, terms array<string>, counts array<int>").collect()
    examples = sorted((r["doc_id"], r["toxic"], sorted(zip(r["terms"], r["counts"], strict=True))) for r in got)
    examples = [(doc, label, dict(counts)) for doc, label, counts in examples]
    held, toxic = Counter(), Counter()
    for _, label, counts in examples:
        held.update(counts.keys())
        if label:
            toxic.update(counts.keys())
    terms = sorted(held)
    context = docs.sparkSession.sparkContext
    known = context.broadcast({t: i for i, t in enumerate(terms)})

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, number = np.zeros(len(known.value) + 1, np.int64), known.value
        for pdf in batches:
            total[-1] += len(pdf)
            for text in pdf["text"].dropna():
                at = [i for t in set(WORD.findall(text.lower())) if (i := number.get(t)) is not None]
                total[at] += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"term": at, "n": total[at]})

    df = np.zeros(len(terms) + 1)
    for r in docs.select("text").mapInPandas(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        df[r["term"]] = r["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    of_class = class_weights(n, p, np.array([held[t] for t in terms], float), np.array([toxic[t] for t in terms], float))
    number = {t: i for i, t in enumerate(terms)}
    packed = [(doc, label, np.array([number[t] for t in counts], np.int32), np.array(list(counts.values()), np.int32)) for doc, label, counts in examples]
    model = {"weights": dict(zip(terms, (idf * of_class).tolist())), "examples": packed, "prior": p / n}
    shared, key = context.broadcast(model), uuid.uuid4().hex

    def from_others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            index, _ = worker_index(key, shared)
            raw = [vote(index, term_counts(x), model["prior"], k, weight_of_prior, d)[0] for d, x in zip(pdf["doc_id"], pdf["text"], strict=True)]
            yield pd.DataFrame({"raw": np.array(raw, float), "toxic": pdf["toxic"]})
        _INDEXES.clear()

    rows = labelled.mapInPandas(from_others, "raw double, toxic int").collect()
    model["calibration"] = logistic(np.array([r["raw"] for r in rows]), np.array([r["toxic"] for r in rows], float))
    return model


def sampled_labels(docs: DataFrame, labels: DataFrame, folds: int, max_examples: int) -> DataFrame:
    """doc_id, text and label of the labelled rows outside fold 0; about ``max_examples`` at most, drawn by a hash of doc_id."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id"), folds) != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    u = F.shiftrightunsigned(F.xxhash64(F.lit(5), "doc_id"), 11) / float(1 << 53)
    few = known.where(u < max_examples / max(n, 1))  # about max_examples rows: safe to broadcast
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")


def scorer(spark: SparkSession, model: dict, k: int = 15, weight_of_prior: float = 2.0):
    """A function of a text column: struct(score, evidence), to be used with any frame; evidence holds the neighbours' doc_ids."""
    shared, model_key = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def answered(texts: pd.Series) -> pd.DataFrame:
        if shared.value["calibration"] is None:
            return pd.DataFrame({"score": np.full(len(texts), shared.value["prior"]), "evidence": [[]] * len(texts)})
        index, seen = worker_index(model_key, shared)
        slope, shift = shared.value["calibration"]
        scores, evidence = [], []
        for text in texts:
            key = hashlib.blake2b((text or "").encode(), digest_size=16).digest()
            if key not in seen:
                if len(seen) >= 5_000:
                    seen.clear()
                raw, near = vote(index, term_counts(text), shared.value["prior"], k, weight_of_prior)
                seen[key] = (1 / (1 + math.exp(-slope * raw - shift)), near)
            scores.append(seen[key][0])
            evidence.append(seen[key][1])
        return pd.DataFrame({"score": pd.Series(scores, dtype=float), "evidence": pd.Series(evidence, dtype=object)})

    @F.pandas_udf("score double, evidence array<bigint>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            for texts in batches:
                yield answered(texts)
        finally:
            _INDEXES.clear()  # a worker that waits for what comes next holds no model

    return lambda text: of(text)


def fitted_scorer(docs: DataFrame, labels: DataFrame, folds: int = 5, max_examples: int = 2000, **options):
    few = materialize(sampled_labels(docs, labels, folds, max_examples), "tox-examples")
    return scorer(docs.sparkSession, fit(docs, few, **options), **options)


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, evidence.

    Labels of fold 0 of crc32(doc_id) are never read. Of several labels of a document the larger
    counts. Up to about ``max_examples`` labelled rows, drawn by a hash, are the examples; that is the
    only bound: all their terms are indexed and whole texts scored. An empty, null or wordless text,
    or one without a term of any example, has no neighbours and gets the calibrated base rate; if all
    labels agree all get that label, without any label 0. Repeated rows are answered alike; an empty
    table gives an empty result. Only doc_id and text are read of other columns, so none can clash.
    """
    of = fitted_scorer(docs, labels, folds, **options)
    held_out = (crc_fold(F.col("doc_id"), folds) == 0).alias("held_out")
    scored = docs.select("doc_id", held_out, of(F.col("text")).alias("p"))
    predicted = F.when(F.col("p.score") >= 0.5, 1).otherwise(0)
    return scored.select("doc_id", "held_out", F.col("p.score").alias("score"), predicted.alias("predicted"), F.col("p.evidence").alias("evidence"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
