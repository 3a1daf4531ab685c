"""Secret scans (3): candidates from whole texts, and a random forest that removes the false positives."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planforge.llm.common import materialize, read
from planforge.llm.langid import load_pieces, vocabulary_path
from planforge.llm.secret_examples import judged_findings

#: A run of 12 or more characters of keys and tokens.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{12,}={0,2}")
#: Three parts of a signed token, joined by dots.
SIGNED = re.compile(r"eyJ[A-Za-z0-9_-]*\.eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*")
#: Published formats of well-known keys, and words before a secret.
FORMATS = re.compile(r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}")
BEFORE = frozenset("password passwd pwd secret token apikey api_key access_key private_key auth credential".split())
#: What is assigned to such a word: up to the closing quote, or to the next blank, quote or angle bracket.
ASSIGNED = re.compile(rf"(?i)(?<!\w)(?:{'|'.join(sorted(BEFORE))})(?!\w)\W{{0,16}}?[=:]\s{{0,16}}(?:\"([^\"\n]+)\"|'([^'\n]+)'|[\"']?([^\s\"'<>]+))")

FINDING = "doc_id long, start int, end int, length int, finding_sha256 string, raw array<float>"
CLASSES = 39
NEIGHBOURS = 12


def _classes() -> np.ndarray:
    """Class of each byte: letters by lower case, digits, and three of other bytes."""
    of = np.full(256, 38, dtype=np.int64)
    of[128:] = 37
    of[[32, 9, 10, 11, 12, 13]] = 36
    for i in range(26):
        of[65 + i] = of[97 + i] = i
    for i in range(10):
        of[48 + i] = 26 + i
    return of


CLASS_OF = _classes()


def transition_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        total = np.zeros(CLASSES * CLASSES, dtype=np.int64)
        for text in pdf["text"].dropna():
            c = CLASS_OF[np.frombuffer(text.encode(), dtype=np.uint8)]
            total += np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
        yield pd.DataFrame({"pair": np.arange(len(total)), "n": total})


def transition_model(docs: DataFrame) -> np.ndarray:
    """Log probability of each character class after another, counted over the whole texts of all documents."""
    got = docs.select("text").mapInPandas(transition_counts, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    n = np.ones(CLASSES * CLASSES)
    for r in got:
        n[r["pair"]] += r["n"]
    n = n.reshape(CLASSES, CLASSES)
    return np.log(n / n.sum(axis=1, keepdims=True))


def covered(text: str, dictionary: frozenset[str], longest: int = 10) -> float:
    """Share of characters under dictionary words of three letters or more, longest first."""
    text, at, hit = text.lower(), 0, 0
    while at < len(text):
        size = next((n for n in range(min(longest, len(text) - at), 2, -1) if text[at : at + n] in dictionary), 0)
        hit += size
        at += size or 1
    return hit / len(text) if text else 0.0


def _bucket(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=4).digest(), "big") % NEIGHBOURS


_SHAPES: dict[str, list[float]] = {}


def shape(value: str, log_p: np.ndarray, dictionary: frozenset[str]) -> list[float]:
    """Features of the value alone: length, transitions, spread, entropy, dictionary coverage, kinds of characters. The last are remembered."""
    if value in _SHAPES:
        return _SHAPES[value]
    raw = np.frombuffer(value.encode(), dtype=np.uint8)
    c = CLASS_OF[raw]
    steps = log_p[c[:-1], c[1:]] if len(c) > 1 else np.zeros(1)
    counts = np.bincount(raw)
    share = counts[counts > 0] / len(raw)
    n = len(value)
    out = [n, float(steps.mean()), float(steps.min()), float(np.abs(np.diff(c)).mean()) if len(c) > 1 else 0.0, float(-(share * np.log2(share)).sum()), covered(value, dictionary)]
    out += [sum(map(str.isdigit, value)) / n, sum(map(str.isupper, value)) / n, sum(map(str.islower, value)) / n, value.count("/") / n, value.count("-") / n, value.count("_") / n, value.count(".") / n]
    if len(_SHAPES) >= 50_000:
        _SHAPES.clear()
    _SHAPES[value] = out
    return out


def describe(text: str, start: int, end: int, log_p: np.ndarray, dictionary: frozenset[str]) -> list[float]:
    """Features of the candidate text[start:end]: its shape, path marks around it and hashed neighbouring words."""
    before, after = text[max(0, start - 48) : start], text[end : end + 32]
    near = [0.0] * (3 * NEIGHBOURS)
    words = re.findall(r"\w+", before.lower())[-2:][::-1] + [None, None]
    for i, w in enumerate([*words[:2], *re.findall(r"\w+", after.lower())[:1]]):  # the nearest, the one before it, the next
        if w:
            near[i * NEIGHBOURS + _bucket(w)] = 1.0
    marks = (words[0] in BEFORE, bool(re.search(r"[=:]\s*[\"']?$", before)), before[-1:] in ("/", ".", "\\", "@"), after[:1] in ("/", "\\", "@"), "://" in before[-24:], bool(re.match(r"\.[A-Za-z]{2,4}\b", after)))
    return [*shape(text[start:end], log_p, dictionary), *map(float, marks), *near]


def spans(text: str, judged: tuple[int, ...] = ()) -> list[tuple[int, int]]:
    """Start and end of every candidate, one for each start.

    Candidates are all runs of 12 or more of ``A-Z a-z 0-9 + / _ -``, whatever is assigned to a word of
    ``BEFORE`` (any length, any characters), every match of ``FORMATS`` and every signed token, and
    what stands up to the next blank at a ``judged`` start. Of two with one start, a known format goes
    before the longer.
    """
    found = [m.span() for pattern in (CANDIDATE, FORMATS, SIGNED) for m in pattern.finditer(text)]
    for m in ASSIGNED.finditer(text):
        start = m.start(m.lastindex)
        found.append((start, start + len(m[m.lastindex].rstrip(",;") or m[m.lastindex])))
    known = {start for start, _ in found}
    found += [(x, m.end()) for x in judged if x not in known and (m := re.compile(r"\S+").match(text, x))]
    best: dict[int, tuple[bool, int]] = {}
    for start, end in found:
        best[start] = max(best.get(start, (False, 0)), (bool(FORMATS.fullmatch(text, start, end)), end))
    return [(start, end) for start, (_, end) in sorted(best.items())]


def _find(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log_p, dictionary = shared.value
        for pdf in batches:
            out = []
            judged = pdf["judged"] if "judged" in pdf else [None] * len(pdf)
            for doc, text, starts in zip(pdf["doc_id"], pdf["text"], judged, strict=True):
                for start, end in spans(text or "", () if starts is None else tuple(starts)):
                    digest = hashlib.sha256(text[start:end].encode()).hexdigest()
                    out.append((None if pd.isna(doc) else int(doc), start, end, end - start, digest, describe(text, start, end, log_p, dictionary)))
            yield pd.DataFrame(out, columns=["doc_id", "start", "end", "length", "finding_sha256", "raw"]).astype({"doc_id": "Int64"})

    return run


def background(docs: DataFrame, path: str | None = None) -> tuple[np.ndarray, frozenset[str]]:
    """Transitions of the documents' characters, and the dictionary: pieces of the public vocabulary of three letters or more."""
    return transition_model(docs), frozenset(p.lstrip("▁") for p in load_pieces(path or vocabulary_path()) if len(p.lstrip("▁")) > 2)


def candidates(docs: DataFrame, model: tuple[np.ndarray, frozenset[str]], labelled: DataFrame | None = None) -> DataFrame:
    """Every candidate (see ``spans``) of every whole text with its features; the value itself is only given as a digest."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text")
    if labelled is not None:
        rows = rows.join(labelled.groupBy("doc_id").agg(F.collect_set(F.col("start").cast("int")).alias("judged")), "doc_id", "left")
    return rows.mapInPandas(_find(shared), FINDING)


def examples(spark: SparkSession, model: tuple[np.ndarray, frozenset[str]], findings: list[tuple[str, int, int, str]]) -> DataFrame:
    """raw, label and kind of judged findings (see ``judged_findings``), described like any others."""
    rows = spark.createDataFrame([(i, *f) for i, f in enumerate(findings)], "doc_id long, text string, start int, label int, kind string").repartition(4)
    judged = rows.select("doc_id", "start", "label", "kind")
    return candidates(rows, model, judged).join(judged, ["doc_id", "start"]).select("raw", "label", "kind")


def train_forest(labelled: DataFrame, trees: int = 40, depth: int = 10, seed: int = 3) -> RandomForestClassificationModel:
    """labelled: raw, label."""
    rows = labelled.select(array_to_vector("raw").alias("features"), F.col("label").cast("double").alias("label"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)


def scored_by(forest: RandomForestClassificationModel, found: DataFrame) -> DataFrame:
    return forest.transform(found.withColumn("features", array_to_vector("raw"))).withColumn("score", vector_to_array("probability")[1])


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, max_findings: int = 20000, at_least: float = 0.5, path: str | None = None) -> DataFrame:
    """One row per candidate: doc_id, start, end, length, finding_sha256, score, is_secret.

    ``labelled`` (doc_id, start, label) holds findings in docs that people have judged; without it the
    judged findings of ``secret_examples`` are learned from, which follow published formats and usual
    near misses and owe nothing to docs. The forest is trained on about ``max_findings`` labelled
    findings at most, drawn by a hash, and sees length, character transitions (counted over all
    docs), entropy, dictionary coverage, path marks and hashed neighbouring words, not the formats.
    All candidates of all whole texts are scored; ``spans`` says what is one.

    Null and empty texts have no candidates; a text's candidates are held in memory together. If all
    labels agree, every score is that label; without any it is 0. Of several labels of one finding the
    larger counts. Repeated rows are scanned each; an empty table gives an empty result. Only doc_id and text are
    read of docs, so other columns can't clash.
    """
    model = background(docs, path)
    found = materialize(candidates(docs, model, labelled), "secret-findings")
    if labelled is None:
        known = examples(docs.sparkSession, model, judged_findings())
    else:
        known = found.join(labelled.groupBy("doc_id", "start").agg(F.max("label").alias("label")), ["doc_id", "start"])
    known = materialize(known.select("raw", "label"), "secret-known")
    totals = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("p")).first()
    if totals["p"] in (0, totals["n"]):
        scored = found.withColumn("score", F.lit(float(totals["p"] > 0)))
    else:
        u = F.shiftrightunsigned(F.xxhash64(F.lit(3), "raw"), 11) / float(1 << 53)
        forest = train_forest(known.where(u < max_findings / totals["n"]))
        scored = scored_by(forest, found)
    return scored.select("doc_id", "start", "end", "length", "finding_sha256", "score", (F.col("score") >= at_least).alias("is_secret"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents"))
