"""Language ID (2): unigram pieces per language, with every segmentation of a word summed."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planforge.llm.common import crc_fold, materialize, read

#: A word is a maximal run of letters of the lower-cased text.
LETTERS = re.compile(r"[^\W\d_]+")
START = "▁"


def vocabulary_path() -> str:
    """The public piece vocabulary: a setting of the environment, else the installed files."""
    if at := os.environ.get("PLANFORGE_VOCABULARY"):
        return at
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        raise FileNotFoundError("set PLANFORGE_VOCABULARY to the path of a sentencepiece model, such as piece_bpe_32k.model") from None
    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> list[str]:
    """The lower-case letter pieces of a public vocabulary, with or without the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if p == p.lower() and LETTERS.fullmatch(p.removeprefix(START))})


class Lattice:
    """All segmentations of words into pieces; a character of no piece is one of the class ``unknown``."""

    def __init__(self, pieces: list[str]):
        self.index = {p: i for i, p in enumerate(pieces)}
        self.unknown, self.none = len(pieces), len(pieces) + 1
        self.longest = max(map(len, pieces), default=1)
        self.begun = {p[:n] for p in pieces for n in range(1, len(p) + 1)}

    def edges(self, words: list[str]) -> np.ndarray:
        """For marked words of one length: [word, end, size - 1] = piece that ends there, or ``none``; up to the longest size there is."""
        n = len(words[0])
        out = np.full((len(words), n + 1, min(self.longest, n)), self.none, dtype=np.int32)
        get, begun = self.index.get, self.begun
        for row, word in zip(out, words):
            for start in range(n):
                for end in range(start + 1, n + 1):
                    part = word[start:end]
                    if part not in begun:
                        break
                    if (p := get(part)) is not None:
                        row[end, end - start - 1] = p
        single = out[:, 1:, 0]
        single[single == self.none] = self.unknown
        used = np.flatnonzero((out != self.none).any(axis=(0, 1)))
        return out[:, :, : used[-1] + 1]

    def forward(self, edges: np.ndarray, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """prob: [piece, language]. Scaled forward sums [word, end, language] and the log of each step's scale."""
        words, ends, longest = edges.shape
        alpha = np.zeros((words, ends, prob.shape[1]))
        logs = np.zeros((words, ends, prob.shape[1]))
        alpha[:, 0] = 1
        for end in range(1, ends):
            total, back = 0.0, 1.0
            for size in range(1, min(longest, end) + 1):
                total = total + alpha[:, end - size] * back * prob[edges[:, end, size - 1]]
                back = back * np.exp(-logs[:, end - size])  # brings earlier sums to the scale of this step
            logs[:, end] = np.log(total)
            alpha[:, end] = 1
        return alpha, logs


def log_likelihood(lattice: Lattice, words: list[str], prob: np.ndarray) -> np.ndarray:
    """[word, language]: the log of the sum over all segmentations of each word."""
    out = np.zeros((len(words), prob.shape[1]))
    for at, group in by_length(words):
        out[at] = lattice.forward(lattice.edges(group), prob)[1].sum(axis=1)
    return out


def by_length(words: list[str], cells: int = 200_000) -> Iterator[tuple[list[int], list[str]]]:
    """Blocks of marked words of one length, small enough to hold their lattices."""
    lengths: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        lengths.setdefault(len(w), []).append(i)
    for n, at in lengths.items():
        step = max(1, cells // (n + 1))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            yield part, [START + words[i] for i in part]


def expected_counts(lattice: Lattice, words: list[str], weights: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """E-step for one language: how often each piece is used, over all segmentations of the weighted words."""
    out = np.zeros(lattice.none + 1)
    column = prob[:, None]
    for at, group in by_length(words, 50_000):
        edges = lattice.edges(group)
        logs = lattice.forward(edges, column)[1][:, :, 0]
        ahead = np.cumsum(logs, axis=1)  # log of the forward sums
        n = edges.shape[1]
        behind = np.full((len(group), n), -np.inf)
        behind[:, -1] = 0
        w = weights[at]
        for end in range(n - 1, 0, -1):
            for size in range(1, min(edges.shape[2], end) + 1):
                piece = edges[:, end, size - 1]
                with np.errstate(divide="ignore"):
                    step = np.log(prob[piece]) + behind[:, end]
                used = np.exp(ahead[:, end - size] + step - ahead[:, -1]) * w
                np.add.at(out, piece, used)
                behind[:, end - size] = np.logaddexp(behind[:, end - size], step)
    out[lattice.none] = 0
    return out


def normalised(counts: np.ndarray, smooth: float = 0.1) -> np.ndarray:
    """Probabilities of the pieces and of ``unknown``; ``none`` stays impossible."""
    p = counts + smooth
    p[-1] = 0
    return p / p.sum()


def word_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    words = pdf["text"].map(lambda t: LETTERS.findall(t.lower()))
    long = pd.DataFrame({"lang": pdf["lang"], "word": words}).explode("word").dropna()
    return long.groupby(["lang", "word"]).size().rename("n").reset_index()


def train(labelled: DataFrame, docs_per_lang: int = 400, rounds: int = 4, path: str | None = None) -> dict:
    """labelled: text, lang, key. Piece probabilities per language by expectation maximisation.

    At most about ``docs_per_lang`` documents of a language are used, drawn by a hash of ``key``
    below count-dependent thresholds; whole texts of those are. Words are counted and each E-step
    runs on the executors; the driver gets one number per language and piece.
    """
    pieces = load_pieces(path or vocabulary_path())
    lattice = Lattice(pieces)
    have = labelled.groupBy("lang").agg(F.count("*").alias("have"))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(2), "key"), 11) / float(1 << 53)
    sample = labelled.join(have, "lang").where(u < F.lit(float(docs_per_lang)) / F.col("have")).select("lang", "text")
    counted = sample.mapInPandas(lambda it: (word_counts(p) for p in it), "lang string, word string, n long")
    counted = materialize(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    langs = sorted(r["lang"] for r in have.select("lang").collect())
    prob = np.tile(normalised(np.ones(lattice.none + 1))[:, None], (1, len(langs)))

    for _ in range(rounds if langs else 0):
        shared = counted.sparkSession.sparkContext.broadcast((lattice, langs, prob))

        def step(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            lattice, langs, prob = shared.value
            for pdf in batches:
                for lang, part in pdf.groupby("lang"):
                    got = expected_counts(lattice, part["word"].tolist(), part["n"].to_numpy(float), prob[:, langs.index(lang)])
                    at = np.flatnonzero(got)
                    yield pd.DataFrame({"lang": lang, "piece": at, "n": got[at]})

        got = counted.mapInPandas(step, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        prob = np.stack([normalised(np.bincount(p["piece"], p["n"], lattice.none + 1)) for p in (got[got["lang"] == x] for x in langs)], axis=1)
    return {"pieces": pieces, "langs": langs, "prob": prob}


class Scorer:
    """Scores texts under all languages; remembers the sums of up to ``most`` words."""

    def __init__(self, model: dict, most: int = 400_000):
        self.lattice, self.langs, self.prob, self.most = Lattice(model["pieces"]), model["langs"], model["prob"], most
        self.rows: dict[str, int] = {}
        self.known = np.zeros((0, len(self.langs)))

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = [LETTERS.findall(t.lower()) if t else [] for t in texts]
        new = {w for words in found for w in words}.difference(self.rows)
        if len(self.rows) + len(new) > self.most:
            self.rows, self.known = {}, self.known[:0]
            new = {w for words in found for w in words}
        if new:
            new = sorted(new)
            self.known = np.concatenate([self.known, log_likelihood(self.lattice, new, self.prob)])
            self.rows.update(zip(new, range(len(self.rows), len(self.known))))
        langs, scores = [], []
        get = self.rows.__getitem__
        for words in found:
            if not words or not self.langs:
                langs.append("und")
                scores.append(0.0)
                continue
            total = self.known[list(map(get, words))].sum(axis=0)
            k = int(total.argmax())
            langs.append(self.langs[k])
            scores.append(float(1 / np.exp(total - total[k]).sum()))
        return langs, scores


_SCORERS: dict[str, Scorer] = {}


def worker_scorer(key: str, shared) -> Scorer:
    """The scorer of a model, made once for each Python worker."""
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(shared.value)
    return _SCORERS[key]


def predict(spark: SparkSession, model: dict):
    """A function of a text column: struct(lang, score), to be used with any frame."""
    shared, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.pandas_udf("lang string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        scorer, langs, scores = worker_scorer(key, shared), [], []
        for at in range(0, len(texts), 256):
            a, b = scorer.score(texts.iloc[at : at + 256].tolist())
            langs += a
            scores += b
        return pd.DataFrame({"lang": langs, "score": scores})

    return lambda text: of(text)


def identify_languages(docs: DataFrame, held_out: Column, **options) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learns from text and non-null lang of the rows that are not held out and scores every whole text.
    The score is the posterior of the best language under equal priors. Null texts, and texts
    without a letter, are ``und`` with score 0, as are all if nothing could be learned; ties go to
    the first language by name. Repeated rows are answered alike; an empty table gives an empty
    result. Only doc_id, text and lang are read, so other columns can't clash. The time of a word
    grows with its length, as does the memory (a number per letter and language).
    """
    labelled = docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.col("doc_id").alias("key"))
    of = predict(docs.sparkSession, train(labelled, **options))
    scored = docs.select("doc_id", held_out.alias("held_out"), of(F.col("text")).alias("p"))
    return scored.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read(spark, sf_dir, "documents"), crc_fold(F.col("doc_id"), 4) == 2)
