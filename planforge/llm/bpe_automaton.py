"""BPE encoding and decoding (13): a tokenization automaton, compiled from the merges by successive gadgets."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planforge.llm.common import in_slices, read

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

#: Fixed value: the white space of Unicode, by which byte-level vocabularies split.
SPACE = "\\t-\\r \\x85\\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A text with a character outside these blocks is split by the library: Unicode versions of regex engines differ there.
UNCOMMON = re.compile("[^\\x00-\u024f\u2000-\u206f\u20a0-\u20bf\u2190-\u23ff\u2500-\u25ff]")


def _word_pattern() -> re.Pattern:
    """Contractions; a run of letters, of digits or of others, each with a space before it; white space."""
    of = lambda kind: re.escape("".join(c for c in map(chr, range(0x250)) if regex.match(rf"\p{{{kind}}}", c)))
    letter, digit = of("L"), of("N")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?[^{SPACE}{letter}{digit}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


WORDS = _word_pattern()


def byte_of_char() -> dict[str, int]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """ids, byte labels, merges in order and special strings of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte, model = byte_of_char(), spec["model"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        label = {token: bytes(byte[c] for c in token) for token in model["vocab"] if token not in self.special}
        self.ids = {label[t]: i for t, i in model["vocab"].items() if t in label}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = [(label[u], label[v]) for u, v in pairs]


class TokenizationAutomaton:
    """A deterministic automaton over tokens that accepts exactly the sequences that the merges give.

    It starts as one state that every byte leads back to. The gadget of a merge (u, v) -> w sends all
    arcs of u to a copy of their state that has lost the arc of v, and gives each state with an arc
    of u one of w, to where v led. So all arcs of a token lead to one state, and a state is a chain
    of (parent, lost arc).

    A state that lost v has no later token either that begins with v by merges: in the tree of left
    parts, children in descending order of their merge, those tokens and v are one interval of the
    pre-order. Hence an arc exists where its token's place is in none of the intervals of the
    state's chain, which one search in a sorted array tells.

    Each prefix of a word has one accepted sequence, so one state per byte position suffices: the
    tokens that match there are found in a trie, and the arc of one of them leads on.
    """

    def __init__(self, vocabulary: Vocabulary):
        base = [bytes([b]) for b in range(256)]
        number = {t: i for i, t in enumerate(base)}
        left, right = [-1] * 256, [-1] * 256
        for u, v in vocabulary.merges:
            if u + v in number:
                raise ValueError(f"two merges make {u + v!r}")
            number[u + v] = len(left)
            left.append(number[u])
            right.append(number[v])
        labels = list(number)
        place, ends = self._pre_order(left)
        # states: chains of lost arcs; 0 has all arcs
        parent, lost, target = [0], [(0, 0)], [0] * 256
        dead = set()
        for w in range(256, len(labels)):
            u, v = left[w], right[w]
            if u in dead or v in dead or self._lacks(parent, lost, target[u], place[v]):
                dead.add(w)  # v never follows u, so the merge never happens
                target.append(0)
                continue
            target.append(target[v])
            parent.append(target[u])
            lost.append((place[v], ends[v](w)))
            target[u] = len(parent) - 1
        self._flatten(parent, lost, target)
        self.place = np.array(place, np.int64)
        self.target = np.array([self.rank[s] for s in target], np.int64)
        self.ids = np.array([vocabulary.ids.get(t, -1) for t in labels], np.int64)
        self._compile_trie(labels, dead)
        self.length = np.array([len(t) for t in labels], np.int64)
        self.longest = int(self.length.max())
        size = max([*vocabulary.ids.values(), *vocabulary.special.values()]) + 1
        self.labels = [b""] * size  # of arcs, by id
        for t, i in vocabulary.ids.items():
            self.labels[i] = t
        for t, i in vocabulary.special.items():
            self.labels[i] = t.encode()
        self.special = vocabulary.special

    @staticmethod
    def _pre_order(left: list[int]) -> tuple[list[int], dict[int, Callable[[int], int]]]:
        """Places of tokens, later merges first among the children; and for v a function: w -> end of v and its children from w on."""
        kids: dict[int, list[int]] = {}
        for w, u in enumerate(left):
            kids.setdefault(u, []).append(w)  # ascending
        size = [1] * len(left)
        for w in range(len(left) - 1, 255, -1):
            size[left[w]] += size[w]
        place, todo, at = [0] * len(left), list(range(256)), 0
        while todo:
            t = todo.pop()
            place[t] = at
            at += 1
            todo += kids.get(t, [])  # the last, so the latest, is taken first

        def end(v: int) -> Callable[[int], int]:
            def after(w: int) -> int:
                return place[v] + 1 + sum(size[k] for k in kids.get(v, []) if k >= w)

            return after

        return place, {v: end(v) for v in range(len(left))}

    @staticmethod
    def _lacks(parent: list[int], lost: list[tuple[int, int]], state: int, place: int) -> bool:
        while state:
            lo, hi = lost[state]
            if lo <= place < hi:
                return True
            state = parent[state]
        return False

    def _flatten(self, parent: list[int], lost: list[tuple[int, int]], target: list[int]) -> None:
        """The states that arcs lead to, numbered anew, each with the union of its chain's intervals in one sorted array."""
        self.rank = {s: i for i, s in enumerate(dict.fromkeys([0, *target]))}
        self.span = len(target) + 1
        starts, stops = [], []
        for s, i in self.rank.items():
            chain = []
            while s:
                chain.append(lost[s])
                s = parent[s]
            end = -1
            for lo, hi in sorted(chain):
                if lo > end:  # intervals are nested or apart
                    starts.append(i * self.span + lo)
                    stops.append(i * self.span + hi)
                    end = hi - 1
        self.starts, self.stops = np.array([-1, *starts], np.int64), np.array([-1, *stops], np.int64)

    def _compile_trie(self, labels: list[bytes], dead: set[int]) -> None:
        """Sorted keys node * 256 + byte, the nodes that they lead to, and the token that ends at each node."""
        step: dict[int, int] = {}
        ends = [-1]
        for t, label in enumerate(labels):
            if t in dead:
                continue
            node = 0
            for b in label:
                key = node << 8 | b
                if key not in step:
                    step[key] = len(ends)
                    ends.append(-1)
                node = step[key]
            ends[node] = t
        keys = np.fromiter(step, np.int64, len(step))
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.fromiter(step.values(), np.int64, len(step))[order]
        self.ends = np.array(ends, np.int64)

    def _matches(self, text: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and token of every token that occurs inside a word; stop: the end of each byte's word."""
        at, node = np.arange(len(text)), np.zeros(len(text), np.int64)
        found = []
        for n in range(self.longest):
            inside = at + n < stop[at]
            at, node = at[inside], node[inside]
            key = node << 8 | text[at + n]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[i] == key
            at, node = at[hit], self.next[i[hit]]
            if not len(at):
                break
            token = self.ends[node]
            done = token >= 0
            found.append((at[done], at[done] + n + 1, token[done]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (at, at, at)

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word: all words take the transitions of their j-th byte together."""
        sizes = np.array([len(w) for w in words], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        stop = np.repeat(first[1:], sizes)
        start, end, token = self._matches(text, stop)
        offset = start - np.repeat(first[:-1], sizes)[start]
        order = np.argsort(offset, kind="stable")
        start, end, token = start[order], end[order], token[order]
        cuts = np.searchsorted(offset[order], np.arange((sizes.max() if len(sizes) else 0) + 1))
        # places in text are shifted by the word's number, so that a word's end is not the next one's start
        shift = np.repeat(np.arange(len(words)), sizes)[start] if len(start) else start
        start, end = start + shift, end + shift
        state, came = np.zeros(len(text) + len(words), np.int64), np.full(len(text) + len(words), -1, np.int64)
        place, target = self.place[token], self.target[token]
        for a, b in zip(cuts, cuts[1:]):
            key = state[start[a:b]] * self.span + place[a:b]
            arc = self.stops[np.searchsorted(self.starts, key, "right") - 1] <= key
            to = end[a:b][arc]
            state[to], came[to] = target[a:b][arc], token[a:b][arc]
        # back along the arcs, all words together, so the last token of each comes first
        word = np.arange(len(words))
        here, begin = first[1:] + word, first[:-1] + word
        words_of, tokens = [], []
        while len(here := here[live := here > begin]):
            word, begin = word[live], begin[live]
            words_of.append(word)
            tokens.append(came[here])
            here = here - self.length[came[here]]
        if not tokens:
            return [np.zeros(0, "<u4") for _ in words]
        word, ids = np.concatenate(words_of[::-1]), self.ids[np.concatenate(tokens[::-1])]
        if (ids < 0).any():
            raise ValueError("a word has a byte that is no token of the vocabulary")
        order = np.argsort(word, kind="stable")
        return np.split(ids[order].astype("<u4"), np.cumsum(np.bincount(word, minlength=len(words)))[:-1])

    def decode(self, ids: np.ndarray) -> str:
        """The labels of the arcs, joined; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.labels.__getitem__, ids.tolist())).decode("utf-8", "replace")


class Tokenizer:
    """Encodes and decodes texts by an automaton, and remembers the ids of up to ``most_words`` words."""

    def __init__(self, automaton: TokenizationAutomaton, most_words: int = 250_000):
        self.automaton, self.most_words = automaton, most_words
        self.known: dict[str, bytes] = {s: np.array([i], "<u4").tobytes() for s, i in automaton.special.items()}
        self.always = dict(self.known)
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(automaton.special, key=len, reverse=True))) + ")") if automaton.special else None

    def words(self, text: str) -> list[str]:
        """The words of a text; a special string is a word, and what is between them is split by itself."""
        if self.at_special is None or not self.at_special.search(text):
            return split_words(text)
        return [w for i, part in enumerate(self.at_special.split(text)) for w in ([part] if i % 2 else split_words(part))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [self.words(t) for t in texts]
        all_words = set().union(*split)
        new = list(all_words - self.known.keys())
        if len(self.known) + len(new) > self.most_words:
            self.known = dict(self.always)
            new = list(all_words - self.known.keys())
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            self.known.update(zip(some, (x.tobytes() for x in self.automaton.encode([w.encode() for w in some])), strict=True))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u4") for words in split]


def split_words(text: str) -> list[str]:
    """The words of a text without special strings."""
    if text.isascii() or not UNCOMMON.search(text):
        return WORDS.findall(text)
    from tokenizers import pre_tokenizers

    return [text[a:b] for _, (a, b) in pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)]


def with_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with two more columns: the ids of each whole text as an array of ints, and what they decode to.

    ``vocabulary`` is the path of a tokenizer file; it is read and compiled on the driver, and the
    automaton, whose size the vocabulary fixes, is broadcast. Rows are encoded where they are,
    without a shuffle. Null texts count as empty and give no ids; ties can't arise, repeated rows
    are encoded each, an empty table gives an empty result. Columns of docs named like the new
    ones are replaced. One text is the work of one task.
    """
    schema = docs.drop(ids, decoded).select("*", F.lit(None).cast("array<int>").alias(ids), F.lit(None).cast("string").alias(decoded)).schema

    def rows(batch: pa.RecordBatch, found: list[np.ndarray], automaton: TokenizationAutomaton) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        flat = np.concatenate([*found, np.zeros(0, "<u4")]).astype(np.int32)
        more = [pa.ListArray.from_arrays(offsets, flat), pa.array([automaton.decode(x) for x in found], pa.string())]
        return pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, ids, decoded])

    return docs.drop(ids, decoded).mapInArrow(_encoder(docs.sparkSession, vocabulary, text_col, rows), schema)


def token_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, computed where the ids are made; cases as in ``with_tokens``."""

    def rows(batch: pa.RecordBatch, found: list[np.ndarray], automaton: TokenizationAutomaton) -> pa.RecordBatch:
        sha = lambda data: hashlib.sha256(data).hexdigest()
        more = [[len(x) for x in found], [sha(x.tobytes()) for x in found], [sha(automaton.decode(x).encode()) for x in found]]
        columns = [batch.column("doc_id"), pa.array(more[0], pa.int64()), pa.array(more[1], pa.string()), pa.array(more[2], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encoder(docs.sparkSession, vocabulary, "text", rows), ENCODED)


def _encoder(spark: SparkSession, vocabulary: str, text_col: str, rows: Callable) -> Callable:
    shared = spark.sparkContext.broadcast(TokenizationAutomaton(Vocabulary(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(shared.value)
        for batch in batches:
            for part in in_slices(batch, text_col):
                yield rows(part, tokenizer.encode([t or "" for t in part.column(text_col).to_pylist()]), shared.value)

    return run


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(read(spark, sf_dir, "documents"), os.environ.get("PLANFORGE_BPE", public_tokenizers.path("byte_bpe_50k.json")))
