"""Suffix-array dedup (10): removes every byte of a long string that starts somewhere else too.

Blockwise construction over a cover sample. The suffixes that matter are the starts of ``length``-byte
strings. A sample of positions is chosen by content: in each string the position whose 64-byte block
hashes lowest. Like a difference cover it has the property that two equal strings both hold a sample
position at one displacement, but it takes 1.7 % of all positions, where the smallest arithmetic cover that
leaves blocks of this size takes 9 %.

1. The sample's blocks are ranked first, one hash bucket at a time: a block that is there once rules
   out every suffix that is assigned to it. So are the stretches from one sample position over the
   next until every suffix between the two is inside: a stretch found more than once decides all of
   those, and only one of its places goes on to step 2.
2. The remaining suffixes go to buckets by fingerprint and are sorted one bucket at a time. Ties
   of any length are decided by an 80-bit fingerprint of the whole string, never by comparing byte
   by byte, so a bucket needs memory for its fingerprints only.
3. Suffixes found more than once go back to their documents, which drop the bytes they cover.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planforge.llm.common import read
from planforge.llm.rolling import Rolling, mix, sliding_least

BLOCK = 64
#: Documents are worked on in segments of so many suffixes, which bounds the arrays of a long one.
SEGMENT = 1 << 20

MARKS = pa.schema([("part", pa.int64()), ("bucket", pa.int64()), ("kind", pa.int32()), ("first", pa.binary()), ("second", pa.binary()), ("twice", pa.binary())])
FLAGS = pa.schema([("part", pa.int64()), ("bucket", pa.int64()), ("kind", pa.int32()), ("flags", pa.binary()), ("chosen", pa.binary())])
KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
DDL = {
    "marks": "part bigint, bucket bigint, kind int, first binary, second binary, twice binary",
    "flags": "part bigint, bucket bigint, kind int, flags binary, chosen binary",
    "kept": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
}


class Strings:
    """80-bit fingerprints of any substrings of a segment."""

    def __init__(self, data: np.ndarray):
        self.data, self.sums = data, Rolling(data)

    def of(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "others"):
            values = (mix(np.arange(256, dtype=np.uint64) + np.uint64(977)) & np.uint64(255)).astype(np.uint8)
            # the same sum over other values of the bytes, each with its left neighbour inside the string
            self.others = Rolling(values[self.data] ^ np.roll(self.data, 1))
        return self.sums.of(start, end), (self.others.of(start + 1, end) >> np.uint64(48)).astype(np.uint16)


def sample_positions(strings: Strings, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of a segment: sampled positions, hashes of their blocks, how many suffixes are assigned to each, size of a block."""
    block = min(BLOCK, length)
    hashes = strings.sums.windows(block)
    low = np.uint64((1 << 21) - 1)  # the leftmost of equal hashes: the position decides
    at = (sliding_least((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - block + 1) & low).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
    places = at[cuts[:-1]]
    return places, hashes[places], np.diff(cuts), block


def stretches(places: np.ndarray, block: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the sample positions that have one: number in places, and end of the stretch that holds all suffixes up to the next."""
    if len(places) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = np.searchsorted(places, places[1:] + length - 1 - block)
    t = np.flatnonzero(last < len(places))
    return t, places[last[t]] + block


def _segments(text: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    data = np.frombuffer(text, dtype=np.uint8)
    for at in range(0, len(data) - length + 1, SEGMENT):
        yield at, data[at : at + SEGMENT + length - 1]


def _distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the fingerprints and where each distinct one begins in it."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], second[order]
    same, other = a[1:] == a[:-1], b[1:] != b[:-1]
    if np.any(same & other):
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        same, other = a[1:] == a[:-1], b[1:] != b[:-1]
    return order, np.concatenate([[True], ~same | other]) if len(first) else np.zeros(0, bool)


def _planes(values: np.ndarray) -> bytes:
    """Bytes of sorted values by significance, which the shuffle's compression makes use of."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


class Marks:
    """The fingerprints of one part, distinct and in order, cut into buckets; ``known`` are there twice for sure."""

    def __init__(self, first: np.ndarray, second: np.ndarray, buckets: int, known: np.ndarray | None = None):
        self.order, begins = _distinct(first, second)
        starts = np.flatnonzero(begins)
        self.group = np.cumsum(begins) - 1
        self.leader = np.zeros(len(first), dtype=bool)  # the first place of each in this part: the sort is stable
        self.leader[self.order[starts]] = True
        self.first, self.second = first[self.order][starts], second[self.order][starts]
        self.twice = np.diff(np.append(starts, len(first))) > 1
        if known is not None and len(starts):
            self.twice |= np.logical_or.reduceat(known[self.order], starts)
        bucket = (self.first >> np.uint64(32)).astype(np.int64) * buckets >> 32
        begins = np.flatnonzero(np.diff(bucket, prepend=-1))  # of the buckets that hold any
        self.spans = {b: slice(lo, hi) for b, lo, hi in zip(bucket[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(bucket)])}

    def rows(self, part: int, kind: int) -> list[dict]:
        return [
            {"part": part, "bucket": b, "kind": kind, "first": _planes(self.first[s]), "second": self.second[s].tobytes() if kind else b"", "twice": np.packbits(self.twice[s]).tobytes()}
            for b, s in self.spans.items()
        ]

    def flagged(self, flags: dict[int, bytes]) -> np.ndarray:
        """For each fingerprint given, in the order given: the bit of its bucket."""
        found = np.zeros(len(self.first), dtype=bool)
        for b, bits in flags.items():
            s = self.spans[b]
            found[s] = _bits(bits, s.stop - s.start)
        out = np.zeros(len(self.order), dtype=bool)
        out[self.order] = found[self.group]
        return out


def sort_bucket(table: pa.Table) -> pa.Table:
    """One bucket of suffixes (blocks, stretches) of all parts: which are there more than once, and one place of each chosen."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    firsts = [_from_planes(r["first"], np.uint64) for r in rows]
    first = np.concatenate(firsts)
    second = np.concatenate([np.frombuffer(r["second"], np.uint16) for r in rows]) if rows[0]["kind"] else np.zeros(len(first), np.uint16)
    twice = np.concatenate([_bits(r["twice"], len(f)) for r, f in zip(rows, firsts, strict=True)])
    order, begins = _distinct(first, second)
    starts = np.flatnonzero(begins)
    many = (np.diff(np.append(starts, len(first))) > 1) | np.logical_or.reduceat(twice[order], starts)
    found, chosen = np.zeros(len(first), dtype=bool), np.zeros(len(first), dtype=bool)
    found[order] = many[np.cumsum(begins) - 1]
    chosen[order[starts]] = many
    out, at = [], 0
    for r, f in zip(rows, firsts, strict=True):
        s = slice(at, at + len(f))
        out.append({"part": r["part"], "bucket": r["bucket"], "kind": r["kind"], "flags": np.packbits(found[s]).tobytes(), "chosen": np.packbits(chosen[s]).tobytes()})
        at += len(f)
    return pa.Table.from_pylist(out, FLAGS)


#: Kinds of marks.
BLOCKS, SUFFIXES, STRETCHES = 0, 1, 2


class Part:
    """The documents of one part; everything here is made anew from their texts when it is asked for."""

    def __init__(self, table: pa.Table, length: int, buckets: int):
        self.ids, self.length, self.buckets = table.column("doc_id").to_pylist(), length, buckets
        self.texts = [(t or "").encode() for t in table.column("text").to_pylist()]
        hashes, first, second, self.spread = [], [], [], []
        for d, text in enumerate(self.texts):
            for at, data in _segments(text, length):
                strings = Strings(data)
                places, h, n, block = sample_positions(strings, length)
                t, end = stretches(places, block, length)
                a, b = strings.of(places[t], end)
                hashes.append(h)
                first.append(a)
                second.append(b)
                self.spread.append((d, at, n, places, t))
        self.sample = Marks(_joined(hashes, np.uint64), np.zeros(sum(map(len, hashes)), np.uint16), buckets)
        self.stretched = Marks(_joined(first, np.uint64), _joined(second, np.uint16), buckets)

    def rows(self, part: int) -> list[dict]:
        return self.sample.rows(part, BLOCKS) + self.stretched.rows(part, STRETCHES)

    def candidates(self, flags: pa.Table) -> None:
        """Fingerprints of the suffixes whose block is there more than once and that no other place's stretch stands for."""
        repeated = self.sample.flagged(_by_kind(flags, BLOCKS, "flags"))
        decided = self.stretched.flagged(_by_kind(flags, STRETCHES, "flags"))
        sent = self.stretched.flagged(_by_kind(flags, STRETCHES, "chosen")) & self.stretched.leader
        first, second, known = [], [], []
        self.places, self.decided = [], []
        i = j = 0
        for d, at, n, places, t in self.spread:
            mine, dec, snd = repeated[i : i + len(n)], decided[j : j + len(t)], sent[j : j + len(t)]
            i, j = i + len(n), j + len(t)
            if not mine.any():
                continue
            inside = np.zeros(int(n.sum()), dtype=bool)  # suffixes in decided stretches; those of them to be sent
            chosen = inside.copy()
            for k, also in zip(t[dec], snd[dec], strict=True):
                inside[places[k] : places[k + 1]] = True
                chosen[places[k] : places[k + 1]] |= also
            if inside.any():
                self.decided.append((d, at + np.flatnonzero(inside)))
            where = np.flatnonzero((np.repeat(mine, n) & ~inside) | chosen)
            if len(where):
                data = np.frombuffer(self.texts[d], dtype=np.uint8)[at : at + SEGMENT + self.length - 1]
                a, b = Strings(data).of(where, where + self.length)
                first.append(a)
                second.append(b)
                known.append(inside[where])
                self.places.append((d, at + where))
        self.suffixes = Marks(_joined(first, np.uint64), _joined(second, np.uint16), self.buckets, _joined(known, bool))

    def kept(self, flags: dict[int, bytes]) -> pa.Table:
        repeated, k = self.suffixes.flagged(flags), 0
        starts: dict[int, list[np.ndarray]] = {}
        for d, at in self.places:
            if len(hit := at[repeated[k : k + len(at)]]):
                starts.setdefault(d, []).append(hit)
            k += len(at)
        for d, at in self.decided:
            starts.setdefault(d, []).append(at)
        out = []
        for d, text in enumerate(self.texts):
            row = {"doc_id": self.ids[d], "n_bytes": len(text), "n_removed": 0, "n_spans": 0}
            if d in starts:
                change = np.zeros(len(text) + 1, dtype=np.int32)
                at = np.unique(np.concatenate(starts[d]))
                change[at] += 1
                change[at + self.length] -= 1
                gone = np.cumsum(change[:-1]) > 0
                row["n_removed"] = int(gone.sum())
                row["n_spans"] = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
                text = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
            out.append(row | {"kept_sha256": hashlib.sha256(text).hexdigest()})
        return pa.Table.from_pylist(out, KEPT)


def _joined(arrays: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


def _by_kind(flags: pa.Table, kind: int, bits: str) -> dict[int, bytes]:
    return {r["bucket"]: r[bits] for r in flags.to_pylist() if r["kind"] == kind}


def remove_repeats(docs: DataFrame, length: int = 200, part_bytes: int = 6 << 20, bucket_bytes: int = 32 << 20) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes, null is empty. A byte goes if a string of ``length`` bytes that covers it
    also starts anywhere else, in the same document (overlapping too) or another; strings never
    cross documents and are judged on the input. n_spans counts maximal removed runs. A task holds a
    part, or the fingerprints of a bucket, which stand for ``bucket_bytes`` of text.

    Documents go by a hash of their id and length to parts of about ``part_bytes``; the text is shuffled once
    and that shuffle serves the three passes over it. A part first drops repeats of its own, so a
    passage that a third of all documents hold reaches a bucket once a part, and buckets are ranges
    of a hash: no task grows with a hot passage. Repeated rows are documents like others, so texts of
    ``length`` or more bytes in them are removed. An empty table gives an empty result.
    """
    size = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts, buckets = max(1, math.ceil(size / part_bytes)), max(1, math.ceil(size / bucket_bytes))
    texts = docs.select(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(parts)).alias("part"), "doc_id", "text")
    by_part = texts.groupBy("part")

    def sample(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(Part(table, length, buckets).rows(table.column("part")[0].as_py()), MARKS)

    def suffixes(table: pa.Table, flags: pa.Table) -> pa.Table:
        if not table.num_rows:
            return MARKS.empty_table()
        part = Part(table, length, buckets)
        part.candidates(flags)
        return pa.Table.from_pylist(part.suffixes.rows(table.column("part")[0].as_py(), SUFFIXES), MARKS)

    def removed(table: pa.Table, flags: pa.Table) -> pa.Table:
        if not table.num_rows:
            return KEPT.empty_table()
        part = Part(table, length, buckets)
        part.candidates(flags)
        return part.kept(_by_kind(flags, SUFFIXES, "flags"))

    def own(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c).alias(c) for c in df.columns])

    blocks = by_part.applyInArrow(sample, DDL["marks"]).groupBy("bucket", "kind").applyInArrow(sort_bucket, DDL["flags"])
    found = by_part.cogroup(own(blocks).groupBy("part")).applyInArrow(suffixes, DDL["marks"]).groupBy("bucket", "kind").applyInArrow(sort_bucket, DDL["flags"])
    flags = own(blocks).unionByName(own(found))
    return by_part.cogroup(flags.groupBy("part")).applyInArrow(removed, DDL["kept"])


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))
