"""MinHash near-dedup (1): an inverted join over signature coordinates, confirmed on full sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planforge.llm.common import Tables, in_slices, materialize, read
from planforge.llm.components import components
from planforge.llm.rolling import in_blocks, shingles, word_hashes

_SETS = "doc_id long, n_shingles long, digest binary, sig array<bigint>"
#: Bits of the parity sketch of a set.
PARITY = 1024


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for part in in_blocks(texts):
        words, of = word_hashes(texts[part])
        cuts = np.searchsorted(of, np.arange(part.stop - part.start + 1))
        out += [np.unique(shingles(words[a:b], size)) for a, b in zip(cuts[:-1], cuts[1:])]
    return out


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """[set, coordinate]: the least value of each coordinate's hash over a set; sets must not be empty."""
    rng = np.random.default_rng(1)
    salts = rng.integers(0, 2**63, coordinates, dtype=np.uint64)
    odds = rng.integers(0, 2**63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(sets), coordinates), dtype=np.uint64)
    at, step = 0, 1 << 18
    while at < len(sets):
        to, size = at, 0
        while to < len(sets) and (to == at or size + len(sets[to]) <= step):
            size += len(sets[to])
            to += 1
        flat = np.concatenate(sets[at:to])
        cuts = np.cumsum([0, *(len(s) for s in sets[at : to - 1])])
        for k in range(coordinates):
            v = (flat ^ salts[k]) * odds[k]
            v ^= v >> np.uint64(31)
            out[at:to, k] = np.minimum.reduceat(v, cuts)
        at = to
    return out


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in batch.column("text").to_pylist()]


def _sketch(size: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_slices(whole):
                sets = shingle_sets(_texts(batch), size)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = signatures([sets[i] for i in full], coordinates).view(np.int64) if full else np.empty((0, coordinates), np.int64)
                counts = np.array([len(s) for s in sets], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum(np.where(counts > 0, coordinates, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), pa.array(counts),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig.ravel())),
                    ],
                    names=["doc_id", "n_shingles", "digest", "sig"],
                )

    return run


def parity(shingles: np.ndarray) -> np.ndarray:
    """Bit b of a set's sketch: whether an odd number of its shingles fall on b. Two sketches differ in |x - y| + |y - x| bits at most."""
    odd = (np.bincount((shingles >> np.uint64(20)).astype(np.int64) % PARITY, minlength=PARITY) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_slices(whole):
                sets = shingle_sets(_texts(batch), size)
                offsets = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64)
                sketches = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([parity(s) for s in sets])), PARITY // 64).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), sketches], names=["id", "shingles", "parity"])

    return run


def _agreeing(pairs: DataFrame, sigs: DataFrame, matches: int, keep: Tables) -> DataFrame:
    """Pairs whose signatures agree in ``matches`` coordinates at least."""
    involved = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    few = keep(sigs.join(involved, "id", "left_semi"), "near-sigs")
    both = pairs.join(few.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a")
    both = both.join(few.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    return both.where(same >= matches).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union, on the full sets."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb")), "b")
    shared, sizes = F.size(F.array_intersect("xa", "xb")), F.size("xa") + F.size("xb")
    return both.where(100 * shared >= percent * (sizes - shared)).select("a", "b")


def _overlapping(outside: DataFrame, sets: DataFrame, percent: int, keep: Tables) -> DataFrame:
    """Pairs (x, y) of an outside set and any of sets in another component that could reach the similarity.

    All sets order their shingles alike: first those that one component holds alone, the others by
    document frequency. An overlap of percent / (100 + percent) * (|x| + |y|) is needed. If the first
    common shingle has r others before it in x and q in y, the overlap is min(|x| - r, |y| - q) at
    most, so r and q are bounded: only the first shingles of either set are posted, which few sets
    hold, however many are alike in all others. The other set is at least percent / 100 as large,
    which bounds r before y is known. Shingles of one component are counted, not posted, as sets of
    two components don't share them; so a group of copies that is one component posts little.
    Sets that meet in very many shingles and are yet below the similarity differ in more bits of
    their parity sketches than sets at the similarity can, and are told apart while they are joined.
    """
    posted = sets.select("id", "c", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    df = posted.groupBy("s").agg(F.count("*").alias("df"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    df = keep(df.where("lo <> hi").select("s", "df"), "near-df")
    own = posted.join(df, "s").groupBy("id", "c", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("by_df"))
    alone = F.col("n") - F.size("by_df")
    spare = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int") - alone
    rare = own.where(spare > 0).select("id", "c", "n", alone.alias("alone"), F.posexplode(F.slice("by_df", F.lit(1), spare)).alias("at", "e"))
    rare = rare.select("id", "c", "n", (F.col("alone") + F.col("at")).alias("r"), F.col("e.s").alias("s")).join(sets.select("id", "parity"), "id")
    rare = keep(rare, "near-rare")
    probe = rare.join(outside, "id", "left_semi").select(F.col("id").alias("x"), F.col("c").alias("c_x"), F.col("n").alias("n_x"), F.col("r").alias("r_x"), F.col("parity").alias("parity_x"), "s")
    probe = keep(probe, "near-probes")
    rest = F.least(F.col("n_x") - F.col("r_x"), F.col("n") - F.col("r"))
    enough = (100 + percent) * rest >= percent * (F.col("n_x") + F.col("n"))
    apart = reduce(Column.__add__, [F.bit_count(F.col("parity_x")[i].bitwiseXOR(F.col("parity")[i])) for i in range(PARITY // 64)])
    enough &= (100 + percent) * apart <= (100 - percent) * (F.col("n_x") + F.col("n"))
    found = probe.join(rare, (probe["s"] == rare["s"]) & (F.col("c_x") != F.col("c")) & enough)
    return found.select("x", F.col("id").alias("y")).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, coordinates: int = 64, matches: int = 38) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents whose sets of ``size``-word shingles (words of A-Z lower-cased text; fewer words are
    one shingle) have a Jaccard similarity of ``percent`` or more are linked; component_id is the
    smallest doc_id reachable.

    1. Equal sets collapse to their smallest doc_id, so copies are never paired.
    2. Each remaining set is posted under every (coordinate, value) of its signature. Two sets that
       agree in ``matches`` of ``coordinates`` share one of any coordinates - matches + 1 of those,
       so only that many, the rarest, are kept (prefix); values that no other set has are the
       rarest, and a set with too few shared ones is skipped altogether.
    3. In each kept list all sets are paired with two of its members, not with each other: the
       smallest id and the most central set, the one with the most shared values. Agreeing
       coordinates are counted and pairs above ``matches`` confirmed on full sets.
    4. Of the lists whose sets are still in different components, those outside the list's largest
       component are looked up by their rarest shingles among the sets of other components. Any set
       that is alike has one of those among its own rarest, so no link that could join components is
       lost, and a large group of copies costs a few pairs a member.

    A pair at the threshold agrees in fewer than ``matches`` coordinates, and is missed, with a
    probability of 4.3e-5 (binomial), a closer one with less. Sets are sets of 64-bit hashes of
    shingles, for the confirmation too. Of a long text's words a task holds arrays, texts of one
    batch together about 4 MB.
    Null and wordless texts have the empty set and are linked with nothing; a null doc_id has a null
    component. Repeated rows are equal sets. An empty table gives an empty result.
    """
    base = materialize(docs.select("doc_id", "text").mapInArrow(_sketch(size, coordinates), _SETS), "near-base")
    reps = base.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"))
    reps, keep = materialize(reps, "near-reps"), Tables()
    sigs = base.select(F.col("doc_id").alias("id"), "sig").join(reps.select("id"), "id", "left_semi")
    sigs = keep(sigs, "near-signatures")
    postings = sigs.select("id", F.posexplode("sig").alias("k", "v")).select("id", F.xxhash64("k", "v").alias("key"))
    shared = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keep(shared, "near-shared")  # sides of their own let adaptive execution split a hot value
    listed = postings.join(shared, "key").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("keys"))
    listed = listed.withColumn("shared", F.size("keys")).where(F.col("shared") >= matches)
    prefix = listed.select("id", "shared", F.explode(F.slice("keys", F.lit(1), F.col("shared") - matches + 1)).alias("x"))
    prefix = keep(prefix.select("id", "shared", F.col("x.key").alias("key")), "near-prefix")
    sets = docs.select("doc_id", "text").join(prefix.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = keep(sets.mapInArrow(_full_sets(size), "id long, shingles array<bigint>, parity array<bigint>"), "near-sets")

    central = F.max(F.struct("shared", -F.col("id"))).getField("col2")
    ends = prefix.groupBy("key").agg(F.min("id").alias("lo"), (-central).alias("mid"), F.count("*").alias("n")).where("n > 1")
    starred = prefix.join(keep(ends, "near-ends"), "key").select("id", F.explode(F.array("lo", "mid")).alias("end")).where("id <> end")
    first = keep(starred.select(F.least("id", "end").alias("a"), F.greatest("id", "end").alias("b")).distinct(), "near-pairs")
    links = keep(_confirmed(_agreeing(first, sigs, matches, keep), sets, percent), "near-links")
    found = components(links)

    member = prefix.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    parts = member.groupBy("key", "c").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("n", "c")).alias("top")).where("parts > 1")
    member = keep(member.join(keep(mixed.select("key", F.col("top.c").alias("top")), "near-mixed"), "key"), "near-members")
    open_sets = keep(sets.join(member.select("id", "c").distinct(), "id"), "near-open")
    cross = _overlapping(member.where("c <> top").select("id").distinct(), open_sets, percent, keep)
    cross = cross.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    more = _confirmed(_agreeing(keep(cross, "near-cross"), sigs, matches, keep), sets, percent)
    found = components(links.unionByName(more))
    keep.release()

    class_of = reps.join(found.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("component", "id").alias("c"))
    out = base.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")).join(class_of, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), size=4)
