"""Ranked lexical search (11): term-at-a-time over shards of documents, with a limit on new accumulators."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from planforge.llm.common import Tables, in_slices, read

#: Bytes of a term: letters, digits and all bytes of characters beyond ASCII; A-Z become a-z, others spaces.
TO_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order: as bytes, which ASCII letters and digits and all of a longer character are."""
    return (text or "").encode().translate(TO_TERMS).split()


def term_counts(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys, n, term, tf: a row per distinct term of each row's whole text, with the text's number of terms n; one of the term '' too."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch, text_col):
                sizes, distinct, terms, tf = [], [], [], []
                for text in part.column(text_col).to_pylist():
                    counts = Counter(terms_of(text))
                    sizes.append(counts.total())
                    counts[b""] = 1
                    distinct.append(len(counts))
                    terms += counts.keys()
                    tf += counts.values()
                at = pa.array(np.repeat(np.arange(len(sizes)), distinct))
                columns = [part.column(k).take(at) for k in keys]
                columns += [pa.array(np.repeat(np.array(sizes, np.int64), distinct)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tf, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*keys, "n", "term", "tf"])

    return rows.select(*[F.col(k).cast("long").alias(k) for k in keys], text_col).mapInArrow(count, ", ".join(f"{k} long" for k in [*keys, "n"]) + ", term string, tf long")


class Shard:
    """The postings of some documents: for each term their numbers and what each adds to a score."""

    def __init__(self, rows: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        self.rows, doc = np.unique(rows, return_inverse=True)
        order = np.argsort(terms, kind="stable")
        self.terms, starts = np.unique(terms[order], return_index=True)
        self.starts = np.append(starts, len(terms))
        self.doc, self.impact = doc[order], impacts[order]
        self.most = np.maximum.reduceat(self.impact, starts) if len(starts) else self.impact
        self.sums, self.open = np.zeros(len(self.rows), np.int64), np.zeros(len(self.rows), bool)

    def search(self, terms: np.ndarray, df: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the documents that can be among the k best, each scored exactly.

        Terms are taken rarest first. What the terms from here on can add to any document is their
        bound; once it is below the k-th partial score, a document not met before cannot come in
        (at an equal sum it could, by its smaller id), so from then on only the accumulators that
        exist are updated.
        """
        at = np.searchsorted(self.terms, terms)
        here = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms)
        at, times, df = at[here], times[here], df[here]
        order = np.lexsort((at, df))
        at, times = at[order], times[order]
        left = np.cumsum((self.most[at] * times)[::-1])[::-1]
        growing, met = True, np.zeros(0, np.int64)
        for i, (t, n) in enumerate(zip(at, times, strict=True)):
            doc, add = self.doc[self.starts[t] : self.starts[t + 1]], self.impact[self.starts[t] : self.starts[t + 1]] * n
            if growing and len(met) >= k:
                partial = self.sums[met]
                growing = left[i] >= np.partition(partial, len(met) - k)[len(met) - k]
            if not growing:
                known = self.open[doc]
                doc, add = doc[known], add[known]
            else:
                new = doc[~self.open[doc]]
                self.open[new] = True
                met = np.concatenate([met, new])
            self.sums[doc] += add  # a document is once in a term's postings
        scores = self.sums[met]
        self.sums[met], self.open[met] = 0, False
        return met, scores


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10, shard_docs: int = 16_384, block_queries: int = 4_096) -> DataFrame:
    """docs: doc_id, text; queries: item_id, text. The k best documents of each item: item_id, rank, doc_id, score.

    Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII, with A-Z
    lower-cased. A term's weight falls with the documents that hold it, a document's share of it
    grows with its occurrences and falls with the document's length; all sums are of 64-bit integers.

    1. Each document's terms are counted where it lies; those of no item are dropped by a join
       that Spark plans by size, and the rest are written as postings, with a row per document for
       the totals.
    2. Documents are dealt by their row number to shards of about ``shard_docs``, items to blocks
       of about ``block_queries``; a block takes only the postings of its own terms. A task holds
       the postings of one shard and the terms of one block, and searches term by term.
    3. The k best of each shard meet by item.

    Equal scores go by ascending doc_id (null ids last), and of rows with one id by the order of
    reading; each row of docs is a document of its own, repeated or not. Texts of rows with one
    item_id are one item; null item ids take no part. Null or empty texts have no terms: such
    documents are never found and such items have no rows. An empty table on either side gives an
    empty result. Only the named columns are read, so other columns can't clash.
    """
    keep = Tables()
    items = term_counts(queries.where("item_id is not null"), ["item_id"], "text").where("term <> ''")
    asked = keep(items.groupBy("item_id", "term").agg(F.sum("tf").alias("times")), "search-items")
    wanted = keep(asked.select("term").distinct().union(docs.sparkSession.createDataFrame([("",)], "term string")), "search-terms")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    postings = keep(term_counts(rows, ["row", "doc_id"], "text").join(wanted, "term"), "search-postings")
    totals = postings.where("term = '' and n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()  # one row
    weight = F.floor(1000 * F.log((2 * F.lit(totals["docs"]) + 2).cast("double") / (2 * F.count("*") + 1))).cast("long")
    weights = postings.where("term <> ''").groupBy("term").agg(F.count("*").alias("df"), weight.alias("w"))

    shards, n_items = max(1, math.ceil(totals["docs"] / shard_docs)), asked.select(F.count_distinct("item_id")).first()[0]
    blocks = max(1, math.ceil(n_items / block_queries))
    known = keep(asked.join(weights, "term").withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))), "search-known")
    held = keep(known.select("term", "w", "block").distinct(), "search-held")
    length = f"100 - 75 + ((75 * n * {totals['docs']}L) div {max(totals['terms'], 1)}L)"
    impact = F.expr(f"w * ((1000000000L * tf) div (1000L * tf + 8L * ({length})))")
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard")
    scored = postings.where("term <> ''").join(held, "term").select(shard, "block", "row", "doc_id", "term", impact.alias("impact"))
    everywhere = known.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>"))).select("shard", "block", "item_id", "term", "df", "times")

    def search(found: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(found) and len(items):
            ids = found.drop_duplicates("row").set_index("row")["doc_id"].astype("Int64")
            code = {t: i for i, t in enumerate(found["term"].unique())}
            shard = Shard(found["row"].to_numpy(), found["term"].map(code).to_numpy(), found["impact"].to_numpy())
            for item, terms in items[items["term"].isin(code)].groupby("item_id", sort=True):
                doc, score = shard.search(terms["term"].map(code).to_numpy(), terms["df"].to_numpy(), terms["times"].to_numpy(), k)
                if len(doc) > k:  # all that reach the k-th: ids decide later
                    best = score >= np.partition(score, len(score) - k)[len(score) - k]
                    doc, score = doc[best], score[best]
                out.append(pd.DataFrame({"item_id": item, "row": shard.rows[doc], "doc_id": ids.loc[shard.rows[doc]].to_numpy(), "score": score}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("item_id", "row", "doc_id", "score")})

    key = ["shard", "block"]
    best = scored.groupBy(*key).cogroup(everywhere.groupBy(*key)).applyInPandas(search, "item_id long, row long, doc_id long, score long").where("score > 0")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order)))
    out = keep(ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"), "search-found")
    keep.release_all_but(out)
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS terms FROM documents),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY 1, 2),
totals AS (SELECT count(*) AS n_docs, sum(len(terms)) AS n_terms FROM d WHERE len(terms) > 0),
lengths AS (SELECT r, doc_id, 100 - 75 + ((CAST(75 AS BIGINT) * len(terms) * n_docs) // CAST(n_terms AS BIGINT)) AS m FROM d, totals WHERE len(terms) > 0),
postings AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY 1, 2),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term, n_docs),
scores AS (
  SELECT item_id, r, sum(times * w * ((CAST(1000000000 AS BIGINT) * tf) // (1000 * tf + 8 * m))) AS score
  FROM q JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (r) GROUP BY 1, 2
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS rank, doc_id, score FROM scores JOIN lengths USING (r) WHERE score > 0)
WHERE rank <= 10
"""
