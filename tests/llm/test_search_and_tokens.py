"""Ranked search, hard negatives and the tokenization automaton against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from planforge.llm import bpe_automaton as B
from planforge.llm import hard_negatives, lexical_search

DOCS = "doc_id long, text string, row long, term string, ids string, n long"


def table(spark, pairs):
    """Documents with extra columns whose names clash with those inside operators."""
    return spark.createDataFrame([(i, t, 7, "x", "y", 3) for i, t in pairs], DOCS).repartition(3)


def prose(rng, n):
    return " ".join(rng.choice(["Ba", "ce", "di9", "fo", "gü", "été", "x-y", "ab,cd"]) + rng.choice(["", "s", "ed", "!"]) for _ in range(n))


# 11


def plain_search(docs, items, k):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [Counter(find(t)) for _, t in docs]
    n_docs, total = sum(1 for c in counts if c), sum(c.total() for c in counts)
    df = Counter(t for c in counts for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, Counter()).update(find(text))
    out = set()
    for item, terms in asked.items():
        scored = []
        for (doc, _), c in zip(docs, counts, strict=True):
            if c:
                m = 100 - 75 + (75 * c.total() * n_docs) // total
                s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in terms.items() if t in c)
                if s > 0:
                    scored.append((-s, doc is None, doc or 0, doc))
        out |= {(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("shard_docs,block_queries", [(16_384, 4_096), (9, 2)])
def test_ranked_search(spark, shard_docs, block_queries):
    rng = random.Random(3)
    docs = [(i, prose(rng, rng.randrange(1, 30))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, " .,! "), (203, "same words here"), (204, "same words here"), (None, "same words here"), (205, "same " * 4000), (3, docs[3][1])]
    items = [(0, "Same WORDS words here!"), (1, prose(rng, 12)), (2, prose(rng, 3)), (3, None), (4, ""), (5, "unknown zzz"), (None, "same"), (6, "gü"), (6, "été gü"), (7, "same")]
    want = plain_search(docs, items, 5)
    clash = spark.createDataFrame([(i, t, "d") for i, t in items], "item_id long, text string, doc_id string").repartition(2)
    got = lexical_search.ranked_search(table(spark, docs), clash, 5, shard_docs, block_queries)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    rows = got.collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def test_ranked_search_without_rows(spark):
    docs, items = table(spark, [(1, "a b")]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.ranked_search(docs.limit(0), items).count() == 0
    assert lexical_search.ranked_search(docs, items.limit(0)).count() == 0


def test_accumulators_stop_and_scores_stay_exact():
    """Documents that only hold the commonest terms get no accumulator, and the k best are right all the same."""
    rng = np.random.default_rng(5)
    rows, terms, impacts = [], [], []
    for t, share in enumerate([0.01, 0.05, 0.3, 0.9]):
        held = np.flatnonzero(rng.random(2000) < share)
        rows.append(held)
        terms.append(np.full(len(held), t))
        impacts.append(rng.integers(1, 10, len(held)) * 10 ** (4 - t))
    rows, terms, impacts = map(np.concatenate, (rows, terms, impacts))
    shard = lexical_search.Shard(rows, terms, impacts)
    for times in ([1, 1, 1, 1], [1, 2, 3, 1], [0, 0, 0, 1]):
        whole = np.bincount(rows, impacts * np.array(times)[terms], 2000).astype(np.int64)
        chosen = np.flatnonzero(np.array(times) > 0)
        found, scores = shard.search(chosen, np.bincount(terms)[chosen], np.array(times)[chosen], 10)
        assert (whole[shard.rows[found]] == scores).all()
        assert sorted(scores)[-10:] == sorted(whole)[-10:]
        if times[0]:
            assert len(found) < (whole > 0).sum() / 2  # the last term opened none


# 12


def plain_negatives(rows, positives, negatives):
    rows = [(i, lab, v) for i, lab, v in rows if i is not None and lab is not None and v is not None]
    out = []
    for a, lab, v in rows:
        if a % 10:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, la) for i, la, w in rows if i != a and len(w) == len(v)]
        for p, pid, _ in sorted(x for x in scored if x[2] == lab)[:positives]:
            inside = sorted(x for x in scored if x[2] != lab and 30 * -p <= 100 * -x[0] <= 90 * -p)
            out += [(a, pid, r + 1, x[1], -p, -x[0]) for r, x in enumerate(inside[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows,blocks", [(4096, 256), (7, 3)])
def test_hard_negatives(spark, shard_rows, blocks):
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(0, 3)) if i % 3 else 0, [int(x) for x in rng.integers(-9, 12, 6)]) for i in range(150)]
    rows += [(300 + i, 1, [5, 5, 5, 5, 5, 5]) for i in range(12)] + [(300, 2, [4] * 6)] * 3  # ties, repeated rows and ids
    rows += [(None, 1, [9] * 6), (400, None, [9] * 6), (401, 1, None), (410, 2, [0] * 6), (420, 1, [3, 3]), (421, 0, [2, 2]), (423, 1, [3, 3]), (430, 77, [1] * 6)]
    df = spark.createDataFrame([(i, lab, v, 1, 2) for i, lab, v in rows], "vec_id long, label long, v array<long>, shard long, asked long").repartition(3)
    got = hard_negatives.mine_negatives(df.select("vec_id", "label", "v"), F.col("vec_id") % 10 == 0, 5, 4, 30, 90, shard_rows, blocks)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, 5, 4)
    assert hard_negatives.mine_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_sorted_lists_stop_early():
    """With one strong dimension the threshold ends the search before all rows are met, and nothing is missed."""
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.integers(-1000, 1000, (5000, 1)), rng.integers(-3, 4, (5000, 3))], axis=1)
    lists, a = hard_negatives.SortedLists(v, np.arange(5000)), np.array([50, -1, 0, 2])
    met = []
    lists.v = type("Seen", (np.ndarray,), {"__getitem__": lambda s, i: (met.append(np.size(i)) if isinstance(i, np.ndarray) else None, np.asarray(s)[i])[1]})(v.shape, v.dtype, v.copy())
    scores = v @ a
    for lo, hi in [(-(2**62), 2**62), (20_000, 30_000), (10**9, 2**62)]:
        met.clear()
        got = {r for _, r, _ in lists.search(a, -1, [(lo, hi)], 10)}
        inside = np.sort(scores[(scores >= lo) & (scores <= hi)])[::-1]
        assert {int(s) for s in scores[list(got)]} == set(inside[:10].tolist())
        assert sum(met) < 4000


# 13


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def automaton():
    return B.TokenizationAutomaton(B.Vocabulary(public_tokenizers.path("byte_bpe_50k.json")))


def odd_texts():
    rng = random.Random(1)
    texts = ["", "a", "<|endoftext|>", " <|endoftext|><|endoftext|>x <|endoftext", "  a\n\n b\t", "x" * 5000, "abc" * 3000, "don't I'LL we've   z", "日本語 한국어 ՘a࢏!", "\U0001f468‍\U0001f469 ok", "\x00\x1c\x1d a\x85b c"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x600), rng.randrange(0x3000, 0x9FFF), rng.randrange(0x10000, 0x1FFFF), 32, 10])) for _ in range(rng.randrange(60))) for _ in range(400)]
    return texts + ["".join(rng.choice("aAeEthTHnN inrsgo 01.'") for _ in range(rng.randrange(80))) for _ in range(800)]


def test_automaton_gives_the_ids_of_the_library(automaton, library):
    texts = odd_texts()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for most in (250_000, 50):  # the second forgets its words all the time
        tokenizer = B.Tokenizer(automaton, most)
        got = [x for i in range(0, len(texts), 97) for x in tokenizer.encode(texts[i : i + 97])]
        assert [x.tolist() for x in got] == want
    assert [automaton.decode(x) for x in got] == texts


def test_words_are_split_as_the_library_splits():
    from tokenizers import pre_tokenizers

    by = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    for cp in [*range(0x2700), *range(0x2700, 0xD800, 61), *range(0xE000, 0x30000, 997)]:
        c = chr(cp)
        for t in ("a" + c + "1" + c + "! " + c + " " + c + c + "b", c + "  " + c):
            assert B.split_words(t) == [t[a:b] for _, (a, b) in by.pre_tokenize_str(t)], hex(cp)


def test_gadgets_on_small_merges(tmp_path):
    """Every word over three letters, with merges that overlap themselves and one that can't happen."""
    import itertools
    import json

    letters = {c: i for i, c in enumerate("abc")}
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "c"), ("ab", "c"), ("aa", "aa"), ("aa", "a")]
    vocab = letters | {u + v: 3 + i for i, (u, v) in enumerate(merges)}
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"added_tokens": [], "model": {"type": "BPE", "vocab": vocab, "merges": [list(m) for m in merges]}}))
    rank = {m: i for i, m in enumerate(merges)}

    def plain(word):
        parts = list(word)
        while True:
            at = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
            if at is None:
                return [vocab[p] for p in parts]
            parts[at[1] : at[1] + 2] = ["".join(parts[at[1] : at[1] + 2])]

    words = ["".join(w) for n in range(1, 9) for w in itertools.product("abc", repeat=n)]
    automaton = B.TokenizationAutomaton(B.Vocabulary(str(path)))
    assert [x.tolist() for x in automaton.encode([w.encode() for w in words])] == [plain(w) for w in words]
    with pytest.raises(ValueError):
        automaton.encode([b"abd"])


def test_token_columns_and_digests(spark, library):
    texts = odd_texts()[:60] + [None, None]
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = table(spark, [(i if i != 5 else None, t) for i, t in enumerate(texts)] + [(1, "a"), (1, "a")])
    rows = B.with_tokens(df, path).collect()
    assert len(rows) == len(texts) + 2 and all(r["decoded"] == (r["text"] or "") for r in rows)
    assert all(list(r["ids"]) == library.encode(r["text"] or "", add_special_tokens=False).ids for r in rows)
    got = B.token_digests(df, path).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in rows:
        ids = np.array(library.encode(r["text"] or "", add_special_tokens=False).ids, "<u4")
        want.append((r["doc_id"], len(ids), sha(ids.tobytes()), sha(library.decode(ids.tolist(), skip_special_tokens=False).encode())))
    order = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert B.token_digests(df.limit(0), path).count() == 0


def test_hard_negatives_end_once_all_rows_are_met(monkeypatch):
    """A search that no threshold ends stops when nothing is left to be met, not at the end of the lists."""
    rng = np.random.default_rng(5)
    v, a = rng.integers(-99, 100, (1024, 64)), rng.integers(-99, 100, 64)
    rounds, kth = [], hard_negatives.SortedLists.kth
    monkeypatch.setattr(hard_negatives.SortedLists, "kth", staticmethod(lambda scores, lo, hi, k: rounds.append(len(scores)) or kth(scores, lo, hi, k)))
    found = hard_negatives.SortedLists(v, np.arange(1024)).search(a, 7, [hard_negatives.ANY], 2000)
    assert sorted(found) == [(0, r, int(v[r] @ a)) for r in range(1024) if r != 7]
    assert rounds.count(1023) == 1  # before, once more for each further step through the lists


def test_hard_negatives_bound_ties_and_batches():
    """Of any number of ties a shard gives the k first, and what is found leaves a task in batches, however many anchors ask."""
    import pyarrow as pa

    ids = np.arange(1000)[::-1].copy()
    lists = hard_negatives.SortedLists(np.ones((1000, 4), np.int64), ids)
    assert sorted(int(ids[r]) for _, r, _ in lists.search(np.ones(4, np.int64), 0, [hard_negatives.ANY], 5)) == [1, 2, 3, 4, 5]
    n = 300
    batch = {"dim": [2] * n, "label": [1] * n, "shard": [0] * n, "row": [*range(100), *[None] * 200], "vec_id": [*range(100), *[-1] * 200], "v": [[i, 1] for i in range(n)]}
    batch |= {"asked": [None] * 100 + list(range(200)), "parts": [None] * 100 + [[0]] * 200, "least": [None] * 100 + [[hard_negatives.ANY[0]]] * 200, "most": [None] * 100 + [[hard_negatives.ANY[1]]] * 200}
    whole = pa.RecordBatch.from_pydict(batch)
    parts = [whole.slice(i, 37) for i in range(0, n, 37)]
    got = list(hard_negatives._searches(5, ["dim", "label", "shard"], most_found=40)(iter(parts)))
    assert sum(b.num_rows for b in got) == 200 * 5 and max(b.num_rows for b in got) <= 44
    assert {r["vec_id"] for b in got for r in b.to_pylist()} == {95, 96, 97, 98, 99}
