"""Toivonen phrase mining against counting every phrase by brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusrules.llm import collocations

RND = random.Random(13)
VOCAB = ["the", "of", "New", "york", "city", "hall", "Über", "straße", "big", "data", "x"]


def text():
    parts = []
    for _ in range(RND.randint(0, 40)):
        if RND.random() < 0.3:
            parts.append(RND.choice(["new york city hall", "big data", "The big data", "new york"]))
        else:
            parts.append(RND.choice(VOCAB))
        parts.append(RND.choice([" ", " ", "\t", ". ", ", ", "\n", "!", " ", "  "]))
    return "".join(parts)


def brute(rows, min_count, top=2000, longest=5):
    counts, totals = {}, Counter()
    for lang, t in rows:
        lang = lang if lang is not None else "und"
        low = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        f = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            ws = [w for w in re.split(r"[ \t]+", piece) if w]
            totals[lang] += len(ws)
            for i in range(len(ws)):
                for k in range(1, longest + 1):
                    if i + k <= len(ws):
                        f[tuple(ws[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        n = totals[lang]
        cands = {g: a for g, a in f.items() if 2 <= len(g) and a >= min_count}
        rows_ = []
        for g, a in cands.items():
            if any(len(h) > len(g) and b >= a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
                   for h, b in cands.items()):
                continue
            best = min(((1000 * a * n) // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            k = best[1]
            rows_.append((lang, " ".join(g), a, f[g[:k]], f[g[k:]], n, best[0]))
        rows_.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i + 1, *r[1:]) for i, r in enumerate(rows_[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(RND.choice(["en", "de", None]), text(), 1, "clash") for _ in range(300)]
    rows += [("en", None, 2, "x"), (None, "", 3, "y"), ("en", "NEW YORK CITY HALL. " * 30, 4, "z")] * 2
    return spark.createDataFrame(rows, "lang string, text string, score int, `rank` string").repartition(4)


@pytest.mark.parametrize("fraction", [0.05, 0.5, 1.0])
def test_against_brute_force(spark, docs, fraction):
    got = collocations.collocations(docs, min_count=20, sample_fraction=fraction)
    want = brute([(r.lang, r.text) for r in docs.collect()], 20)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert len(want) > 10


def test_failures_expand_until_closed(spark, docs):
    found, passes = collocations.frequent_phrases(docs, min_count=20, sample_fraction=0.01)
    assert passes >= 2  # a tiny sample misses frequent phrases, the border brings them in
    found_all, _ = collocations.frequent_phrases(docs, min_count=20, sample_fraction=1.0)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, found_all.collect()))


def test_top_ties_and_empty(spark, docs):
    got = collocations.collocations(docs, min_count=20, top=3).collect()
    want = [r for r in brute([(r.lang, r.text) for r in docs.collect()], 20) if r[1] <= 3]
    assert sorted(map(tuple, got)) == want
    assert collocations.collocations(docs.where("score < 0")).collect() == []


def test_joined_path_beyond_the_size_bound(spark, docs, monkeypatch):
    monkeypatch.setattr(collocations, "BROADCAST_ROWS", 0)
    got = collocations.collocations(docs, min_count=20, sample_fraction=0.3)
    assert sorted(tuple(r) for r in got.collect()) == brute([(r.lang, r.text) for r in docs.collect()], 20)


def test_texts_are_read_twice_whatever_the_passes(spark, docs):
    """Once to count the words, once to number them: a pass over the phrases reads the numbers."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = docs.select("lang", "text")
    watched = rows.mapInArrow(counted, "lang string, text string")
    _, passes = collocations.frequent_phrases(watched, min_count=20, sample_fraction=0.01)
    assert passes >= 2
    assert read.value == 2 * rows.count()


def test_blocks_of_texts_and_numbers(monkeypatch):
    monkeypatch.setattr(collocations, "SPLIT_BYTES", 8)
    monkeypatch.setattr(collocations, "POSITIONS", 3)
    texts = ["A b. C", "", "long text of many words", "\t x  y!", "é,\rÉ"]
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de", "en", "en", "de"], "text": texts}).slice(0)
    got = {}
    for lang, words, piece, row in collocations._split(batch):
        held = [[] for _ in row]
        for word, p in zip(words.to_pylist(), piece, strict=True):
            held[p] += [word.decode()] if word else []
        got.setdefault(lang, []).extend(x for x in held if x)
    assert got == {
        "en": [["a", "b"], ["c"], ["long", "text", "of", "many", "words"], ["x", "y"]],
        "de": [["é"], ["É"]],
    }
    ids = [[0, 1, 2, 0, 3, 4], [], [0, 1, 1, 1, 1, 1, 0, 2, 2]]
    rows = pa.RecordBatch.from_pydict({"ids": [np.array(i, np.int32).tobytes() for i in ids]})
    blocks = [b.tolist() for b in collocations._blocks(rows)]
    assert sum(blocks, []) == sum(ids, []) and len(blocks) > 2
    assert all(b[0] == 0 for b in blocks)  # cut between runs only


def test_many_proposals_are_not_joined(spark, docs, monkeypatch):
    """Proposals beyond the vocabulary's bound, in several jobs a pass: no phrase is exploded."""

    def joined(*args):
        raise AssertionError("exploded and joined")

    words = len({(r.lang, w) for r in collocations.words_counted(docs).collect() for w in [r.g]})
    monkeypatch.setattr(collocations, "_joined", joined)
    monkeypatch.setattr(collocations, "BROADCAST_ROWS", words)
    monkeypatch.setattr(collocations, "PASS_BYTES", 0.2)
    monkeypatch.setattr(collocations, "ROWS_HELD", 50)
    got = collocations.collocations(docs, min_count=20, sample_fraction=0.5)
    assert sorted(tuple(r) for r in got.collect()) == brute([(r.lang, r.text) for r in docs.collect()], 20)


def test_shares_of_a_pass_are_all_of_it(spark):
    ids = [[0, *(RND.choice([1, 2, 3, 4]) for _ in range(60))] for _ in range(20)]
    rows = spark.createDataFrame([(np.array(i, np.int32).tobytes(),) for i in ids], "ids binary")

    def counted(share, shares):
        chunks = collocations._chunks(rows, 5, 5, 3, share=share, shares=shares)
        return [(bytes(r.g), r.f) for r in collocations._sums(chunks, 3, 2).collect()]

    want = Counter()
    for i in ids:
        for k in range(2, 6):
            want.update(np.array(i[a : a + k], ">i4").tobytes() for a in range(1, len(i) - k + 1))
    assert sorted(counted(0, 1)) == sorted((g, f) for g, f in want.items() if f >= 2)
    shares = [counted(s, 3) for s in range(3)]
    assert all(shares) and sorted(sum(shares, [])) == sorted(counted(0, 1))


def test_packed_counts_and_filters(monkeypatch):
    words = np.array([[1, 70000, 3], [1, 70001, 2], [9, 1, 1], [2**31 - 1, 5, 5]], np.int32)
    counts = np.array([1, 70000, 3, 2])
    back, sums = collocations._unpacked(3, 4, collocations._packed(words, counts))
    assert back.T.tolist() == words.tolist() and sums.tolist() == counts.tolist()
    back, sums = collocations._unpacked(2, 1, collocations._packed(words[:1, :2], counts[:1]))
    assert (back.tolist(), sums.tolist()) == ([[1], [70000]], [1])
    hashes = collocations._hashes(np.arange(300_000, dtype=np.int32).reshape(-1, 3))
    held = collocations.Filter(1000)
    held.add(hashes[:1000])
    assert held.holds(hashes[:1000]).all() and held.holds(hashes[1000:]).mean() < 0.02
    # a table too small for its phrases holds too many, and then too many are counted, all of them exactly
    monkeypatch.setattr(collocations, "FILTER_BITS", (3, 3))
    proposals = collocations.Proposals.__new__(collocations.Proposals)
    proposals.known, proposals.fresh = collocations.Filter(1000), collocations.Filter(0)
    proposals.known.add(hashes)
    ids = np.array([0, 1, 2, 1, 2, 0, 2, 1, 2], np.int64)
    got = [list(map(tuple, w)) for w, _, _ in collocations._block_counts(ids, 3, 5, proposals, False)]
    assert [len(w) for w in got] == [2, 2, 1]
    assert not list(collocations._block_counts(ids, 3, 5, proposals, True))
