"""Best-fit packing against the tokenizer itself and the rules of a packing."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusrules.llm import packing
from corpusrules.llm.catalog import WORD_BPE

PATH = public_tokenizers.path(WORD_BPE)
RND = random.Random(11)
WORDS = ["alpha", "beta", "Gamma", "delta", "épée", "数据", "x1", "!", "the"]


def text(n):
    return " ".join(RND.choice(WORDS) for _ in range(n))


TEXTS = [None, "", "one", "one", text(5), text(300), text(2500), text(7000), "\n\t ", text(40)]
TEXTS += [text(RND.randint(1, 900)) for _ in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(None, "null id", "x", 2), (3, "one", "y", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, `a.b` int").repartition(3)


def check(rows, texts, length=packing.LENGTH):
    tok = Tokenizer.from_file(PATH)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert sorted(by_doc, key=str) == sorted({d for d, _ in texts}, key=str)
    for doc_id, t in texts:
        ids = np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        pieces = sorted(by_doc[doc_id], key=lambda r: (r.start, r.piece))
        copies = sum(1 for d, _ in texts if d == doc_id)
        assert sum(p.length for p in pieces) == copies * len(ids)
        for p in pieces:
            part = ids[p.start : p.start + p.length]
            assert p.piece == p.start // length and p.length == len(part)
            assert p.length == min(length, len(ids) - p.start)
            assert p.ids_crc32 == zlib.crc32(part.tobytes())
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in sequences.values():
        held.sort()
        at = 0
        for offset, size in held:
            assert offset == at
            at += size
        assert at <= length
    return sequences


def test_pack_is_whole_and_gapless(spark, docs):
    rows = packing.pack(docs, PATH).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    sequences = check(rows, texts)
    total = sum(r.length for r in rows)
    # three tasks, each leaves at most its open bins part full
    assert len(sequences) <= -(-total // packing.LENGTH) + 3 * packing.OPEN_BINS


def test_small_sequences_and_few_bins(spark, docs):
    rows = packing.pack(docs, PATH, length=64, open_bins=2).collect()
    sequences = check(rows, [(r.doc_id, r.text) for r in docs.collect()], length=64)
    assert max(sum(s for _, s in held) for held in sequences.values()) == 64


def test_best_fit_closes_fullest_and_fills_tightest():
    packer = packing.BestFit(10, open_bins=2)
    assert packer.put(("a",), 6) == [] and packer.put(("b",), 5) == []  # bins 0 (4 free), 1 (5 free)
    assert packer.put(("c",), 4) == [(0, [("a", 0), ("c", 6)])]  # tightest fit closes bin 0
    closed = packer.put(("d",), 7)  # no fit, two open bins are not reached: open bin 2
    assert closed == []
    closed = packer.put(("e",), 6)  # no fit, two open: close the fullest (bin 2, 3 free)
    assert closed == [(2, [("d", 0)])]
    assert packer.flush() == [(3, [("e", 0)]), (1, [("b", 0)])]  # 4 free before 5 free
    with pytest.raises(ValueError):
        packer.put(("f",), 11)


def test_against_offline_best_fit():
    """Online with many bins packs as tightly as offline best-fit on the same order."""
    sizes = [RND.randint(1, 2048) for _ in range(3000)]
    online = packing.BestFit(2048, open_bins=10_000)
    for i, s in enumerate(sizes):
        online.put((i,), s)
    online_bins = online.next_id
    free, opened = [], 0
    for s in sizes:
        fits = [f for f in free if f >= s]
        if fits:
            best = min(fits)
            free.remove(best)
            if best - s:
                free.append(best - s)
        else:
            opened += 1
            if s < 2048:
                free.append(2048 - s)
    assert online_bins == opened
    bounded = packing.BestFit(2048, open_bins=64)
    for i, s in enumerate(sizes):
        bounded.put((i,), s)
    assert bounded.next_id <= online_bins * 1.02 + 64


def test_empty(spark, docs):
    assert packing.pack(docs.where("doc_id < 0"), PATH).collect() == []


ODD = ["a", "B", "É", "é", "İ", "ß", "ς", "ΑΣ", "क़", "가", "가", "'s", "'LL", "1", "२", ".", ",", "?!", "..."]
ODD += ["<|endoftext|>", "<|endoftext|>.", "<|ENDOFTEXT|>", "<", " ", "  ", "\n", "\t", " ", "　", "\r\n"]
ODD += ["́", "̧", "-", "数", "😀", "‍", "\x00", "\x85", "ª", "ʰ", "÷", "don't", "$", "﻿"]


def test_ids_of_words_are_those_of_the_whole_text():
    rnd = random.Random(5)
    encode = packing.Encoder(PATH, known_words=300)  # starts again many times
    assert encode.wordwise
    for _ in range(60):
        texts = ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 25))) for _ in range(50)]
        plain = encode.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        assert encode(texts) == [np.asarray(e.ids, dtype="<u4").tobytes() for e in plain]


def test_a_word_is_given_to_the_tokenizer_once():
    encode = packing.Encoder(PATH)
    given = []

    class Watched:
        def encode(self, text, **options):
            given.extend(text.split(" "))
            return inner.encode(text, **options)

    inner, encode.tokenizer = encode.tokenizer, Watched()
    encode(["New york, new York. " * 50, "York new? new york\n" * 50])
    encode(["new york new york"] * 50)
    assert sorted(given) == [",", ".", "?", "new", "york"]


def test_other_rules_are_given_whole_texts():
    """Byte-level rules keep the blank before a word, so words in turn would have other ids."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode = packing.Encoder(path)
    assert not encode.wordwise
    plain = encode.tokenizer.encode_batch_fast(["one two  three", ""], add_special_tokens=False)
    assert encode(["one two  three", ""]) == [np.asarray(e.ids, dtype="<u4").tobytes() for e in plain]


def test_words_of_letters_go_straight_to_the_model():
    tok, encode = Tokenizer.from_file(PATH), packing.Encoder(PATH, letters=True)
    encode.tokenizer = None  # the rules are not needed for these
    texts = ["Plain wörds ÉCOLE straßenbahn", "niño\nqueñazo PLAIN of of"]
    expected = [np.asarray(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encode(texts) == expected


def test_odd_words_have_the_librarys_ids():
    letters = "aAzZéÉßÀÖØöøÿ×÷µªº'’.,*#%&$|<>\xad\u0301\u0307\u0130\u212a\u212b\u017f\ufb01數9_-\t\r\x0b\x85\u00a0\u2028\x1cΣςЖ"
    words = ["".join(RND.choice(letters) for _ in range(RND.randint(0, 9))) for _ in range(6000)]
    words += ["".join(RND.choice("aàÉz*,$") for _ in range(RND.randint(1, 30))) for _ in range(2000)]
    texts = [" ".join(words[i : i + 20]) for i in range(0, len(words), 20)]
    tok, encode = Tokenizer.from_file(PATH), packing.Encoder(PATH, known_words=2000, letters=True)
    got = [ids for i in range(0, len(texts), 50) for ids in encode(texts[i : i + 50])]
    for t, ids in zip(texts, got, strict=True):
        assert np.asarray(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() == ids
