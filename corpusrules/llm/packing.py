"""Best-fit packing of tokenised documents into sequences of bounded length.

Method: bounded-space online best-fit. Each task keeps at most ``open_bins`` open sequences,
indexed by free space in a bitset (an int whose bit ``f`` is set when some open sequence has
``f`` tokens free, with a stack of those sequences per free value). A piece goes into the open
sequence with the least free space that still holds it; when none holds it and all bins are
open, the fullest open sequence is closed first; a sequence with no free space closes at once.
Closed sequences are emitted, so a task holds ``open_bins`` sequences of placements at most.

Spark deals the documents over tasks; each task tokenises its rows and packs them, so the
work is one narrow stage with no shuffle and memory bounded by ``open_bins``, the batch and
``KNOWN_WORDS``. All ids come from the ``tokenizers`` library; where its rules cut every text at
blanks, each word is given to it once and its ids are kept for the next occurrence; words of
plain letters go straight to its model.
Sequence ids are ``task partition << 32 | number in the task``: unique and the same when a
lost task is run again over the same rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .rows import batches_of, col, worker_held

LENGTH = 2048
OPEN_BINS = 64
#: Texts given to the tokenizer at once, so that a batch of long texts is not held as ids.
ENCODED_AT_ONCE = 256
#: Words whose ids a worker keeps; beyond that it starts again.
KNOWN_WORDS = 1_000_000
#: New words given to the tokenizer at once.
NEW_WORDS = 2000
END_ID = 0
PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, "
    "sequence_id long, offset long"
)


class BestFit:
    """Open sequences by free space; ``put`` returns the placements of sequences it closes."""

    def __init__(self, capacity: int = LENGTH, open_bins: int = OPEN_BINS, first_id: int = 0):
        self.capacity, self.open_bins, self.next_id = capacity, open_bins, first_id
        self.free_bits = 0  # bit f: an open sequence has f tokens free
        self.by_free: dict[int, list[int]] = {}
        self.bins: dict[int, list] = {}  # id -> [free, placements]

    def put(self, item: tuple, size: int) -> list[tuple[int, list]]:
        if not 0 < size <= self.capacity:
            raise ValueError(f"a piece of {size} tokens does not fit a sequence")
        closed = []
        fitting = self.free_bits >> size << size  # free values >= size
        if fitting:
            free = (fitting & -fitting).bit_length() - 1  # least free space that holds it
            seq = self._take(free)
        else:
            if len(self.bins) >= self.open_bins:
                fullest = (self.free_bits & -self.free_bits).bit_length() - 1
                closed.append(self._close(self._take(fullest)))
            seq, self.next_id = self.next_id, self.next_id + 1
            self.bins[seq] = [self.capacity, []]
        held = self.bins[seq]
        held[1].append((*item, self.capacity - held[0]))
        held[0] -= size
        if held[0] == 0:
            closed.append(self._close(seq))
        else:
            self._file(seq, held[0])
        return closed

    def flush(self) -> list[tuple[int, list]]:
        """Close every open sequence, fullest first."""
        closed = []
        while self.free_bits:
            fullest = (self.free_bits & -self.free_bits).bit_length() - 1
            closed.append(self._close(self._take(fullest)))
        return closed

    def _file(self, seq: int, free: int) -> None:
        self.by_free.setdefault(free, []).append(seq)
        self.free_bits |= 1 << free

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        seq = stack.pop()
        if not stack:
            del self.by_free[free]
            self.free_bits &= ~(1 << free)
        return seq

    def _close(self, seq: int) -> tuple[int, list]:
        return seq, self.bins.pop(seq)[1]


#: Rules that drop white space between matches without white space: no token of one word
#: depends on the next word.
_BLANK = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
_WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, _BLANK, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}
#: Marks that end words, and letters whose small form and bytes Unicode rules leave no choice of.
_POINTS = ".,;:!?*#%&$"
_LETTERS = "a-zß-öø-ÿ"
_SPLIT = re.compile(f"^([{_LETTERS}]+)([{re.escape(_POINTS)}]*)$|^.*$", re.MULTILINE)


def cuts_at_blanks(rules: dict) -> bool:
    """Whether the tokenizer file with these rules gives a text the ids of its words in turn."""
    plain = all(
        not token["lstrip"] and not token["rstrip"] and not token["normalized"] and not token["single_word"]
        and "<" in token["content"] and not any(c.isspace() or c in _POINTS for c in token["content"])
        for token in rules["added_tokens"]
    )
    return plain and all(rules[name] == value for name, value in _WORDWISE.items())


def _parts(word: str) -> tuple[str, ...]:
    """Texts that together have the word's ids, so that fewer of them are new: points behind a
    letter are a match of their own, and capitals count as small letters."""
    if "<" in word:  # may hold an added token, which is matched as it is written
        return (word,)
    stem = word.rstrip(_POINTS)
    if stem and (stem[-1] >= "\u0100" or not stem[-1].isalpha()):
        stem = word
    points = word[len(stem) :]
    if stem.isascii():
        stem = stem.lower()
    return (stem, points) if stem and points else (stem or points,)


class LetterEncoder:
    """The ids of words of ``_LETTERS`` alone, by the model of a word-wise tokenizer.

    Its rules leave such a word as it is, one match; so the library gets the bytes of many words,
    spelt as its model spells them, cut at blanks only. Where one word ends among the ids is told
    by the bytes that each id stands for.
    """

    def __init__(self, rules: dict):
        from tokenizers import Tokenizer

        bare = {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.tokenizer = Tokenizer.from_str(json.dumps({**rules, **bare}))
        suffix = rules["model"]["end_of_word_suffix"] or ""
        vocab = self.tokenizer.get_vocab()
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, number in vocab.items():
            self.size[number] = len(token.removesuffix(suffix))
        # the bytes of these letters in UTF-8, spelt as byte-level tokens are
        spelt = [0xC3, *range(0x80, 0xC0)]
        plain = {*range(0xA1, 0xAD), *range(0xAE, 0x100)}
        others = [b for b in range(0x100) if b not in plain and not 0x21 <= b <= 0x7E]
        self.spelling = {b: chr(b if b in plain else 0x100 + others.index(b)) for b in spelt}

    def __call__(self, words: list[str]) -> list[bytes]:
        text = " ".join(words)
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.spelling)
        encoded = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        ids = np.asarray(encoded.ids, dtype="<u4")
        sizes = np.fromiter(map(len, text.split(" ")), np.int64, len(words))
        ends, stops = np.cumsum(self.size[ids]), np.cumsum(sizes)
        at = np.searchsorted(ends, stops)
        if len(ids) == 0 or ends[-1] != stops[-1] or (ends[at] != stops).any():
            raise ValueError("the ids do not stand for the words' bytes")
        data, cuts = ids.tobytes(), (4 * (at + 1)).tolist()
        return [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


class Encoder:
    """The ids of texts, 4 bytes each, little-endian, by a ``tokenizers`` file.

    With ``letters``, words of plain letters go straight to the tokenizer's model.
    """

    def __init__(self, path: str, known_words: int = KNOWN_WORDS, letters: bool = False):
        # Spark already runs one task per core: threads of the tokenizer would only compete.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        self.wordwise = cuts_at_blanks(rules)
        self.letters = LetterEncoder(rules) if self.wordwise and letters else None
        self.known_words = known_words
        self.known = {"": b""}

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.wordwise:
            encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            return [np.asarray(e.ids, dtype="<u4").tobytes() for e in encoded]
        if len(self.known) > self.known_words:
            self.known = {"": b""}
        words = [t.replace("\n", " ").split(" ") for t in texts]
        self._learn(list(set().union(*words).difference(self.known)))
        ids = self.known.__getitem__
        return [b"".join(map(ids, w)) for w in words]

    def _learn(self, words: list[str]) -> None:
        if not words:
            return
        known = self.known
        split = _SPLIT.findall("\n".join(words).lower())
        stems = list({stem for stem, _ in split if stem and stem not in known})
        for at in range(0, len(stems), NEW_WORDS) if self.letters else ():
            some = stems[at : at + NEW_WORDS]
            known.update(zip(some, self.letters(some), strict=True))
        others = {p for _, p in split}.union(() if self.letters else stems)
        parts = {w: _parts(w) for w, (stem, _) in zip(words, split, strict=True) if not stem}
        self._learn_any(others.union(*parts.values()).difference(known))
        for word, (stem, point) in zip(words, split, strict=True):
            if not stem:
                known[word] = b"".join([known[p] for p in parts[word]])
            else:
                known[word] = known[stem] + known[point] if point else known[stem]

    def _learn_any(self, words: Iterable[str]) -> None:
        """By the tokenizer with all its rules."""
        new = list(words)
        for at in range(0, len(new), NEW_WORDS):
            some = new[at : at + NEW_WORDS]
            encoded = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            stops = np.cumsum([len(p) + 1 for p in some])  # places in the text, blanks included
            starts = np.fromiter((o[0] for o in encoded.offsets), np.int64, len(encoded))
            owner = np.searchsorted(stops, starts, side="right")
            if len(owner) and (np.diff(owner) < 0).any():
                raise ValueError("ids of one word stand behind those of the next")
            ends = np.cumsum(4 * np.bincount(owner, minlength=len(some))).tolist()
            data = np.asarray(encoded.ids, dtype="<u4").tobytes()
            first = 0
            for part, end in zip(some, ends, strict=True):
                self.known[part] = data[first:end]
                first = end


@worker_held
def encoder(path: str) -> Encoder:
    """One for all tasks of a Python worker, which keeps the words it has met."""
    return Encoder(path, letters=True)


def pieces_of(ids: list[int] | np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids cut into pieces of ``length``."""
    data = np.asarray(ids, dtype="<u4")
    for number, start in enumerate(range(0, len(data), length)):
        part = data[start : start + length]
        yield number, start, len(part), zlib.crc32(part.tobytes())


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    length: int = LENGTH,
    open_bins: int = OPEN_BINS,
    text: str = "text",
) -> DataFrame:
    """One row per piece of every document: ``PIECES``.

    A document is its ids by the ``tokenizers`` file ``tokenizer_path`` (no special tokens
    added) followed by id ``END_ID``; a null or empty text is that id alone. Documents longer
    than ``length`` are cut into pieces of ``length`` ids, the last one shorter; shorter ones
    stay whole. Sequences hold at most ``length`` ids; ``offset`` is a piece's place in its
    sequence, gapless from 0 in the order the pieces went in. Rows with a null ``doc_id``
    are packed like others and keep their null. Other columns of ``docs`` are not returned,
    so names that clash with the output do not matter. Repeated rows are packed each time.
    An empty table gives no rows.
    """
    source = docs.select(col("doc_id").cast("long").alias("doc_id"), col(text).cast("string"))
    schema = T.StructType.fromDDL(PIECES)
    names = schema.names
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        end = np.asarray([END_ID], dtype="<u4").tobytes()
        task = TaskContext.get()
        first = (task.partitionId() if task else 0) << 32
        packer = BestFit(length, open_bins, first)

        def placements() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, ENCODED_AT_ONCE):
                    part = batch.slice(at, ENCODED_AT_ONCE)
                    texts = [t or "" for t in part.column(1).to_pylist()]
                    for doc_id, ids in zip(part.column(0).to_pylist(), encode(texts), strict=True):
                        for piece, start, size, crc in pieces_of(np.frombuffer(ids + end, "<u4"), length):
                            for seq, held in packer.put((doc_id, piece, start, size, crc), size):
                                yield from ((*p[:5], seq, p[5]) for p in held)
            for seq, held in packer.flush():
                yield from ((*p[:5], seq, p[5]) for p in held)

        yield from batches_of(placements(), names, kinds)

    return source.mapInArrow(run, schema)
