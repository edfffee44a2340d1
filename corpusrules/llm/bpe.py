"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

The merges of a rank file are compiled into a trie of tokens and a relation *a may be
followed by b* (the merges of the bytes of ``a`` and ``b`` give just ``a, b``). A sequence
of tokens is the encoding of its bytes if and only if each adjacent pair is in that
relation, so every prefix of a text has one last token. A non-deterministic transducer
holds, for each place where a token may still be growing, its trie node and the token
that ends there. A deterministic state is the tuple of all these; a transition goes to the
next state and puts out the last token of the prefix. States and transitions are made when
a text first needs them and dropped together when there are too many. A place dies after as
many bytes as the longest token has, so all live places soon agree on what lies behind
them: those tokens are emitted every ``LOOK`` bytes and at the end of a piece.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import sys
from array import array
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .rows import add_columns, worker_held

MAX_STATES = 150_000
LOOK = 4096
MAX_PIECES = 600_000
MAX_HELD = 12_000_000

#: UTF-8: length of the character that a lead byte begins.
_LEAD = [1] * 0x80 + [0] * 0x42 + [2] * 0x1E + [3] * 0x10 + [4] * 0x5 + [0] * 0xB


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Transducer:
    """Encoder of one piece of text; what it has compiled so far is kept between pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        self.next: dict[int, int] = {}
        self.accepts: dict[int, int] = {}
        self.depth = [0]
        for text, rank in ranks.items():
            node = 0
            for depth, byte in enumerate(text, 1):
                node = self.next.setdefault(node << 8 | byte, len(self.depth))
                if node == len(self.depth):
                    self.depth.append(depth)
            self.accepts[node] = rank
        self.follows: dict[int, bool] = {}
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.forget()

    def forget(self) -> None:
        """Drop what was determinised; the start state is 0."""
        start = ((0, -1),)
        self.numbers = {start: 0}
        self.states = [start]
        self.moves: dict[int, tuple[int, int]] = {}

    def halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens that a token is merged from; None if it is one byte or never made."""
        if rank not in self.splits:
            text, parts = self.token[rank], None
            if len(text) > 1:
                parts = self._last_two(text)
            self.splits[rank] = parts
        return self.splits[rank]

    def _last_two(self, text: bytes) -> tuple[int, int] | None:
        """Merges in rank order, leftmost first, as far as the two parts before the last."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 2:
            best, at = min(
                (self.ranks.get(a + b, sys.maxsize), i)
                for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))
            )
            if best == sys.maxsize:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def edge(self, rank: int, side: int) -> list[tuple[int, int]]:
        """Tokens at one edge of a token while it is merged, with the rank that ends each."""
        key = rank, side
        if key not in self.edges:
            steps, ends, at = [], sys.maxsize, rank
            while True:
                steps.append((at, ends))
                halves = self.halves(at)
                if halves is None:
                    break
                ends, at = at, halves[side]
            self.edges[key] = steps[::-1]
        return self.edges[key]

    def made(self, rank: int) -> bool:
        return len(self.token[rank]) == 1 or self.halves(rank) is not None

    def may_follow(self, left: int, right: int) -> bool:
        """Whether no merge across the border of the two comes first; -1: start of a piece."""
        if left < 0:
            return self.made(right)
        known = self.follows.get(left << 32 | right)
        if known is None:
            known = self.made(right) and self._apart(left, right)
            if len(self.follows) > 20 * MAX_STATES:
                self.follows.clear()
            self.follows[left << 32 | right] = known
        return known

    def _apart(self, left: int, right: int) -> bool:
        token, ranks = self.token, self.ranks
        lefts, rights = self.edge(left, 1), self.edge(right, 0)
        i = j = 0
        while True:
            (a, a_ends), (b, b_ends) = lefts[i], rights[j]
            across = ranks.get(token[a] + token[b])
            # of merges of one rank the leftmost comes first
            if across is not None and across < a_ends and across <= b_ends:
                return False
            if a_ends == b_ends == sys.maxsize:
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1

    def determinise(self, state: int, byte: int) -> tuple[int, int]:
        """Target of a transition that no text has needed before, and the last token there."""
        grown, last = [], -1
        step, accepts, follows = self.next.get, self.accepts.get, self.follows.get
        for node, left in self.states[state]:
            node = step(node << 8 | byte)
            if node is not None:
                grown.append((node, left))
                if last < 0:
                    rank = accepts(node, -1)
                    if rank >= 0:
                        good = follows(left << 32 | rank) if left >= 0 else None
                        if self.may_follow(left, rank) if good is None else good:
                            last = rank
        if last < 0:
            raise ValueError("the ranks lack single bytes")
        grown.append((0, last))
        move = self.number(tuple(grown)), last
        self.moves[state << 8 | byte] = move
        return move

    def number(self, live: tuple[tuple[int, int], ...]) -> int:
        number = self.numbers.setdefault(live, len(self.states))
        if number == len(self.states):
            self.states.append(live)
        return number

    def agreed(self, state: int, lasts: list[int], done: int) -> list[int]:
        """Tokens behind place ``done`` that all live places have in common, in order."""
        chains, here = [], done + len(lasts)
        for node, _ in self.states[state]:
            at, chain = here - self.depth[node], []
            while at > done:
                chain.append(lasts[at - done - 1])
                at -= self.size[chain[-1]]
            chains.append(chain[::-1])
        out = []
        for tokens in zip(*chains, strict=False):
            if len(set(tokens)) > 1:
                break
            out.append(tokens[0])
        return out

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > MAX_STATES:
            self.forget()
        state, moves, out, lasts, done = 0, self.moves, [], [], 0
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                if len(self.states) > 2 * MAX_STATES:  # a very long piece takes its state along
                    live = self.states[state]
                    self.forget()
                    state, moves = self.number(live), self.moves
                move = self.determinise(state, byte)
            state, last = move
            lasts.append(last)
            if len(lasts) >= LOOK:
                tokens = self.agreed(state, lasts, done)
                size = sum(self.size[t] for t in tokens)
                out += tokens
                del lasts[:size]
                done += size
        behind = []
        while lasts:
            behind.append(lasts[-1])
            del lasts[-self.size[behind[-1]] :]
        return out + behind[::-1]


class StreamDecoder:
    """Ids in, complete characters out; up to three bytes of an open character are held.

    The machine works on tokens: from (held bytes, id) to (held bytes, text bytes), each
    such move worked out once. A byte that can't go on is passed on as it stands, so the
    bytes that come out are those of the tokens.
    """

    def __init__(self, token: dict[int, bytes]):
        self.token = token
        self.held = b""
        self.moves: dict[tuple[bytes, int], tuple[bytes, bytes]] = {}

    def push(self, ids) -> bytes:
        held, moves, out = self.held, self.moves, []
        for i in ids:
            move = moves.get((held, i))
            if move is None:
                if len(moves) > MAX_STATES:
                    moves.clear()
                move = moves[held, i] = self._move(held, i)
            held = move[0]
            out.append(move[1])
        self.held = held
        return b"".join(out)

    def _move(self, held: bytes, i: int) -> tuple[bytes, bytes]:
        data = held + self.token[i]
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead >= 0xC2:
                if _LEAD[lead] > back:
                    return data[-back:], data[:-back]
                break
            if lead < 0x80:
                break
        return b"", data

    def close(self) -> bytes:
        rest, self.held = self.held, b""
        return rest


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        # \s of a rank file's pattern means the Unicode property White_Space
        self.pieces = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.transducer = Transducer(ranks)
        self.decoder = StreamDecoder(self.transducer.token)
        self.known: dict[str, list[int]] = {}
        self.held = 0

    def encode(self, text: str) -> list[int]:
        known, pieces = self.known, self.pieces.findall(text)
        if len(known) > MAX_PIECES or self.held > MAX_HELD:
            known.clear()
            self.held = 0
        for piece in set(pieces).difference(known):
            known[piece] = self.transducer.encode(piece.encode())
            self.held += len(piece)
        return list(chain.from_iterable(map(known.__getitem__, pieces)))

    def decode(self, ids, chunk: int = 65536) -> bytes:
        out = [self.decoder.push(ids[i : i + chunk]) for i in range(0, len(ids), chunk)]
        return b"".join([*out, self.decoder.close()])


@worker_held
def codec(path: str, pattern: str) -> Codec:
    """One per Python worker and rank file; its tables hold no cycles to look for."""
    made = Codec(read_ranks(path), pattern)
    gc.freeze()
    gc.set_threshold(200_000, 50, 1000)
    return made


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``ids array<int>``: the text cut by ``pattern``, each piece merged by rank.

    A null text counts as empty; an empty text has no ids. ``path`` must be readable
    on every executor (an installed vocabulary).
    """

    def make():
        c = codec(path, pattern)
        return lambda text: (c.encode(text or ""),)

    return add_columns(df, text_col, "ids array<int>", make)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded binary``, the bytes of ``ids_col``; null or empty gives none."""
    kept = df.drop("decoded")
    names = [*kept.columns, "decoded"]
    at = kept.columns.index(ids_col)

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            out = pa.array([c.decode(ids.as_py() or []) for ids in batch.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=names)

    schema = T.StructType([*kept.schema.fields, T.StructField("decoded", T.BinaryType())])
    return kept.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``df`` with number and digest of the ids, and digest of the bytes decoded from them.

    ``ids_sha256`` is over the ids as little-endian 32-bit numbers. Encoding and
    decoding share one pass, so ids of long texts never travel.
    """

    def make():
        c = codec(path, pattern)

        def one(text):
            ids = c.encode(text or "")
            packed = array("I", ids)
            if sys.byteorder == "big":
                packed.byteswap()
            return (
                len(ids),
                hashlib.sha256(packed.tobytes()).hexdigest(),
                hashlib.sha256(c.decode(ids)).hexdigest(),
            )

        return one

    return add_columns(
        df, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", make
    )
