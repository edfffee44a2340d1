"""Secret scan: fixed patterns, and novelty against dictionaries measured with zstandard.

A string in the same paragraph or statement as a sensitive word, before or behind it, is a
candidate. Its novelty is the number of bytes by which it makes the compressed surroundings
longer: the compressor is primed with a dictionary of identifiers and common words and
has the text around the candidate before it. A name, a path or a repeated value costs
little; a random key costs its own entropy and is reported as ``novel``: more than ``NOVEL_BITS``
a character, or, if it is long, as much as random characters of its alphabet cost, if its
characters are spread as those of a random string of that length are.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import add_columns

KINDS = ("assign", "access", "hex", "novel")
_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")

CONTEXT = 512
#: Marginal compressed bits per character from which a string counts as incompressible.
NOVEL_BITS = 6.5
#: From this length on the fixed costs of a string no longer carry it over ``NOVEL_BITS``.
_LONG = 32
#: The share of the entropy of its alphabet that a random string costs at least, and the share of
#: the entropy to be expected of its characters that they have at least.
_COST, _SPREAD = 0.85, 0.94
#: Alphabets, the narrower first; all other strings count as base64.
_ALPHABETS = (
    (16, re.compile(r"(?:[0-9A-F]+|[0-9a-f]+)=*")),
    (32, re.compile(r"[A-Z2-7]+=*")),
    (36, re.compile(r"(?:[0-9A-Z]+|[0-9a-z]+)")),
    (62, re.compile(r"[0-9A-Za-z]+")),
)
#: Ends of a paragraph or a statement.
_BORDER = re.compile(r"\n[ \t\r]*(?=\n)|;(?=[ \t\r]*\n)")

_SENSITIVE = re.compile(
    r"passw|pwd|secret|token|api_?key|credential|auth|bearer|private|signature|session|"
    r"access|encryption|salt|cookie|webhook",
    re.IGNORECASE | re.ASCII,
)
_NEAR = (
    "passw", "pwd", "secret", "token", "apikey", "api_key", "credential", "auth", "bearer",
    "private", "signature", "session", "access", "encryption", "salt", "cookie", "webhook",
)
_STRING = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

#: Identifiers and words of source code and configuration that prime the compressor.
IDENTIFIERS = (
    "abstract account address allocate application argument array assert async attribute "
    "authenticate authorization await backend background before boolean branch browser buffer "
    "build button bytes callback channel character checksum children class client close "
    "collection column command comment commit component compress config configuration connect "
    "connection console constant constructor container content context controller convert cookie "
    "counter create credential current customer database dataset datetime debug decode default "
    "define delete deploy description destination development dictionary directory document "
    "domain download element email enable encode encoding endpoint environment error event "
    "example exception execute expected exports extension factory false field filename filter "
    "float folder format forward function gateway generate getElementById handler header height "
    "history hostname identifier image implements import include index information initialize "
    "input insert instance integer interface internal iterator javascript keyword label language "
    "length library listener loader location logger manager mapping message metadata method "
    "middleware migration model module monitor namespace network node notification null number "
    "object offset operator option order output override package parameter parent parse partition "
    "password payload permission pipeline placeholder platform policy position prefix previous "
    "primary private process production profile project property protocol provider public publish "
    "query queue random receive record redirect reference register release remote remove render "
    "replace repository request require resource response result return route schema script "
    "search secret section select sender sequence serialize server service session setting "
    "signature socket source static status storage stream string struct subscribe success suffix "
    "switch symbol system target template terminal test thread timeout timestamp title token "
    "transaction transform true undefined unique update upload username validate value variable "
    "version virtual void volume warning webhook width window worker wrapper "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 "
    "https http localhost www com org net"
)


class Novelty:
    def __init__(self, identifiers: str = IDENTIFIERS):
        primed = zstandard.ZstdCompressionDict(
            identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT
        )
        self.compressor = zstandard.ZstdCompressor(
            level=9, dict_data=primed, write_checksum=False, write_content_size=False
        )

    def bits(self, candidate: str, before: str, after: str) -> float:
        """Marginal compressed bits per character of ``candidate`` between its surroundings."""
        around = (before + after).encode()
        with_it = around + candidate.encode()
        more = len(self.compressor.compress(with_it)) - len(self.compressor.compress(around))
        return 8 * more / len(candidate)


def spans_of(text: str | None, novelty: Novelty) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of each finding, in that order; code points."""
    if not text:
        return []
    found = []
    lower = text.lower()
    if any(w in lower for w in _WORDS):
        found += [
            (m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12
        ]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if any(w in lower for w in _NEAR):
        found += _novel(text, sorted((s, e) for s, _, e in found), novelty)
    return sorted(found)


@functools.lru_cache(maxsize=4096)
def _expected(size: int, length: int) -> float:
    """Mean entropy of the characters of a random string over an alphabet of ``size``."""
    total, p = 0.0, 1 / size
    for k in range(1, length):
        log = math.lgamma(length + 1) - math.lgamma(k + 1) - math.lgamma(length - k + 1)
        log += k * math.log(p) + (length - k) * math.log1p(-p)
        total -= math.exp(log) * k / length * math.log2(k / length)
    return size * total


def _random(value: str, bits: float) -> bool:
    """Does ``value`` cost what a random string of its alphabet and length costs?"""
    if bits >= NOVEL_BITS:
        return True
    size = next((n for n, p in _ALPHABETS if p.fullmatch(value)), 64)
    if len(value) < _LONG or bits < _COST * math.log2(size):
        return False
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return entropy >= _SPREAD * _expected(size, min(n, 2000))


def _paragraphs(text: str):
    at = 0
    for border in _BORDER.finditer(text):
        yield at, border.end()
        at = border.end()
    yield at, len(text)


def _novel(text: str, base: list[tuple[int, int]], novelty: Novelty):
    """Candidates of every paragraph with a sensitive word; each string is judged once."""
    first = 0
    for start, end in _paragraphs(text):
        if not _SENSITIVE.search(text, start, end):
            continue
        for m in _STRING.finditer(text, start, end):
            s, e = m.span()
            while first < len(base) and base[first][1] <= s:
                first += 1
            at = first
            while at < len(base) and base[at][0] <= s and base[at][1] < e:
                at += 1
            if at < len(base) and base[at][0] <= s:  # the base patterns have all of it
                continue
            value = m[0]
            if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
                continue
            before = text[max(0, s - CONTEXT) : s]
            if _random(value, novelty.bits(value, before, text[e : e + CONTEXT])):
                yield s, 3, e


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``secrets array<struct<kind, start, end>>``, by start, then kind.

    Ends are exclusive and count code points of the whole text. Null and empty texts
    give an empty array; rows are independent of each other, nothing is shuffled.
    """

    def make():
        novelty = Novelty()
        return lambda text: (
            [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans_of(text, novelty)],
        )

    schema = "secrets array<struct<kind: string, start: int, `end`: int>>"
    return add_columns(df, text_col, schema, make)


def digests(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_assign, n_access, n_hex, base_sha256 and spans in place of the array."""
    found = scan(df, text_col)
    base = F.filter("secrets", lambda x: x["kind"] != "novel")

    def joined(spans):
        return F.array_join(
            F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","
        )

    def count(kind):
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")

    return found.withColumns(
        {
            "n_assign": count("assign"),
            "n_access": count("access"),
            "n_hex": count("hex"),
            "n_novel": count("novel"),
            "base_sha256": F.sha2(joined(base), 256),
            "spans": joined(F.col("secrets")),
        }
    ).drop("secrets")

