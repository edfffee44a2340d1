"""Text primitives shared by every operator.

Java regular expressions differ from the ones this library has to agree with in
three places, so the classes are written out once here:

* white space includes NBSP, BOM and the Unicode spaces;
* word boundaries are ASCII only (Java counts accented letters as word characters);
* ``.`` stops at LF, CR, U+2028 and U+2029 only, and the end of text is ``\\z``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# the range in front lets every character below it fail after two tests
_WIDE = r"[\u1680-\uFEFF&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]]"
WS = rf"[ \t\n\x0B\f\r\u00A0{_WIDE}]"
NOT_WS = r"[^ \t\n\x0B\f\r\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
WS_IN_LINE = rf"[ \t\x0B\f\r\u00A0{_WIDE}]"
REST_OF_LINE = r"[^\n\r\u2028-\u2029]"
NOT_AFTER_WORD = r"(?<![A-Za-z0-9_])"
NOT_BEFORE_WORD = r"(?![A-Za-z0-9_])"

_WS_CHARS = (
    " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

NL = "\n"


def strip(col: Column) -> Column:
    """Remove white space (the wide class, not only blanks) at both ends."""
    return F.btrim(col, F.lit(_WS_CHARS))


def lines_of(col: Column) -> Column:
    return F.split(col, "\n", -1)


def newlines_of(col: Column) -> Column:
    """The line breaks of a text and nothing else."""
    return F.regexp_replace(col, r"[^\n]+", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``.

    A column referenced from inside a lambda would be inlined by the optimizer
    and evaluated again for each array element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def extract(col: Column, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern`` or null."""
    return F.nullif(F.regexp_extract(col, pattern, group), F.lit(""))


def extract_all(col: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def matches(col: Column, pattern: str) -> Column:
    return F.regexp_like(col, F.lit(pattern))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def first_line(col: Column, default: str = "No description") -> Column:
    """First line of a text, or ``default`` if there is none."""
    return F.coalesce(
        F.nullif(F.split_part(col, F.lit("\n"), F.lit(1)), F.lit("")), F.lit(default)
    )
