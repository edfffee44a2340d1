"""The statement split against a line-by-line loop, on random files."""

import random

import pytest
from pyspark.sql import functions as F

from corpusrules.functions.sql_text import statement_array
from corpusrules.functions.text import WS, extract_all

BLANKS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
PARTS = [
    "a", "SELECT 1", ";", ";", "$$", "$$", "$", "$$$", "--", "-- x;", "-- $$", " ", "\t", "\r", "\u00a0",
    "\u2028", "\x85", "-", "/*", "'", "é", "end;", "$$;", ";;", "; --", ";\u3000",
]


def split(text, dollar_quotes):
    """The rule, one line at a time."""
    found, piece, start, code, dollars = [], [], 1, False, 0
    for n, line in enumerate(text.split("\n"), 1):
        piece.append(line)
        bare = line.strip(BLANKS)
        if bare == "" or bare.startswith("--"):
            continue
        if not code:
            start, code = n, True
        dollars += line.count("$$")
        if bare.endswith(";") and not (dollar_quotes and dollars % 2):
            found.append(("\n".join(piece).strip(BLANKS), start))
            piece, code = [], False
    rest = "\n".join(piece).strip(BLANKS)
    return found + ([(rest, start)] if rest else [])


def random_text(r):
    lines = ["".join(r.choices(PARTS, k=r.randint(0, 4))) for _ in range(r.randint(0, 12))]
    return "\n".join(lines)


@pytest.mark.parametrize("dollar_quotes", [True, False])
def test_split(spark, dollar_quotes):
    r = random.Random(7)
    texts = [random_text(r) for _ in range(20000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4)
    rows = df.select("i", statement_array(F.col("t"), dollar_quotes).alias("s")).collect()
    assert len(rows) == len(texts)
    for row in rows:
        got = [(s.text, s.start_line) for s in row.s]
        assert got == split(texts[row.i], dollar_quotes), repr(texts[row.i])


def test_white_space_class_is_exact(spark):
    df = spark.range(0x110000).filter("id < 55296 or id > 57343")
    # code points beyond the basic plane are two units in a pattern and none of them is white space
    text = df.filter("id < 65536").select(
        "id", F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c")
    )
    hits = text.filter(F.size(extract_all(F.col("c"), WS, 0)) > 0).select("id").collect()
    assert sorted(h.id for h in hits) == sorted(map(ord, BLANKS))


def test_long_lines_need_no_stack(spark):
    df = spark.range(1).select(
        F.concat(
            F.lit("SELECT "), F.repeat(F.lit("a;b $x$ $$y;$$ "), 20000), F.lit(";\n"),
            F.repeat(F.lit("-- c\n"), 20000), F.lit("$$"), F.repeat(F.lit("x;\n$"), 20000), F.lit("$$;\nZ"),
        ).alias("t")
    )
    s = df.select(statement_array(F.col("t"))).first()[0]
    assert [x.start_line for x in s] == [1, 20002, 40003]
