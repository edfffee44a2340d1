"""Licence scan by sentences: known sentences become identifiers, rules are sequences of them.

Native columns. A text is cut into sentences twice, at line ends and regardless of them
(wrapped lines, where blank lines and lines of a copyright or SPDX mark are borders all the same);
each piece is normalised to lower-case words and digits, and up to ``PIECES`` pieces together are
looked up among the known licence sentences, so a colon inside one does no harm. The sequence of
identifiers is matched with rules, in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import col

#: Normalised sentence to identifier.
SENTENCES = {
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "spdx license identifier mit": "mit-spdx",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "licensed under the apache license version 2 0": "apache-ref",
    "licensed under the apache license version 2 0 the license": "apache-ref",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-basis",
    "spdx license identifier apache 2 0": "apache-spdx",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "licensed under the gnu general public license version 3": "gpl3-ref",
    "spdx license identifier gpl 3 0": "gpl3-spdx",
    "spdx license identifier gpl 3 0 only": "gpl3-spdx",
    "spdx license identifier gpl 3 0 or later": "gpl3-spdx",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-see",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "licensed under the bsd 3 clause license": "bsd3-ref",
    "spdx license identifier bsd 3 clause": "bsd3-spdx",
    "licensed under cc by 4 0": "cc-by-ref",
    "licensed under cc by sa 4 0": "cc-by-sa-ref",
    "licensed under cc by nc 4 0": "cc-by-nc-ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-ref",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
}
#: Licence, identifiers that must follow each other in this order (others may stand between).
RULES = (
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-spdx",)),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("Apache-2.0", ("apache-ref",)),
    ("Apache-2.0", ("apache-comply", "apache-basis")),
    ("Apache-2.0", ("apache-spdx",)),
    ("GPL-3.0", ("gpl3-ref",)),
    ("GPL-3.0", ("gpl3-grant",)),
    ("GPL-3.0", ("gpl3-spdx",)),
    ("BSD", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD", ("bsd3-ref",)),
    ("BSD", ("bsd3-spdx",)),
    ("CC-BY-4.0", ("cc-by-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    ("Unlicense", ("unlicense",)),
)
#: Any known sentence holds one of these, in any case.
HINT = (
    "licen[cs]e|permission|copyright|software|redistribution|warrant|rights reserved|cc by|cc-by"
)


#: A known sentence is cut into so many pieces at most, by its colons and semicolons.
PIECES = 3
#: Lines without letters and digits, and lines that are a sentence for themselves (Java).
_BLANK = r"\n[^\p{L}\p{N}\n]*(?=\n)"
_MARK = (
    r"(?m)^([^\p{L}\p{N}\n]*(?:Copyright[ \t]+[A-Z0-9(©]|(?i:copyright[ \t:]*(?:\(c\)|©|\d{4}))"
    r"|(?:\([cC]\)|©)[ \t]*\d{4}|(?i:spdx-[a-z]+:))[^\n]*)$"
)
#: What ends a sentence inside a line: its mark, an address between blanks, the end of a comment.
_CUT = r"([.!?:;])[ \t]+|\x01|\*/|-->|[ \t]https?://[^\s]+(?=[ \t])"


def _plain(sentence: Column) -> Column:
    words = F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))
    words = F.regexp_replace(words, "^(?:[0-9]{1,2}|[a-h]|i{1,3}) (?=redistribution)", "")
    return F.regexp_replace(words, "^.{1,80} is free software$", "this program is free software")


def _identifiers(sentences: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    plain = F.filter(F.transform(sentences, _plain), lambda s: s != "")

    def found(pieces, at):
        some = [F.array_join(F.slice(pieces, at + 1, n), " ") for n in range(PIECES, 0, -1)]
        return F.coalesce(*[F.get(F.array(known[s]), F.lit(0)) for s in some])

    # one array of arrays, so that the pieces are made once and not for each of them
    rows = F.transform(F.array(plain), lambda p: F.transform(p, lambda _, i: found(p, i)))
    return F.filter(F.get(rows, F.lit(0)), lambda x: x.isNotNull())


def _sentences(text: Column, by_line: bool) -> Column:
    text = F.regexp_replace(text, "\r\n?", "\n")
    if not by_line:
        text = F.regexp_replace(F.regexp_replace(text, _BLANK, "\x01"), _MARK, "\x01$1\x01")
        text = F.regexp_replace(text, "\n", " ")
    return F.split(F.regexp_replace(text, _CUT, "$1\n"), "\n", -1)


def _pattern(rule: tuple[str, ...]) -> str:
    return ",(?:[^,]+,)*".join(f"{x}" for x in rule)


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``sentence_ids`` (array, in text order) and ``licenses`` (array, sorted).

    ``sentence_ids`` is the longer of the two sequences, by line if they are equally long.
    Null and empty texts have neither. Rows stand for themselves, nothing is shuffled;
    columns of these names, or beginning with ``__l_``, are replaced.
    """
    names = [c for c in df.columns if c not in ("sentence_ids", "licenses") or c == text_col]
    text = F.when(col(text_col).rlike(f"(?i){HINT}"), col(text_col))
    out = df.select(*[col(c) for c in names]).withColumns(
        {
            "__l_lines": _identifiers(_sentences(text, True)),
            "__l_flow": _identifiers(_sentences(text, False)),
        }
    )
    none = F.array().cast("array<string>")
    lines, flow = (F.coalesce(F.col(c), none) for c in ("__l_lines", "__l_flow"))
    both = [F.concat(F.lit(","), F.array_join(x, ","), F.lit(",")) for x in (lines, flow)]
    found = [
        F.when(both[0].rlike(f",{_pattern(rule)},") | both[1].rlike(f",{_pattern(rule)},"), F.lit(name))
        for name, rule in RULES
    ]
    return out.select(
        *[col(c) for c in names if c not in ("sentence_ids", "licenses")],
        F.when(F.size(flow) > F.size(lines), flow).otherwise(lines).alias("sentence_ids"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*found)))).alias("licenses"),
    )
