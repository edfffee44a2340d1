"""Column functions over the text of SQL files and SQL statements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import (
    NL,
    NOT_AFTER_WORD,
    NOT_BEFORE_WORD,
    NOT_WS,
    REST_OF_LINE,
    WS,
    WS_IN_LINE,
    extract,
    extract_all,
    let,
    lines_of,
    matches,
    newlines_of,
    strip,
)

# Object kinds, table keywords and the words that make a string look like SQL.
CREATE_KINDS = ("procedure", "function", "view", "trigger")
TABLE_KEYWORDS = ("FROM", "JOIN", "INTO", "UPDATE")
SQL_WORDS = (
    "SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP",
    "WITH", "FROM", "WHERE", "JOIN", "GROUP BY", "ORDER BY",
)
SQL_CALLEES = ("spark.sql", "execute", "sql")

# A statement is any number of lines that do not close it and one that does, or the end
# of the text. All repetitions are possessive: the matcher never goes back, so a file
# takes one pass and no stack. A line is seen in parts: runs without special characters,
# a semicolon inside the line, and $$ bodies, which may run over many lines (comment
# lines in a body are passed over whole).
_COMMENT = rf"{WS_IN_LINE}*+--[^\n]*+"
_INNER_SEMICOLON = rf";(?!{WS_IN_LINE}*+(?:\n|\z))"
_BODY = rf"\$\$(?:[^\n$]++|\$(?!\$)|\n(?:{_COMMENT})?+)*+(?:\$\$|\z)"
_LINE_PARTS = {
    True: rf"(?:[^\n;$]++|{_INNER_SEMICOLON}|\$(?!\$)|{_BODY})*+",
    False: rf"(?:[^\n;]++|{_INNER_SEMICOLON})*+",
}
_STATEMENT = {
    quotes: rf"(?:[^\n;$]*+\n|{_COMMENT}\n|{parts}\n)*+(?:{_COMMENT}|{parts}(?:;{WS_IN_LINE}*+)?+)(?:\n|\z)"
    for quotes, parts in _LINE_PARTS.items()
}
# blank and comment lines in front of the code of a statement, and its first character
_UP_TO_CODE = rf"^(?:{WS_IN_LINE}*+(?:--[^\n]*+)?+\n)*+{WS_IN_LINE}*+(?!--)[^\n]"

_LEADING_COMMENTS = rf"^(?:{WS_IN_LINE}*(?:(?:--|/\*)[^\n]*)?(?:\n|\z))*+"
_DESCRIPTION_LINE = (
    rf"(?md)^{WS_IN_LINE}*--{WS_IN_LINE}*+(?!(?i:business_rule))([^\n]*?){WS_IN_LINE}*$"
)

_QUOTED = "|".join(
    rf"f?{q}({body}*?){q}"
    for q, body in (
        ('"""', r"[\s\S]"),
        ("'''", r"[\s\S]"),
        ('"', r'[^"]'),
        ("'", r"[^']"),
    )
)
_CALL = (
    "(?:" + "|".join(c.replace(".", r"\.") for c in SQL_CALLEES) + ")"
    rf"{WS}*\({WS}*(?:{_QUOTED})"
)


def statement_array(content: Column, dollar_quotes: bool = True) -> Column:
    """``array<struct<text, start_line>>`` of the statements of one file.

    A statement ends at a code line that ends in ``;``, with ``dollar_quotes`` only
    outside a ``$$`` body. Linear in the text and inside the row: no shuffle.
    """
    pieces = F.filter(extract_all(content, _STATEMENT[dollar_quotes], 0), lambda p: p != "")

    def number(pieces: Column) -> Column:
        # every piece but the last ends its line: one mark per piece, line breaks between
        skeleton = F.array_join(
            F.transform(pieces, lambda p: F.concat(F.lit("x"), newlines_of(p))), ""
        )
        first_lines = F.filter(
            F.transform(lines_of(skeleton), lambda mark, i: F.when(mark != "", i)),
            lambda i: i.isNotNull(),
        )

        def one(piece: Column, line: Column) -> Column:
            lead = F.regexp_extract(piece, _UP_TO_CODE, 0)
            return F.struct(
                strip(piece).alias("text"),
                F.when(lead != "", line + F.length(newlines_of(lead)) + 1).alias("start_line"),
            )

        return F.filter(F.zip_with(pieces, first_lines, one), lambda s: s["text"] != "")

    def complete(found: Column) -> Column:
        # only a trailing block of comments has no code line: it keeps the line before it
        return F.transform(
            found,
            lambda s, j: F.struct(
                s["text"].alias("text"),
                F.coalesce(
                    s["start_line"], F.get(found, j - 1)["start_line"], F.lit(1)
                ).alias("start_line"),
            ),
        )

    return let(let(pieces, number), complete)


def embedded_array(content: Column) -> Column:
    """``array<struct<text, start_line>>`` of SQL strings passed to SQL calls.

    ``start_line`` is the line of the call. The text around the calls is reduced
    to its line breaks with one mark per call, so the line of every call comes
    from one pass over that skeleton.
    """

    def call_lines(b: Column) -> Column:
        skeleton = F.array_join(
            F.transform(
                b["around"],
                lambda piece, i: F.concat(
                    newlines_of(piece),
                    F.coalesce(
                        F.concat(F.lit("x"), newlines_of(F.get(b["calls"], i))), F.lit("")
                    ),
                ),
            ),
            "",
        )
        return F.flatten(
            F.transform(lines_of(skeleton), lambda marks, i: F.array_repeat(i + 1, F.length(marks)))
        )

    def literal(call: Column) -> Column:
        # at most one of the four quote styles took part in the match
        return F.concat(*[F.regexp_extract(call, _CALL, g) for g in (1, 2, 3, 4)])

    def build(b: Column) -> Column:
        found = F.zip_with(
            b["calls"],
            call_lines(b),
            lambda call, line: F.struct(literal(call).alias("text"), line.alias("start_line")),
        )
        return F.filter(found, lambda s: (s["text"] != "") & looks_like_sql(s["text"]))

    parts = F.struct(
        extract_all(content, _CALL, 0).alias("calls"), F.split(content, _CALL, -1).alias("around")
    )
    # most files hold no call at all: skip the work behind two cheap substring tests
    return F.when(
        F.contains(content, F.lit("sql")) | F.contains(content, F.lit("execute")),
        let(parts, build),
    )


def looks_like_sql(text: Column) -> Column:
    return matches(text, rf"(?i){NOT_AFTER_WORD}(?:{'|'.join(SQL_WORDS)}){NOT_BEFORE_WORD}")


def sql_type(text: Column) -> Column:
    upper = F.upper(text)
    kind = F.lower(
        F.regexp_extract(
            upper,
            rf"^{WS}*CREATE{WS}+(?:OR{WS}+REPLACE{WS}+)?({'|'.join(CREATE_KINDS).upper()})",
            1,
        )
    )
    return F.when(kind == "", F.lit("query")).otherwise(kind)


def sql_name(text: Column, kind: Column) -> Column:
    query_name = F.coalesce(
        extract(text, rf"(?i)--{WS}*name:{WS}*(\w+)"),
        F.concat(F.lit("cte_"), extract(text, rf"(?i)WITH{WS}+(\w+){WS}+AS")),
        F.lit("unnamed_query"),
    )
    name = F.when(kind == "query", query_name)
    for word in CREATE_KINDS:
        pattern = rf"(?i)CREATE{WS}+(?:OR{WS}+REPLACE{WS}+)?{word}{WS}+(\w+)"
        name = name.when(
            kind == word, F.coalesce(extract(text, pattern), F.lit(f"unnamed_{word}"))
        )
    return name


def sql_description(text: Column) -> Column:
    """Leading ``--`` comments joined by a blank, rule markers left out; null if none."""
    comments = extract_all(F.regexp_extract(text, _LEADING_COMMENTS, 0), _DESCRIPTION_LINE)
    return F.when(
        matches(text, rf"^{WS}*(?:--|/\*)"),
        let(comments, lambda c: F.when(F.size(c) > 0, F.array_join(c, " "))),
    )


def sql_markers(text: Column) -> Column:
    pattern = rf"(?i)--{WS}*BUSINESS_RULE{WS}*[:=]?{WS}*({REST_OF_LINE}+)"
    return F.transform(extract_all(text, pattern), strip)


def sql_tables(text: Column) -> Column:
    """Names after the four table keywords, one keyword after the other, distinct."""
    found = [
        # the look-behind comes last so that it only runs where the keyword is
        extract_all(text, rf"(?i){word}(?<![A-Za-z0-9_]{word}){WS}+(\w+(?:\.\w+)?)")
        for word in TABLE_KEYWORDS
    ]
    return F.array_distinct(F.concat(*found))


def sql_columns(text: Column) -> Column:
    """Output names of the first SELECT list: the last word of each comma part."""
    # where no FROM follows the first SELECT none follows a later one, so only one is tried; words
    # and the space between them are passed over whole, not a character at a time
    first = rf"(?i)\A(?:[^S]++|S(?!ELECT{WS}))*+SELECT{WS}++"
    words = rf"(?:[!-~]++|{NOT_WS}++|{WS}++(?!FROM))*+"
    select_list = F.regexp_extract(text, rf"{first}({words}){WS}++FROM", 1)
    return F.array_distinct(extract_all(select_list, rf"(?<![A-Za-z0-9_])(\w++){WS}*+(?:,|\z)"))
