"""Statements of SQL files and SQL strings in Python files."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusrules.functions import sql_text as S
from corpusrules.operators.sql_units import all_sql, embedded_sql, sql_blocks, split_statements


@pytest.fixture(scope="module")
def blocks(files):
    def run(text, **options):
        return sql_blocks(files({"a.sql": text}), **options).orderBy("ordinal").collect()

    return run


def test_named_select(blocks):
    text = "-- name: paid_orders\n-- All orders with a payment\nSELECT id, total, paid\nFROM orders\nWHERE paid = 1;\n"
    (b,) = blocks(text)
    assert (b.name, b.sql_type) == ("paid_orders", "query")
    assert b.tables == ["orders"]
    assert b.columns == ["id", "total", "paid"]
    assert b.description == "name: paid_orders All orders with a payment"
    assert (b.start_line, b.end_line) == (3, 7)
    assert b.source_code == text.strip()


def test_marker_in_comment(blocks):
    (b,) = blocks("-- BUSINESS_RULE: refunds above 900 need a second look\nSELECT 1 FROM refunds;")
    assert b.markers == ["refunds above 900 need a second look"]
    assert b.description is None


PROCEDURE = """CREATE OR REPLACE PROCEDURE close_month(m INT)
LANGUAGE plpgsql
AS $$
BEGIN
    UPDATE ledger SET closed = true WHERE month = m;
    INSERT INTO audit.log VALUES (m);
END;
$$;
SELECT 1;
"""


def test_procedure_is_one_block(blocks):
    procedure, query = blocks(PROCEDURE)
    assert (procedure.name, procedure.sql_type) == ("close_month", "procedure")
    assert (procedure.start_line, procedure.end_line) == (1, 8)
    assert procedure.tables == ["audit.log", "ledger"]
    assert (query.start_line, query.source_code) == (9, "SELECT 1;")


def test_procedure_without_dollar_quotes(blocks):
    assert [b.start_line for b in blocks(PROCEDURE, dollar_quotes=False)] == [1, 6, 7, 8, 9]


def test_dollar_quote_on_comment_line_does_not_count(blocks):
    texts = [b.source_code for b in blocks("-- costs $$\nSELECT 1;\nSELECT 2;")]
    assert texts == ["-- costs $$\nSELECT 1;", "SELECT 2;"]


def test_dollar_quotes_opened_and_closed_on_one_line(blocks):
    assert len(blocks("SELECT $$a;b$$;\nSELECT $$c;\nd$$, 2;\nSELECT 3;")) == 3


@pytest.mark.parametrize("kind", ["VIEW", "FUNCTION", "TRIGGER"])
def test_other_objects(blocks, kind):
    (b,) = blocks(f"CREATE {kind} open_items AS SELECT * FROM items;")
    assert (b.name, b.sql_type) == ("open_items", kind.lower())


def test_leading_comment_hides_the_kind(blocks):
    (b,) = blocks("-- an index\nCREATE VIEW v AS SELECT 1;")
    assert (b.sql_type, b.name) == ("query", "unnamed_query")


def test_name_without_a_word(blocks):
    (b,) = blocks('CREATE VIEW "x y" AS SELECT 1;')
    assert (b.sql_type, b.name) == ("view", "unnamed_view")


def test_schema_is_taken_as_the_name(blocks):
    (b,) = blocks("CREATE VIEW mart.v AS SELECT 1;")
    assert b.name == "mart"


def test_joins(blocks):
    (b,) = blocks(
        "SELECT * FROM a JOIN b ON 1=1 LEFT JOIN s.c ON 1=1 JOIN x.y.z ON 1=1 JOIN b ON 1=1;"
    )
    assert b.tables == ["a", "b", "s.c", "x.y"]
    assert b.columns == []


def test_two_statements(blocks):
    first, second = blocks("-- one\nSELECT 1 FROM a;\n\n-- two\nSELECT 2 FROM b;\n")
    assert (first.start_line, second.start_line) == (2, 5)
    assert second.source_code == "-- two\nSELECT 2 FROM b;"


def test_cte_name(blocks):
    (b,) = blocks("WITH recent AS (SELECT 1 FROM o) SELECT k FROM recent;")
    assert b.name == "cte_recent"
    assert b.tables == ["o", "recent"]


def test_columns_take_the_last_word_of_each_part(blocks):
    (b,) = blocks("SELECT a.x AS y, coalesce(p, q) z, COUNT(*), t.k, k, *\nFROM t;")
    # the comma inside the call splits too, and a bare call has no last word
    assert b.columns == ["y", "p", "z", "k"]


def test_inner_comment_with_semicolon_does_not_end_a_statement(blocks):
    (b,) = blocks("SELECT 1\n  -- not here;\nFROM t;")
    assert b.end_line == 3


def test_no_final_semicolon(blocks):
    assert [b.source_code for b in blocks("SELECT 1;\nSELECT 2\n\n")] == ["SELECT 1;", "SELECT 2"]


def test_trailing_comment_keeps_the_line_before_it(blocks):
    blocks_ = blocks("\n\nSELECT 1;\nSELECT 2;\n\n-- the end\n")
    assert [(b.start_line, b.source_code) for b in blocks_][-1] == (4, "-- the end")
    assert blocks_[-1].name == "unnamed_query"


def test_comments_only(blocks):
    (b,) = blocks("\n-- a\n\n-- b\n")
    assert (b.start_line, b.description) == (1, "a b")


@pytest.mark.parametrize("text", ["", "\n\n", "  \t\n\u00a0\n"])
def test_blank_file(blocks, text):
    assert blocks(text) == []


def test_crlf(blocks):
    first, second = blocks("-- name: x\r\nSELECT 1 FROM t;\r\nSELECT 2 FROM u;\r\n")
    assert (first.name, first.start_line, second.start_line) == ("x", 2, 3)
    assert first.source_code == "-- name: x\r\nSELECT 1 FROM t;"


def test_wide_white_space_around_a_line(blocks):
    first, second = blocks("\u00a0-- c\nSELECT 1;\u00a0\u2003\nSELECT 2;")
    assert first.source_code == "-- c\nSELECT 1;"
    assert first.start_line == 2 and second.start_line == 3


def test_accented_letter_does_not_hide_a_keyword(blocks):
    (b,) = blocks("SELECT 1 éFROM t JOIN_x xJOIN y;")
    assert b.tables == ["t"]


def test_empty_marker_takes_the_next_line(blocks):
    (b,) = blocks("-- BUSINESS_RULE:\n-- real text\nSELECT 1;")
    assert b.markers == ["-- real text"]


def test_every_marker_form(blocks):
    (b,) = blocks("-- BUSINESS_RULE = one \nSELECT 1 --business_rule two\nFROM t;")
    assert b.markers == ["one", "two"]


def test_description_quirks(blocks):
    (b,) = blocks("-- a\n--\n/* passed over */\n  --  b\n-- Business_Rule: x\nSELECT 1; -- late")
    assert b.description == "a  b"


def test_empty_description_is_not_null(blocks):
    (b,) = blocks("--\nSELECT 1;")
    assert b.description == ""


def test_extra_columns_are_carried(spark):
    df = spark.createDataFrame([("a.sql", "SELECT 1;", "c9")], "file_path string, content string, commit string")
    assert sql_blocks(df).first().commit == "c9"
    assert split_statements(df).first().commit == "c9"


def test_large_file_is_linear(spark):
    """A third of a corpus in one file: exact, and no quadratic step."""
    from pyspark.sql import functions as F

    n = 30000
    df = spark.range(1).select(
        F.lit("big.sql").alias("file_path"),
        F.repeat(F.lit("-- c\nSELECT 1\nFROM t;\n"), n).alias("content"),
    )
    out = split_statements(df).agg(F.count("*"), F.max("start_line"), F.sum("start_line")).first()
    assert tuple(out) == (n, 3 * n - 1, sum(3 * i + 2 for i in range(n)))


def test_columns_of_large_statement_are_linear(spark):
    """1 MB of SELECTs without any FROM, and the same with one at the end."""
    import time

    from pyspark.sql import functions as F

    from corpusrules.functions.sql_text import sql_columns

    many = F.repeat(F.lit("SELECT a,  b UNION ALL\n"), 45000)
    start = time.monotonic()
    row = spark.range(1).select(
        sql_columns(many).alias("none"),
        sql_columns(F.concat(many, F.lit("SELECT c FROM t"))).alias("one"),
        sql_columns(F.lit("SELECT  FROM t")).alias("blank"),
        sql_columns(F.lit("xSELECT\n x.a , b  AS  c\n\n from t")).alias("plain"),
    ).first()
    assert (row.none, row.one, row.blank, row.plain) == ([], ["a", "c"], [], ["a", "c"])
    assert time.monotonic() - start < 30


# --- embedded ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def embedded(files):
    def run(text):
        return embedded_sql(files({"a.py": text})).orderBy("ordinal").collect()

    return run


def test_four_quote_styles(embedded):
    text = (
        'spark.sql("SELECT 1 FROM a")\n'
        "cur.execute(  'SELECT 2 FROM b')\n"
        'x = spark.sql(f"""\n  SELECT 3\n  FROM c\n""")\n'
        "sql('''DELETE FROM d''')\n"
    )
    found = embedded(text)
    assert [b.name for b in found] == [f"embedded_sql_{i}" for i in (1, 2, 3, 4)]
    assert [(b.start_line, b.end_line) for b in found] == [(1, 1), (2, 2), (3, 6), (7, 7)]
    assert found[2].source_code == "\n  SELECT 3\n  FROM c\n"
    assert [b.tables for b in found] == [["a"], ["b"], ["c"], ["d"]]


def test_only_kept_calls_are_numbered(embedded):
    found = embedded('sql("hello")\nsql("")\nmysql("UPDATE t SET a = 1")\nsql(x)\nsql("select 1")')
    assert [(b.name, b.start_line) for b in found] == [("embedded_sql_1", 3), ("embedded_sql_2", 5)]


def test_keyword_has_to_be_a_whole_word(embedded):
    assert embedded('sql("selected fromage")\nsql("GROUP  BY")') == []
    assert len(embedded('sql("order by x")')) == 1


def test_raw_prefix_is_not_handled(embedded):
    assert embedded('spark.sql(r"SELECT 1")') == []


def test_statements_inside_a_string_are_not_split(embedded):
    (b,) = embedded('execute("""SELECT 1;\nSELECT 2;""")')
    assert b.end_line == 2


def test_mixed_files_in_one_pass(files):
    df = files(
        {
            "a.sql": "SELECT 1;\nSELECT 2;",
            "b.py": 'sql("SELECT 3")',
            "c.txt": "SELECT 4;",
            "d.py": "x = 1",
        }
    )
    rows = all_sql(df).orderBy("file_path", "ordinal").collect()
    assert [(r.file_path, r.name) for r in rows] == [
        ("a.sql", "unnamed_query"),
        ("a.sql", "unnamed_query"),
        ("b.py", "embedded_sql_1"),
    ]


def test_select_list_ends_at_the_first_from_behind_space(spark):
    """The list is passed over in words; it ends where a search a character at a time would end it."""
    rnd = random.Random(4)
    tokens = ["SELECT", "select ", " ", "\n", "\u00a0", "\u3000", "FROM", " from", "s", "S", "\u00e9", "\u017f"]
    tokens += [",", "a.b", "FROMx", "\x1c"]
    texts = ["".join(rnd.choices(tokens, k=rnd.randint(0, 12))) for _ in range(1500)]
    texts += ["SELECT " + "".join(rnd.choices(tokens, k=rnd.randint(0, 8))) + "\nFROM t" for _ in range(1500)]
    texts += ["SELECT a, " + "b c, \u00e9" * 20000 + " d FROM t", "SELECT " + "x \n" * 50000, "S" * 100000, "select x", ""]
    space = "[ \\t\\n\\x0b\\f\\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
    wanted = []
    for text in texts:
        head = re.search(f"(?ia)SELECT{space}+", text)
        tail = head and re.compile(f"(?ia)(?<!{space}){space}+FROM").search(text, head.end())
        listed = text[head.end() : tail.start()] if tail else ""
        wanted.append(list(dict.fromkeys(re.findall(rf"(?a)(?<![A-Za-z0-9_])(\w+)(?={space}*(?:,|\Z))", listed))))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = df.select("i", S.sql_columns(F.col("text")).alias("columns")).orderBy("i").collect()
    assert [r["columns"] for r in got] == wanted
    assert sum(map(bool, wanted)) > 500
