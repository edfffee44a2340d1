"""Functions of Python files."""

import pytest

from corpusrules.operators.py_units import functions, parse_errors


@pytest.fixture(scope="module")
def found(files):
    def run(text):
        return functions(files({"a.py": text})).orderBy("ordinal").collect()

    return run


def params(f):
    return [tuple(p) for p in f.parameters]


def test_typed_function(found):
    (f,) = found('def net(gross: float, rate: float) -> float:\n    """Price without tax."""\n    return gross\n')
    assert (f.name, f.return_type, f.docstring) == ("net", "float", "Price without tax.")
    assert params(f) == [("gross", "float", None), ("rate", "float", None)]
    assert f.signature == "def net(gross: float, rate: float) -> float"
    assert (f.start_line, f.end_line, f.markers, f.decorators) == (1, 3, [], [])


def test_three_docstring_markers(found):
    (f,) = found(
        'def f(x):\n    """Text.\n\n    BUSINESS_RULE: one\n    BUSINESS_RULE = two\n'
        '    business_rule three\n    """\n    return x\n'
    )
    assert f.markers == ["one", "two", "three"]


def test_one_line_docstring_with_marker(found):
    (f,) = found('def f():\n    """BUSINESS_RULE: one"""\n    # BUSINESS_RULE: two\n    return 1\n')
    assert f.markers == ["one", "two"]


def test_comment_marker(found):
    (f,) = found("def f():\n    # BUSINESS_RULE: no cash\n    return 1\n")
    assert f.markers == ["no cash"]


def test_defaults(found):
    (f,) = found('def f(a: int = 3, b: str = "x y", c=(1), d: (int) = [1, 2]): pass')
    assert params(f) == [
        ("a", "int", "3"),
        ("b", "str", '"x y"'),
        ("c", None, "(1)"),
        ("d", "(int)", "[1, 2]"),
    ]
    assert f.signature == 'def f(a: int = 3, b: str = "x y", c = (1), d: (int) = [1, 2])'


def test_methods(found):
    first, second = found(
        "class A:\n    def one(self, x): pass\n    @classmethod\n    def two(cls, self): pass\n"
    )
    assert (first.name, params(first)) == ("one", [("x", None, None)])
    assert (second.name, params(second), second.decorators) == ("two", [], ["@classmethod"])
    assert second.source_code == "    def two(cls, self): pass"


def test_stars_and_separators_vanish(found):
    (f,) = found("def f(a, /, b, *args: int, c, d: int = 1, **kw): pass")
    assert [p[0] for p in params(f)] == ["a", "b", "c", "d"]
    (g,) = found("def g(a, *, b): pass")
    assert [p[0] for p in params(g)] == ["a", "b"]


def test_async(found):
    (f,) = found("async def fetch(u: str):\n    return u\n")
    assert f.signature == "def fetch(u: str)"
    assert f.source_code.startswith("async def")


def test_nested_functions_in_order_of_the_text(found):
    names = [f.name for f in found("def a():\n    def b():\n        def c(): pass\n    if 1:\n        def d(): pass\ndef e(): pass")]
    assert names == ["a", "b", "c", "d", "e"]


@pytest.mark.parametrize(
    "body, doc",
    [
        ("return 1", None),
        ("'''  x  '''", "x"),
        ("'x'", "x"),
        ("import os\n    'late'", "late"),
        ("x = 1\n    'too late'", None),
        ("print()\n    'too late'", None),
        ("'a' 'b'", None),
        ("('a')", None),
        ("f'{x}'", "f'{x}"),
        ("b'x'", "b'x"),
        ("r'''x'''", "r'''x"),
        ("'a', 'b'", "a"),
        (r"'it\'s'", r"it\'s"),
        ("''", ""),
        ("...", None),
    ],
)
def test_docstring(found, body, doc):
    (f,) = found(f"def f(x):\n    {body}\n")
    assert f.docstring == doc


def test_decorators(found):
    (f,) = found("@a\n@b.c(1,\n   2)\ndef f(): pass\n")
    assert f.decorators == ["@a", "@b.c(1,\n   2)"]
    assert (f.start_line, f.end_line) == (4, 4)


def test_comment_line_ends_the_run_of_decorators(found):
    (f,) = found("@a\n# note\n@b\ndef f(): pass\n")
    assert f.decorators == ["@b"]


def test_crlf_bom_and_wide_letters(found):
    (f,) = found('\ufeffdef f(é: "ü" = "ö") -> "ß":\r\n    """Dök."""\r\n    return é\r\n')
    assert params(f) == [("é", '"ü"', '"ö"')]
    assert (f.return_type, f.docstring, f.end_line) == ('"ß"', "Dök.", 3)
    assert f.source_code.startswith("\ufeffdef")


def test_crlf_marker_only_at_the_end(found):
    (f,) = found("def f():\r\n    # BUSINESS_RULE: one\r\n    return 1 # BUSINESS_RULE: two")
    assert f.markers == ["two"]


def test_two_functions_of_one_name(found):
    assert [f.ordinal for f in found("def f(): pass\ndef f(): pass\n")] == [0, 1]


def test_bad_file_is_an_error_row(files):
    df = files({"bad.py": "def f(:\n", "nul.py": "x = '\0'", "good.py": "def g(): pass"})
    assert sorted(f.name for f in functions(df).collect()) == ["f", "g"]
    errors = {e.file_path: e.error for e in parse_errors(df).collect()}
    assert set(errors) == {"bad.py", "nul.py"}
    assert errors["bad.py"].startswith("SyntaxError")


def test_deep_nesting_is_an_error_row(files):
    df = files({"deep.py": "x = " + "(" * 5000 + ")" * 5000})
    assert parse_errors(df).count() == 1


BROKEN = '''\
import os
@deco
@other(1)
def good(a: int) -> str:
    "Doc. def inner(): no"
    def nested(): pass
    return a

class A:
    def old(self, x=1,
            y=2):  # head
        """Old style.

        BUSINESS_RULE: never
        """
        print x

    # between
    def fine(self):
        return 1
def one(): print 1
def (:
    pass
'''


def test_functions_of_a_file_with_errors(files):
    df = files({"b.py": BROKEN})
    rows = functions(df).orderBy("ordinal").collect()
    assert [(r.name, r.start_line, r.end_line) for r in rows] == [
        ("good", 4, 7),
        ("nested", 6, 6),
        ("old", 10, 16),
        ("fine", 19, 20),
        ("one", 21, 21),
    ]
    good, _, old, fine, one = rows
    assert (one.signature, one.source_code) == ("def one()", "def one(): print 1")
    assert (good.docstring, good.decorators) == ("Doc. def inner(): no", ["@deco", "@other(1)"])
    assert good.signature == "def good(a: int) -> str"
    assert old.docstring.startswith("Old style.") and old.markers == ["never"]
    assert params(old) == [("x", None, "1"), ("y", None, "2")]
    assert old.source_code.endswith("print x") and fine.source_code.startswith("    def fine")
    assert parse_errors(df).count() == 1


def test_bom_in_a_file_with_errors(found):
    (f,) = found("﻿def f():\n    'doc BUSINESS_RULE: x'\n    return 1\n)\n")
    assert (f.name, f.docstring, f.markers) == ("f", "doc BUSINESS_RULE: x", ["x"])


# --- texts with syntax errors -------------------------------------------------------------


def test_unreadable_head_keeps_its_row(found):
    text = 'import x\n\n@deco\ndef f(a, (b, c)):\n    """BUSINESS_RULE: one"""\n    return a\n\n\ndef g(): pass\n'
    f, g = found(text)
    assert (f.name, f.start_line, f.end_line, params(f), f.markers) == ("f", 4, 6, [], ["one"])
    assert f.source_code == "\n".join(text.split("\n")[3:6])
    assert f.decorators == ["@deco"]
    assert g.name == "g"


def test_no_function_inside_strings(found):
    text = '"""\ndef no(): pass\n"""\nX = \'\'\'\ndef nor(): pass\n\'\'\'\nprint 1\ndef yes(a=")", *, b={1: 2}): # :\n  print 1\n'
    (f,) = found(text)
    assert (f.name, f.start_line, f.end_line) == ("yes", 8, 9)
    assert params(f) == [("a", None, '")"'), ("b", None, "{1: 2}")]


def test_dedented_text_does_not_end_a_function(found):
    (f,) = found('def f():\n    """a\nb\n    """\n    print 1\n')
    assert (f.end_line, f.docstring) == (5, "a\nb\n    ".strip())


def test_unclosed_head_is_linear():
    import time

    from corpusrules.functions.py_syntax import salvaged_facts

    text = "def f(\n" + "".join(f"    a{i}: int = {{1: 2}},\n" for i in range(20000))
    start = time.monotonic()
    (f,) = salvaged_facts(text)
    assert (f["name"], f["end_line"]) == ("f", 20001)
    assert time.monotonic() - start < 20
