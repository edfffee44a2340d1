"""Per-file helper: raw facts about the functions of one Python text.

This is the only step that needs a parser, so it returns source text cuts and
nothing else; everything derived from them is done in native columns.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
import warnings

_LITERAL = re.compile(r"[A-Za-z]*('''|\"\"\"|'|\")")
BOM = "\ufeff"
_SPACE = b" \t\r\n\f\\"


class _Text:
    """Byte positions (as the parser counts them) to text cuts."""

    def __init__(self, text: str):
        self.data = text.encode("utf-8")
        self.starts = [0]
        for m in re.finditer(rb"\n", self.data):
            self.starts.append(m.end())

    def span(self, node: ast.AST) -> tuple[int, int]:
        return (
            self.starts[node.lineno - 1] + node.col_offset,
            self.starts[node.end_lineno - 1] + node.end_col_offset,
        )

    def cut(self, lo: int, hi: int) -> str:
        return self.data[lo:hi].decode("utf-8")

    def with_parentheses(self, node: ast.AST) -> str:
        """Text of an expression with the parentheses put around it, if any."""
        lo, hi = self.span(node)
        while True:
            left = lo - 1
            while left >= 0 and self.data[left] in _SPACE:
                left -= 1
            right = hi
            while right < len(self.data) and self.data[right] in _SPACE:
                right += 1
            if left < 0 or self.data[left : left + 1] != b"(" or self.data[right : right + 1] != b")":
                return self.cut(lo, hi)
            lo, hi = left, right + 1


def _is_one_literal(segment: str) -> bool:
    """One string token, not several joined by juxtaposition."""
    opening = _LITERAL.match(segment)
    if opening is None:
        return False
    quote = opening.group(1)
    inner = segment[opening.end() : -len(quote)]
    if segment.endswith(quote) and quote not in inner:
        return True
    depth = found = 0
    for token in tokenize.generate_tokens(io.StringIO(segment).readline):
        kind = tokenize.tok_name[token.type]
        if kind == "FSTRING_END":
            depth -= 1
        elif depth == 0 and kind in ("STRING", "FSTRING_START"):
            found += 1
        if kind == "FSTRING_START":
            depth += 1
    return found == 1


def _doc_node(function: ast.AST) -> ast.AST | None:
    """String literal that is the first expression statement of the body."""
    statements = (ast.Expr, ast.Assign, ast.AugAssign, ast.AnnAssign)
    first = next((s for s in function.body if isinstance(s, statements)), None)
    if not isinstance(first, ast.Expr):
        return None
    value = first.value
    # "a", "b" without parentheses: the strings are direct parts of the statement
    parts = value.elts if isinstance(value, ast.Tuple) else [value]
    if not parts or (parts[0].lineno, parts[0].col_offset) != (first.lineno, first.col_offset):
        return None
    for node in parts:
        if isinstance(node, ast.JoinedStr) or (
            isinstance(node, ast.Constant) and isinstance(node.value, (str, bytes))
        ):
            return node
    return None


def _parameters(args: ast.arguments, text: _Text) -> list[dict]:
    plain = [*args.posonlyargs, *args.args]
    defaults = [None] * (len(plain) - len(args.defaults)) + list(args.defaults)
    both = [*zip(plain, defaults), *zip(args.kwonlyargs, args.kw_defaults)]
    return [
        {
            "name": arg.arg,
            "type": text.with_parentheses(arg.annotation) if arg.annotation else None,
            "default": text.with_parentheses(value) if value else None,
        }
        for arg, value in both
    ]


def _decorators(function: ast.AST, text: _Text) -> list[str]:
    """Decorators right above the function; a comment line between ends the run."""
    kept: list[str] = []
    below = text.starts[function.lineno - 1]
    for node in reversed(function.decorator_list):
        lo, hi = text.span(node)
        gap = text.cut(hi, below).split("\n")[1:]
        if any(line.strip().startswith("#") for line in gap):
            break
        kept.insert(0, text.with_parentheses(node))
        below = text.data.rfind(b"@", 0, lo)
    return kept


def _parse(text: str) -> ast.Module:
    # a lone CR ends a line for the parser only; same length, so positions hold
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return ast.parse(re.sub(r"\r(?!\n)", " ", text))


def _functions_in(tree: ast.AST) -> list[ast.AST]:
    """All functions at any depth, in the order of the text."""
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef)
    found = [n for n in ast.walk(tree) if isinstance(n, kinds)]
    return sorted(found, key=lambda n: (n.lineno, n.col_offset))


def _facts_of(node: ast.AST, text: _Text, lines: list[str], shift: int = 0) -> dict:
    """Facts of one function; ``lines`` are those of the file, ``shift`` lines above the text."""
    start, end = node.lineno + shift, node.end_lineno + shift
    facts = {
        "name": node.name,
        "start_line": start,
        "end_line": end,
        "parameters": _parameters(node.args, text),
        "return_type": text.with_parentheses(node.returns) if node.returns else None,
        "doc_literal": None,
        "doc_offset": None,
        "decorators": _decorators(node, text),
        "source_code": "\n".join(lines[start - 1 : end]),
    }
    doc = _doc_node(node)
    if doc is not None:
        lo, hi = text.span(doc)
        literal = text.cut(lo, hi)
        if _is_one_literal(literal):
            before = text.cut(text.starts[node.lineno - 1], lo)
            bom = start == 1 and lines[0].startswith(BOM)
            facts |= {"doc_literal": literal, "doc_offset": len(before) + bom}
    return facts


def function_facts(source: str) -> list[dict]:
    """Facts about every function of a text, in the order of the text."""
    body = source.removeprefix(BOM)
    tree = _parse(body)
    text, lines = _Text(body), source.split("\n")
    return [_facts_of(node, text, lines) for node in _functions_in(tree)]


# --- texts that do not parse as a whole ---------------------------------------------------

_DEF = re.compile(r"([ \t]*)(?:async[ \t]+)?def[ \t]+(\w+)[ \t]*\(")
_SPACE_OR_COMMENT = re.compile(r"\s*(?:#|$)")
_DOC = re.compile(r"\s*[A-Za-z]*(\"\"\"|'''|\"|')[\s\S]*?\1[ \t\r]*(?:\n|$)")
_HIDDEN = re.compile(
    r"#[^\n]*|(\"\"\"|''')(?:\\[\s\S]|[^\\])*?\1|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
)
_MARK = re.compile(r"[()\[\]{}:]")


def _outside_strings(text: str) -> tuple[list[str], set[int]]:
    """Lines with comments blank and strings as x, places kept; lines that begin in a string.

    A quote that is never closed hides nothing.
    """

    def hide(m: re.Match) -> str:
        return re.sub(r"[^\n]", " " if m.group().startswith("#") else "x", m.group())

    inside: set[int] = set()
    line = at = 0
    for m in _HIDDEN.finditer(text):
        line += text.count("\n", at, m.start())
        more = m.group().count("\n")
        inside.update(range(line + 1, line + more + 1))
        line, at = line + more, m.end()
    return _HIDDEN.sub(hide, text).split("\n"), inside


def _block_end(lines: list[str], inside: set[int], first: int) -> int:
    """Line after the block that starts at ``first``, by indentation."""
    indent = len(_DEF.match(lines[first]).group(1).expandtabs())
    end = first + 1
    for i in range(first + 1, len(lines)):
        line = lines[i].expandtabs()
        if i not in inside:
            if _SPACE_OR_COMMENT.match(line):
                continue
            if len(line) - len(line.lstrip()) <= indent and not line.lstrip().startswith(")"):
                break
        end = i + 1
    return end


def _parsed(lines: list[str], indented: bool) -> tuple[ast.Module, _Text] | None:
    text = "\n".join(["if 1:", *lines] if indented else lines)
    try:
        return _parse(text), _Text(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _head_end(shown: list[str]) -> tuple[int, int] | None:
    """Line and place of the colon behind the brackets of a head, in one pass."""
    depth = 0
    for n, line in enumerate(shown):
        for m in _MARK.finditer(line):
            if m.group() == ":":
                if depth == 0:
                    return n, m.start()
            else:
                depth += 1 if m.group() in "([{" else -1
        if depth <= 0:
            return None
    return None


def _head_only(
    block: list[str], shown: list[str], indented: bool
) -> tuple[ast.Module, _Text] | None:
    """The head of a function, with its docstring if that follows."""
    colon = _head_end(shown)
    if colon is None:
        return None
    n, place = colon
    head = _parsed([*block[:n], block[n][: place + 1] + " pass"], indented)
    if head is None:
        return None
    rest = "\n".join(block[n + 1 :])
    doc = _DOC.match(rest)
    if doc is None or not _SPACE_OR_COMMENT.match(block[n], place + 1):
        return head
    return _parsed(block[: n + 1] + rest[: doc.end()].rstrip().split("\n"), indented) or head


def _decorators_above(lines: list[str], first: int) -> list[str]:
    kept: list[str] = []
    while first > 0 and lines[first - 1].strip().startswith("@"):
        first -= 1
        kept.insert(0, lines[first].strip()[1:].strip())
    return kept


def _unread_head(block: list[str], shown: list[str], name: str, line: int) -> dict:
    """Facts of a function with a head that does not parse: its docstring is still found."""
    facts = {"name": name, "start_line": line, "parameters": [], "return_type": None}
    facts |= {"doc_literal": None, "doc_offset": None}
    colon = _head_end(shown)
    if colon is None or not _SPACE_OR_COMMENT.match(block[colon[0]], colon[1] + 1):
        return facts
    above = "\n".join(block[: colon[0] + 1]) + "\n"
    doc = _DOC.match("\n".join(block[colon[0] + 1 :]))
    if doc is not None and _parsed([doc.group().strip()], False):
        blank = len(doc.group()) - len(doc.group().lstrip())
        facts |= {"doc_literal": doc.group().strip(), "doc_offset": len(above) + blank}
    return facts


def salvaged_facts(source: str) -> list[dict]:
    """Facts from a text with errors: each function is parsed on its own.

    A function that does not parse either gives what its head and docstring say; one whose
    head cannot be read gives name, lines and source. Text in strings starts no function.
    """
    lines = source.split("\n")
    text = source.removeprefix(BOM)
    body = text.split("\n")
    shown, inside = _outside_strings(text)
    facts: list[dict] = []
    done = 0
    for first, line in enumerate(shown):
        head = None if first < done or first in inside else _DEF.match(line)
        if head is None:
            continue
        end = _block_end(shown, inside, first)
        block, indented = body[first:end], bool(head.group(1))
        whole = _parsed(block, indented)
        read = whole or _head_only(block, shown[first:end], indented)
        if read is None:
            found = [_unread_head(block, shown[first:end], head.group(2), first + 1)]
            if first == 0 and source.startswith(BOM) and found[0]["doc_offset"] is not None:
                found[0]["doc_offset"] += 1
        else:
            nodes = _functions_in(read[0])
            nodes = nodes if whole else nodes[:1]
            found = [_facts_of(node, read[1], lines, first - int(indented)) for node in nodes]
        if whole:
            done = end
        else:
            found[0] |= {"end_line": end, "source_code": "\n".join(lines[first:end])}
        found[0]["decorators"] = _decorators_above(body, first)
        facts += found
    return facts
