"""Python: the standard parser, and block by block where a file doesn't parse as a whole."""

from __future__ import annotations

import ast
import re
import warnings

from .text import binding, call, docstring, header, relation, symbol

_SCOPES = (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)


def _parse(text: str) -> ast.Module | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


_GOES_ON = re.compile(r"(else|elif|except|finally)\b")


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def _mended(lines: list[str]) -> list[str]:
    """A block whose inner statements that don't parse give way to ``pass``, as deep inside as can be; lines keep their places."""
    out = list(lines)
    inner = next((_indent(x) for x in lines[1:] if x.strip() and _indent(x) > _indent(lines[0])), None)
    starts = [i for i, x in enumerate(lines) if i and x.strip() and _indent(x) == inner and not _GOES_ON.match(x.strip()) and not lines[i - 1].strip().startswith("@")]
    for a, b in zip(starts, [*starts[1:], len(lines)], strict=False):
        if _parse("if 1:\n" + "\n".join(lines[a:b])) is None:
            less = _mended(lines[a:b])
            fits = _parse("if 1:\n" + "\n".join(less)) is not None
            out[a:b] = less if fits else [" " * inner + "pass"] + [""] * (b - a - 1)
    return out


def _blocks(text: str, lost: list[int]):
    """The top-level blocks of a broken file, each at its own line and parsed alone, of broken ones what is intact; ``lost`` gets their lines."""
    lines, start = text.split("\n"), 0
    own = re.compile(r"[^\s#)\]}]")
    ends = [i for i, line in enumerate(lines) if i and own.match(line) and not _GOES_ON.match(line) and not lines[i - 1].startswith("@")]
    for end in [*ends, len(lines)]:
        block = lines[start:end]
        tree = _parse("\n" * start + "\n".join(block))
        if tree is None:
            lost.append(start + 1)
        if tree is None and block[0].startswith(("class ", "@")):
            tree = _parse("\n" * start + "\n".join(_mended(block)))
        if tree is not None:
            yield tree
        start = end


class _File:
    def __init__(self, data: bytes):
        text = re.sub(r"\r(?!\n)", "\n", data.decode("utf-8", "replace")).replace("\f", " ").replace("\0", " ")
        self.bytes = text.encode()
        body = text.removeprefix("\ufeff")
        self.at = [len(self.bytes) - len(body.encode())]
        for line in body.split("\n"):
            self.at.append(self.at[-1] + len(line.encode()) + 1)
        whole = _parse(body)
        self.ok = whole is not None
        self.symbols, self.calls, self.imports, self.relations, self.lost = [], [], [], [], []
        for tree in [whole] if self.ok else _blocks(body, self.lost):
            self._walk(tree, [])

    def _start(self, node) -> int:
        return self.at[node.lineno - 1] + node.col_offset

    def _end(self, node) -> int:
        return self.at[node.end_lineno - 1] + node.end_col_offset

    def _text(self, a: int, b: int) -> str:
        return self.bytes[a:b].decode("utf-8", "replace")

    def _walk(self, root: ast.AST, outer: list) -> None:
        """Depth first with a stack of our own: long chains of operators must not exhaust the interpreter's."""
        stack = [(root, outer)]
        while stack:
            node, scopes = stack.pop()
            inner = scopes
            if isinstance(node, _SCOPES):
                self._define(node, scopes)
                inner = [*scopes, node]
            elif isinstance(node, ast.Call):
                self._call(node, scopes)
            elif isinstance(node, ast.Import):
                self.imports += [binding(n.name, None, n.asname or n.name.split(".")[0], node.lineno) for n in node.names]
            elif isinstance(node, ast.ImportFrom):
                module = "." * node.level + (node.module or "")
                self.imports += [binding(module, n.name, n.asname or n.name, node.lineno) for n in node.names]
            stack += [(child, inner) for child in reversed(list(ast.iter_child_nodes(node)))]

    def _define(self, node, scopes) -> None:
        names = [s.name for s in scopes]
        kind = "class" if isinstance(node, ast.ClassDef) else "method" if scopes and isinstance(scopes[-1], ast.ClassDef) else "function"
        first = node.decorator_list[0] if node.decorator_list else None
        line = first.lineno if first else node.lineno
        for base in node.bases if kind == "class" else []:
            base = base.value if isinstance(base, ast.Subscript) else base
            if isinstance(base, ast.Name | ast.Attribute):
                self.relations.append(relation(node.name, "extends", base.id if isinstance(base, ast.Name) else base.attr, base.lineno))
        start = self.bytes.rfind(b"@", 0, self._start(first)) if first else self._start(node)
        words = self._text(self._start(node), self._start(node.body[0]))
        self.symbols.append(
            symbol(node.name, ".".join([*names, node.name]), kind, ".".join(names) or None, (line, node.end_lineno), (start, self._end(node)), _signature(words), docstring(ast.get_docstring(node)), not node.name.startswith("_"))
        )

    def _call(self, node, scopes) -> None:
        f = node.func
        if isinstance(f, ast.Name):
            name, receiver = f.id, None
        elif isinstance(f, ast.Attribute):
            name, receiver = f.attr, self._text(self._start(f.value), self._end(f.value))
        else:
            return
        hint = None
        if receiver in ("self", "cls"):
            hint = next((s.name for s in reversed(scopes) if isinstance(s, ast.ClassDef)), None)
        self.calls.append(call(name, receiver, hint, node.lineno, self._start(node)))


def _signature(text: str) -> str:
    """The header up to the colon outside brackets and quotes that opens the body."""
    depth, quote, i = 0, None, 0
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif text.startswith(quote, i):
                i += len(quote) - 1
                quote = None
        elif c in "\"'":
            quote = c * 3 if text.startswith(c * 3, i) else c
            i += len(quote) - 1
        elif c == "#":
            i = text.find("\n", i) if "\n" in text[i:] else len(text)
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == ":" and depth == 0:
            return header(text[:i])
        i += 1
    return header(text)


def extract(data: bytes):
    f = _File(data)
    for rows in (f.symbols, f.calls):
        rows.sort(key=lambda r: r["start_byte"])
    return f.ok, f.symbols, f.calls, f.imports, f.relations, [{"line": n, "found": "block"} for n in f.lost]
