"""Go declarations, calls, imports and the types that local declarations prove."""

from __future__ import annotations

import bisect

from .text import binding, call, fold, header, relation, shorten, symbol
from .tokens import Source

_KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_RESULT_WORDS = frozenset({"chan", "map", "func"})


def _bare(text: str) -> str:
    """A type's own name, without pointer, type arguments and package."""
    return text.strip().lstrip("*&").split("[")[0].split(".")[-1].strip()


class _Go:
    def __init__(self, data: bytes):
        self.s = Source(data, templates=False)
        self.symbols, self.calls, self.imports, self.relations = [], [], [], []
        self.declared: set[int] = set()
        self.methods: list[tuple[int, int, str, str]] = []  # first, last token, receiver variable and type
        self.functions: list[tuple[int, int]] = []
        self.contracts: set[int] = set()  # opening braces of interfaces
        s = self.s
        for i, t in enumerate(s.tokens):
            if t.kind != "word":
                continue
            if t.text == "func":
                self._func(i)
            elif t.text == "type" and s.at(i - 1) != "(":
                self._types(i)
            elif t.text == "import" and s.parent[i] < 0:
                self._imports(i)
            elif t.text == "interface" and s.at(i + 1) == "{":
                self.contracts.add(i + 1)
        self.locals = {f: self._locals(*f) for f in self.functions}
        self.around = self._innermost()
        self._find_calls()

    def _body(self, i: int) -> int | None:
        """The brace that opens a function's body, from the token after its parameters."""
        s = self.s
        while i < len(s.tokens) and not s.breaks(i):
            t = s.at(i)
            if t == "{":
                return i
            if t in ("struct", "interface") and s.at(i + 1) == "{":
                i = s.close(i + 1)
            elif t in ("(", "["):
                i = s.close(i)
            elif t not in (".", "*", "<-") and not (s.word(i) and (t in _RESULT_WORDS or t not in _KEYWORDS)):
                return None
            i += 1
        return None

    def _func(self, i: int) -> None:
        s, j, receiver = self.s, i + 1, None
        top = s.parent[i] < 0
        if top and s.at(j) == "(" and s.word(s.close(j) + 1):
            receiver = (j + 1, s.close(j))
            j = s.close(j) + 1
        named = top and s.word(j)
        name = j
        if named:
            self.declared.add(j)
            j += 1
            if s.at(j) == "[":
                j = s.close(j) + 1
        if s.at(j) != "(":
            return
        params = s.close(j)
        body = self._body(params + 1)
        if not named:
            if body is not None:
                self.functions.append((i, s.close(body)))
            return
        if s.broken(params if body is None else body) or s.broken(j):
            return
        end = s.close(body) if body is not None else self._line_end(params)
        variable = owner = None
        if receiver:
            words = [k for k in range(*receiver) if s.word(k)]
            variable = s.at(receiver[0]) if len(words) > 1 and s.at(receiver[0] + 1) not in ("[", ".") and s.word(receiver[0]) else None
            owner = s.between(receiver[0] + (variable is not None), receiver[1]).strip().lstrip("*").split("[")[0].strip() or None
        if body is not None:
            self.functions.append((i, end))
        if owner and variable:
            self.methods.append((i, end, variable, owner))
        label = s.at(name)
        text = s.between(i, body) if body is not None else s.through(i, end)
        self.symbols.append(symbol(label, f"{owner}.{label}" if owner else label, "method" if receiver else "function", owner, *s.span(i, end), header(text), s.doc(i), label[0].isupper()))

    def _line_end(self, i: int) -> int:
        """The last token of the line that ``i`` stands on, brackets taken whole."""
        s = self.s
        while i + 1 < len(s.tokens) and not s.breaks(i + 1) and s.at(i + 1) not in (";", ")", "}"):
            i += 1
            i = s.close(i) if s.at(i) in ("(", "[", "{") else i
        return i

    def _types(self, i: int) -> None:
        s = self.s
        if s.word(i + 1) and s.at(i + 1) not in _KEYWORDS:
            self._type(i + 1, i)
        elif s.at(i + 1) == "(":
            j, end = i + 2, s.close(i + 1)
            while j < end:
                j = self._type(j, j) + 1 if s.word(j) else j + 1

    def _type(self, i: int, anchor: int) -> int:
        """One type from its name on; its last token. An alias (``=``) is no symbol."""
        s, name, j = self.s, self.s.at(i), i + 1
        if s.at(j) == "[" and s.word(j + 1) and s.at(j + 2) != "]":
            j = s.close(j) + 1
        if s.at(j) == "=":
            return self._line_end(j)
        if s.at(j) in ("struct", "interface") and s.at(j + 1) == "{":
            end, kind, words = s.close(j + 1), s.at(j), f"type {name} {s.at(j)}"
            self._members(name, kind, j + 1, end)
        else:
            end = self._line_end(j)
            kind, words = "type", f"type {name} {shorten(fold(s.through(j, end)), 100)}" if j <= end and j < len(s.tokens) else f"type {name}"
        self.declared.add(i)
        self.symbols.append(symbol(name, name, kind, None, *s.span(i, end), words, s.doc(i) or s.doc(anchor), name[0].isupper()))
        return end

    def _members(self, owner: str, kind: str, i: int, end: int) -> None:
        """What an interface requires, and the types that it or a struct embeds, each on a line of its own."""
        s = self.s
        for k in range(i + 1, end):
            if s.parent[k] != i or not (k == i + 1 or s.breaks(k) or s.at(k - 1) == ";"):
                continue
            at = k + (s.at(k) == "*")
            if not s.word(at):
                continue
            line = s.line(s.tokens[k].start)
            if kind == "interface" and s.at(at + 1) == "(":
                self.relations.append(relation(owner, "requires", s.at(at), line))
                continue
            while s.at(at + 1) == "." and s.word(at + 2) and not s.breaks(at + 1):
                at += 2
            name, after = s.at(at), at + 1
            if s.at(after) == "[" and not s.breaks(after):
                after = s.close(after) + 1
            if after >= end or s.breaks(after) or s.at(after) == ";" or (kind == "struct" and s.tokens[after].kind == "text"):
                self.relations.append(relation(owner, "embeds", name, line))

    def _imports(self, i: int) -> None:
        s = self.s
        j, end = (i + 2, s.close(i + 1)) if s.at(i + 1) == "(" else (i + 1, min(i + 3, len(s.tokens)))
        for k in range(j, end):
            if s.tokens[k].kind != "text":
                continue
            module = s.tokens[k].text.strip('"`')
            alias = s.at(k - 1) if k > j and not s.breaks(k) and (s.word(k - 1) or s.at(k - 1) == ".") else ""
            first = k - 1 if alias else k
            self.imports.append(binding(module, None, module.split("/")[-1] if alias in ("", "_", ".") else alias, s.line(s.tokens[first].start)))
            if j == i + 1:
                break

    def _locals(self, first: int, last: int) -> dict[str, str]:
        """Variable -> type where a declaration in this function states it; the first declaration counts."""
        s, found = self.s, {}
        for i in range(first, last):
            if s.at(i) == ":=" and s.word(i - 1) and s.at(i - 2) != ",":
                kind = self._literal(i + 1)
                if kind:
                    found.setdefault(s.at(i - 1), kind)
            elif s.at(i) == "var":
                specs = range(i + 2, s.close(i + 1)) if s.at(i + 1) == "(" else [i + 1]
                for j in specs:
                    if s.word(j) and (len(specs) == 1 or (s.breaks(j) and s.parent[j] == i + 1)):
                        self._variable(j, found)
        return found

    def _variable(self, i: int, found: dict[str, str]) -> None:
        s, j = self.s, i + 1
        while s.at(j) == ",":
            j += 2
        if s.at(j) == "=":
            kind = self._literal(j + 1)
        else:
            k = j
            while k < len(s.tokens) and not s.breaks(k) and s.at(k) not in ("=", ";", ")", "}"):
                k = s.close(k) + 1 if s.at(k) in ("(", "[", "{") else k + 1
            kind = _bare(s.between(j, k)) if k > j else None
        if kind:
            found.setdefault(s.at(i), kind)

    def _literal(self, i: int) -> str | None:
        """The type of a composite literal that is the only value."""
        s = self.s
        i += s.at(i) == "&"
        j = i
        while s.word(j) and s.at(j) not in _KEYWORDS and s.at(j + 1) == ".":
            j += 2
        if not s.word(j) or s.at(j) in _KEYWORDS:
            return None
        end = j + 1
        if s.at(end) == "[":
            end = s.close(end) + 1
        if s.at(end) != "{" or s.at(s.close(end) + 1) == ",":
            return None
        return s.at(j)

    def _innermost(self) -> list[tuple[int, int] | None]:
        """For every token the innermost function around it: one pass with the open ones on a stack."""
        out, open_, todo = [], [], sorted(self.functions, reverse=True)
        for i in range(len(self.s.tokens)):
            while todo and todo[-1][0] <= i:
                open_.append(todo.pop())
            while open_ and open_[-1][1] < i:
                open_.pop()
            out.append(open_[-1] if open_ else None)
        return out

    def _find_calls(self) -> None:
        s = self.s
        for i, t in enumerate(s.tokens):
            if t.kind != "word" or s.at(i + 1) != "(" or i in self.declared or t.text in _KEYWORDS or s.parent[i] in self.contracts:
                continue
            start, receiver, hint = i, None, None
            if s.at(i - 1) == ".":
                start = i - 2
                if not s.word(start) or s.at(start) in _KEYWORDS or s.at(start - 1) == ".":
                    continue
                receiver = s.at(start)
                hint = self._hint(i, receiver)
            elif s.at(i - 1) == "]" and not s.breaks(i):
                continue
            at = s.tokens[start].start
            self.calls.append(call(t.text, receiver, hint, s.line(at), s.byte(at)))

    def _hint(self, i: int, receiver: str) -> str | None:
        at = bisect.bisect_right(self.methods, i, key=lambda m: m[0]) - 1  # methods don't nest
        if at >= 0 and i <= self.methods[at][1] and self.methods[at][2] == receiver:
            return self.methods[at][3]
        around = self.around[i]
        return self.locals[around].get(receiver) if around else None


def extract(data: bytes):
    f = _Go(data)
    return f.s.ok, f.symbols, f.calls, f.imports, f.relations, f.s.errors()
