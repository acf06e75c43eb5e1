"""TypeScript and TSX declarations, calls and imports."""

from __future__ import annotations

from .text import binding, call, fold, header, relation, shorten, symbol
from .tokens import Source

#: Tokens that type arguments don't hold outside brackets.
_NO_TYPE = frozenset((";", "&&", "||", "="))
_KEYWORDS = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield await let".split()
)
_MODIFIERS = frozenset("public private protected static async readonly override abstract get set declare accessor".split())
#: After these tokens a declaration's keyword is part of an expression.
_INSIDE = frozenset({"=", "(", ",", ":", "=>", "[", "?", "&&", "||", "??", "!", "...", "<", "+", "return", "typeof", "new", "await", "void", "yield", "case", "in", "of", "extends", "."})
#: A line that starts or ends so goes on.
_STARTS = frozenset(". ?. | & ? : => = + - * / && || ?? , extends instanceof in as satisfies == === != !== < > <= >= (".split())
_ENDS = frozenset(". ?. | & ? : => = + - * / && || ?? , < ( [ {".split())
#: A brace after one of these opens a type, not a body.
_TYPE_BRACE = frozenset({":", "|", "&", "=>", "<", ",", "=", "(", "[", "extends", "keyof"})


class _Ts:
    def __init__(self, data: bytes, loose: bool = False):
        self.s = Source(data, templates=True, loose=loose)
        self.symbols, self.calls, self.imports, self.relations = [], [], [], []
        self.declared: set[int] = set()
        self.classes: list[tuple[int, int, str]] = []  # tokens of the body, name
        self.open_bodies: set[int] = set()  # bodies of exported functions
        s = self.s
        for i, t in enumerate(s.tokens):
            if t.kind != "word" or s.at(i - 1) in (".", "?."):
                continue
            if t.text == "class":
                self._class(i)
            elif t.text == "function":
                self._function(i)
            elif t.text == "interface" and s.word(i + 1) and s.at(i + 2) in ("{", "<", "extends"):
                self._interface(i)
            elif t.text == "type" and s.word(i + 1) and s.at(i + 2) in ("=", "<") and s.at(i - 1) not in _INSIDE:
                self._alias(i)
            elif t.text in ("const", "let", "var"):
                self._variables(i)
            elif t.text == "import" and s.at(i + 1) not in ("(", "."):
                self._import(i)
            elif s.at(i + 1) in ("(", "<", "?"):
                self._method(i)
        self._find_calls()

    def _scopes(self, i: int) -> list[str]:
        return [name for a, b, name in self.classes if a <= i <= b]

    def _first(self, i: int, words) -> int:
        while s_ok(self.s, i - 1, words):
            i -= 1
        return i

    def _exported(self, i: int) -> bool:
        before = self._first(i, {"default", "declare", "async", "abstract"})
        return self.s.at(before - 1) == "export" or self.s.parent[i] in self.open_bodies

    def _angle(self, i: int) -> int:
        """The token after type parameters that open at ``i``."""
        depth = 0
        while i < len(self.s.tokens):
            t = self.s.at(i)
            depth += (t == "<") - (t == ">")
            if t in ("(", "[", "{"):
                i = self.s.close(i)
            i += 1
            if depth == 0:
                break
        return i

    def _body(self, i: int) -> int | None:
        """The brace of the body that follows a header; None if the header ends first."""
        s = self.s
        while i < len(s.tokens):
            t = s.at(i)
            if t == "{":
                if s.at(i - 1) not in _TYPE_BRACE:
                    return i
                i = s.close(i)
            elif t in ("(", "["):
                i = s.close(i)
            elif t in (";", "}", ")", "]") or (s.breaks(i) and t not in _STARTS and s.at(i - 1) not in _ENDS and t not in ("extends", "implements")):
                return None
            i += 1
        return None

    def _add(self, name, kind, first, last, signature, exported, scopes=None, doc_at=None) -> None:
        s = self.s
        scopes = self._scopes(first) if scopes is None else scopes
        doc = s.doc(first)
        if doc is None:
            before = self._first(first, {"default", "declare", "export"})
            doc = s.doc(before) if s.at(before) == "export" else None
        self.symbols.append(symbol(name, ".".join([*scopes, name]), kind, ".".join(scopes) or None, *s.span(first, last), signature, doc, exported))

    def _class(self, i: int) -> None:
        s = self.s
        first = self._first(i, {"abstract"})
        if not s.word(i + 1) or s.at(i + 1) in ("extends", "implements") or s.at(first - 1) in _INSIDE:
            return
        body = self._body(i + 2)
        if body is None:
            return
        name, end = s.at(i + 1), s.close(body)
        self.declared.add(i + 1)
        self._add(name, "class", first, end, header(s.between(first, body)), self._exported(i))
        self.classes.append((body, end, name))
        self._heritage(name, i + 2, body)

    def _function(self, i: int) -> None:
        s = self.s
        first = self._first(i, {"async"})
        name = i + 1 + (s.at(i + 1) == "*")
        if not s.word(name):
            return
        self.declared.add(name)
        at = self._angle(name + 1) if s.at(name + 1) == "<" else name + 1
        if s.at(at) != "(" or s.at(first - 1) in _INSIDE:
            return
        body = self._body(s.close(at) + 1)
        if body is None or s.broken(at) or s.broken(body):
            return
        exported = self._exported(i)
        if s.at(self._first(i, {"default", "declare", "async"}) - 1) == "export":
            self.open_bodies.add(body)
        self._add(s.at(name), "function", first, s.close(body), header(s.between(first, body)), exported)

    def _interface(self, i: int) -> None:
        s, at = self.s, i + 2
        if s.at(i - 1) in _INSIDE:
            return
        at = self._angle(at) if s.at(at) == "<" else at
        body = self._body(at)
        if body is not None:
            self._add(s.at(i + 1), "interface", i, s.close(body), header(s.between(i, body)), self._exported(i))
            self._heritage(s.at(i + 1), at, body)
            for k in range(body + 1, s.close(body)):
                if s.parent[k] == body and s.word(k) and (s.breaks(k) or s.at(k - 1) in ("{", ";", ",")):
                    after = k + 1 + (s.at(k + 1) == "?")
                    after = self._angle(after) if s.at(after) == "<" else after
                    if s.at(after) == "(":
                        self.relations.append(relation(s.at(i + 1), "requires", s.at(k), s.line(s.tokens[k].start)))

    def _heritage(self, owner: str, i: int, body: int) -> None:
        """The types that a header names after ``extends`` and ``implements``, without their type arguments."""
        s, kind = self.s, None
        while i < body:
            t = s.at(i)
            if t in ("extends", "implements"):
                kind = t
            elif kind and s.word(i):
                while s.at(i + 1) == "." and s.word(i + 2):
                    i += 2
                if s.at(i + 1) != "(":  # no type: a class made by a call
                    self.relations.append(relation(owner, kind, s.at(i), s.line(s.tokens[i].start)))
            i = self._angle(i) if t == "<" else s.close(i) + 1 if t in ("(", "[", "{") else i + 1

    def _statement_end(self, i: int, comma: bool) -> int:
        """The last token of the expression or type that starts at ``i``."""
        s, depth = self.s, 0
        first = i
        while i < len(s.tokens):
            t = s.at(i)
            if t in (";", ")", "]", "}") or (comma and t == "," and depth == 0) or (i > first and s.breaks(i) and t not in _STARTS and s.at(i - 1) not in _ENDS):
                return max(i - 1, first)
            depth += (t == "<" and not comma) - (t == ">" and not comma)
            i = s.close(i) + 1 if t in ("(", "[", "{") else i + 1
        return len(s.tokens) - 1

    def _alias(self, i: int) -> None:
        s = self.s
        at = self._angle(i + 2) if s.at(i + 2) == "<" else i + 2
        if s.at(at) != "=":
            return
        end = self._statement_end(at + 1, comma=False)
        end += s.at(end + 1) == ";"
        self._add(s.at(i + 1), "type_alias", i, end, shorten(fold(s.through(i, end)), 120), self._exported(i))

    def _variables(self, i: int) -> None:
        """``const f = () => ...``: the declarators of one statement whose value is a function."""
        s, at = self.s, i + 1
        while s.word(at):
            name, k = at, at + 1
            if s.at(k) == ":":
                while k < len(s.tokens) and s.at(k) not in ("=", ";", ",", ")", "}") and not (s.breaks(k) and s.at(k) not in _STARTS and s.at(k - 1) not in _ENDS):
                    k = self._angle(k) if s.at(k) == "<" else s.close(k) + 1 if s.at(k) in ("(", "[", "{") else k + 1
            if s.at(k) != "=":
                return
            body = self._function_value(k + 1)
            if body is None:
                end = self._statement_end(k + 1, comma=True)
            else:
                end = s.close(body) if s.at(body) == "{" else self._statement_end(body, comma=True)
                self.declared.add(name)
                self._add(s.at(name), "function", i, end, header(s.between(i, body)), self._exported(i))
            if s.at(end + 1) != ",":
                return
            at = end + 2

    def _function_value(self, i: int) -> int | None:
        """The first token of the body, if an arrow function or function expression starts at ``i``."""
        s = self.s
        i += s.at(i) == "async" and (s.word(i + 1) or s.at(i + 1) in ("(", "<"))
        if s.at(i) == "function":
            at = i + 1 + (s.at(i + 1) == "*")
            at += s.word(at)
            at = self._angle(at) if s.at(at) == "<" else at
            return self._body(s.close(at) + 1) if s.at(at) == "(" else None
        if s.word(i) and s.at(i + 1) == "=>":
            return i + 2
        i = self._angle(i) if s.at(i) == "<" else i
        if s.at(i) != "(":
            return None
        i = s.close(i) + 1
        if s.at(i) == ":":
            while i < len(s.tokens) and s.at(i) not in ("=>", ";", "=", ")", "}"):
                i = self._angle(i) if s.at(i) == "<" else s.close(i) + 1 if s.at(i) in ("(", "[", "{") else i + 1
        return i + 1 if s.at(i) == "=>" else None

    def _method(self, i: int) -> None:
        """A method with a body, of a class or an object."""
        s = self.s
        inside = any(a == s.parent[i] for a, _, _ in self.classes)
        first = self._first(i - (s.at(i - 1) == "*"), _MODIFIERS)
        before = s.at(first - 1)
        if s.at(i) in _KEYWORDS - {"delete", "default", "import", "catch"} and not inside or before in ("function", "new", ".", "?.", "@"):
            return
        if not inside and (before not in ("{", ",") or s.at(i) in _KEYWORDS):
            return
        at = i + 1 + (s.at(i + 1) == "?")
        at = self._angle(at) if s.at(at) == "<" else at
        if s.at(at) != "(" or (inside and not (before in ("{", "}", ";", ")") or s.breaks(first))):
            return
        after = s.close(at) + 1
        body = self._body(after) if s.at(after) in (":", "{") else None
        if body is None or s.broken(at) or s.broken(body):
            return
        self.declared.add(i)
        private = any(s.at(k) in ("private", "protected") for k in range(first, i))
        self._add(s.at(i), "method", first, s.close(body), header(s.between(first, body)), not private)

    def _import(self, i: int) -> None:
        s, line = self.s, self.s.line(self.s.tokens[i].start)
        j = i + 1
        while j < len(s.tokens) and s.tokens[j].kind != "text" and s.at(j) not in (";", "="):
            j += 1
        if j >= len(s.tokens) or s.tokens[j].kind != "text" or s.at(j - 1) != "from":
            return
        module, k, end = s.tokens[j].text.strip("\"'"), i + 1, j - 1
        k += s.at(k) == "type" and k + 1 < end and s.at(k + 1) != ","
        while k < end:
            if s.at(k) == "*":
                self.imports.append(binding(module, None, s.at(k + 2), line))
                k += 3
            elif s.at(k) == "{":
                for words in _specifiers(s, k):
                    self.imports.append(binding(module, words[0], words[-1], line))
                k = s.close(k) + 1
            else:
                if s.word(k):
                    self.imports.append(binding(module, "default", s.at(k), line))
                k += 1

    def _find_calls(self) -> None:
        s = self.s
        for i, t in enumerate(s.tokens):
            if t.kind != "word" or i in self.declared:
                continue
            at = i + 1
            if s.at(at) == "<":
                at = self._type_arguments(at)
                if at is None or s.at(at) != "(":
                    continue
            at += s.at(at) == "?."
            if s.at(at) != "(" or s.at(i - 1) in ("function", "#"):
                continue
            start, receiver, hint = i, None, None
            if s.at(i - 1) in (".", "?."):
                start = self._chain(i)
                if start is None:
                    continue
                receiver = s.through(start, i - 2)
                if receiver == "this":
                    hint = next(iter(reversed(self._scopes(i))), None)
            elif t.text in _KEYWORDS or s.at(i - 1) == "new" or self._signature(i) or (t.text == "async" and s.at(s.close(at) + 1) in ("=>", ":")):
                continue
            where = s.tokens[start].start
            self.calls.append(call(t.text, receiver, hint, s.line(where), s.byte(where)))

    def _type_arguments(self, i: int) -> int | None:
        """The token after type arguments that open at ``i``; None where "<" compares."""
        depth = 0
        while i < len(self.s.tokens):
            t = self.s.at(i)
            depth += (t == "<") - (t == ">")
            if t in _NO_TYPE or t in (")", "]", "}"):
                return None
            if t in ("(", "[", "{"):
                i = self.s.close(i)
            i += 1
            if depth == 0:
                return i
        return None

    def _angle_back(self, i: int) -> int | None:
        """The token that opens the type arguments that end at ``i``."""
        depth = nested = 0
        for k in range(i, -1, -1):
            t = self.s.at(k)
            nested += (t in (")", "]", "}")) - (t in ("(", "[", "{"))
            if nested < 0 or nested == 0 and t in _NO_TYPE:
                return None
            depth += (t == ">") - (t == "<")
            if depth == 0:
                return k
        return None

    def _signature(self, i: int) -> bool:
        """A method without a body, in a class or interface."""
        s = self.s
        inside = any(a == s.parent[i] for a, _, _ in self.classes)
        return (inside and (s.breaks(i) or s.at(i - 1) in _MODIFIERS or s.at(i - 1) in (";", "{"))) or (s.at(s.close(i + 1) + 1) == ":" and s.at(i - 1) in ("{", ";") and s.at(i + 1) == "(")

    def _chain(self, i: int) -> int | None:
        """The first token of the expression that a member is called on; None for constructor calls."""
        s, j, called = self.s, i - 2, False
        while j >= 0:
            if s.at(j) == "!":
                j -= 1
                continue
            if s.at(j) in (")", "]") and j in s.match:
                called |= s.at(j) == ")"
                j = s.match[j]
                before = s.at(j - 1)
                if before in (")", "]") or (s.word(j - 1) and (before not in _KEYWORDS or before in ("this", "super", "import"))):
                    j -= 1
                    continue
                if before == "?.":
                    j -= 2
                    continue
                if before == ">" and (opened := self._angle_back(j - 1)) is not None:
                    j = opened - 1
                    continue
            elif not (s.word(j) or s.tokens[j].kind in ("text", "number") or s.at(j) == "}"):
                return None
            if s.at(j - 1) in (".", "?."):
                j -= 2
                continue
            break
        if j < 0:
            return None
        if s.at(j - 1) == "new":
            return j - 1 if called else None
        return j


def s_ok(s: Source, i: int, words) -> bool:
    return s.word(i) and s.at(i) in words


def _specifiers(s: Source, i: int):
    """The words of each name in braces, without ``type`` and ``as``."""
    words: list[str] = []
    for k in range(i + 1, s.close(i) + 1):
        if s.word(k):
            words.append(s.at(k))
        elif words:
            yield [w for n, w in enumerate(words) if not (w == "as" and 0 < n < len(words) - 1) and not (w == "type" and n == 0 and len(words) > 1)]
            words = []


def extract(data: bytes):
    f = _Ts(data)
    return f.s.ok, f.symbols, f.calls, f.imports, f.relations, f.s.errors()


def extract_tsx(data: bytes):
    """Text between JSX tags may hold a lone quote, which is no error."""
    f = _Ts(data, loose=True)
    return f.s.ok, f.symbols, f.calls, f.imports, f.relations, f.s.errors()
