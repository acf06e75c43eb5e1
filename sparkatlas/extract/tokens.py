"""A tolerant token scanner for languages with braces: words, strings, comments and matched brackets, no grammar.

Where brackets don't match, the layout decides: a closing brace that starts a line belongs to the brace whose line is
indented like it, and a declaration ends every bracket that was opened on a line indented as far or further. So what is
broken stays within its function, and each bracket without a partner is a fault with a place.
"""

from __future__ import annotations

import bisect
import re
from typing import NamedTuple

from .text import bare_comment, docstring


class Token(NamedTuple):
    kind: str  # word, number, text or op
    text: str
    start: int
    end: int


_COMMENT = r"(?P<comment>//[^\n]*|/\*(?s:.*?)(?:\*/|\Z))"
_WORD = r"(?P<word>[^\W\d][\w$]*|\$[\w$]*)"
_NUMBER = r"(?P<number>\d[\w.]*)"
_QUOTED = r"\"(?:[^\"\\\n]|\\.)*(?:\"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z)"
GO = re.compile(rf"\s+|{_COMMENT}|(?P<text>`[^`]*(?:`|\Z)|{_QUOTED})|{_WORD}|{_NUMBER}|(?P<op>:=|<-|&&|\|\||==|!=|<=|>=|\.\.\.|.)", re.S)
TS = re.compile(rf"\s+|{_COMMENT}|(?P<text>{_QUOTED})|{_WORD}|{_NUMBER}|(?P<op>\?\.(?!\d)|=>|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\.\.\.|.)", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
#: After these a slash starts a regular expression.
_BEFORE_REGEX = frozenset("return typeof case in of new delete void instanceof do else yield await".split())

#: A line that starts so declares something.
_DECLARES = {False: frozenset("func type var const import package".split()), True: frozenset("export function class interface enum namespace abstract declare import".split())}

OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class Source:
    """Tokens of one file with the partner of every bracket; ``ok`` tells whether all brackets and texts close."""

    def __init__(self, data: bytes, templates: bool, loose: bool = False):
        self.text = data.decode("utf-8", "replace")
        self.ok, self.loose, self.tokens, self.comments = True, loose, [], []
        self._scan(templates)
        self.match: dict[int, int] = {}
        self.ended: dict[int, int] = {}  # brackets that never close, and the last token of what they hold
        self.faults: list[int] = []  # tokens of brackets without a partner
        self.parent: list[int] = []
        if not self._pair():
            self.ok = False
            self._pair_by_layout(_DECLARES[templates])
        self._lines = [i for i, c in enumerate(self.text) if c == "\n"]
        self._ascii = self.text.isascii()
        if not self._ascii:
            self._bytes = [0]
            for c in self.text:
                self._bytes.append(self._bytes[-1] + len(c.encode()))

    def _scan(self, templates: bool) -> None:
        text, at, held = self.text, 0, []
        rule = TS if templates else GO
        while at < len(text):
            c = text[at]
            if templates and c == "`":
                at = self._template(at + 1, at, held)
                continue
            if templates and c == "}" and held and held[-1] == 0:
                held.pop()
                self.tokens.append(Token("op", ")", at, at + 1))
                at = self._template(at + 1, at + 1, held)
                continue
            if templates and held and c in "{}":
                held[-1] += 1 if c == "{" else -1
            if templates and c == "/" and self._regex_here(at) and (found := _REGEX.match(text, at)):
                self.tokens.append(Token("text", found[0], at, found.end()))
                at = found.end()
                continue
            found = rule.match(text, at)
            kind = found.lastgroup
            if kind == "comment":
                self.comments.append((found.start(), found.end(), len(self.tokens)))
                self.ok &= not found[0].startswith("/*") or (len(found[0]) > 3 and found[0].endswith("*/"))
            elif kind:
                self.tokens.append(Token(kind, found[0], found.start(), found.end()))
                if kind == "text":
                    self.ok &= self.loose or (len(found[0]) > 1 and found[0][-1] == found[0][0])
            at = found.end()
        self.ok &= not held

    def _template(self, at: int, start: int, held: list) -> int:
        end = _TEMPLATE.match(self.text, at).end()
        if self.text.startswith("${", end):
            self.tokens += [Token("text", self.text[start:end], start, end), Token("op", "(", end, end + 2)]
            held.append(0)
            return end + 2
        self.ok &= end < len(self.text)
        self.tokens.append(Token("text", self.text[start : end + 1], start, min(end + 1, len(self.text))))
        return end + 1

    def _regex_here(self, at: int) -> bool:
        if not self.tokens:
            return True
        last = self.tokens[-1]
        if last.kind == "word":
            return last.text in _BEFORE_REGEX
        return last.kind == "op" and last.text not in CLOSE and not (last.text == "<" and last.end == at)

    def _pair(self) -> bool:
        """Partners by nesting alone; whether all brackets have one."""
        stack = []
        for i, t in enumerate(self.tokens):
            self.parent.append(stack[-1] if stack else -1)
            if t.kind != "op":
                continue
            if t.text in OPEN:
                stack.append(i)
            elif t.text in CLOSE:
                if not stack or OPEN[self.tokens[stack[-1]].text] != t.text:
                    return False
                j = stack.pop()
                self.match[j], self.match[i] = i, j
                self.parent[i] = stack[-1] if stack else -1
        return not stack

    def _pair_by_layout(self, declares: frozenset[str]) -> None:
        self.match, self.parent = {}, []
        stack: list[tuple[int, int]] = []  # bracket, indent of its line
        indent = 0

        def leave(i: int) -> None:
            j, _ = stack.pop()
            self.ended[j] = i - 1
            self.faults.append(j)

        for i, t in enumerate(self.tokens):
            new = i == 0 or "\n" in self.text[self.tokens[i - 1].end : t.start]
            if new:
                indent = t.start - self.text.rfind("\n", 0, t.start) - 1
            if new and t.kind == "word" and t.text in declares:
                while stack and stack[-1][1] >= indent:
                    leave(i)
            closes = t.kind == "op" and t.text in CLOSE
            if closes:
                own = [k for k, (j, at) in enumerate(stack) if OPEN[self.tokens[j].text] == t.text and (not (new and t.text == "}") or at == indent)]
                floor = max((k for k, (j, _) in enumerate(stack) if self.tokens[j].text == "{"), default=-1)
                if not own or (t.text != "}" and own[-1] < floor):  # a round or square bracket closes nothing outside its block
                    self.faults.append(i)
                    closes = False
                else:
                    while len(stack) > own[-1] + 1:
                        leave(i)
                    j = stack.pop()[0]
                    self.match[j], self.match[i] = i, j
            self.parent.append(stack[-1][0] if stack else -1)
            if t.kind == "op" and t.text in OPEN:
                stack.append((i, indent))
        while stack:
            leave(len(self.tokens))
        self.faults.sort()

    def at(self, i: int) -> str:
        """Text of token ``i``; of a text token a quote; empty outside the file."""
        if not 0 <= i < len(self.tokens):
            return ""
        return self.tokens[i].text if self.tokens[i].kind != "text" else '"'

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "word"

    def close(self, i: int) -> int:
        """The partner of bracket ``i``; the last token that it holds if it never closes."""
        return self.match[i] if i in self.match else self.ended.get(i, len(self.tokens) - 1)

    def broken(self, i: int) -> bool:
        return i in self.ended

    def errors(self) -> list[dict]:
        """The line and the bracket of every fault; of texts and comments that don't close the file's last line."""
        out = [{"line": self.line(self.tokens[i].start), "found": self.tokens[i].text} for i in self.faults]
        return out or ([] if self.ok else [{"line": self.line(max(0, len(self.text) - 1)), "found": "end"}])

    def line(self, offset: int) -> int:
        return bisect.bisect_left(self._lines, offset) + 1

    def byte(self, offset: int) -> int:
        return offset if self._ascii else self._bytes[offset]

    def breaks(self, i: int) -> bool:
        """Whether token ``i`` starts a later line than the token before it ends on."""
        return i <= 0 or i >= len(self.tokens) or "\n" in self.text[self.tokens[i - 1].end : self.tokens[i].start]

    def between(self, i: int, j: int) -> str:
        """Text from token ``i`` up to token ``j``, without it."""
        end = self.tokens[j].start if j < len(self.tokens) else len(self.text)
        return self.text[self.tokens[i].start : end]

    def through(self, i: int, j: int) -> str:
        return self.text[self.tokens[i].start : self.tokens[j].end]

    def span(self, i: int, j: int):
        """((first line, last line), (first byte, end byte)) of tokens ``i`` to ``j``."""
        a, b = self.tokens[i].start, self.tokens[j].end
        return (self.line(a), self.line(b - 1)), (self.byte(a), self.byte(b))

    def doc(self, i: int) -> str | None:
        """Words of the comments that stand directly above token ``i`` without a blank line between."""
        row, block = self.line(self.tokens[i].start), []
        k = bisect.bisect_right(self.comments, i, key=lambda c: c[2]) - 1
        while k >= 0 and self.comments[k][2] == i and self.line(self.comments[k][1] - 1) >= row - 1:
            block.append(self.text[self.comments[k][0] : self.comments[k][1]])
            row = self.line(self.comments[k][0])
            k -= 1
        return docstring(bare_comment("\n".join(reversed(block)))) if block else None
