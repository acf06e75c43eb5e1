"""Text rules that the extractors share."""

from __future__ import annotations

import inspect
import re


def fold(text: str) -> str:
    """White space to single spaces."""
    return " ".join(text.split())


def header(text: str) -> str:
    """A declaration up to its body, as a signature."""
    return fold(text).rstrip(" {:")


def shorten(text: str, size: int) -> str:
    return text if len(text) <= size else text[: size - 3] + "..."


def bare_comment(comment: str) -> str:
    """The words of a comment block without its markers."""
    lines = []
    for line in comment.splitlines():
        line = re.sub(r"^(///?|/\*\*?|\*/)", "", line.strip()).strip()
        line = re.sub(r"^\*( |$)", "", line)
        lines.append(re.sub(r"\s*\*/$", "", line))
    return "\n".join(lines).strip()


def docstring(text: str | None) -> str | None:
    return (inspect.cleandoc(text).strip() or None) if text else None


def symbol(name, qualified, kind, parent, lines, span, signature, doc, exported) -> dict:
    return {
        "name": name, "qualified_name": qualified, "kind": kind, "parent": parent, "start_line": lines[0], "end_line": lines[1], "start_byte": span[0], "end_byte": span[1],
        "signature": signature, "docstring": doc, "is_exported": exported,
    }


def call(callee, receiver, hint, line, at) -> dict:
    return {"callee": callee, "receiver": receiver, "receiver_type_hint": hint, "line": line, "start_byte": at}


def binding(module, name, alias, line) -> dict:
    return {"module": module, "symbol": name, "alias": alias, "line": line}


def relation(owner, kind, name, line) -> dict:
    """``owner`` extends, implements or embeds the type ``name``, or requires a member so named."""
    return {"owner": owner, "kind": kind, "name": name, "line": line}
