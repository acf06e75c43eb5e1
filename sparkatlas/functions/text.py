"""Column functions with the semantics of the stored queries: ASCII case folding, live wildcards, posix paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def like_ci(c: Column, pattern: str) -> Column:
    """LIKE that folds A-Z only, with ``%`` and ``_`` live and no escape character."""
    body = "".join({"%": "(?s:.*)", "_": "(?s:.)"}.get(x, "\\Q" + x + "\\E" if x != "\\" else "\\\\") for x in pattern.translate(str.maketrans(_UPPER, _LOWER)))
    return ascii_lower(c).rlike(f"\\A{body}\\z")


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def directory_bucket(path: Column) -> Column:
    """The first two segments of a path's directory; ``(root)`` for files at the top."""
    depth = F.size(F.split(path, "/"))
    return F.when(depth == 1, "(root)").when(depth == 2, F.split_part(path, F.lit("/"), F.lit(1))).otherwise(F.substring_index(path, "/", 2))
