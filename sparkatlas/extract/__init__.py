"""Symbols, call sites and imports of source files: one parse a file, one row a file, in one Arrow stage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from . import go, python, typescript

#: language -> contents -> (parse_ok, symbols, calls, imports, relations, errors); a language is one entry here and one in ``sources.tree``.
EXTRACTORS: dict[str, Callable] = {"python": python.extract, "go": go.extract, "typescript": typescript.extract, "tsx": typescript.extract_tsx}

_META = "id long, path string, language string, size_bytes long, mtime long, line_count int, content_hash string, is_test boolean, skipped_reason string"
_LISTS = {"symbols": schema.SYMBOL, "calls": schema.CALL, "imports": schema.IMPORT, "relations": schema.RELATION, "errors": schema.ERROR}
#: Bytes of source after which the rows found so far are handed on.
PIECE_BYTES = 1 << 20
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def _fields(ddl: str) -> list[tuple[str, pa.DataType]]:
    return [(n, _KINDS[k]) for n, k in (f.split() for f in ddl.split(","))]


def _output(lists: tuple[str, ...]) -> str:
    return ", ".join([f"{_META}, parse_ok boolean", *(f"{n} array<struct<{','.join(c.strip().replace(' ', ':') for c in _LISTS[n].split(','))}>>" for n in lists)])


OUTPUT = _output(tuple(_LISTS))


def _rows(batches: Iterator[pa.RecordBatch], lists: tuple[str, ...] = tuple(_LISTS)) -> Iterator[pa.RecordBatch]:
    kinds = {"parse_ok": pa.bool_(), **{n: pa.list_(pa.struct(_fields(_LISTS[n]))) for n in lists}}
    at = ["parse_ok", *_LISTS]
    for batch in batches:
        languages, contents = batch.column("language"), batch.column("content")
        first, held, found = 0, 0, []
        for i in range(batch.num_rows):
            content = contents[i].as_py()
            found.append((True, *[[]] * len(_LISTS)) if content is None else EXTRACTORS[languages[i].as_py()](content))
            held += len(content or b"")
            if held > PIECE_BYTES or i + 1 == batch.num_rows:
                meta = [batch.column(n).slice(first, len(found)).cast(t) for n, t in _fields(_META)]
                new = [pa.array([x[at.index(n)] for x in found], t) for n, t in kinds.items()]
                yield pa.RecordBatch.from_arrays([*meta, *new], names=[*(n for n, _ in _fields(_META)), *kinds])
                first, held, found = i + 1, 0, []


def extract(raw: DataFrame, lists: tuple[str, ...] = tuple(_LISTS)) -> DataFrame:
    """Rows of ``repo_tree`` -> the same without content, with id, parse_ok, symbols, calls, imports, type relations and parse errors.

    The id is a hash of the path, so it neither depends on partitions nor changes between runs. A skipped file has no
    symbols and counts as parsed. ``lists`` names those that are wanted, so that no others are brought back.
    """
    return raw.withColumn("id", F.xxhash64("path")).mapInArrow(lambda batches: _rows(batches, lists), _output(lists))
