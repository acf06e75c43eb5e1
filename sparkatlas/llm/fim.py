"""Fill in the middle by overlapping chunks.

A text's bytes are cut into chunks that overlap by the byte before them, so a predicate over two adjacent bytes tells
inside a chunk alone where units start. Every chunk counts its starts; prefix sums of the counts name the chunk that
owns a cut's rank, and only these chunks are scanned again for the byte. Texts are never indexed by unit as a whole,
rows stay where they are (no shuffle), and memory beside a text and its output is a chunk's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .common import slices
from .text import SPACE

#: Bytes of a chunk; marks of the parts; shares, in hundredths, of texts that get a form at all and of those that get spm.
CHUNK, PREFIX, SUFFIX, MIDDLE = 65_536, b"<P>", b"<S>", b"<M>"
FORMED, SPM = 90, 20

#: unit -> whether a unit starts at the second of two adjacent bytes. Code points start at bytes that don't continue one,
#: words at what follows white space, lines at what follows a line feed; what precedes the first start belongs to it.
UNITS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "char": lambda a, b: (b & 0xC0) != 0x80,
    "word": lambda a, b: SPACE[a] & ~SPACE[b],
    "line": lambda a, b: a == 10,
}


class Chunks:
    """The chunks of one text: ``n`` units in all, and the byte at which a given number of units ends."""

    def __init__(self, data: bytes, unit: str, size: int = CHUNK):
        self.data, self.starts, self.size = np.frombuffer(b"\n" + data, np.uint8), UNITS[unit], size  # a text starts like a line
        counts = [int(np.count_nonzero(self._scan(c))) for c in range((len(data) + size - 1) // size)]
        self.before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        self.n = int(self.before[-1])

    def _scan(self, chunk: int) -> np.ndarray:
        a = self.data[chunk * self.size : (chunk + 1) * self.size + 1]
        return self.starts(a[:-1], a[1:])

    def offset(self, rank: int) -> int:
        """The byte after the first ``rank`` units."""
        if rank <= 0:
            return 0
        if rank >= self.n:
            return len(self.data) - 1
        owner = int(np.searchsorted(self.before, rank, side="right")) - 1
        return owner * self.size + int(np.flatnonzero(self._scan(owner))[rank - int(self.before[owner])])


def arrange(doc_id: int | None, data: bytes, unit: str = "char", seed: int = 1, size: int = CHUNK) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, units of the prefix, of the middle, output) of one text; all draws come from ``seed`` and the id."""
    chunks = Chunks(data, unit, size)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = np.frombuffer(digest[:16], ">u4").tolist()
    if not data or h3 % 100 >= FORMED or PREFIX in data or SUFFIX in data or MIDDLE in data:
        return chunks.n, "plain", None, None, data
    first, last = sorted((h1 % (chunks.n + 1), h2 % (chunks.n + 1)))
    a, b = chunks.offset(first), chunks.offset(last)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < SPM:
        return chunks.n, "spm", first, last - first, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return chunks.n, "psm", first, last - first, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


_NEW = {"n": S.LongType(), "form": S.StringType(), "prefix_units": S.LongType(), "middle_units": S.LongType(), "output": S.StringType()}


def transform(docs: DataFrame, unit: str = "char", seed: int = 1) -> DataFrame:
    """``docs`` with n (units of the text), form, prefix_units, middle_units and output.

    The two cuts are drawn from doc_id; the form is ``plain`` (the text as it is, both numbers null) where the text is
    empty or holds a mark, and for a tenth of the others; else ``psm``, or ``spm`` for a fifth. A null text counts as
    empty and stays null in its own column. Every row is arranged by itself: repeated rows alike, rows of one doc_id and
    different texts with the same draws, a null doc_id with the draws of the empty id. Columns of ``docs`` with a new
    column's name give way, others stay, whatever their names. An empty table gives an empty result.
    """
    rest = [f for f in docs.schema.fields if f.name not in _NEW]
    spare = next(n for n in (f"bytes_{i}" for i in range(len(rest) + 1)) if n not in docs.columns)
    names = [f.name for f in rest]

    def rows(batches):
        for whole in batches:
            for batch in slices(whole):
                pairs = zip(batch.column("doc_id").to_pylist(), batch.column(spare).to_pylist(), strict=True)
                n, form, prefix, middle, output = zip(*(arrange(i, t or b"", unit, seed) for i, t in pairs), strict=True) if batch.num_rows else [()] * 5
                new = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(x) for x in names] + new, names=[*names, *_NEW])

    sent = docs.select(*names, F.col("text").cast("binary").alias(spare))
    return sent.mapInArrow(rows, S.StructType([*rest, *(S.StructField(k, v) for k, v in _NEW.items())]))


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form alone. No text that has a form holds a mark, and no mark overlaps another."""
    p, s, m = (x.decode() for x in (PREFIX, SUFFIX, MIDDLE))
    after = lambda x, mark: F.split_part(x, F.lit(mark), F.lit(2))
    upto = lambda x, mark: F.split_part(x, F.lit(mark), F.lit(1))
    psm = F.concat(upto(after(output, p), s), after(output, m), upto(after(output, s), m))
    spm = F.concat(upto(after(output, p), m), after(output, m), upto(after(output, s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
