"""Packing: length combinations that fill a window, repeated as often as non-negative least squares tells."""

from __future__ import annotations

import json
import re
import zlib
from functools import cached_property, lru_cache
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_rows

#: Bins of piece lengths for the combinations, and tokens packed together; both bound memory, none bounds the input.
GRID, CHUNK_TOKENS, CACHE_WORDS = 32, 4_000_000, 600_000
BATCH_CHARS = 1_000_000
_ODD = re.compile("[\x02\x03\x1c-\x1f]")
# '.,' is one piece: it is sought before its two marks, and set apart after them, lest a mark before it seem to end a run.
_STANDS = (("., ", "\x01"), (".,\n", "\x01"), (", ", " \x02 "), (". ", " \x03 "), (",\n", " \x02 "), (".\n", " \x03 "), ("\x01", " \x01 "))
_STOOD = {"\x01": ".,", "\x02": ",", "\x03": "."}
# A stand-in for marks that form one piece with the mark before them.
_JOINED = re.compile("[\x01-\x03] (?<=(?:[^\\w\\s\x01-\x03]|_) . )")
# The vocabulary's pattern, and the same for characters below U+0250, among which there are six numbers
# besides the digits. Left out of these: "<", with which special tokens begin, and a capital whose lower case is two.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[0-9²³¹¼½¾]|(?:[^\w\s]|_)+")
_PLAIN = re.compile("[\x04-\x1b -;=-\u012f\u0131-\u024f]*")
#: Byte-level symbols: printable bytes stand for themselves, the others for the characters from U+0100 on.
_OTHER = [*range(33), *range(127, 161), 173]
_SYMBOLS = {b: 256 + i for i, b in enumerate(_OTHER)}


class Memory:
    """Values of strings in two generations of at most CACHE_WORDS / 2 each; ``make`` gives (string, value) of new strings."""

    def __init__(self, make):
        self.make, self.held, self.old = make, {}, {}

    def learn(self, wanted: set[str]) -> dict:
        new = wanted.difference(self.held)
        if len(self.held) + len(new) > CACHE_WORDS // 2:
            self.old, self.held, new = self.held, {}, wanted
        for x in new & self.old.keys():
            self.held[x] = self.old[x]
        self.held.update(self.make(new.difference(self.held)))
        return self.held


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes; equal to encoding each text as a whole.

    The vocabulary's pattern cuts a text into pieces that are encoded by themselves, and no piece crosses white space, so
    runs between white space, or else pieces, are encoded once and remembered. Where lower case and normal form are
    plain to see, the pattern is applied here and new pieces go to the vocabulary ready cut, with their bytes as its
    symbols. Other runs are encoded as they are, and so is all under a vocabulary that cuts in another way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path, self.ready = path, Tokenizer.from_file(path)
        first = json.loads(self.ready.pre_tokenizer.__getstate__()) if self.ready.pre_tokenizer else {}
        self.ready.normalizer, self.ready.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.Sequence([])
        cutter = (first.get("pretokenizers") or [{}])[0]
        self.known = cutter.get("pattern") == {"Regex": _PATTERN} and cutter.get("behavior") == "Removed"
        self.run_ids, self.piece_ids = Memory(self.of_runs), Memory(self.of_pieces)

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def plain(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def runs(self, text: str) -> list[str] | None:
        """Lower-case runs between white space; a comma, full stop or both that end one are apart, by their stand-in."""
        if not self.known or not _PLAIN.fullmatch(text):
            return None
        text = text.lower() + " "
        for mark, stand_in in _STANDS:
            text = text.replace(mark, stand_in)
        if _JOINED.search(text):
            parts, at = [], 0
            for m in _JOINED.finditer(text):
                parts += text[at : m.start() - 1], _STOOD[text[m.start()]], " "
                at = m.end()
            text = "".join([*parts, text[at:]])
        return text.split()

    def of_runs(self, new: set[str]):
        words = list(filter(str.isalpha, new))
        yield from zip(words, self.ready_ids(words), strict=True)
        mixed = list(new.difference(words))
        pieces = [(_STOOD[r],) if r in _STOOD else _PIECE.findall(r) for r in mixed]
        ids = iter(self.ready_ids([p for ps in pieces for p in ps]))
        for r, ps in zip(mixed, pieces, strict=True):
            yield r, b"".join([next(ids) for _ in ps])

    def pieces(self, text: str) -> list[str] | None:
        """The pattern's pieces, and whole the runs whose lower case or normal form isn't plain."""
        if not self.known or _ODD.search(text):
            return None
        if _PLAIN.fullmatch(text):
            return _PIECE.findall(text.lower())
        return [p for run in text.split() for p in (_PIECE.findall(run.lower()) if _PLAIN.fullmatch(run) else (run,))]

    def of_pieces(self, new: set[str]):
        cut = [p for p in new if p.isascii() and p.isalpha() or _PLAIN.fullmatch(p)]
        yield from zip(cut, self.ready_ids(cut), strict=True)
        for p in new.difference(cut):
            yield p, self.plain(p)

    def ready_ids(self, pieces: list[str]) -> list[bytes]:
        symbols = [p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(_SYMBOLS) for p in pieces]
        got = self.ready.encode(symbols, is_pretokenized=True, add_special_tokens=False)
        data = np.array(got.ids, "<u4").tobytes()
        ends = (np.cumsum(np.bincount(np.array(got.word_ids, np.int64), minlength=len(pieces))) * 4).tolist()
        return list(map(data.__getitem__, map(slice, [0, *ends], ends)))

    def __call__(self, texts: list[str]) -> list[bytes]:
        runs = [self.runs(t) for t in texts]
        held = self.run_ids.learn(set().union(*filter(None, runs)))
        out = [None if p is None else b"".join(map(held.__getitem__, p)) for p in runs]
        rest = [i for i, x in enumerate(out) if x is None]
        cut = [self.pieces(texts[i]) for i in rest]
        held = self.piece_ids.learn(set().union(*filter(None, cut)))
        for i, p in zip(rest, cut, strict=True):
            out[i] = self.plain(texts[i]) if p is None else b"".join(map(held.__getitem__, p))
        return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def combos(grid: int, depth: int = 3) -> np.ndarray:
    """Every multiset of two to ``depth`` bins whose sizes add up to the window: a column of counts by bin each."""
    found = [c for n in range(2, depth + 1) for c in combinations_with_replacement(range(1, grid), n) if sum(c) == grid]
    a = np.zeros((grid + 1, len(found)))
    for j, c in enumerate(found):
        for x in c:
            a[x, j] += 1
    return a


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 300) -> np.ndarray:
    """x >= 0 that nearly minimises |a x - b|, by accelerated projected gradients."""
    q, c = a.T @ a, a.T @ b
    rate = 1 / max(np.linalg.norm(q, 2), 1e-9)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        z = np.maximum(0, y - rate * (q @ y - c))
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = z + (t - 1) / u * (z - x)
        x, t = z, u
    return x


def pack(lengths: list[int], window: int = 4096) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length) for items of the given lengths; nothing is padded.

    Full windows are cut from an item first. The rests are put in bins by size; the repeat counts of the combinations
    are solved against the histogram and rounded down; a combination is filled up with what is left over elsewhere.
    The leftovers are packed one after another, cut at window ends, and the last of them into power-of-two sequences.
    """
    out: list[list[tuple[int, int, int]]] = []
    step = window // GRID
    bins: list[list[tuple[int, int, int]]] = [[] for _ in range(GRID + 1)]
    for i, n in enumerate(lengths):
        full = n - n % window
        out += [[(i, s, window)] for s in range(0, full, window)]
        if rest := n - full:
            bins[-(-rest // step)].append((i, full, rest))
    a = _combos()
    counts = np.array([len(b) for b in bins], float)
    times = np.floor(nnls(a, counts) + 1e-6).astype(int)
    open_: list[list[tuple[int, int, int]]] = []
    for j in np.argsort(-times, kind="stable"):
        need = [(x, int(a[x, j])) for x in np.flatnonzero(a[:, j])]
        for _ in range(times[j]):
            if any(len(bins[x]) < k for x, k in need):
                break
            open_.append([bins[x].pop() for x, k in need for _ in range(k)])
    loose = [p for b in bins for p in b][::-1]  # short ones at the end, taken first for small gaps
    while open_ or loose:
        seq = open_.pop() if open_ else []
        room = window - sum(p[2] for p in seq)
        while room and (loose or open_):
            if not loose:
                loose = open_.pop(0)[::-1]
            i, s, n = loose.pop()
            if n > room:
                loose.append((i, s + room, n - room))
                n = room
            seq.append((i, s, n))
            room -= n
        if not room:
            out.append(seq)
            continue
        left = window - room  # the last one: split at the bits of its length
        while seq:
            size = 1 << (left.bit_length() - 1)
            part, got = [], 0
            while got < size:
                i, s, n = seq.pop(0)
                if n > size - got:
                    seq.insert(0, (i, s + size - got, n - size + got))
                    n = size - got
                part.append((i, s, n))
                got += n
            out.append(part)
            left -= size
    return out


@lru_cache(1)
def _combos() -> np.ndarray:
    return combos(GRID)


def pack_documents(docs: DataFrame, vocabulary: str, end: int = 2, window: int = 4096, chunk_tokens: int = CHUNK_TOKENS, remember: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids followed by ``end``; a null or empty text is that id alone. Chunks of the input's
    partitions are packed by themselves, so no token is shuffled and a task holds one chunk; pieces of a sequence stay
    in one chunk. Sequences are full windows, or powers of two at the end of a chunk. sequence_id is unique: the
    partition's number and a count within it. Repeated rows are packed as documents of their own. ``vocabulary`` is
    the file's path on every executor; without ``remember`` a worker forgets its pieces after a task. Extra columns are ignored; an empty table gives an empty result.
    """

    def rows(batches):
        from pyspark import TaskContext

        encode, next_id = encoder(vocabulary), TaskContext.get().partitionId() << 40
        tail = int(end).to_bytes(4, "little")
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush():
            nonlocal held, size, next_id
            cols: list[list[int]] = [[] for _ in range(7)]
            for seq in pack([len(x) // 4 for _, x in held], window):
                at = 0
                for i, s, n in seq:
                    d, x = held[i]
                    for c, v in zip(cols, (d, s, n, zlib.crc32(memoryview(x)[4 * s : 4 * (s + n)]), len(x) // 4, next_id, at), strict=True):
                        c.append(v)
                    at += n
                next_id += 1
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for ids, texts in _portions(batches):
            for d, x in zip(ids, encode(texts), strict=True):
                held.append((d, x + tail))
                size += len(x) // 4 + 1
                if size >= chunk_tokens:
                    yield flush()
        if held:
            yield flush()
        if not remember:
            encoder.cache_clear()

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _portions(batches):
    """(ids, texts) of about BATCH_CHARS characters."""
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for b in batches:
        for d, t in text_rows(b):
            ids.append(d)
            texts.append(t)
            size += len(t)
            if size >= BATCH_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts
