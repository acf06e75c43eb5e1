"""LM scoring: a weighted backoff automaton of smoothed n-grams, traversed once from left to right.

The model is P(w | u) = (c(uw) + m P(w | u')) / (c(u) + m), u' being u without its first word, down to the empty state's
(c(w) + 1) / (N + V + 1). As an automaton: a state is an n-gram seen in training, an arc (state, word) holds the
probability where uw was seen, and a state's failure arc holds m / (c(u) + m) and leads to u'. So the model needs the
training counts of n-grams and nothing else.

A model of the whole corpus fits no executor. Texts are gathered into buckets of bounded size; a bucket sends the n-grams
that its texts hold, with their own counts, to shards by hash range; a shard adds up and answers every bucket with the
totals of just these n-grams; a bucket builds the part of the automaton that its texts can reach and traverses it. That
is exact, both shuffles are dealt by hash ranges and buckets, and no word, however frequent, is more than one key a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import slices
from .labelled import remainder_of

#: Longest n-gram (4 at most), weight of the lower order, bytes of text of a bucket and of a shard's share, lanes of a traversal.
ORDER, WEIGHT, BUCKET_BYTES, SHARD_BYTES, LANES = 2, 128.0, 6_000_000, 12_000_000, 4096
#: Hashes of the marks around a text. A key's two lowest bits tell its order, the others are a hash.
BEGIN, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x94D049BB133111EB)
_LOW = np.uint64(3)
#: Rows on the way to the shards: a bucket's keys of a shard with their counts, or (``at`` below 0) the bucket's own texts.
PACKED = "at long, bucket long, keys binary, counts binary, ids binary, held binary, lengths binary, words binary"


def planes(a: np.ndarray) -> bytes:
    """An array's bytes, plane by plane: numbers that are small or often the same take less than a byte each."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T), 1) if len(a) else b""


def unplanes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel() if data else np.zeros(0, kind)


def steps(a: np.ndarray) -> bytes:
    """Hashes as differences, small where they ascend; these wrap around, so any order is kept."""
    return planes(np.diff(a, prepend=a.dtype.type(0)))


def unsteps(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, np.uint64), dtype=np.uint64)


def counted(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and how often each occurs; by a sort, which is faster for hashes than np.unique."""
    a = np.sort(a)
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    return a[first], np.diff(first, append=len(a))


def ranked(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and the rank of every element's value."""
    order = np.argsort(a)
    a = a[order]
    new = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)
    rank = np.empty(len(a), np.int64)
    rank[order] = np.cumsum(new) - 1
    return a[new], rank


def stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of many texts with their marks, and the tokens of each text, both marks included."""
    data = [T.encode(t) for t in texts]
    ends = np.cumsum([len(d) + 1 for d in data])
    h, start, _ = T.words(b"\n".join(data))
    of = np.searchsorted(ends, start, side="right")
    lengths = np.bincount(of, minlength=len(data)).astype(np.int64) + 2
    out = np.empty(int(lengths.sum()), np.uint64)
    first = np.cumsum(lengths) - lengths
    out[first], out[first + lengths - 1] = BEGIN, END
    out[np.arange(len(h)) + 1 + 2 * of] = h
    return out, lengths


def grams(h: np.ndarray, back: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 to ``order`` the key of the n-gram that ends at each token; 0 where that would begin in another text."""
    out = []
    for n in range(1, order + 1):
        key = np.zeros(len(h), np.uint64)
        if len(h) >= n:
            key[n - 1 :] = (T.runs(h, n) & ~_LOW) | np.uint64(n - 1)
        key[back < n - 1] = 0
        out.append(key)
    return out


def places(lengths: np.ndarray) -> np.ndarray:
    """Of every token the number of tokens before it in its text."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


BEGIN_KEY = (T.runs(np.array([BEGIN]), 1)[0] & ~_LOW) | np.uint64(0)


class Bucket:
    """Texts on their way into a bucket, as word hashes."""

    def __init__(self, order: int, shards: int, modulus: int, held_out: int):
        self.order, self.shards, self.modulus, self.held_out = order, shards, modulus, held_out
        self.clear()

    def clear(self) -> None:
        self.ids, self.held, self.hashes, self.lengths, self.size = [], [], [], [], 0

    def add(self, ids: list, texts: list[str]) -> None:
        h, lengths = stream(texts)
        self.ids += ids
        self.held += [i is not None and remainder_of(i, self.modulus) == self.held_out for i in ids]
        self.hashes.append(h)
        self.lengths.append(lengths)
        self.size += sum(map(len, texts))

    def requests(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, lengths, distinct keys, their counts in the texts that aren't held out)."""
        h, lengths = np.concatenate(self.hashes), np.concatenate(self.lengths)
        back = places(lengths)
        learn = np.repeat(~np.array(self.held, bool), lengths)
        got = grams(h, back, self.order)
        mine, count = counted(np.concatenate([k[learn & (k > 0)] for k in got]))
        keys, _ = counted(np.concatenate([mine, *(k[~learn & (k > 0)] for k in got)]))
        counts = np.zeros(len(keys), np.int64)
        counts[np.searchsorted(keys, mine)] = count
        return h, lengths, keys, counts

    def rows(self, name: int, texts: bool) -> pa.RecordBatch:
        h, lengths, keys, counts = self.requests()
        width = np.uint64(((1 << 64) - 1) // self.shards + 1)  # at least two shards
        of = (keys // width).astype(np.int64)
        ends = np.searchsorted(of, np.arange(self.shards + 1))
        out: dict[str, list] = {c.split()[0]: [] for c in PACKED.split(", ")}
        for s in np.flatnonzero(np.diff(ends)).tolist():
            a, b = ends[s], ends[s + 1]
            row = {"at": s, "bucket": name, "keys": steps(keys[a:b]), "counts": planes(counts[a:b])}
            for c, v in out.items():
                v.append(row.get(c))
        if texts:
            words, inverse = ranked(h)
            often = np.argsort(-np.bincount(inverse), kind="stable")  # frequent words get small numbers; ties ascend by hash
            number = np.empty(len(words), np.int32)
            number[often] = np.arange(len(words), dtype=np.int32)
            ids = pa.array(self.ids, pa.int64())
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("id", pa.int64())])) as w:
                w.write_batch(pa.record_batch([ids], names=["id"]))
            row = {"at": -1 - name, "bucket": name, "ids": sink.getvalue().to_pybytes(), "held": np.array(self.held, np.uint8).tobytes(), "lengths": planes(lengths), "words": planes(number[inverse]), "keys": steps(words[often])}
            for c, v in out.items():
                v.append(row.get(c))
        return pa.RecordBatch.from_arrays([pa.array(out["at"], pa.int64()), pa.array(out["bucket"], pa.int64()), *(pa.array(out[c], pa.binary()) for c in ("keys", "counts", "ids", "held", "lengths", "words"))], names=list(out))


def pack(docs: DataFrame, order: int, shards: int, modulus: int, held_out: int, texts: bool) -> DataFrame:
    """PACKED rows of ``docs``. A task's texts fill its buckets in their order, so ``docs`` must be a table or written first."""

    def rows(batches):
        bucket, n, task = Bucket(order, shards, modulus, held_out), 0, TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, 1_000_000):
                bucket.add(part.column("doc_id").to_pylist(), [t or "" for t in part.column("text").to_pylist()])
                if bucket.size >= BUCKET_BYTES:
                    yield bucket.rows(task << 24 | n, texts)
                    bucket.clear()
                    n += 1
        if bucket.ids:
            yield bucket.rows(task << 24 | n, texts)

    return docs.select("doc_id", "text").mapInArrow(rows, PACKED)


def totals(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every row of one shard its keys and their counts over all rows."""
    each = [unsteps(k) for k in table.column("keys").to_pylist()]
    counts = [unplanes(c, np.int64) for c in table.column("counts").to_pylist()]
    keys, inverse = ranked(np.concatenate(each))
    summed = np.bincount(inverse, np.concatenate(counts), len(keys)).astype(np.int64)  # exact below 2 to the 53rd
    ends = np.cumsum([0, *map(len, each)])
    return [(k, summed[inverse[a:b]]) for k, a, b in zip(each, ends[:-1], ends[1:], strict=True)]


def corpus_size(docs: DataFrame, shards: int, modulus: int, held_out: int) -> tuple[int, int]:
    """(N, V): tokens and distinct tokens of the texts that aren't held out, ends counted."""

    def count(table: pa.Table) -> pa.Table:
        keys, counts = (np.concatenate(x) for x in zip(*totals(table), strict=True))
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        counts = counts[np.concatenate([[True], keys[1:] != keys[:-1]]) & (keys != BEGIN_KEY)]
        return pa.table({"n": pa.array([int(counts.sum())], pa.int64()), "v": pa.array([int((counts > 0).sum())], pa.int64())})

    got = pack(docs, 1, shards, modulus, held_out, False).groupBy("at").applyInArrow(count, "n long, v long").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    return got.n or 0, got.v or 0


class Automaton:
    """The states and arcs that a bucket's tokens reach. Arcs are numbered as their keys; ``at[n - 1][p]`` is the arc of the
    n-gram that ends at token p. State 0 is the empty one, state 1 + a the n-gram of arc a."""

    def __init__(self, h: np.ndarray, lengths: np.ndarray, counts: np.ndarray, order: int, tokens: int, kinds: int, weight: float):
        self.order, self.back, self.counts = order, places(lengths), counts
        keys = np.concatenate(grams(h, self.back, order))
        found, rank = ranked(keys)
        if len(found) and found[0] == 0:  # ends of texts' first words have no n-gram: the number past the last arc
            rank[rank == 0] = len(found)
            rank -= 1
        self.at = np.split(rank, order)
        n = len(counts) + 1
        self.arc = np.full(n, np.log10(1 / (tokens + kinds + 1)))  # log10 of an arc's probability
        self.fail, self.cost = np.zeros(n + 1, np.int64), np.zeros(n + 1)  # of state s: where it fails to, log10 of the weight
        seen = np.append(counts, 0)
        p = np.zeros(n)
        p[:-1] = (counts + 1) / (tokens + kinds + 1)
        one = np.zeros(n, np.int64)  # a token that ends the n-gram of each arc
        for k, at in enumerate(self.at):
            one[at] = np.arange(len(at))
            own = np.zeros(n, bool)
            own[at] = k > 0
            arcs = np.flatnonzero(own[:-1])
            ends = one[arcs]
            context, shorter = self.at[k - 1][ends - 1], self.at[k - 1][ends]
            p[arcs] = (seen[arcs] + weight * p[shorter]) / (seen[context] + weight)
            self.fail[1 + arcs] = 1 + shorter
        self.arc[:-1] = np.log10(p[:-1])
        self.cost[1:] = np.log10(weight / (seen + weight))
        self.seen = seen > 0

    def traverse(self) -> np.ndarray:
        """log10 probability of every token, 0 for begin marks.

        Lanes of equal length are read in step, each from left to right with a state of its own. A lane starts ``order``
        tokens early with the empty state; by its first own token it is in the state that the whole text leads to.
        """
        size, n = len(self.back), self.order
        step = max(1, -(-size // LANES))
        starts = np.arange(0, size, step)
        out = np.zeros(size)
        state, depth = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)  # depth: words of the state's n-gram
        for t in range(-n, step):
            p = starts + t
            on = np.flatnonzero((p >= 0) & (p < size))
            q, s, d = p[on], state[on], depth[on]
            mark = self.back[q] == 0
            s[mark], d[mark] = 0, 0
            total, open_ = np.zeros(len(on)), ~mark
            taken = np.zeros(len(on), np.int64)
            for k in range(n - 1, 0, -1):  # arcs of states of k words; a missing one fails to a state of fewer
                here = np.flatnonzero(open_ & (d == k))
                arc = self.at[k][q[here]]
                hit = self.seen[arc]
                total[here[hit]] += self.arc[arc[hit]]
                taken[here[hit]], open_[here[hit]] = k + 1, False
                miss = here[~hit]
                total[miss] += self.cost[s[miss]]
                s[miss] = self.fail[s[miss]]
                d[miss] = k - 1
            root = np.flatnonzero(open_)
            total[root] += self.arc[self.at[0][q[root]]]
            taken[root] = self.seen[self.at[0][q[root]]]
            taken[mark] = self.seen[self.at[0][q[mark]]]
            d = np.minimum(taken, n - 1)  # an n-gram of full length is no state: its last n - 1 words are
            for k in range(n - 1):
                at = np.flatnonzero(d == k + 1)
                s[at] = 1 + self.at[k][q[at]]
            s[d == 0] = 0
            state[on], depth[on] = s, d
            if t >= 0:
                out[q] = total
        return out


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score_documents(docs: DataFrame, order: int = ORDER, weight: float = WEIGHT, modulus: int = 7, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Learns from the rows whose crc32 of doc_id, modulo ``modulus``, isn't ``held_out``; a null doc_id is not held out. A
    null text counts as empty: one token, the end. Every row is a text of its own, repeated ones too, in training and in
    the result. Without training rows every token has probability 1. Extra columns are ignored, whatever their names; an
    empty table gives an empty result. ``docs`` must be a table or written first: a task that is run again must see
    the same rows in the same order. A bucket holds one text at least, so the longest text bounds a task's memory.
    """
    if not 1 <= order <= 4:
        raise ValueError("order must be 1 to 4")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    shards = max(64, -(-size // SHARD_BYTES))
    tokens, kinds = corpus_size(docs, shards, modulus, held_out)

    def answer(table: pa.Table) -> pa.Table:
        if table.column("at")[0].as_py() < 0:
            return table
        replies = [planes(c) for _, c in totals(table)]
        return table.set_column(table.schema.get_field_index("counts"), "counts", pa.array(replies, pa.binary())).set_column(table.schema.get_field_index("keys"), "keys", pa.nulls(len(replies), pa.binary()))

    def traverse(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["at"])
        own, replies = rows[0], rows[1:]
        h = unsteps(own["keys"])[unplanes(own["words"], np.int32)]
        lengths, held = unplanes(own["lengths"], np.int64), np.frombuffer(own["held"], np.uint8).astype(bool)
        counts = np.concatenate([unplanes(r["counts"], np.int64) for r in replies])
        machine = Automaton(h, lengths, counts, order, tokens, kinds, weight)
        first = np.cumsum(lengths) - lengths
        plain = np.where(machine.back > 0, np.append(counts, 0)[machine.at[0]], -1)
        base = np.where(plain >= 0, np.log10((np.maximum(plain, 0) + 1) / (tokens + kinds + 1)), 0.0)
        with pa.ipc.open_stream(own["ids"]) as r:
            ids = r.read_all().column("id")
        columns = [ids, pa.array(held), pa.array(lengths - 1), pa.array(np.add.reduceat((plain > 0).astype(np.int64), first)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(machine.traverse(), first))]
        return pa.table(columns, names=[c.split()[0] for c in SCORED.split(", ")])

    packed = pack(docs, order, shards, modulus, held_out, True)
    scored = packed.groupBy("at").applyInArrow(answer, PACKED).groupBy("bucket").applyInArrow(traverse, SCORED)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
