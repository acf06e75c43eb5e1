"""Toxicity: a Levenshtein automaton over a trie of learned terms, with scores of the words around a match."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .common import text_rows
from .labelled import SAMPLE_ROWS, remainder, training_sample

#: Words of context on either side, words remembered by a worker, edits allowed by word length.
CONTEXT, CACHE_WORDS, LONG_TERM = 6, 200_000, 8
_WORD = re.compile(r"[^\W_]+(?:[*@$][^\W_]+)*|[\"“”«»„]")
QUOTES = set("\"“”«»„")
# Words that report what others said.
REPORTING = frozenset("said says quote quoted quotes called reported wrote writes term word insult slur citing according".split())
EXACT, STEM, FUZZY = 1, 2, 3


class Automaton:
    """Deterministic automaton of the strings near a lexicon: Levenshtein automaton and trie walked together.

    A state is a set of (trie node, edits so far); states and their moves are made when first met and kept, so a word
    costs one table look-up a letter and most words stop at a dead state after a few.
    """

    def __init__(self, words: list[str], stems: list[str], states: int = 100_000):
        self.next: list[dict[str, int]] = [{}]
        self.word = [""]
        self.stem = [False]
        for kind, terms in ((False, words), (True, stems)):
            for w in terms:
                at = 0
                for c in w:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                        self.word.append("")
                        self.stem.append(False)
                    at = self.next[at][c]
                if kind:
                    self.stem[at] = True
                else:
                    self.word[at] = w
        self.room = [0] * len(self.next)  # edits that the longest word below a node allows
        for w in words:
            at, room = 0, 0 if len(w) < 5 else 2 if len(w) >= LONG_TERM else 1
            for c in ("", *w):
                at = self.next[at][c] if c else at
                self.room[at] = max(self.room[at], room)
        self.most = states
        self._reset()

    def _reset(self):
        self.ids: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.sets: list[dict[int, int]] = []
        self.ends: list[int] = []
        self.start = self._state(self._close({0: 0}))

    def _close(self, nodes: dict[int, int]) -> dict[int, int]:
        todo = list(nodes)
        while todo:
            at = todo.pop()
            for to in self.next[at].values():  # a letter of the term left out
                if nodes[at] + 1 <= self.room[to] and nodes[at] + 1 < nodes.get(to, 9):
                    nodes[to] = nodes[at] + 1
                    todo.append(to)
        return nodes

    def _state(self, nodes: dict[int, int]) -> int:
        key = frozenset(nodes.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(nodes)
            self.moves.append({})
            self.ends.append(min((self._end(n, e) for n, e in nodes.items()), default=0, key=lambda k: k or 9))
        return self.ids[key]

    def _end(self, node: int, edits: int) -> int:
        if edits == 0 and self.word[node]:
            return EXACT
        w = self.word[node]
        return FUZZY if w and edits <= (0 if len(w) < 5 else 2 if len(w) >= LONG_TERM else 1) else 0

    def _move(self, state: int, c: str) -> int:
        if len(self.sets) > self.most:
            raise OverflowError
        to: dict[int, int] = {}
        for n, e in self.sets[state].items():
            for d, m in self.next[n].items():
                cost = e + (c != d)
                if cost <= self.room[m] or cost == 0:
                    to[m] = min(cost, to.get(m, 9))
            if e + 1 <= self.room[n]:
                to[n] = min(e + 1, to.get(n, 9))
        got = self.moves[state][c] = self._state(self._close(to)) if to else -1
        return got

    def kind(self, word: str) -> int:
        """EXACT, STEM (a learned stem begins the word), FUZZY or 0."""
        at, node = self.start, 0
        stem = 0
        try:
            for c in word:
                if node >= 0:
                    node = self.next[node].get(c, -1)
                    stem = stem or (STEM if node >= 0 and self.stem[node] else 0)
                if at >= 0:
                    got = self.moves[at].get(c)
                    at = self._move(at, c) if got is None else got
                if at < 0 and (node < 0 or stem):
                    break
        except OverflowError:  # too many states at once: forget them and walk again
            self._reset()
            return self.kind(word)
        end = self.ends[at] if at >= 0 else 0
        return EXACT if end == EXACT else stem or end


class Matcher:
    """Features of a text: counts of matches by kind, how many stand in quotation, and the share of words that match."""

    NAMES = ("exact", "stem", "fuzzy", "abuse", "quoted", "share")

    def __init__(self, words: list[str], stems: list[str]):
        self.auto = Automaton(words, stems)
        self.held: dict[str, int] = {}

    def features(self, text: str) -> list[float]:
        tokens = _WORD.findall(text.lower())
        held = self.held
        try:
            kinds = [held[w] for w in tokens]
        except KeyError:
            if len(held) > CACHE_WORDS:
                held.clear()
            for w in set(tokens):
                if w not in held:
                    held[w] = 0 if w in QUOTES else self.auto.kind(w)
            kinds = [held[w] for w in tokens]
        count = [0, 0, 0, 0]
        abuse = quoted = 0.0
        if any(kinds):
            inside, open_ = [], False
            for w in tokens:
                if w in QUOTES:
                    open_ = not open_
                inside.append(open_)
            for i, kind in enumerate(kinds):
                if kind:
                    count[kind] += 1
                    near = tokens[max(0, i - CONTEXT) : i + CONTEXT + 1]
                    told = sum(w in REPORTING for w in near) / 2 + inside[i]
                    quoted += min(1.0, told)
                    abuse += 1 - min(1.0, told)
        return [*(float(np.log1p(c)) for c in count[1:]), float(np.log1p(abuse)), float(np.log1p(quoted)), min(1.0, 20 * (abuse + 0.2 * quoted) / (len(tokens) + 20))]


def learn_terms(sample: DataFrame, least: int = 6, precision: float = 0.9) -> tuple[list[str], list[str]]:
    """(words, stems) of toxic training documents: in at least ``least`` of them and, smoothed, precise enough.

    A stem is a beginning of four letters or more that several words share; of nested stems the shortest is kept. All
    terms that qualify are learned; the sample's size bounds them.
    """

    def rows(batches):
        seen: dict[str, list[int]] = {}
        for b in batches:
            for y, t in zip(b.column("y").to_pylist(), b.column("text").to_pylist(), strict=True):
                terms = {w for w in _WORD.findall(t.lower()) if len(w) >= 4}
                if y:
                    tops = {"^" + w[:n] for w in terms for n in range(4, min(9, len(w)))}
                    for x in terms | tops:
                        seen.setdefault(x, [0, 0])[0] += 1
                else:
                    for x in terms | {"^" + w[:n] for w in terms for n in range(4, min(9, len(w)))}:
                        seen.setdefault(x, [0, 0])[1] += 1
        if seen:
            yield pa.RecordBatch.from_pydict({"term": pa.array(list(seen), pa.string()), "bad": pa.array([v[0] for v in seen.values()], pa.int64()), "good": pa.array([v[1] for v in seen.values()], pa.int64())})

    got = sample.select("text", "y").mapInArrow(rows, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    rate = (F.col("bad") + 0.5) / (F.col("bad") + 3 * F.col("good") + 1)
    top = got.where((F.col("bad") >= least) & (rate >= precision)).orderBy(F.desc(F.col("bad") * rate), "term").collect()
    words = [r.term for r in top if not r.term.startswith("^")]
    bad = {r.term: r.bad for r in top}
    below = Counter(w[:n] for w in words for n in range(4, len(w)))
    stems: list[str] = []
    for s in sorted((r.term[1:] for r in top if r.term.startswith("^")), key=lambda s: (len(s), s)):
        own = max((bad["" + w] for w in words if w.startswith(s)), default=0)
        if not any(s.startswith(x) for x in stems) and (below[s] >= 2 or bad["^" + s] > 1.5 * own):
            stems.append(s)
    return words, stems


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights, the constant last, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w)) * 0.1
        w -= np.linalg.solve(hess, x.T @ (p - y) / len(x) + 0.1 * ridge * w)
    return w


class Model:
    def __init__(self, words: list[str], stems: list[str], weights: np.ndarray):
        self.words, self.stems, self.weights = words, stems, weights

    def scorer(self):
        m, w = Matcher(self.words, self.stems), self.weights
        return lambda text: float(1 / (1 + np.exp(-np.clip(np.dot(m.features(text), w[:-1]) + w[-1], -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, rows: int = SAMPLE_ROWS) -> Model:
    """Learns terms and weights from at most ``rows`` labelled documents that aren't held out.

    Without any labelled document, or with one class only, the score is that class's share (next to 0 if none).
    """
    sample = training_sample(docs, labels, "toxic", modulus, held_out, rows)
    words, stems = learn_terms(sample)

    def featured(batches):
        m = Matcher(words, stems)
        for b in batches:
            ys, ts = b.column("y").to_pylist(), b.column("text").to_pylist()
            yield pa.RecordBatch.from_pydict({"x": pa.array([m.features(t) for t in ts], pa.list_(pa.float64())), "y": pa.array(ys, pa.int32())})

    got = sample.select("text", "y").mapInArrow(featured, "x array<double>, y int").collect()
    y = np.array([r.y for r in got], float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.0) / max(1, len(y))
        return Model([], [], np.array([0.0] * len(Matcher.NAMES) + [30.0 * (2 * share - 1)]))
    return Model(words, stems, logistic(np.array([r.x for r in got]), y))


def score_documents(docs: DataFrame, model: Model, modulus: int = 4, held_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; null and empty texts get the score of no match.

    Equal texts score alike and every row is scored by itself, so repeated rows give a row each; a null doc_id is not
    held out. Extra columns are ignored, whatever their names; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        score = sent.value.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([score(t) for _, t in text_rows(b)], pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), modulus) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay, whatever their names.

    Null and empty texts score as texts without a match. Rows are judged one by one, repeated ones alike; an empty
    table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        score = sent.value.scorer()
        for b in batches:
            yield b.filter(pa.array([score(t) < threshold for _, t in text_rows(b)], pa.bool_()))

    return docs.mapInArrow(rows, S.StructType(docs.schema.fields))
