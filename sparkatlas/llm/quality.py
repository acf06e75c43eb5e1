"""Quality: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_rows
from .labelled import SAMPLE_ROWS, remainder, training_sample

#: Fourier features, bins of raw scores for the calibration, and the seed of the random directions.
FEATURES, CALIBRATION_BINS, SEED = 192, 400, 7
_CLASSES = np.zeros(256, np.int64)
for _chars, _kind in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b".,;:?'\"()-", 4), (b"!", 5), (b"#$%&*@^~+=<>", 6), (b"|_\\/[]{}", 7), (b" \t\r\n\x0b\x0c", 8)):
    _CLASSES[list(_chars)] = _kind
_CLASSES[128:] = 9
_LINK = re.compile(r"https?://|www\.|\S+@\S+\.\w")
N_STATS = 24


def statistics(text: str) -> list[float]:
    """Bounded statistics of a text: shares of characters, words, lines and repetition."""
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    if not n:
        return [0.0] * N_STATS
    c = np.bincount(_CLASSES[np.frombuffer(data, np.uint8)], minlength=10) / n
    words = text.split()
    m = len(words)
    if not m:
        return [*c.tolist(), *[0.0] * (N_STATS - 10)]
    count = Counter(words)
    top = count.most_common(3)
    lines = [x for x in text.split("\n") if x.strip()]
    twice = m - len(set(zip(words, words[1:], strict=False))) - 1 if m > 1 else 0
    upper = sum(w.isupper() and len(w) > 1 for w in words) / m
    mean = sum(map(len, words)) / m
    ends = sum(x.rstrip()[-1] in ".!?\"”»" for x in lines) / max(1, len(lines))
    return [
        *c.tolist(), np.log1p(m) / 10, len(count) / m, top[0][1] / m, sum(x[1] for x in top) / m, max(0, twice) / m, upper, min(mean, 40) / 10,
        min(1.0, len(set(lines)) / max(1, len(lines))), np.log1p(m / max(1, len(lines))) / 6, ends, min(1.0, 10 * len(_LINK.findall(text)) / m),
        sum(len(w) == 1 for w in words) / m, sum(w[-1] in "#$%&*!" for w in words) / m, sum(w == "|" for w in words) / m,
    ]


class Model:
    def __init__(self, mean, scale, w, b, beta, cuts, values):
        self.mean, self.scale, self.w, self.b, self.beta, self.cuts, self.values = mean, scale, w, b, beta, cuts, values

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), z / 6, np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.cuts, self.values) if len(x) else np.zeros(0)


class Constant:
    """The model of labels that are all alike: their share of ones for every text."""

    def __init__(self, share: float):
        self.share = share

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing values nearest to ``y`` under ``weight``: adjacent violators are pooled."""
    blocks: list[list[float]] = []
    for v, w in zip(y.tolist(), weight.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else y


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.array([statistics(t) for t in batch.column("text").to_pylist()], float).reshape(-1, N_STATS)
    return x, batch.column("y").to_numpy().astype(float), batch.column("part").to_numpy()


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, rows: int = SAMPLE_ROWS, ridge: float = 1e-3) -> Model | Constant | None:
    """Fits on at most ``rows`` labelled documents that aren't held out: four fifths for the ridge, one for calibration.

    Each partition sums its moments, its normal equations and its calibration bins; sums are of fixed size. Labels of
    one class alone give that class's share, 0 or 1, for all; None without labelled documents.
    """
    sample = training_sample(docs, labels, "quality", modulus, held_out, rows).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(5)).cast("int")).select("text", "y", "part")

    def summed(make, size: int) -> np.ndarray:
        """Sum over all batches of ``make(x, y, part)``, a vector of ``size``: first in every partition, then in eight."""

        def partial(batches):
            got = np.zeros(size)
            for b in batches:
                if b.num_rows:
                    got += make(*_matrix(b))
            yield pa.RecordBatch.from_pydict({"s": pa.array([got.tobytes()], pa.binary())})

        def add(batches):
            got = np.zeros(size)
            for b in batches:
                for s in b.column("s").to_pylist():
                    got += np.frombuffer(s)
            yield pa.RecordBatch.from_pydict({"s": pa.array([got.tobytes()], pa.binary())})

        out = sample.mapInArrow(partial, "s binary").repartition(8).mapInArrow(add, "s binary").collect()
        return sum((np.frombuffer(r.s) for r in out), np.zeros(size))

    d = N_STATS
    m = summed(lambda x, y, part: np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)]), 2 + 2 * d)
    if not m[0]:
        return None
    if m[1] in (0, m[0]):
        return Constant(float(m[1] / m[0]))
    mean = m[2 : 2 + d] / m[0]
    scale = np.sqrt(np.maximum(m[2 + d :] / m[0] - mean**2, 0)) + 1e-3
    rng = np.random.default_rng(SEED)
    model = Model(mean, scale, rng.normal(0, 1 / np.sqrt(d) * 1.2, (d, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), None, None, None)
    p = FEATURES + d + 1

    def normal(x, y, part):
        use = part != 0
        z = model.fourier(x[use])
        return np.concatenate([(z.T @ z).ravel(), z.T @ y[use]])

    s = summed(normal, p * p + p)
    model.beta = np.linalg.solve(s[: p * p].reshape(p, p) + ridge * m[0] / 100 * np.eye(p), s[p * p :])
    grid = np.linspace(-0.5, 1.5, CALIBRATION_BINS + 1)

    def bins(x, y, part):
        use = part == 0
        at = np.clip(np.searchsorted(grid, model.raw(x[use])) - 1, 0, CALIBRATION_BINS - 1)
        return np.concatenate([np.bincount(at, minlength=CALIBRATION_BINS), np.bincount(at, y[use], CALIBRATION_BINS)])

    s = summed(bins, 2 * CALIBRATION_BINS)
    n, good = s[:CALIBRATION_BINS], s[CALIBRATION_BINS:]
    has = n > 0
    if not has.any():
        model.cuts, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        return model
    share = m[1] / m[0]
    flat = isotonic((good[has] + share) / (n[has] + 1), n[has])
    middle = ((grid[:-1] + grid[1:]) / 2)[has]
    # a slight slope keeps raw order among equal calibrated scores
    model.cuts, model.values = middle, np.clip(flat * 0.998 + 0.002 * np.clip(middle, 0, 1), 0, 1)
    return model


def score_documents(docs: DataFrame, model: Model | Constant | None, modulus: int = 5, held_out: int = 0, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; a null text counts as empty. Without a model the score is 0.

    Equal texts score alike and every row is scored by itself, so repeated rows give a row each; a null doc_id is not
    held out. Extra columns are ignored, whatever their names; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        model = sent.value
        for b in batches:
            x = np.array([statistics(t) for _, t in text_rows(b)], float).reshape(-1, N_STATS)
            score = model.score(x) if model else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), modulus) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
