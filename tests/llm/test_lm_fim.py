"""LM scoring against brute force and sums of probabilities; fill-in-middle against plain slicing and a round trip."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkatlas.llm import fim, lm_score

COLUMNS = "doc_id long, text string, n long, score double, form string, bucket int"
ODD = [None, "", "  \n\t ", "one", "ONE", "x " * 30_000, "a\n" * 50, "Ünï çödé 😀 é   x\x0by", "hold <P> it", "<S", "a<P"]


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 7, 2.0, "k", 1) for i, t in zip(ids or range(len(texts)), texts, strict=True)], COLUMNS)


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "Alpha", "beta", "gamma", "delta"]) + rng.choice(["", "", "1", "2"]) for _ in range(n))


def model(rows, order, weight):
    """(probability of a word after a context, N, V, count of a word) of the rows that aren't held out, by definition."""
    counts, tokens = Counter(), Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            w = ["<begin>", *words(t), "<end>"]
            tokens.update(w[1:])
            counts.update(tuple(w[a : a + n]) for n in range(1, order + 1) for a in range(len(w) - n + 1))
    n, v = sum(tokens.values()), len(tokens)

    def p(context, w):
        context = context[-(order - 1) :] if order > 1 else ()
        if not context:
            return (tokens[w] + 1) / (n + v + 1)
        return (counts[(*context, w)] + weight * p(context[1:], w)) / (counts[context] + weight)

    return p, n, v, tokens


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_brute_force(spark, order, monkeypatch):
    monkeypatch.setattr(lm_score, "BUCKET_BYTES", 3000)
    rng = random.Random(order)
    texts = [*ODD, *(prose(rng, rng.randrange(1, 60)) for _ in range(60)), *["copy of one text"] * 9]
    ids = [None, *range(1, len(texts))]
    ids[40] = 39
    rows = list(zip(ids, texts, strict=True))
    p, n, v, tokens = model(rows, order, 128.0)
    got = lm_score.score_documents(docs(spark, texts, ids), order).collect()
    want = []
    for i, t in rows:
        w = [*words(t), "<end>"]
        s = sum(math.log10(p(("<begin>", *w[:k]), w[k])) for k in range(len(w)))
        want.append((i or -1, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(tokens[x] > 0 for x in w), n, round(sum(math.log10((tokens[x] + 1) / (n + v + 1)) for x in w), 4), round(s, 4)))
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in got) == sorted(want)
    assert any(r.held_out for r in got)


def test_probabilities_of_a_state_sum_to_one(spark):
    rng = random.Random(8)
    train = [(i, prose(rng, 40)) for i in range(30) if zlib.crc32(str(i).encode()) % 7 != 2]
    every = sorted({w for _, t in train for w in words(t)})
    held = [i for i in range(1000, 3000) if zlib.crc32(str(i).encode()) % 7 == 2]
    asked = [f"the of {w}" for w in every] + ["the of neverseen", "the of"]
    both = [*train, *zip(held, asked, strict=False), (held[len(asked)], "the")]
    got = {r.doc_id: r for r in lm_score.score_documents(docs(spark, [t for _, t in both], [i for i, _ in both])).collect()}
    p, *_ = model(train, 2, 128.0)
    start = math.log10(p(("<begin>",), "the") * p(("the",), "of"))
    after = [10 ** (got[i].score - start) / (p((w,), "<end>") if w else 1) for i, w in zip(held, [*every, "neverseen", None], strict=False)]
    assert abs(sum(after) - 1) < 1e-9


def test_scores_without_training_rows(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = lm_score.score_documents(docs(spark, ["a b", None, "c"], held)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [(1, 0, 0, 0.0, 0.0), (2, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]
    assert lm_score.score_documents(docs(spark, [])).count() == 0


def test_lanes_and_planes():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(1, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (lm_score.unsteps(lm_score.steps(keys)) == keys).all() and len(lm_score.unsteps(b"")) == 0
    h, lengths = lm_score.stream(["a B", "", " c\n"])
    assert lengths.tolist() == [4, 2, 3] and h[1] != h[2] and (h[[0, 4, 6]] == lm_score.BEGIN).all() and (h[[3, 5, 8]] == lm_score.END).all()


def test_fim_equals_slicing(spark):
    rng = random.Random(2)
    texts = [*ODD, *("".join(rng.choice("aé😀 \n中") for _ in range(rng.randrange(1, 90))) for _ in range(80)), "é" * 70_000, "same", "same"]
    ids = [None, *range(1, len(texts) - 1), len(texts) - 2]
    table = docs(spark, texts, ids)
    made = fim.transform(table)
    assert made.columns == ["doc_id", "text", "score", "bucket", "n", "form", "prefix_units", "middle_units", "output"]
    got = made.withColumn("back", fim.restored(made.output, made.form)).collect()
    forms = Counter()
    for r, (i, t) in zip(sorted(got, key=lambda r: (r.doc_id or 0, r.text or "")), sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] or 0, x[1] or "")), strict=True):
        t = t or ""
        h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
        a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
        form = "plain" if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
        output = {"plain": t, "psm": f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", "spm": f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"}[form]
        assert (r.n, r.form, r.output, r.back) == (len(t), form, output, t)
        assert (r.prefix_units, r.middle_units) == ((None, None) if form == "plain" else (a, b - a))
        forms[form] += 1
    assert len(forms) == 3 and fim.transform(table.limit(0)).count() == 0


def test_chunks_count_units_across_their_edges():
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(" a\né😀b") for _ in range(rng.randrange(0, 40)))
        data = text.encode()
        starts = {"char": [len(text[:i].encode()) for i in range(len(text))], "word": [m.start() for m in re.finditer(rb"(?<![^\x20\t-\r])[^\x20\t-\r]+", data)], "line": [m.end() for m in re.finditer(rb"\A|\n(?=[\s\S])", data)] if data else []}
        for unit, want in starts.items():
            for size in (1, 2, 7, 100):
                chunks = fim.Chunks(data, unit, size)
                assert chunks.n == len(want) and [chunks.offset(k) for k in range(1, len(want))] == want[1:]
                assert chunks.offset(0) == 0 and chunks.offset(chunks.n) == (len(data) if want else 0)
