"""Spelling variants against brute force over every pair of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from sparkatlas.llm import spelling

COLUMNS = "doc_id long, text string, n long, word string, id int, form string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 7, "k", 1, "x") for i, t in rows], COLUMNS)


def apart_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, length=7, count=2, ratio=10, lost=31):
    n = Counter()
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if lost and h % lost == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= length and c >= count}
    near = {w: [x for x in n if apart_by_one(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def rows_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("letters", ["ab", "abcÀÿ÷", "aaaab"])
def test_variants_equal_brute_force(spark, letters):
    rng = random.Random(letters)
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 10))) for _ in range(150)]
    weights = [rng.choice([1, 1, 1, 3, 20, 300]) for _ in words]
    rows = [(i, " ".join(x.upper() if rng.random() < 0.1 and x.isascii() else x for x in rng.choices(words, weights, k=80))) for i in range(150)]
    rows += [(None, "abababab abababab, aaaaaaaa-aaaaaaaa"), (7, None), (8, ""), (9, " \n"), (3, rows[3][1]), (11, "bbbbbbb1bbbbbbb"), (12, "z" * 3000), (13, "z" * 3000 + " " + "z" * 2999), (14, "z" * 2999)]
    got, want = rows_of(spelling.spelling_variants(docs(spark, rows))), brute(rows)
    assert got == want and any(r[1] for r in got) and any(r[4] > 3 for r in got)


def test_chains_end_at_their_last_form(spark):
    counts = {"maximals": 2, "maximal": 20, "maxima": 9000, "maximaal": 200, "maximalls": 2, "mazimal": 3}
    rows = [(1, " ".join(f"{w} " * c for w, c in counts.items()))]
    got = {r.word: (r.form, r.root) for r in spelling.spelling_variants(docs(spark, rows), lost=None).collect()}
    assert got["maximals"] == ("maximal", "maximaal") and got["maximal"] == ("maximaal", "maximaal") and got["maximaal"] == (None, "maximaal") and got["maximalls"][0] is None
    assert rows_of(spelling.spelling_variants(docs(spark, rows), lost=None)) == brute(rows, lost=None)


def test_no_words(spark):
    assert spelling.spelling_variants(docs(spark, [])).count() == 0
    assert spelling.spelling_variants(docs(spark, [(1, None), (2, "short words only"), (3, "onceonly")])).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(docs(spark, []), ratio=1)


def test_words_of_one_text_are_counted_alike():
    assert sum(spelling.runs_of(5, "Wordings wordings WORDINGS short", 7, 31).values()) in (0, 3)
    of, depth, node, leaves = spelling.path_nodes(["abc", "ab", ""])
    assert of.tolist() == [0, 0, 0, 0, 1, 1, 1, 2] and depth.tolist() == [0, 1, 2, 3, 0, 1, 2, 0] and leaves.tolist() == [97, 98, 99, 0, 97, 98, 0, 0]
    assert node[0] == node[4] == node[7] and node[2] == node[6] and len(set(node.tolist())) == 4
