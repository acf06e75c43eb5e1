"""License scan: normalised text against licence templates by Dice coefficient over word bigrams."""

from __future__ import annotations

import bisect
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as T
from .common import text_rows

# Licence notices in common use, as published by their authors.
TEMPLATES = {
    "agpl-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd": "Released under the BSD License.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-sa-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "Licensed under CC0 1.0.",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "epl-1.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0",
    "isc": "Released under the ISC License.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "lgpl-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1",
}
#: Whole texts, named "...-text"; that of the ISC, MIT, BSD and public-domain ones is all of the licence below its copyright line.
TEMPLATES |= {f"{p.stem}-text": p.read_text() for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}

#: ASCII punctuation becomes white space before words are taken; A-Z is lower-cased.
_PLAIN = bytes(32 if 32 < i < 127 and not chr(i).isalnum() else i for i in range(256))


def normalise(text: str) -> bytes:
    return T.encode(text).translate(_PLAIN)


def bigrams(h: np.ndarray) -> np.ndarray:
    return T.shingles(h, 2)


def dice(a: np.ndarray, b: np.ndarray) -> float:
    """2 |a and b| / (|a| + |b|) over distinct bigrams; 0 if both are empty."""
    a, b = np.unique(a), np.unique(b)
    return 2 * T.overlap(a, b) / (len(a) + len(b)) if len(a) + len(b) else 0.0


def window_scores(g: np.ndarray, own: np.ndarray, size: int, template: int) -> np.ndarray:
    """Dice coefficient of the distinct bigrams of every window of ``size`` places of ``g`` with a template of ``template``
    distinct ones, ``own`` telling which of ``g`` it holds.

    A place counts in the windows from after its bigram's place before up to itself, so that each window's distinct
    bigrams are a running sum of steps: the cost is that of the text, not of its windows.
    """
    n = len(g)
    order = np.argsort(g, kind="stable")
    before = np.full(n, -1)
    again = g[order[1:]] == g[order[:-1]]
    before[order[1:][again]] = order[:-1][again]
    at = np.arange(n)
    first = np.maximum(np.maximum(before + 1, at - size + 1), 0)
    last = max(1, n - size + 1)

    def windows(use: np.ndarray) -> np.ndarray:
        steps = np.bincount(np.minimum(first[use], last), minlength=last + 1) - np.bincount(np.minimum(at[use] + 1, last), minlength=last + 1)
        return np.cumsum(steps)[:last]

    return 2 * windows(own) / (windows(np.ones(n, bool)) + template)


def apart(starts: np.ndarray, scores: np.ndarray, size: int) -> list[int]:
    """Starts of windows of ``size`` that don't overlap: the best first, of equal ones the first."""
    taken: list[int] = []
    for s in starts[np.lexsort((starts, -scores))].tolist():
        k = bisect.bisect_left(taken, s)
        if (k == 0 or s - taken[k - 1] >= size) and (k == len(taken) or taken[k] - s >= size):
            taken.insert(k, s)
    return taken


def scanner(templates: dict[str, str], least: float):
    """text -> (license, score, start word, words) of its passages."""
    known = []
    for name, t in sorted(templates.items()):
        h = T.words(normalise(t))[0]
        known.append((name, len(h), np.unique(bigrams(h))))
    pool = np.unique(np.concatenate([b for _, _, b in known])) if known else np.zeros(0, np.uint64)
    # the templates of each bigram of the pool, one after the other
    of = np.repeat(np.arange(len(known)), [len(b) for _, _, b in known])
    places = np.searchsorted(pool, np.concatenate([b for _, _, b in known])) if known else np.zeros(0, np.int64)
    members, ends = of[np.argsort(places, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(places, minlength=len(pool)))])
    needs = np.array([max(1, int(np.ceil(least * len(b) / 2 - 1e-9))) for _, _, b in known], np.int64)  # 2 a / (a + b) reaches least with as many at the least

    def scan(text: str) -> list[tuple[str, float, int, int]]:
        h = T.words(normalise(text))[0]
        if not len(h) or not len(pool):
            return []
        g = bigrams(h)
        at = np.searchsorted(pool, g)
        at[at == len(pool)] = 0
        hits = np.flatnonzero(pool[at] == g)
        if not len(hits):
            return []
        at, first = at[hits], ends[at[hits]]
        many = ends[at + 1] - first
        held = members[np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)]  # the templates of every hit
        spots = np.repeat(hits, many)
        found = []
        for k in np.flatnonzero(np.bincount(held, minlength=len(known)) >= needs).tolist():
            name, m, b = known[k]
            if not len(b) or 2 * len(g) < least * (len(g) + len(b)) and len(g) < len(b):  # distinct ones may be fewer than words
                continue
            own, need = spots[held == k], int(needs[k])
            size = max(1, min(m, len(h)) - 1)
            if not (own[need - 1 :] - own[: len(own) - need + 1] < size).any():
                continue
            lo, hi = max(0, int(own[0]) - size + 1), min(len(g), int(own[-1]) + size)
            mine = np.zeros(hi - lo, bool)
            mine[own - lo] = True
            scores = window_scores(g[lo:hi], mine, size, len(b))
            good = np.flatnonzero(scores >= least)
            found += [(name, float(scores[s]), s + lo, min(m, len(h))) for s in apart(good, scores[good], min(m, len(h)))]
        found.sort(key=lambda x: (-x[1] * x[3], x[0], x[2]))
        kept: list[tuple[int, int]] = []  # in order of their starts
        out = []
        for x in found:
            k = bisect.bisect_left(kept, (x[2], 0))
            if (k == 0 or sum(kept[k - 1]) <= x[2]) and (k == len(kept) or x[2] + x[3] <= kept[k][0]):
                kept.insert(k, (x[2], x[3]))
                out.append(x)
        return out

    return scan


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """(doc_id, license, score, start_word, n_words): all passages of a document that are a template's.

    A passage is as many words as the template has (or the whole text if that is shorter); its score is the Dice
    coefficient of the distinct word bigrams of both, and at least ``least`` is reported. Of a template's passages that
    overlap the best counts, of equal ones the first; of different templates' that of the largest score times words, of
    equal ones the first by name, then by place. A text whose bigrams are so few that 2 a / (a + b) cannot reach ``least``
    prunes the template unseen, as one that doesn't hold enough of its bigrams close together. A document with no
    passage gives no row, as null and empty texts do. Repeated rows give their passages each; extra columns are
    ignored; an empty table gives an empty result. Templates are a parameter of fixed size, not data.
    """
    given = templates or TEMPLATES

    def rows(batches):
        scan = scanner(given, least)
        for batch in batches:
            out = [(i, *x) for i, t in text_rows(batch) for x in scan(t)]
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "license", "score", "start_word", "n_words"), x, strict=True)) for x in out], schema=_OUT)

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, license string, score double, start_word long, n_words long")


_OUT = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("score", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int64())])
