"""Spelling variant grouping by the merges of an errata trie.

The words form a trie. At every node the child with the most words below is heavy, the others (and a word that ends
there) are light. The words of a light subtree are merged into the heavy one's, small into large, with one character
changed at that node: the light character skipped, replaced by the heavy one, or the heavy one put before it; among the
light subtrees the character is left open. Where a merged word's end coincides with another word's end, the two are one
edit apart: for the first place where two such words part, at least one of them is light there. A word is light at no
more nodes than the logarithm of the number of words, so that many merges of it are made, at any length and frequency.

Nodes are named by hashes of prefixes. Two nodes that share a hash share a heavy child, which costs time but no
result: all merged words are compared as they are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import cut, slices

#: Least code points and occurrences of a word, how many times as frequent a form must be, and one in how many runs loses a character.
LENGTH, COUNT, RATIO, LOST = 7, 2, 10, 31
#: Distinct words that a task counts before it hands them on, and prefixes of words that are laid out at a time.
HELD, LAID = 300_000, 500_000
#: Nodes with more than this part of all words' nodes are sent to every task, so that the many words below them stay dealt evenly.
HOT_NODES = 20_000


def runs_of(doc_id: int | None, text: str, length: int, lost: int | None) -> Counter:
    """Occurrences of a text's words: runs of Latin letters, A-Z lower-cased, by a crc32 of id and run less one character."""
    out: Counter = Counter()
    name = "" if doc_id is None else doc_id
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    for run, n in Counter(re.findall(rf"[a-zÀ-ÿ]{{{length},}}", lowered)).items():
        h = zlib.crc32(f"{name}:{run}".encode()) if lost else 1
        if lost and h % lost == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < length:
                continue
        out[run] += n
    return out


def count_words(docs: DataFrame, length: int = LENGTH, count: int = COUNT, lost: int | None = LOST) -> DataFrame:
    """(word, n) of all words of ``length`` code points and ``count`` occurrences or more."""

    def rows(batches):
        held: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    held.update(runs_of(i, t or "", length, lost))
                    if len(held) > HELD:
                        yield pa.RecordBatch.from_pydict({"word": pa.array(held, pa.string()), "n": pa.array(held.values(), pa.int64())})
                        held.clear()
        yield pa.RecordBatch.from_pydict({"word": pa.array(held, pa.string()), "n": pa.array(held.values(), pa.int64())})

    found = docs.select("doc_id", "text").mapInArrow(rows, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def path_nodes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every word and every node on its path: the word's place, depth, the node's hash and the character that leaves it (0 at the word's end)."""
    chars = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    lengths = np.array([len(w) for w in words], np.int64)
    nodes = lengths + 1
    of = np.repeat(np.arange(len(words)), nodes)
    depth = np.arange(int(nodes.sum())) - np.repeat(np.cumsum(nodes) - nodes, nodes)
    first = np.repeat(np.cumsum(lengths) - lengths, nodes)
    place = np.arange(len(chars)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(T.BYTE[chars] * T.powers(T._BASE, int(lengths.max(initial=0)) + 1)[place], out=sums[1:])
    node = T.mix(sums[first + depth] - sums[first] + depth.astype(np.uint64) * T.PLACE[15])
    leaves = np.where(depth < lengths[of], np.append(chars, 0)[np.minimum(first + depth, len(chars))], 0)
    return of, depth, node, leaves


def trie_paths(words: DataFrame) -> DataFrame:
    """(node, id, depth, leaves): the path of every word of ``words(id, word)``, its end included."""

    def rows(batches):
        for batch in batches:
            ids, found = batch.column("id").to_numpy(), batch.column("word").to_pylist()
            ends = np.cumsum([len(w) + 1 for w in found])
            at = 0
            while at < len(found):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LAID)))
                of, depth, node, leaves = path_nodes(found[at:to])
                yield pa.RecordBatch.from_arrays([pa.array(T.as_long(node)), pa.array(ids[at:to][of]), pa.array(depth.astype(np.int32)), pa.array(leaves.astype(np.int32))], names=["node", "id", "depth", "leaves"])
                at = to

    return words.select("id", "word").mapInArrow(rows, "node long, id long, depth int, leaves int")


def light_edges(words: DataFrame) -> DataFrame:
    """(word, n, lights): each word with the nodes where it is light, as depth and heavy character.

    The root and other nodes above many words are the hot keys here. By their share they are fewer than HOT_NODES, at any
    size of the trie, and are joined by broadcast; words go on by a key of their own there.
    """
    paths = trie_paths(words)
    size = paths.groupBy("node", "leaves").agg(F.count(F.lit(1)).alias("size"))
    most = F.max(F.struct(F.when(F.col("leaves") > 0, F.col("size")).otherwise(0).alias("size"), F.col("leaves").alias("heavy")))
    nodes = size.groupBy("node").agg(most.alias("m"), F.count(F.lit(1)).alias("kinds"), F.sum("size").alias("words"))
    nodes = cut(nodes.where("kinds > 1").select("node", F.col("m.heavy").alias("heavy"), "words"), "nodes")
    least = (nodes.agg(F.sum("words").alias("n")).first().n or 0) // HOT_NODES
    hot = nodes.where(F.col("words") > least).select("node", F.col("heavy").alias("hot"))  # fewer than HOT_NODES
    rest = nodes.where(F.col("words") <= least).select(F.col("node").alias("at"), "heavy")
    paths = paths.join(F.broadcast(hot), "node", "left").withColumn("at", F.when(F.col("hot").isNull(), F.col("node")).otherwise(F.xxhash64("id")))
    edges = paths.join(rest, "at", "left").select("id", "depth", "leaves", F.coalesce("hot", "heavy").alias("heavy"))
    lights = edges.where("leaves <> heavy").groupBy("id").agg(F.collect_list(F.struct("depth", "heavy")).alias("lights"))
    return words.join(lights, "id").select("word", "n", "lights")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every two words of ``words(id, word, n)`` that differ by one inserted, deleted or replaced character, once.

    The open places of light subtrees meet by the whole word but for that place, so a group has no more words than the
    alphabet has letters.
    """
    lights = cut(light_edges(words), "lights").select("word", "n", F.explode("lights").alias("x"))
    word, depth = F.col("word"), F.col("x.depth")
    before, own, after = F.substr(word, F.lit(1), depth), F.substr(word, depth + 1, F.lit(1)), F.substr(word, depth + 2)
    parts = lights.select("word", "n", before.alias("v"), own.alias("c"), after.alias("s"), F.char("x.heavy").alias("h"))
    skipped = F.when((F.col("c") != "") & (F.substr("s", F.lit(1), F.lit(1)) != F.col("c")), F.concat("v", "s"))  # of a run of equal letters the last
    replaced = F.when(F.col("c") != "", F.concat("v", "h", "s"))
    merged = F.array_compact(F.array(skipped, replaced, F.concat("v", "h", "c", "s")))
    merges = parts.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode(merged).alias("b"))
    meets = merges.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b").select("a", "a_n", "b", "b_n")
    open_ = parts.where("c <> ''").select(F.concat("v", F.lit("*"), "s").alias("open"), "word", "n")
    beside = open_.select("open", F.col("word").alias("a"), F.col("n").alias("a_n")).join(open_.select("open", F.col("word").alias("b"), F.col("n").alias("b_n")), "open").where("a < b")
    return meets.union(beside.select("a", "a_n", "b", "b_n"))


def roots(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """(word, root) of ``forms(word, form)``: the end of the chain of forms. A form's count is a multiple of its word's, so
    chains have no circle and end after as many steps as the largest count has powers of that ratio."""
    step = forms.select(F.col("word").alias("at"), F.col("form").alias("next"))
    level = forms.select("word", F.col("form").alias("at"), F.lit(0).alias("steps"))
    levels = [level]
    for i in range(1, rounds):
        level = cut(level.join(step, "at").select("word", F.col("next").alias("at"), F.lit(i).alias("steps")), "chain")
        if level.isEmpty():
            break
        levels.append(level)
    else:
        raise RuntimeError("chains of forms did not end")
    every = levels[0]
    for x in levels[1:]:
        every = every.union(x)
    return every.groupBy("word").agg(F.max(F.struct("steps", "at"))["at"].alias("root"))


def spelling_variants(docs: DataFrame, length: int = LENGTH, count: int = COUNT, ratio: int = RATIO, lost: int | None = LOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``length`` code points or more that occurs ``count`` times.

    Words are runs of Latin letters, A-Z lower-cased; with ``lost``, one in so many runs (by a hash of id and run, alike
    for all occurrences in a text) loses a character, else none. n_near counts the words one edit away; form is the one
    of them with the largest n (of equals the smallest by code points) if its n is ``ratio`` times the word's, else null;
    root follows forms to the last and is the word itself without one. Null and empty texts have no words. Repeated rows
    count as often as they stand; rows of a null doc_id count with an empty id. Extra columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, so that chains of forms end")
    words = cut(count_words(docs, length, count, lost).withColumn("id", F.monotonically_increasing_id()), "words")
    pairs = cut(near_pairs(words), "near")
    turned = lambda a, b: pairs.select(F.col(a).alias("word"), F.col(f"{a}_n").alias("own"), F.col(b).alias("near"), F.col(f"{b}_n").alias("near_n"))
    best: Column = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near")))
    near = turned("a", "b").union(turned("b", "a")).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("m"), F.first("own").alias("own"))
    is_form = -F.col("m.n") >= ratio * F.col("own")
    near = cut(near.select("word", "n_near", F.when(is_form, F.col("m.near")).alias("form"), F.when(is_form, -F.col("m.n")).alias("form_n")), "forms")
    found = near.join(roots(near.where("form IS NOT NULL").select("word", "form")), "word", "left")
    return words.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
