"""Line dedup by a log-template tree, in DataFrame functions alone.

The tree has a fixed depth: token count, then the leading tokens; fields with a digit are variable. A template is a
leaf's line with its variable fields masked; what varies in a leaf beyond digits is generalised by the tokens that
most of its lines have at each place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Documents that make a template recurring, leading tokens in the tree, share of a leaf's lines that makes a token
#: constant, and share of a line's tokens that must equal the template's.
MIN_DOCS, LEADING, CONSTANT, SIMILAR = 8, 3, 0.5, 0.75
VARIABLE = "<*>"
_BLANK = r"[ \t\r\f\x0B]+"


def tokens(line: Column) -> Column:
    plain = F.array_remove(F.split(line, _BLANK), "")
    return F.when(line.rlike("[0-9]"), F.transform(plain, lambda t: F.when(t.rlike("[0-9]"), F.lit(VARIABLE)).otherwise(t))).otherwise(plain)


def _named(t: Column) -> Column:
    """Of a line's tokens: leaf (their count and the leading ones), full (all of them) and n."""
    return F.struct(F.xxhash64(F.size(t), F.array_join(F.slice(t, 1, LEADING), " ")).alias("leaf"), F.xxhash64(F.array_join(t, " ")).alias("full"), F.size(t).alias("n"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, full): the lines, by the hash of their masked form, that are to be dropped from a document.

    Every document but the first (smallest doc_id) loses a recurring template. A leaf's lines that differ are
    compared, place by place, with the tokens that most of them share.
    """
    named = docs.select("doc_id", F.explode(F.array_distinct(F.transform(F.transform(_lines(F.col("text")), tokens), _named))).alias("x")).select("doc_id", "x.*").where("n > 0")
    named = cut(named, "lines")
    exact = named.groupBy("leaf", "full").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first"))
    exact = cut(exact, "forms")
    often = exact.where(F.col("docs") >= min_docs).select("full", "first")
    dropped = named.select("doc_id", "full").join(often, "full").where("doc_id <> first").select("doc_id", "full")
    varied = exact.groupBy("leaf").agg(F.sum("docs").alias("docs"), F.max("docs").alias("most"), F.count(F.lit(1)).alias("forms"))
    varied = cut(varied.where((F.col("docs") >= min_docs) & (F.col("forms") > 1)).select("leaf", "docs"), "leaves")
    open_ = docs.select("doc_id", F.explode(_lines(F.col("text"))).alias("line")).select("doc_id", tokens(F.col("line")).alias("t")).select("doc_id", _named(F.col("t")).alias("x"), "t").where("x.n > 0")
    open_ = cut(open_.select("doc_id", "x.leaf", "x.full", "t").join(varied.select("leaf"), "leaf").select("leaf", "full", "doc_id", "t").dropDuplicates(["leaf", "full", "doc_id"]), "open")
    words = open_.select("leaf", F.posexplode("t").alias("place", "token")).groupBy("leaf", "place", "token").agg(F.count(F.lit(1)).alias("c"))
    top = words.groupBy("leaf", "place").agg(F.max(F.struct(F.col("c"), F.col("token"))).alias("m")).join(varied, "leaf").where(F.col("m.c") >= CONSTANT * F.col("docs"))
    # written, so that both sides of the joins with it are dealt by an exchange of their own and a hot leaf can be split
    shape = cut(top.groupBy("leaf").agg(F.map_from_entries(F.collect_list(F.struct("place", "m.token"))).alias("constant")), "shapes")
    alike = F.aggregate(F.map_entries("constant"), F.lit(0), lambda a, e: a + F.when(F.get(F.col("t"), e["key"]) == e["value"], 1).otherwise(0))
    fit = open_.join(shape, "leaf").where(alike >= SIMILAR * F.size("t")).select("leaf", "full", "doc_id")
    fit = cut(fit, "fit")
    kinds = fit.groupBy("leaf").agg(F.countDistinct("doc_id").alias("docs"), F.min("doc_id").alias("first")).where(F.col("docs") >= min_docs)
    general = fit.join(cut(kinds.select("leaf", "first"), "kinds"), "leaf").where("doc_id <> first").select("doc_id", "full")
    return dropped.union(general).distinct()


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``text`` less its recurring lines, and ``n_lines`` and ``n_dropped`` after the other columns.

    Null and empty texts stay as they are (n_lines 0 and 1). Lines without tokens are never dropped. Repeated rows
    of one doc_id are treated alike, each counting as one document; a null doc_id names no document, so such rows keep
    their lines. Columns of ``docs`` named n_lines or n_dropped give way to the new ones, others stay, whatever their
    names. An empty table gives an empty result.
    """
    spare = next(n for n in (f"gone_{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    gone = recurring_lines(docs.where("doc_id IS NOT NULL"), min_docs).groupBy("doc_id").agg(F.collect_set("full").alias(spare))
    lines = _lines(F.col("text"))
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(spare), F.xxhash64(F.array_join(tokens(x), " "))))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    both = docs.select(*rest).join(gone, "doc_id", "left")
    both = both.select(*rest, n.alias("n_lines"), F.when(F.col(spare).isNotNull() & F.col("text").isNotNull(), kept).alias(spare))  # filtered once
    text = F.when(F.col(spare).isNotNull(), F.array_join(spare, "\n")).otherwise(F.col("text"))
    dropped = F.when(F.col(spare).isNotNull(), F.col("n_lines") - F.size(spare)).otherwise(0)
    return both.select(*[text.alias(c) if c == "text" else F.col(c) for c in rest], "n_lines", dropped.alias("n_dropped"))
