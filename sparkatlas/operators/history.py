"""History mining: market baskets of commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Commits that touch more files than this say nothing about pairs; pairs below this support are noise.
BULK_FILES, MIN_SUPPORT = 50, 3
#: Commits that a task expands at a time.
TASK_COMMITS = 50_000
#: Authors named of a file; days after which a commit weighs half; units of a weight of one; the day that weights are counted from.
TOP_AUTHORS, HALF_LIFE, WEIGHT_UNIT, LANDMARK = 3, 180, 1_000_000, "1990-01-01"
#: Subjects of commits that mend, and of those that take back.
FIXES, REVERTS = r"(?i)\b(fix(e[sd])?|bugs?|hotfix|patch(es|ed)?|repairs?)\b", r"(?i)^revert\b"


def baskets(commits: DataFrame) -> DataFrame:
    """``commits(seq, author, author_date, files)`` without bulk commits, dealt by ``seq`` so that a task has about TASK_COMMITS.

    What a task combines before a shuffle, pairs or authors of files, hardly repeats, so its memory is that of all it
    reads; a part of a compact table can hold very many commits.
    """
    usable = commits.where(F.size("files") <= BULK_FILES)
    tasks = -(-usable.count() // TASK_COMMITS)
    return usable if tasks < 2 else usable.repartition(max(tasks, commits.sparkSession.sparkContext.defaultParallelism), "seq")


def cochange(commits: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """(file_a, file_b, both_count, a_count, b_count, support, conf_ab, conf_ba, lift) of pairs with enough support.

    Pairs are formed inside a commit's own array of at most 50 files, so nothing but (pair, 1) is shuffled and that is
    combined before. Files are counted by row, pairs by distinct file.
    """
    usable = baskets(commits)
    names = F.array_sort(F.array_distinct("files"))
    pairs = usable.select(names.alias("f")).select(
        F.explode(F.flatten(F.transform("f", lambda a, i: F.transform(F.slice("f", i + 2, F.greatest(F.size("f") - i - 1, F.lit(0))), lambda b: F.struct(a.alias("file_a"), b.alias("file_b")))))).alias("p")
    )
    both = pairs.groupBy("p.file_a", "p.file_b").agg(F.count(F.lit(1)).alias("both_count")).where(F.col("both_count") >= min_support)
    single = usable.select(F.explode("files").alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    total = usable.agg(F.count(F.lit(1)).alias("total"))
    out = both.join(single.select(F.col("path").alias("file_a"), F.col("n").alias("a_count")), "file_a").join(single.select(F.col("path").alias("file_b"), F.col("n").alias("b_count")), "file_b").crossJoin(F.broadcast(total))
    b, ca, cb, n = (F.col(c).cast("double") for c in ("both_count", "a_count", "b_count", "total"))
    return out.select("file_a", "file_b", "both_count", "a_count", "b_count", (b / n).alias("support"), (b / ca).alias("conf_ab"), (b / cb).alias("conf_ba"), (b * n / (ca * cb)).alias("lift"))


def file_history(commits: DataFrame) -> DataFrame:
    """(path, change_count, last_changed, top_authors): churn, date of the newest commit, three most frequent authors."""
    rows = baskets(commits).select("seq", "author", "author_date", F.explode("files").alias("path"))
    by_author = rows.groupBy("path", "author").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"), F.min_by("author_date", "seq").alias("day"))
    whole = by_author.groupBy("path").agg(F.sum("n").alias("change_count"), F.min_by("day", "seq").alias("last_changed"))
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("n"), "seq", "author"))
    top = by_author.withColumn("place", place).where(F.col("place") <= TOP_AUTHORS).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("place", "author", "n"))).alias("top"))
    text = F.array_join(F.transform("top", lambda t: F.concat(t["author"], F.lit(" ("), t["n"].cast("string"), F.lit(")"))), "; ")
    return whole.join(top, "path").select("path", "change_count", "last_changed", text.alias("top_authors"))


def decayed(commits: DataFrame, half_life: int = HALF_LIFE, landmark: str = LANDMARK) -> DataFrame:
    """(path, author, changes, weight): each author's changes of a file, the newer the heavier, to be stored and added to.

    A change of day d weighs 2 ** ((d - landmark) / half_life) in whole parts of WEIGHT_UNIT. Since weights grow from a
    fixed day on in place of shrinking towards today, the sums of two sets of commits add up to that of both, on any day.
    Weights have 38 digits: a hundred half-lives after the landmark take a later one.
    """
    rows = baskets(commits).select("author", F.datediff(F.to_date(F.substring("author_date", 1, 10)), F.lit(landmark).cast("date")).alias("days"), F.explode(F.array_distinct("files")).alias("path"))
    weight = (F.lit(float(WEIGHT_UNIT)) * F.pow(F.lit(2.0), F.col("days") / F.lit(float(half_life)))).cast("decimal(38,0)")
    return rows.where("days IS NOT NULL").groupBy("path", "author").agg(F.count(F.lit(1)).alias("changes"), F.sum(weight).cast("decimal(38,0)").alias("weight"))


def added(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The weights of two sets of commits, as :func:`decayed` gives them for both together."""
    return stored.unionByName(fresh).groupBy("path", "author").agg(F.sum("changes").alias("changes"), F.sum("weight").cast("decimal(38,0)").alias("weight"))


def owners(weights: DataFrame, k: int = TOP_AUTHORS) -> DataFrame:
    """(path, author, changes, share, place): the ``k`` authors of a file whose changes weigh most, ties by name, and their
    share of all its weight."""
    by = Window.partitionBy("path")
    x = weights.withColumn("place", F.row_number().over(by.orderBy(F.desc("weight"), "author"))).where(F.col("place") <= k)
    whole = weights.groupBy("path").agg(F.sum("weight").alias("whole"))
    return x.join(whole, "path").select("path", "author", "changes", (F.col("weight").cast("double") / F.col("whole").cast("double")).alias("share"), "place")


def signals(commits: DataFrame, as_of: str) -> DataFrame:
    """(path, changes, fixes, reverts, fix_share, age_days): how often a file is mended or taken back, and how long it rests.

    ``commits`` with ``subject``; one that is null is neither. ``age_days`` counts from the newest author date to ``as_of``.
    """
    day = F.to_date(F.substring("author_date", 1, 10))
    rows = baskets(commits).select("subject", day.alias("day"), F.explode(F.array_distinct("files")).alias("path"))
    out = rows.groupBy("path").agg(
        F.count(F.lit(1)).alias("changes"), F.count_if(F.coalesce(F.col("subject").rlike(FIXES), F.lit(False))).alias("fixes"), F.count_if(F.coalesce(F.col("subject").rlike(REVERTS), F.lit(False))).alias("reverts"), F.max("day").alias("day"),
    )
    return out.select("path", "changes", "fixes", "reverts", (F.col("fixes") / F.col("changes")).alias("fix_share"), F.datediff(F.lit(as_of).cast("date"), "day").alias("age_days"))
