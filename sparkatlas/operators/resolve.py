"""Call resolution: enclosing symbols, import bindings, module probes and the first-match-wins ladder.

Candidates are aggregated to one row per key before they are joined, so no join fans out, and rungs decide in turn.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import dirname
from ..shared import cut

#: Names that most symbols have and that tell no single one; calls of them are decided where they stand.
COMMON = 10_000


def enclosing(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """``calls(file_id, ord, start_byte, ...)`` with ``src_symbol_id``, the innermost symbol around the call.

    Of spans of equal start the one that ends first, then of the least id. Calls outside any symbol drop out. Starts of
    spans and calls are swept in one order of file and byte, with the spans begun so far on a stack: the top is the one
    that began last, and one that has ended when it comes to the top is over for good. So the work is the number of
    spans and calls, not of their pairs, and a file is never held as a whole.
    """
    columns = calls.columns
    kinds = [f.dataType for f in calls.schema.fields]
    spans = symbols.where("file_id IS NOT NULL AND start_byte < end_byte").select(*[F.col(c).cast("long").alias(c) if c in ("file_id", "start_byte") else F.lit(None).cast(k).alias(c) for c, k in zip(columns, kinds, strict=True)], F.col("end_byte").cast("long").alias("end_"), F.col("id").cast("long").alias("id_"))
    sites = calls.where("file_id IS NOT NULL AND start_byte IS NOT NULL").select(*[F.col(c).cast("long").alias(c) if c in ("file_id", "start_byte") else F.col(c) for c in columns], F.lit(None).cast("long").alias("end_"), F.lit(None).cast("long").alias("id_"))
    # of spans that begin together the longest is pushed first, calls come after the spans that begin where they do
    order = ["file_id", "start_byte", F.col("end_").desc_nulls_last(), F.col("id_").desc_nulls_last()]
    both = spans.union(sites).repartition("file_id").sortWithinPartitions(*order)

    def sweep(batches):
        file, open_ = None, []
        for b in batches:
            found = []
            for f, at, end, i in zip(*(b.column(c).to_pylist() for c in ("file_id", "start_byte", "end_", "id_")), strict=True):
                if f != file:
                    file, open_ = f, []
                if i is not None:
                    open_.append((end, i))
                    found.append(None)
                    continue
                while open_ and open_[-1][0] <= at:
                    open_.pop()
                found.append(open_[-1][1] if open_ else None)
            source = pa.array(found, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), source], names=[*columns, "src_symbol_id"]).filter(source.is_valid())

    out = both.mapInArrow(sweep, T.StructType([*(T.StructField(c, T.LongType() if c in ("file_id", "start_byte") else k) for c, k in zip(columns, kinds, strict=True)), T.StructField("src_symbol_id", T.LongType())]))
    return out.select(*[F.col(c).cast(k).alias(c) for c, k in zip(columns, kinds, strict=True)], "src_symbol_id")


def bindings(imports: DataFrame) -> DataFrame:
    """The last import of every alias in a file: (file_id, alias, symbol, resolved_file_id, go_dir)."""
    last = imports.groupBy("file_id", "alias").agg(F.max_by(F.struct("symbol", "resolved_file_id", "go_dir"), "ord").alias("b"))
    return last.select("file_id", "alias", "b.*")


def probe(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """``wanted(file_id, ord, candidates)`` -> (file_id, ord, resolved_file_id): the first candidate path that exists."""
    tried = wanted.select("file_id", "ord", F.posexplode("candidates").alias("pos", "path"))
    return tried.join(files.select("path", F.col("id").alias("hit")), "path").groupBy("file_id", "ord").agg(F.min_by("hit", "pos").alias("resolved_file_id"))


def python_candidates(module: Column, package_dir: Column) -> Column:
    """Paths to try for an absolute or relative Python module; one dot is the file's own package."""
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))
    parts = F.when(package_dir == "", F.array().cast("array<string>")).otherwise(F.split(package_dir, "/"))
    up = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - dots + 1, F.lit(0))), "/")
    base = F.when(dots == 0, rest).otherwise(F.concat_ws("/", F.nullif(up, F.lit("")), F.nullif(rest, F.lit(""))))
    return F.when(dots == 0, F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")), F.concat(F.lit("src/"), base, F.lit(".py")), F.concat(F.lit("src/"), base, F.lit("/__init__.py")))).otherwise(
        F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))
    )


def typescript_candidates(module: Column, from_dir: Column) -> Column:
    """Paths to try for a relative module; none for a package name."""
    joined = F.concat_ws("/", F.nullif(from_dir, F.lit("")), F.regexp_replace(module, r"\.jsx?$", ""))
    fold = F.aggregate(
        F.split(joined, "/"),
        F.array().cast("array<string>"),
        lambda a, s: F.when(s.isin("", "."), a).when((s == "..") & (F.size(a) > 0), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))),
    )
    base = F.array_join(fold, "/")
    tails = [".ts", ".tsx", ".mts", ".cts", "/index.ts", "/index.tsx"]
    own = F.when(base.rlike(r"\.tsx?$"), F.array(base)).otherwise(F.array().cast("array<string>"))
    return F.when(module.startswith("."), F.concat(own, F.array(*[F.concat(base, F.lit(t)) for t in tails]))).otherwise(F.array().cast("array<string>"))


def _by_file(calls: DataFrame, symbols: DataFrame, files: DataFrame, bound: DataFrame) -> DataFrame:
    """What a call's own file tells: (src_symbol_id, callee, line, bare, hint, dir, at, own, near, tag).

    One shuffle by file brings calls together with the file's directory, bindings, names and spans; they are swept as by
    :func:`enclosing`, which finds ``src_symbol_id`` unless ``calls`` have it. ``near`` and ``tag`` are the symbol of the same file or
    the import that a bare call names, ``at`` and ``own`` the directory and file in which to look next.
    """
    given = "src_symbol_id" in calls.columns
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda df, tag, start, end, id_, name, s1, s2: df.select(F.col("file_id").cast("long").alias("file_id"), F.lit(tag).alias("row"), *[c.cast(k).alias(n) for c, k, n in zip((start, end, id_, name, s1, s2), ("long",) * 3 + ("string",) * 3, ("start", "end_", "id_", "name", "s1", "s2"), strict=True)])
    lit, col = none("long"), F.col
    parts = [
        row(files, 0, lit, lit, lit, col("language"), col("dir"), lit),
        row(bound, 1, lit, col("b_file"), col("i_id"), col("alias"), col("b_symbol"), col("b_dir")),
        row(symbols.where("name IS NOT NULL"), 2, col("start_byte"), lit, col("id"), col("name"), lit, lit),
        row(calls if given else calls.where("start_byte IS NOT NULL"), 4, F.lit(0) if given else col("start_byte"), col("line"), col("src_symbol_id") if given else lit, col("callee"), col("receiver"), col("receiver_type_hint")),
    ]
    if not given:
        parts.append(row(symbols.where("start_byte < end_byte"), 3, col("start_byte"), col("end_byte"), col("id"), lit, lit, lit))
    both = reduce(DataFrame.union, parts).where("file_id IS NOT NULL").repartition("file_id")
    both = both.sortWithinPartitions("file_id", F.least("row", F.lit(3)), "start", "row", F.col("end_").desc_nulls_last(), F.col("id_").desc_nulls_last())
    out = T.StructType([T.StructField(n, k) for n, k in (("src_symbol_id", T.LongType()), ("callee", T.StringType()), ("line", T.LongType()), ("bare", T.BooleanType()), ("hint", T.StringType()), ("dir", T.StringType()), ("at", T.StringType()), ("own", T.LongType()), ("near", T.LongType()), ("tag", T.StringType()))])
    kinds = pa.schema([(n, k) for n, k in zip(out.names, (pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)])

    def sweep(batches):
        file, home, open_, names, binds = None, None, [], {}, {}
        for b in batches:
            found = []
            for f, row, start, end, i, name, s1, s2 in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if f != file:
                    file, home, open_, names, binds = f, None, [], {}, {}
                if row == 0:
                    home = (name, s1)
                elif row == 1:
                    binds[name] = (s1, end, s2, i)
                elif row == 2:
                    at = (start is not None, start or 0, i)
                    if name not in names or at < names[name]:
                        names[name] = at
                elif row == 3:
                    open_.append((end, i))
                elif home is not None:
                    if not given:
                        while open_ and open_[-1][0] <= start:
                            open_.pop()
                        if not open_:
                            continue
                        i = open_[-1][1]
                    (language, folder), near, tag, look, own = home, None, None, None, None
                    if s1 is not None:
                        _, own, look, _ = binds.get(s1, (None,) * 4)
                    elif language == "go":
                        look = folder
                    elif language is not None:
                        if name in names:
                            near, tag = names[name][2], "same_file"
                        elif name in binds and binds[name][0] not in (None, "*", "default") and binds[name][3] is not None:
                            near, tag = binds[name][3], "import"
                    found.append((i, name, end, s1 is None, s2, folder if s2 is not None else None, look, own, near, tag))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds.types, strict=True)], schema=kinds)

    return both.mapInArrow(sweep, out)


def resolve(calls: DataFrame, symbols: DataFrame, files: DataFrame, binds: DataFrame) -> DataFrame:
    """``calls(file_id, callee, receiver, receiver_type_hint, line, src_symbol_id)`` -> edges with their evidence.

    Calls with ``start_byte`` in place of ``src_symbol_id`` get the symbol around them, as by :func:`enclosing`; those outside any drop out.
    Rungs, first match wins: receiver type (0.95; 0.90 if only the caller's directory tells; several: unresolved), Go
    package (0.95; several: unresolved), same file (0.90), import (0.90), unique name (0.50), unresolved.

    Calls are the long table. What their file tells is found in one sweep and written; a later lookup moves only the
    calls that ask for it and that no earlier rung decided, and the commonest names, which decide nothing, move no call.
    """
    line = calls.schema["line"].dataType
    f = files.select(F.col("id").alias("file_id"), "language", dirname(F.col("path")).alias("dir"))
    s = symbols.select("id", "file_id", "name", "qualified_name", "kind", "start_byte").join(f.select("file_id", "dir"), "file_id")
    q1 = s.groupBy(F.col("qualified_name").alias("q")).agg(F.count(F.lit(1)).alias("q_n"), F.min("id").alias("q_id"))
    q1d = s.groupBy(F.col("qualified_name").alias("q"), "dir").agg(F.count(F.lit(1)).alias("qd_n"), F.min("id").alias("qd_id"))
    d2 = s.groupBy(F.col("dir").alias("at"), F.col("name").alias("callee")).agg(F.count(F.lit(1)).alias("d_n"), F.min("id").alias("d_id"))
    f3 = s.groupBy(F.col("file_id").alias("own"), F.col("name").alias("callee")).agg(F.min_by("id", F.struct("start_byte", "id")).alias("f_id"))
    method = F.col("kind") == "method"
    u6 = s.groupBy(F.col("name").alias("callee")).agg(F.count(F.lit(1)).alias("u_n"), F.min("id").alias("u_id"), F.count_if(method).alias("m_n"), F.min(F.when(method, F.col("id"))).alias("m_id"))
    u6 = cut(u6.where("callee IS NOT NULL"), "names")
    bound = binds.select("file_id", "alias", F.col("symbol").alias("b_symbol"), F.col("resolved_file_id").alias("b_file"), F.col("go_dir").alias("b_dir"))
    # what an import names is looked up once a binding, not once a call
    nothing = lambda *keys: F.concat(F.lit("\0"), F.pmod(F.xxhash64(*keys), F.lit(4096)).cast("string"))  # noqa: E731  # equals no name; keeps rows without one from meeting in one task
    bound = bound.withColumn("b_name", F.coalesce("b_symbol", nothing("file_id", "alias")))
    bound = bound.join(f3.select(F.col("own").alias("b_file"), F.col("callee").alias("b_name"), F.col("f_id").alias("i_id")), ["b_file", "b_name"], "left").drop("b_name")
    x = cut(_by_file(calls, symbols, f, bound), "calls")

    def to(dst, confidence: float, tag) -> Column:
        return F.struct((F.col(dst) if dst else F.lit(None).cast("long")).alias("dst_symbol_id"), F.lit(confidence).alias("confidence"), (F.lit(tag) if isinstance(tag, str) else tag).alias("resolution"))

    none, bare = to(None, 0.0, "unresolved"), F.col("bare")
    edge = lambda df, rung: df.select("src_symbol_id", F.col("callee").alias("dst_name"), F.col("line").cast(line).alias("line"), rung.alias("r"))
    later = ["src_symbol_id", "callee", "line", "bare", "at", "own", "near", "tag"]
    hinted = x.where("hint IS NOT NULL").withColumn("q", F.concat_ws(".", "hint", "callee")).drop("hint")
    hinted = cut(hinted.join(q1, "q", "left").join(q1d, ["q", "dir"], "left").select(*later, "q_n", "q_id", "qd_n", "qd_id"), "hinted")
    typed = edge(hinted.where("q_n IS NOT NULL"), F.when(F.col("q_n") == 1, to("q_id", 0.95, "receiver")).when(F.col("qd_n") == 1, to("qd_id", 0.90, "receiver")).otherwise(none))
    x = x.where("hint IS NULL").select(*later).union(hinted.where("q_n IS NULL").select(*later))
    local, x = edge(x.where("near IS NOT NULL"), to("near", 0.90, F.col("tag"))), x.where("near IS NULL").drop("near", "tag")
    asked = x.where("at IS NOT NULL OR own IS NOT NULL")
    # as a rule one of the two is given
    asked = asked.where("at IS NULL").withColumn("d_n", F.lit(None).cast("long")).withColumn("d_id", F.lit(None).cast("long")).unionByName(asked.where("at IS NOT NULL").join(d2, ["at", "callee"], "left"))
    asked = asked.where("own IS NULL").withColumn("f_id", F.lit(None).cast("long")).unionByName(asked.where("own IS NOT NULL").join(f3, ["own", "callee"], "left"))
    rung = F.when(bare & (F.col("d_n") == 1), to("d_id", 0.95, "package")).when(bare & (F.col("d_n") > 1), none).when(~bare & (F.col("d_n") == 1), to("d_id", 0.90, "import")).when(~bare & F.col("f_id").isNotNull(), to("f_id", 0.90, "import"))
    asked = cut(asked.select("src_symbol_id", "callee", "line", "bare", rung.alias("r")), "asked")
    found = edge(asked.where("r IS NOT NULL"), F.col("r"))
    x = x.where("at IS NULL AND own IS NULL").select("src_symbol_id", "callee", "line", "bare").union(asked.where("r IS NULL").select("src_symbol_id", "callee", "line", "bare"))
    useful = "u_n = 1 OR m_n = 1"
    common = F.broadcast(cut(u6.where(f"NOT ({useful})").orderBy(F.desc("u_n"), "callee").limit(COMMON).select("callee"), "common"))
    rare = x.join(common, "callee", "left_anti").withColumn("callee_", F.coalesce("callee", nothing("src_symbol_id", "line")))
    rare = rare.join(u6.where(useful).withColumnRenamed("callee", "callee_"), "callee_", "left")
    named = edge(rare, F.when(bare & (F.col("u_n") == 1), to("u_id", 0.50, "name_only")).when(~bare & (F.col("m_n") == 1), to("m_id", 0.50, "name_only")).otherwise(none))
    edges = reduce(DataFrame.union, [typed, local, found, edge(x.join(common, "callee", "left_semi"), none), named])
    return edges.select("src_symbol_id", "r.dst_symbol_id", "dst_name", "line", "r.confidence", "r.resolution")
