"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Rates r of documents are sought that stay closest to one copy each in relative
entropy, sum(r log r - r + 1) with r at most ``cap``, while each source gives its
target of tokens and, so that long and short documents are taken alike, a share of
its documents in proportion. The convex dual has two unknowns for each source; its
solution is a tilt r = min(cap, exp(a + b x)) of a document of relative size x.
Newton steps need a few sums for each source, which one aggregate over the sizes
gives for all sources at once. Rates are then rounded to copies by a hash, and the
roundings nearest to a tie are turned until the source's tokens meet its target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helio_spark.session import materialize

CAP, STEPS, TOLERANCE = 3.0, 40, 1e-9
#: Levels of one round of correcting the rounding, and rounds: levels ** rounds is the finest step.
LEVELS, ROUNDS = 256, 3
SOURCES = 1_000_000
WORD = r"[^\x20\x09-\x0D]+"


def group_key(source: Column) -> Column:
    """A key that orders by code point with null last and equals itself for null."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source.cast("string")))


def water_filled(sizes: DataFrame, weights: tuple[float, ...], cap: float = CAP) -> DataFrame:
    """(g, total) of each source with its ``target``: shares by weight, at most cap x total.

    Sources in order of g weigh ``weights`` in turn. What a source cannot take is
    shared again by weight: with sources in order of cap x total / weight, those
    up to some place are full, and the others get one amount per weight. The
    window runs over one row for each source.
    """
    n = len(weights)
    place = F.row_number().over(Window.orderBy("g")) - 1
    weighed = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % n + 1).cast("int")))
    full = cap * F.col("total") / F.col("w")
    every = Window.partitionBy(F.lit(0))
    upto = Window.orderBy(full, "g").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0.0))
    rest = F.sum(F.col("total").cast("double")).over(every) - before(cap * F.col("total"))
    level = rest / (F.sum("w").over(every) - before("w"))
    open_level = F.min(F.when(level <= full, level)).over(every)  # of the first source that isn't full
    return (
        weighed.withColumn("_full", full)
        .withColumn("_level", level)
        .withColumn("_ok", F.col("_level") <= F.col("_full"))
        .withColumn("_first", F.min(F.when(F.col("_ok"), F.struct("_full", "g", "_level"))).over(every))
        .withColumn(
            "target",
            F.when(F.col("_first").isNull() | (F.struct("_full", "g") < F.struct("_first._full", "_first.g")), cap * F.col("total"))
            .otherwise(F.least(F.col("_first._level") * F.col("w"), cap * F.col("total"))),
        )
        .select("g", "total", "n", "target")
    )


def _by_source(rows: DataFrame, small: DataFrame, how: str = "inner") -> DataFrame:
    """Join a stored table of a row for each source; up to a million sources it is broadcast, so no row moves."""
    return rows.join(F.broadcast(small) if small.count() <= SOURCES else small, "g", how)


def _numbered(rows: DataFrame) -> DataFrame:
    """``nth`` with the place of a row among its equals, so that each is rounded on its own.

    Equals are counted slice by slice (``slice``, the task that stored them) and the counts are
    chained, so a row that makes up a third of the table is spread over its slices. Which of
    two equal rows comes first makes no difference to the rows that come out.
    """
    counts = rows.groupBy("nth", "slice").agg(F.count(F.lit(1)).alias("own"))
    upto = Window.partitionBy("nth").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("nth")
    starts = counts.withColumns({"first": F.coalesce(F.sum("own").over(upto), F.lit(0)), "all": F.sum("own").over(every)})
    starts = materialize(starts.where("all > 1").select("nth", "slice", "first"), "equals")
    several = rows.join(starts, ["nth", "slice"])
    place = F.row_number().over(Window.partitionBy("nth", "slice").orderBy(F.lit(0))) + F.col("first")
    again = several.withColumn("nth", F.xxhash64("nth", place)).drop("first")
    return rows.join(starts, ["nth", "slice"], "left_anti").unionByName(again).drop("slice")


def balance(sizes: DataFrame, targets: DataFrame, cap: float = CAP, steps: int = STEPS) -> DataFrame:
    """Tilts (g, a, b, mean) of the sources that solve the dual.

    ``sizes``: (g, size, n) how many documents of a source have a size, sizes over
    0. ``targets``: (g, total, n, target tokens, docs). Each step is one aggregate
    of partial sums by source and a stored table of one row for each source, so a
    lost executor repeats one step.
    """
    x = F.col("size") / F.col("mean")
    eta = F.col("a") + F.col("b") * x
    rate = F.when(eta >= math.log(cap), F.lit(cap)).otherwise(F.exp(eta))
    free = F.when(eta >= math.log(cap), F.lit(0.0)).otherwise(F.exp(eta))  # a full document has no slope
    known = targets.where("total > 0 and target > 0").select(
        "g", (F.col("total") / F.col("n")).alias("mean"), "target", "docs"
    )
    tilt = known.select("*", F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("off"))
    # decimal sums don't depend on the order of tasks, so reruns take the same steps
    sums = lambda c, name: F.sum((F.col("n") * c).cast("decimal(38,12)")).cast("double").alias(name)
    tilt = materialize(tilt, "tilts")
    for _ in range(steps):
        step = (
            _by_source(sizes, tilt)
            .groupBy("g")
            .agg(
                sums(rate, "r0"), sums(rate * x, "r1"), sums(free, "h0"), sums(free * x, "h1"), sums(free * x * x, "h2"),
                *[F.first(c).alias(c) for c in ("a", "b", "mean", "target", "docs")],
            )
        )
        g0 = F.col("r0") - F.col("docs")
        g1 = F.col("r1") - F.col("target") / F.col("mean")
        ridge = F.lit(1e-9) * (F.col("h0") + F.col("h2")) + 1e-12  # sizes all alike leave one direction free
        h0, h2 = F.col("h0") + ridge, F.col("h2") + ridge
        det = h0 * h2 - F.col("h1") * F.col("h1")
        da = (F.col("h1") * g1 - h2 * g0) / det
        db = (F.col("h1") * g0 - h0 * g1) / det
        scale = F.least(F.lit(1.0), F.lit(2.0) / F.greatest(F.abs(da), F.abs(db), F.lit(1e-300)))
        off = F.greatest(F.abs(g0) / F.col("docs"), F.abs(g1) * F.col("mean") / F.col("target"))
        tilt = materialize(
            step.select(
                "g", "mean", "target", "docs", (F.col("a") + scale * da).alias("a"), (F.col("b") + scale * db).alias("b"),
                F.coalesce(off, F.lit(0.0)).alias("off"),
            ),
            "tilts",
        )
        worst = tilt.agg(F.max("off")).first()[0]
        if worst is None or worst < TOLERANCE:
            break
    # one rate for all documents of a source meets both of its sums: what a source without convergence gets
    even = F.log(F.col("target") / F.col("total"))
    far = F.col("off") >= TOLERANCE
    known = targets.select("g", "total")
    return _by_source(tilt, known).select(
        "g", F.when(far, even).otherwise(F.col("a")).alias("a"), F.when(far, F.lit(0.0)).otherwise(F.col("b")).alias("b"), "mean"
    )


def _turned(rows: DataFrame, targets: DataFrame, cap: float, digit: int) -> DataFrame:
    """Copies after turning the roundings nearest to a tie, whole levels at a time.

    ``near`` orders a source's documents by how little their rate must move to
    change the copies in the direction that is missing. Levels of that order are
    turned as long as their tokens do not pass what is missing.
    """
    gap = (
        rows.groupBy("g")
        .agg(F.sum(F.col("copies") * F.col("size")).alias("have"))
        .join(targets.select("g", "target"), "g")
        .select("g", (F.col("target") - F.col("have")).alias("gap"))
    )
    gap = materialize(gap, "gaps")
    up = F.col("gap") > 0
    way = F.when(up, 1.0 - F.col("u")).otherwise(F.col("u"))
    able = F.when(up, F.col("copies") + 1 <= cap).otherwise(F.col("copies") > 0) & ~F.col("turned")
    level = F.when(able, F.least(F.floor(way * float(LEVELS) ** digit), F.lit(LEVELS - 1 if digit == 1 else 2**62)))
    marked = _by_source(rows, gap).withColumn("level", level)
    # only the lowest levels can be reached in later rounds: what the round before left is below one of its levels
    per = marked.where("level is not null").groupBy("g", "level").agg(F.sum("size").alias("tokens"), F.first("gap").alias("gap"))
    first = per.groupBy("g").agg(F.min("level").alias("low"))
    per = per.join(first, "g").where(F.col("level") < F.col("low") + LEVELS)
    run = F.sum("tokens").over(Window.partitionBy("g").orderBy("level"))
    taken = per.withColumn("run", run).where(F.col("run") <= F.abs("gap")).groupBy("g").agg(F.max("level").alias("until"))
    done = _by_source(marked, materialize(taken, "taken"), "left")
    turn = F.coalesce(F.col("level") <= F.col("until"), F.lit(False))
    return materialize(
        done.select(
            "id", "source", "g", "size", "rate", "u", "nth",
            (F.col("copies") + F.when(turn, F.when(up, 1).otherwise(-1)).otherwise(0)).alias("copies"),
            (F.col("turned") | turn).alias("turned"),
        ),
        "copies",
    )


def _last(rows: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """One document of each source turned whose size is closest to what is still missing."""
    gap = (
        rows.groupBy("g")
        .agg(F.sum(F.col("copies") * F.col("size")).alias("have"))
        .join(targets.select("g", "target"), "g")
        .select("g", (F.col("target") - F.col("have")).alias("gap"))
    )
    gap = materialize(gap, "gaps")
    up = F.col("gap") > 0
    able = F.when(up, F.col("copies") + 1 <= cap).otherwise(F.col("copies") > 0) & (F.col("size") > 0)
    miss = F.abs(F.abs("gap") - F.col("size"))
    pick = (
        _by_source(rows, gap).where(able & (miss < F.abs("gap")))
        .groupBy("g", "gap")
        .agg(F.min(F.struct(miss.alias("miss"), F.col("nth").alias("pick"))).alias("best"))
        .select("g", F.col("best.pick").alias("pick"), F.signum("gap").cast("int").alias("sign"))
    )
    pick = materialize(pick, "picks")
    return _by_source(rows, pick, "left").withColumn(
        "copies", F.col("copies") + F.when(F.col("nth") == F.col("pick"), F.col("sign")).otherwise(0)
    ).drop("pick", "sign")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    cap: float = CAP,
) -> DataFrame:
    """id, source, size, source_size, target, rate, copies, taken of every row.

    Size is the number of words, 0 for a null or empty text, which is never taken.
    Sources by code point, null last, weigh ``weights`` in turn and share all
    sizes; no target is over ``cap`` times its source. ``taken`` is copies x size.
    Repeated rows are mixed each; equal ones (id, text) may get different copies.
    Copies depend on ids, texts and sources only, and sums are exact, so reruns agree. An
    empty table gives no rows.

    The text is read once; all later work is on narrow stored rows. Sums by source
    are partial before they are shuffled, so a hot source costs a task no more.
    """
    rows = materialize(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), group_key(F.col(source_col)).alias("g"),
            F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.col(id_col), F.col(text_col), F.col(source_col), F.lit("nth")).alias("nth"),
            F.spark_partition_id().alias("slice"),
        ),
        "sizes",
    )
    rows = materialize(_numbered(rows), "sizes")
    sizes = materialize(rows.groupBy("g", "size").agg(F.count(F.lit(1)).alias("n")), "size-counts")
    # a source's number of documents counts those that have words
    per_source = sizes.groupBy("g").agg(
        F.sum(F.col("size") * F.col("n")).alias("total"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("n")
    )
    targets = water_filled(per_source, weights, cap).withColumn(
        "docs", F.when(F.col("total") > 0, F.col("n") * F.col("target") / F.col("total")).otherwise(0.0)
    )
    targets = materialize(targets, "targets")
    tilts = balance(sizes.where("size > 0"), targets, cap)
    eta = F.col("a") + F.col("b") * F.col("size") / F.col("mean")
    rated = _by_source(rows, materialize(tilts, "tilts"), "left").withColumn(
        "rate", F.when(F.col("a").isNull() | (F.col("size") == 0), 0.0).otherwise(F.least(F.exp(eta), F.lit(cap)))
    )
    chance = F.pmod(F.xxhash64("id", "nth"), F.lit(2**52)) / float(2**52)
    start = rated.select("id", "source", "g", "size", "rate", "nth", (F.col("rate") + chance).alias("_sum")).select(
        "id", "source", "g", "size", "rate", "nth",
        F.least(F.floor("_sum"), F.lit(int(cap))).alias("copies"), (F.col("_sum") - F.floor("_sum")).alias("u"),
        (F.col("size") == 0).alias("turned"),
    )
    copies = materialize(start, "copies")
    for digit in range(1, ROUNDS + 1):
        copies = _turned(copies, targets, cap, digit)
    copies = _last(copies, targets, cap)
    return _by_source(copies, targets).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", F.col("total").alias("source_size"),
        "target", "rate", F.col("copies").cast("int").alias("copies"), (F.col("copies") * F.col("size")).alias("taken"),
    )
