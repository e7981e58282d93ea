"""Mixing sources to target weights by Pareto order sampling.

Every document first gets the whole copies that its source's ratio of target to size holds. What is left of the target
is a sample without replacement: inclusion grows with the square root of a document's size, documents whose inclusion
reaches 1 are certain, and the others are ranked by random odds divided by inclusion odds; the ranks are taken in order
up to the words that are left. The cut is found by two rounds of 1024-bin histograms and an exact order of the distinct
ranks inside the last bin, so no source is ever sorted whole. The random numbers are digests of doc_id and size: reruns
agree.

Null texts and blank ones have size 0 and are never taken. Rows that tie (equal doc_id and size share a rank) are cut one
row at a time: they are counted as one group, ordered by a digest of their columns, and of rows alike in all of them as
many are taken as fit. A null source is a source of its own. An empty table gives an empty result. Columns of names that
start with _mix_ are replaced; all others are ignored or carried. A text is counted in its row, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import forget, join_small, materialise, n_words_of, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BINS = 1024
P = "_mix_"


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """A row for each source: source, source_size, n, target. Water filling: a source is full when its share at its
    turn, by size over weight, reaches `most` times its size; the rest share what is left by weight."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row for each source
    k = F.row_number().over(order) - 1
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (k % len(weights) + 1).cast("int"))
    s = sources.withColumn("w", w).withColumn("full", most * F.col("source_size"))
    every = Window.partitionBy()
    total = share * F.sum("source_size").over(every)
    turn = Window.orderBy((F.col("full") / F.col("w")), F.col("source").asc_nulls_last())
    before = turn.rowsBetween(Window.unboundedPreceding, -1)
    left = total - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("turn", F.row_number().over(turn))
    stop = F.min(F.when(F.col("level") * F.col("w") <= F.col("full"), F.struct("turn", "level"))).over(every)["level"]  # of the first that isn't full
    target = F.least(F.col("full"), F.coalesce(stop, F.lit(float("inf"))) * F.col("w"))
    return s.select("source", "source_size", "n", F.when(F.col("full") > 0, target).otherwise(0.0).alias("target"))


def _uniform(*cols: Column) -> Column:
    """In (0, 1), from 48 bits of a digest."""
    key = F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def scales(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """c of each source, so that min(1, c * sqrt(size)) includes the words left over: from sums by size bin, largest first."""
    bits = F.length(F.bin("size")) - 6
    size_bin = F.when(F.col("size") < 64, F.col("size")).otherwise(F.call_function("shiftright", F.col("size"), bits) + 32 * bits)
    sums = sized.groupBy("source", size_bin.cast("long").alias("bin")).agg(F.sum("size").cast("double").alias("s"), F.sum(F.col("size") * F.sqrt("size")).alias("r"), F.max("size").alias("top"))
    sums = join_small(sums, goal.select(F.col("source").alias("src"), "left"), F.col("source").eqNullSafe(F.col("src")), "inner")
    w = Window.partitionBy("source").orderBy(F.desc("bin"))
    above = F.coalesce(F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    here = F.sum("r").over(Window.partitionBy("source").orderBy("bin"))
    c = sums.withColumn("c", (F.col("left") - above) / here).where((F.col("c") > 0) & (F.col("c") * F.sqrt("top") <= 1))
    return c.groupBy("source").agg(F.max_by("c", "bin").alias("c"))


def sample_mix(docs: DataFrame, carry: list[str], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The `carry` columns, source, _mix_size, _mix_source_size, _mix_target and _mix_copies for every document."""
    keep = list(dict.fromkeys([*carry, "doc_id", "source"]))
    keep = [c for c in keep if not c.startswith(P)]
    plain = [c for c, t in docs.select(*keep).dtypes if "map<" not in t and "variant" not in t]
    tie = F.xxhash64(*plain)
    sized = docs.select(*keep, n_words_of(F.col("text")).alias(f"{P}size"), tie.alias(f"{P}tie"), F.monotonically_increasing_id().alias(f"{P}row"))
    sized = materialise(sized.withColumn(f"{P}u", _uniform(F.col("doc_id"), F.col(f"{P}size"))), "sizes")
    plain = sized.select("source", F.col(f"{P}size").alias("size"))
    goal = targets(plain.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, share, most)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long"))
    goal = materialise(goal.withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))), "goals")
    scale = materialise(scales(plain.where("size > 0"), goal), "scales")
    goals = goal.join(scale.select(F.col("source").alias("scale_source"), "c"), F.col("source").eqNullSafe(F.col("scale_source")), "left")
    goals = materialise(goals.select(F.col("source").alias(f"{P}source"), *(F.col(c).alias(f"{P}{c}") for c in ("source_size", "target", "whole", "left", "c"))), "goals")

    size, rank = F.col(f"{P}size"), F.col(f"{P}rank")
    every = F.col(f"{P}left") / F.col(f"{P}source_size")  # one inclusion for all where no scale fits
    lam = F.coalesce(F.least(F.lit(1.0), F.col(f"{P}c") * F.sqrt(size.cast("double"))), every)
    u = F.col(f"{P}u")
    odds = F.when(lam >= 1, F.lit(0.0)).otherwise((u / (1 - u)) / (lam / (1 - lam)))
    ranked = join_small(sized, goals, F.col("source").eqNullSafe(F.col(f"{P}source"))).withColumn(f"{P}rank", F.when((size > 0) & (F.col(f"{P}left") > 0), odds / (1 + odds)))
    cuts = cut_of(ranked.where(rank.isNotNull()).select("source", "doc_id", f"{P}size", f"{P}rank", f"{P}tie", f"{P}row"), goals)

    done = join_small(ranked, cuts, F.col("source").eqNullSafe(F.col(f"{P}cut_source")))
    mine = F.struct(rank.alias("rank"), F.col("doc_id"), size.alias("size"), F.col(f"{P}tie").alias("tie"))
    part = (mine == F.col(f"{P}part")) & (F.col(f"{P}row") <= F.col(f"{P}last_row"))
    inside = F.coalesce(mine <= F.col(f"{P}end"), F.lit(False)) | F.coalesce(part, F.lit(False))
    taken = rank.isNotNull() & (F.col(f"{P}from").isNull() | (rank < F.col(f"{P}from")) | ((rank < F.col(f"{P}to")) & inside))
    copies = F.when(size > 0, F.col(f"{P}whole") + taken.cast("long")).otherwise(0).cast("long")
    return done.select(*keep, f"{P}size", f"{P}source_size", f"{P}target", copies.alias(f"{P}copies"))


def cut_of(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """For each source that is not taken whole: ranks below _mix_from are taken, ranks from _mix_to on are not, and between
    them the groups of equal rank, doc_id, size and tie up to _mix_end, and of group _mix_part the rows up to _mix_last_row."""
    rank = F.col(f"{P}rank")
    edges = goals.select(f"{P}source", F.col(f"{P}left").alias(f"{P}room"), F.lit(0.0).alias(f"{P}from"), F.lit(1.0).alias(f"{P}width"))
    for _ in range(2):
        bin_ = F.when(rank == 0, -1).otherwise(F.floor((rank - F.col(f"{P}from")) / F.col(f"{P}width") * BINS)).cast("long")  # certain ones come first
        inside = join_small(rows, edges, F.col("source").eqNullSafe(F.col(f"{P}source")), "inner").withColumn("bin", bin_)
        inside = inside.where((F.col("bin") < BINS) & ((F.col("bin") >= 0) | ((rank == 0) & (F.col(f"{P}from") == 0) & (F.col(f"{P}width") == 1))))
        hist = inside.groupBy("source", f"{P}room", f"{P}from", f"{P}width", "bin").agg(F.sum(f"{P}size").cast("double").alias("s"))
        upto = F.sum("s").over(Window.partitionBy("source").orderBy("bin"))
        over = hist.withColumn("upto", upto).where((F.col("upto") > F.col(f"{P}room")) & (F.col("bin") >= 0))
        first = over.groupBy("source").agg(F.min_by(F.struct(f"{P}room", f"{P}from", f"{P}width", "bin", "s", "upto"), "bin").alias("b"))
        b = F.col("b")
        edges = materialise(first.select(F.col("source").alias(f"{P}source"), (b[f"{P}room"] - b["upto"] + b["s"]).alias(f"{P}room"), (b[f"{P}from"] + b["bin"] * b[f"{P}width"] / BINS).alias(f"{P}from"), (b[f"{P}width"] / BINS).alias(f"{P}width")), "edges")
    last = join_small(rows, edges, F.col("source").eqNullSafe(F.col(f"{P}source")), "inner").where((rank > 0) & (rank >= F.col(f"{P}from")) & (rank < F.col(f"{P}from") + F.col(f"{P}width")))

    group = F.struct(rank.alias("rank"), F.col("doc_id"), F.col(f"{P}size").alias("size"), F.col(f"{P}tie").alias("tie"))
    parts = last.groupBy("source", group.alias("g"), F.shiftright(f"{P}row", 33).alias("p")).agg(F.count("*").alias("n"), F.first(f"{P}room").alias("room"))
    parts = materialise(parts, "last")
    groups = parts.groupBy("source", "g").agg(F.sum("n").alias("n"), F.first("room").alias("room"))
    before = F.coalesce(F.sum(F.col("n") * F.col("g.size")).over(Window.partitionBy("source").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fits = F.floor((F.col("room") - before) / F.col("g.size") + 0.5).cast("long")  # rows whose middle is within the room
    groups = materialise(groups.withColumn("m", F.greatest(F.lit(0).cast("long"), F.least(fits, F.col("n")))).where("m > 0"), "groups")
    ends = groups.groupBy("source").agg(F.max(F.when(F.col("m") == F.col("n"), F.col("g"))).alias("end"), F.max(F.when(F.col("m") < F.col("n"), F.struct("g", "m"))).alias("part"))

    # the row that is the m-th of its group: first the partition of the written table that holds it, then its place there
    split = groups.where("m < n").select(F.col("source").alias("s"), F.col("g").alias("h"), "m")
    mine = F.col("source").eqNullSafe(F.col("s")) & F.col("g").eqNullSafe(F.col("h"))
    w = Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    at = join_small(parts, split, mine, "inner").withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    at = materialise(at.where("before < m and m <= before + n").select("s", "h", "p", (F.col("m") - F.col("before")).alias("k")), "at")
    here = F.col("source").eqNullSafe(F.col("s")) & group.eqNullSafe(F.col("h")) & (F.shiftright(f"{P}row", 33) == F.col("p"))
    turn = F.row_number().over(Window.partitionBy("s", "p").orderBy(f"{P}row"))
    found = join_small(last, at, here, "inner").withColumn("turn", turn).where("turn = k").select("s", F.col(f"{P}row").alias("last_row"))

    out = edges.join(ends.withColumnRenamed("source", "e"), F.col(f"{P}source").eqNullSafe(F.col("e")), "left").join(found, F.col(f"{P}source").eqNullSafe(F.col("s")), "left")
    to = F.col(f"{P}from") + F.col(f"{P}width")
    return materialise(out.select(F.col(f"{P}source").alias(f"{P}cut_source"), f"{P}from", to.alias(f"{P}to"), F.col("end").alias(f"{P}end"), F.col("part.g").alias(f"{P}part"), F.col("last_row").alias(f"{P}last_row")), "cut")


def op8_mix_sources(spark, sf_dir):
    out = sample_mix(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", F.col(f"{P}size").alias("size"), F.col(f"{P}source_size").alias("source_size"), F.col(f"{P}target").alias("target"), (F.col(f"{P}copies") * F.col(f"{P}size")).alias("taken"))
