"""Pairing of duels, period by period: a least-cost assignment on time differences, in one pass over the sorted times.

On a line of times the least-cost assignment without fixed points is made of neighbouring pairs and threes: a pair costs twice
its span, so does a three, and any longer cycle covers a gap that cutting it would save. A linear programme over the sorted
times finds the cheapest cut; of equal ones it prefers a pair at the later end. In a three the closer neighbours are partners
(the earlier two, if equally close) and the third has none. A period's duels (some hundreds) are one array of times and ids.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import let


#: Steps of one block: results are appended to a block's own short list, and blocks to the list of blocks.
BLOCK = 512
RUNS = "array<struct<start:int,size:int>>"


def blocked(places: Column, zero: Column, step, out: str, kind: str) -> Column:
    """The field `out` (an array of type `kind`) of an aggregate over `places` whose step appends to it: appending copies
    the list, so it is done block by block, and the lists are put end to end at last."""

    def block(acc: Column, start: Column) -> Column:
        fresh = F.struct(acc["state"].alias("state"), F.array().cast(kind).alias(out))
        mine = F.aggregate(F.slice(places, start + 1, F.lit(BLOCK)), fresh, step)
        return let(mine, lambda x: F.struct(x["state"].alias("state"), F.concat(acc["blocks"], F.array(x[out])).alias("blocks")))

    begin = F.struct(zero.alias("state"), F.array().cast(f"array<{kind}>").alias("blocks"))
    starts = F.sequence(F.lit(0), F.greatest(F.size(places) - 1, F.lit(0)), F.lit(BLOCK))
    return F.flatten(F.aggregate(starts, begin, block)["blocks"])


def cuts(times: Column) -> Column:
    """array<int>, one for each of the sorted times: whether the cheapest cut of the times up to it ends in a run of 2 or 3."""
    never = F.lit(math.inf)
    zero = F.struct(F.lit(0.0).alias("b"), never.alias("c"), never.alias("d"), F.lit(0).alias("i"))

    def step(acc, t):
        # b, c, d: costs of the times up to 1, 2 and 3 before this one
        s = acc["state"]
        at = lambda k: F.get(times, s["i"] - k)
        two, three = s["c"] + (t - at(1)), s["d"] + (t - at(2))
        pair = F.coalesce(two <= F.coalesce(three, never), F.lit(True))
        cost = F.coalesce(F.when(pair, two).otherwise(three), never)
        state = F.struct(cost.alias("b"), s["b"].alias("c"), s["c"].alias("d"), (s["i"] + 1).alias("i"))
        return F.struct(state.alias("state"), F.concat(acc["runs"], F.array(F.when(pair, 2).otherwise(3))).alias("runs"))

    return blocked(times, zero, step, "runs", "array<int>")


def runs(lengths: Column) -> Column:
    """array<struct(start, size)> of the cut, from its end; none for fewer than two times."""

    def found(lengths: Column) -> Column:
        n = F.size(lengths)

        def step(acc, i):
            size = F.get(lengths, i - 1)
            mine = F.struct((i - size).alias("start"), size.alias("size"))
            return F.when(acc["state"] == i, F.struct((i - size).alias("state"), F.concat(acc["found"], F.array(mine)).alias("found"))).otherwise(acc)

        back = lambda places: blocked(places, n, step, "found", RUNS)
        return F.when(n > 1, let(F.sequence(n, F.lit(1), F.lit(-1)), back)).otherwise(F.array().cast(RUNS))

    return let(lengths, found)  # computed once, not at every step


def partners(rows: Column) -> Column:
    """array<struct(id, pair_id)> of sorted rows struct(t, id): every row once, its partner null where it has none."""
    row = lambda x, y: F.struct(x["id"].alias("id"), y.alias("pair_id"))

    def members(run, rows):
        one, two, three = (F.get(rows, run["start"] + k) for k in range(3))
        early = two["t"] - one["t"] <= three["t"] - two["t"]
        mates = F.array(row(one, F.when(early, two["id"])), row(two, F.when(early, one["id"]).otherwise(three["id"])), row(three, F.when(~early, two["id"])))
        return F.when(run["size"] == 2, F.array(row(one, two["id"]), row(two, one["id"]))).otherwise(mates)

    alone = F.transform(rows, lambda x: F.struct(x["id"].alias("id"), F.when(F.lit(False), x["id"]).alias("pair_id")))
    cut = let(F.transform(rows, lambda x: x["t"]), lambda times: runs(cuts(times)))
    return F.when(F.size(rows) < 2, alone).otherwise(F.flatten(F.transform(cut, lambda run: members(run, rows))))


def pair_duels(df: DataFrame, keys: list[str], id_col: str, time: str) -> DataFrame:
    """keys, id, pair_id (null without a partner). Null times pair with nothing; equal times are ordered by id."""
    timed = df.where(F.col(time).isNotNull())
    rows = timed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(time).cast("double").alias("t"), F.col(id_col).alias("id")))).alias("rows"))
    out = rows.select(*keys, F.explode(let(F.col("rows"), partners)).alias("p")).select(*keys, F.col("p.id").alias(id_col), F.col("p.pair_id").alias("pair_id"))
    return out.unionByName(df.where(F.col(time).isNull()).select(*keys, id_col, F.lit(None).cast(dict(df.dtypes)[id_col]).alias("pair_id")))
