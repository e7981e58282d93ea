"""Stored, mergeable sketches of values by group: written once, merged for any coarser grouping, asked for quantiles.

A sketch is a table of counts by bin. Bins grow by a fixed ratio, so every value lies within `error` of its bin's middle,
relatively; zero has a bin of its own, negative values mirror positive ones, and values under LEAST in size are zero. Counts
add, so sketches merge in any order with one result, a roll-up is equal to the sketch of the whole, and a sketch is no larger
than its bins: some hundred for values that span six decades, whatever the number of rows. Storing and merging are a partial
aggregation and its exchange; no sketch passes the driver.

Null and NaN values are not counted; infinite ones are the outermost bins. Null keys form a group. Without rows there is no
sketch, and no quantile.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

ERROR = 0.01
LEAST = 1e-9
#: The bin of infinity.
MOST_BIN = 1_000_000


def bin_of(value: Column, error: float = ERROR) -> Column:
    """The bin's number: 0 for zero, 1 and up for positive values, below for negative ones."""
    step = math.log((1 + error) / (1 - error))
    size = F.abs(value.cast("double"))
    k = F.when(size < LEAST, 0).when(size == math.inf, MOST_BIN).otherwise(F.ceil(F.log(size / LEAST) / step) + 1)
    return F.when(value < 0, -k).otherwise(k).cast("int")


def middle_of(b: Column, error: float = ERROR) -> Column:
    """The value that is within `error` of every value of a bin."""
    step = math.log((1 + error) / (1 - error))
    size = F.exp((F.abs(b) - 1) * step) * LEAST * (1 - error)
    return F.when(b == 0, F.lit(0.0)).when(F.abs(b) == MOST_BIN, F.signum(b.cast("double")) * math.inf).otherwise(F.signum(b.cast("double")) * size)


def sketch(df: DataFrame, keys: list[str], values: list[str], error: float = ERROR) -> DataFrame:
    """keys, measure (the value's name), bin, n, total, low, high of every group: one aggregation over all measures."""
    every = F.explode(F.array(*(F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("v")) for v in values)))
    rows = df.select(*keys, every.alias("m")).select(*keys, "m.*").where(F.col("v").isNotNull() & ~F.isnan("v"))
    return rows.groupBy(*keys, "measure", bin_of(F.col("v"), error).alias("bin")).agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of coarser groups, or of the union of several sketch tables."""
    return sketches.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))


def quantiles(sketches: DataFrame, keys: list[str], shares: list[float], error: float = ERROR) -> DataFrame:
    """keys, measure, n, share, value: the value at each share of a group, within `error` of the exact one, and never outside
    what was seen."""
    w = Window.partitionBy(*keys, "measure")
    rows = sketches.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "size": F.sum("n").over(w), "least": F.min("low").over(w), "most": F.max("high").over(w)})
    rows = rows.withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    rank = F.greatest(F.lit(1.0), F.ceil(F.col("share") * F.col("size")))
    hit = (F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)
    value = F.least(F.col("most"), F.greatest(F.col("least"), middle_of(F.col("bin"), error)))
    return rows.where(hit).select(*keys, "measure", F.col("size").alias("n"), "share", value.alias("value"))
