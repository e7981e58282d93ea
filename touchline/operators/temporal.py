"""Joins in time. As-of joins and semi-joins ahead are a union and windows: never a nested loop. The rows of one key (a match
or a period) are one task's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .series import along, next_known, up_to


def _both(left: DataFrame, right: DataFrame, keys: list[str], t: str, cols: list[str]) -> DataFrame:
    r = right.select(*keys, t, F.struct(F.col(t).alias("t"), *cols).alias("_r"))
    return left.withColumn("_side", F.lit(1)).unionByName(r.withColumn("_side", F.lit(0)), allowMissingColumns=True)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], t: str, cols: list[str], how: str = "backward", order: list[str] | None = None) -> DataFrame:
    """left with `cols` of the right row last at or before t (backward), first at or after it (forward), or nearest, the
    earlier of two equally near (nearest). `order` breaks ties of the right side's time."""
    rows = _both(left, right, keys, t, cols)
    tie = [F.col(f"_r.{c}") for c in order or []]
    back = F.last("_r", True).over(Window.partitionBy(*keys).orderBy(t, "_side", *tie).rowsBetween(Window.unboundedPreceding, 0))
    fore = next_known("_r", Window.partitionBy(*keys).orderBy(F.col(t), F.col("_side").desc(), *tie))
    if how == "backward":
        rows = rows.withColumn("_m", back)
    elif how == "forward":
        rows = rows.withColumn("_m", fore)
    else:
        rows = rows.withColumns({"_a": back, "_b": fore})
        near = F.when(F.col("_b").isNull() | (F.col(t) - F.col("_a.t") <= F.col("_b.t") - F.col(t)), F.col("_a")).otherwise(F.coalesce("_b", "_a"))
        rows = rows.withColumn("_m", near).drop("_a", "_b")
    return rows.where("_side = 1").select(*left.columns, *(F.col(f"_m.{c}").alias(c) for c in cols))


def as_of_filled(left: DataFrame, right: DataFrame, keys: list[str], t: str, col: str, empty=0) -> DataFrame:
    """Forward as-of, then carried on where nothing follows, then `empty`."""
    out = as_of(left, right, keys, t, [col], "forward")
    return out.withColumn(col, F.coalesce(F.last(col, True).over(up_to(keys, t)), F.lit(empty)))


def trailing(keys: list[str], t: str, span: int):
    """The window [t - span, t]."""
    return Window.partitionBy(*keys).orderBy(t).rangeBetween(-span, 0)


def followed_by(left: DataFrame, right: DataFrame, keys: list[str], t: str, span: int, other: str, out: str) -> DataFrame:
    """left with `out`: is there a right row of the same keys with another `other` in [t, t + span]? Both sides are one
    union: right rows ahead are counted, and those of the row's own `other`; a difference is a row of another. A null `other`
    differs from none. Windows by keys, and by keys and `other`, need one exchange; a key's rows are one task's work."""
    r = right.select(*keys, t, other).withColumn("_side", F.lit(0))
    rows = left.withColumn("_side", F.lit(1)).unionByName(r, allowMissingColumns=True)
    counted = F.count(F.when((F.col("_side") == 0) & F.col(other).isNotNull(), 1))
    ahead = lambda *by: counted.over(Window.partitionBy(*by).orderBy(t).rangeBetween(0, span))
    rows = rows.withColumns({"_all": ahead(*keys), "_same": ahead(*keys, other)})
    return rows.where("_side = 1").select(*left.columns, (F.col(other).isNotNull() & (F.col("_all") > F.col("_same"))).alias(out))


def first_in_next_rows(df: DataFrame, keys: list[str], order: list[str], n: int, wanted, col: str) -> Column:
    """`col` of the first of the next n rows for which wanted(row) holds; rows are structs of all columns."""
    ahead = F.collect_list(F.struct(*df.columns)).over(along(keys, *order).rowsBetween(1, n))
    return F.get(F.filter(ahead, wanted), F.lit(0))[col]


__all__ = ["as_of", "as_of_filled", "first_in_next_rows", "followed_by", "trailing"]
