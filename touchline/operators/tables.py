"""Relational operators: lookups, guards, merges, duplicates, reshaping, splits, array padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: A dimension of at most so many rows, and by the planner's estimate so many bytes, is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20


def look_up(facts: DataFrame, dim: DataFrame, on, how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Left join to a dimension whose size is checked: broadcast when small, by shuffle beyond."""
    size = int(dim._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    small = size <= BROADCAST_BYTES and dim.limit(limit + 1).count() <= limit
    return facts.join(F.broadcast(dim) if small else dim, on, how)


def natural(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on all columns that both sides have."""
    return left.join(right, [c for c in left.columns if c in right.columns])


def unmatched(facts: DataFrame, dim: DataFrame, on) -> DataFrame:
    return facts.join(dim, on, "left_anti")


def require_matched(facts: DataFrame, dim: DataFrame, on: str, allowed: set[str]) -> DataFrame:
    """facts, or an error if other keys than the allowed ones are missing in dim."""
    missing = unmatched(facts.select(on).distinct(), dim, on).where(~F.col(on).isin(*allowed)) if allowed else unmatched(facts.select(on).distinct(), dim, on)
    if found := missing.limit(5).collect():
        raise ValueError(f"no match for {[r[0] for r in found]}")
    return facts


def merge_coalesce(left: DataFrame, right: DataFrame, on: str, cols: list[str]) -> DataFrame:
    """Left join; `cols` come from the right where the left has null."""
    r = right.select(on, *(F.col(c).alias(f"_r_{c}") for c in cols))
    return left.join(r, on, "left").withColumns({c: F.coalesce(c, f"_r_{c}") for c in cols}).drop(*(f"_r_{c}" for c in cols))


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def distinct_but(df: DataFrame, aside: list[str], order: list[str]) -> DataFrame:
    """First row of those that agree in all columns but `aside`; nested columns are compared as JSON."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")}
    keys = [F.to_json(F.struct(c)) if c in nested else F.col(c) for c in df.columns if c not in aside]
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def first_non_null(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """The first value that isn't null of each column by itself."""
    at = F.struct(*order)
    return df.groupBy(*keys).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in cols))


def presence(df: DataFrame, keys: list[str], order: str, cols: list[str]) -> DataFrame:
    """First and last order and values of each key: t0, t1, <col>0, <col>1."""
    ends = [(f(c, order)).alias(f"{c}{k}") for c in cols for k, f in ((0, F.min_by), (1, F.max_by))]
    return df.groupBy(*keys).agg(F.min(order).alias("t0"), F.max(order).alias("t1"), *ends)


def wide(df: DataFrame, keys: list[str], name: str, values: list[str], col: str) -> DataFrame:
    return df.groupBy(*keys).pivot(name, values).agg(F.avg(col))


def long(df: DataFrame, keys: list[str], cols: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(keys, cols, name, value)


def co_occurring(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def arg_max_cell(matrix: Column) -> Column:
    """struct(row, col, value) of the first largest cell, by row then column, from 0."""
    flat = F.flatten(F.transform(matrix, lambda r, i: F.transform(r, lambda v, j: F.struct((-v).alias("q"), i.alias("row"), j.alias("col")))))
    best = F.array_min(flat)
    return F.struct(best["row"].alias("row"), best["col"].alias("col"), (-best["q"]).alias("value"))


def pad_matrix(matrix: Column, rows: int, cols: int) -> Column:
    zero = F.lit(0.0)
    cell = lambda r: lambda j: F.coalesce(F.get(r, j), zero)
    row = lambda i: F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), cell(F.get(matrix, i)))
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), row)


def pad_ragged(df: DataFrame, col: str, least: int) -> DataFrame:
    """Arrays filled with 0 to the longest one's length, `least` at least, and their lengths."""
    n = F.size(col)
    most = F.greatest(F.lit(least), F.coalesce("_most", F.lit(0)))
    wide = df.crossJoin(F.broadcast(df.agg(F.max(n).alias("_most"))))
    return wide.withColumns({"length": n, col: F.concat(col, F.array_repeat(F.lit(0.0), most - n))}).drop("_most")


def folds(ids: list, n: int, seed: int = 42) -> list[tuple]:
    """(fold, id, part) of a shuffled k-fold over sorted ids: sizes differ by one at most, and each fold's training ids
    give their first of n - 1 inner folds to validation. The shuffle is that of the seed's Mersenne generator."""
    import numpy as np

    def split(items, n):
        order = np.random.RandomState(seed).permutation(len(items))
        sizes = [len(items) // n + (k < len(items) % n) for k in range(n)]
        at = 0
        for s in sizes:
            test = set(order[at : at + s].tolist())
            yield [x for i, x in enumerate(items) if i not in test], [x for i, x in enumerate(items) if i in test]
            at += s

    out = []
    for k, (rest, test) in enumerate(split(sorted(ids), n)):
        train, valid = next(iter(split(rest, n - 1)))
        out += [(k, x, part) for part, xs in (("train", train), ("valid", valid), ("test", test)) for x in xs]
    return out


def ranked(df: DataFrame, key: str, seed: int, out: str) -> DataFrame:
    """Places from 0 of the rows in the order of a digest of seed and key, which is the same on every run: rows are numbered
    inside 4096 buckets of the digest, and the buckets' sizes, a bounded table, are summed up before them. Keys are distinct;
    null keys are one."""
    rows = df.withColumn("_digest", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    rows = rows.withColumn("_bucket", F.substring("_digest", 1, 3))
    rows = rows.withColumn(out, F.row_number().over(Window.partitionBy("_bucket").orderBy("_digest", key)) - 1)
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_bucket", before.alias("_before"))  # at most 4096 rows
    return rows.join(F.broadcast(sizes), "_bucket").withColumn(out, (F.col(out) + F.col("_before")).cast("long")).drop("_bucket", "_digest", "_before")


def fold_parts(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """fold, part beside each row of distinct keys, once for each of n folds: folds() for keys of any number, without the driver.
    The shuffle is that of a digest; sizes differ by one at most, and of a fold's other keys every (n - 1)-th is for validation."""
    rows = ranked(df, key, seed, "_place").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    mine = F.pmod(F.col("_place"), F.lit(n))
    other = F.pmod(mine - F.col("fold") - 1, F.lit(n)) + (n - 1) * F.floor(F.col("_place") / n)
    part = F.when(mine == F.col("fold"), "test").when(F.pmod(other, F.lit(n - 1)) == 0, "valid").otherwise("train")
    return rows.withColumn("part", part).drop("_place")


def ratio_split(df: DataFrame, order: list[str], valid: float, test: float) -> DataFrame:
    """`part` by position: the first floor(n * test) rows are test, the next floor(n * valid) valid, the rest train."""
    w = Window.orderBy(*order)  # a row for each group to split, such as a match
    n = F.count("*").over(Window.partitionBy())
    i = F.row_number().over(w) - 1
    t, v = F.floor(n * F.lit(test)), F.floor(n * F.lit(valid))
    return df.withColumn("part", F.when(i < t, "test").when(i < t + v, "valid").otherwise("train"))


def summary(df: DataFrame, ids: dict[str, str], kind: str) -> DataFrame:
    """Distinct ids, rows, and rows of each kind, as (name, value, n)."""
    one = df.agg(*(F.count_distinct(c).alias(k) for k, c in ids.items()), F.count("*").alias("rows"))
    names = [*ids, "rows"]
    top = one.select(F.explode(F.arrays_zip(F.array(*(F.lit(x) for x in names)).alias("name"), F.array(*names).alias("n"))).alias("z")).select(F.col("z.name").alias("name"), F.lit(None).cast("string").alias("value"), F.col("z.n").alias("n"))
    return top.unionByName(df.groupBy(F.col(kind).alias("value")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("name"), "value", "n"))
