"""Connected components by alternating large-star and small-star steps, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import forget, materialise


def _mark(df: DataFrame) -> tuple:
    """Number of edges and an order-free digest of them."""
    r = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return tuple(r)


def _step(pairs: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """pairs (u, v), and written: the least v of each u. Its join back is by shuffle, where AQE can split a hot u."""
    return pairs, materialise(pairs.groupBy("u").agg(F.min("v").alias("m")), tag)


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """node, root (the least node of the component) for every node that has an edge to another. Nodes may be numbers,
    strings or binaries; edges may repeat or point either way; rows with a null end or with equal ends say nothing."""
    hi, lo = F.greatest(a, b), F.least(a, b)
    if dict(edges.dtypes)[a] == "binary":
        hi, lo = F.when(F.col(a) > F.col(b), F.col(a)).otherwise(F.col(b)), F.when(F.col(a) > F.col(b), F.col(b)).otherwise(F.col(a))
    star = materialise(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(hi.alias("u"), lo.alias("v")).distinct(), "star")
    before = _mark(star)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both, low = _step(both, "large")
        low = low.select("u", F.when(F.col("m") < F.col("u"), F.col("m")).otherwise(F.col("u")).alias("m"))
        large = materialise(both.where("v > u").join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        pairs, least = _step(large, "small")
        small = pairs.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "star")
        for old in (star, large, least):
            forget(old)
        star, now = new, _mark(new)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return star.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
