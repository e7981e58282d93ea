"""Boosted trees by distributed histogram splits.

Features are cut into at most BINS bins at quantiles of the whole table; a row is then its bins, its label and its score, in a
written table. A level of a tree asks one question of all rows: gradient, curvature and count by (node, feature, bin), summed in
the tasks and merged over the cluster. These histograms are at most nodes x features x bins rows, whatever the number of
rows. Prefix sums in a window over the bins give the gain of every split, and the best one of a node is one row; a tree's splits
(at most 2 ** depth rows) are the only thing that passes the driver. Rows find their node by an expression compiled from the
tree, so a tree costs one pass a level and one rewrite of the scores.

Gradients are summed as fixed-point whole numbers, so the trees are the same for every partitioning. Of equal gains the lower
feature, then the lower bin, wins. A null or NaN feature is in a bin of its own below all others. Rows with a null label teach
nothing. Without labelled rows there is no tree, and every score is the start. Repeated rows count each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written
from .sketches import quantiles, sketch

BINS = 32
#: Fixed-point numbers have this many binary places.
PLACES = 24
#: Relative error of the bins' edges.
EDGE_ERROR = 0.001


class Tree:
    """Splits by node (heap order, from 1): feature's place, last bin that goes left; and the value of each leaf."""

    def __init__(self, splits: dict[int, tuple[int, int, float]], values: dict[int, float]):
        self.splits, self.values = splits, values

    def node(self, bins: Column, at: int = 1, depth: int = 99) -> Column:
        """The node that a row reaches, at most `depth` levels down."""
        if at not in self.splits or not depth:
            return F.lit(at)
        feature, cut, _ = self.splits[at]
        return F.when(F.get(bins, F.lit(feature)) <= cut, self.node(bins, 2 * at, depth - 1)).otherwise(self.node(bins, 2 * at + 1, depth - 1))

    def value(self, bins: Column, at: int = 1) -> Column:
        if at not in self.splits:
            return F.lit(float(self.values.get(at, 0.0)))
        feature, cut, _ = self.splits[at]
        return F.when(F.get(bins, F.lit(feature)) <= cut, self.value(bins, 2 * at)).otherwise(self.value(bins, 2 * at + 1))


class Model:
    def __init__(self, features: list[str], edges: list[list[float]], start: float, trees: list[Tree]):
        self.features, self.edges, self.start, self.trees = features, edges, start, trees

    def bins(self) -> Column:
        return F.array(*(bin_of(F.col(f), e) for f, e in zip(self.features, self.edges, strict=True)))

    def score(self, rows: DataFrame, out: str = "score") -> DataFrame:
        """rows with the log odds of label 1."""
        rows = rows.withColumn("_bins", self.bins())
        for t in self.trees:  # a column each: one expression of all trees would be too large to compile
            rows = rows.withColumn("_sum", (F.col("_sum") if "_sum" in rows.columns else F.lit(float(self.start))) + t.value(F.col("_bins")))
        return rows.withColumn(out, F.col("_sum") if self.trees else F.lit(float(self.start))).drop("_bins", "_sum")


def bin_of(value: Column, edges: list[float]) -> Column:
    """0 for null and NaN, else 1 and the number of edges below the value."""
    v = value.cast("double")
    above = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < v)) if edges else F.lit(0)
    return F.when(v.isNull() | F.isnan(v), 0).otherwise(above + 1).cast("int")


def edges_of(rows: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """Upper edges of the bins of each feature, but for the last: its quantiles, each once, from mergeable sketches, so that
    they too are the same for every partitioning."""
    found = quantiles(sketch(rows, [], features, EDGE_ERROR), [], [k / bins for k in range(1, bins)], EDGE_ERROR).collect()  # features x bins rows
    return [sorted({r["value"] for r in found if r["measure"] == f and math.isfinite(r["value"])}) for f in features]


def histograms(rows: DataFrame, node: Column) -> DataFrame:
    """node, feature, bin, g, h, n: fixed-point sums over rows of bins, g and h."""
    each = rows.select(node.alias("node"), "g", "h", F.posexplode("bins").alias("feature", "bin"))
    return each.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))


def best_splits(hist: DataFrame, ridge: float, least: int, least_gain: float = 1e-9) -> DataFrame:
    """A row for each node: its g, h, n, and feature, cut and gain of its best split (null if none gains enough)."""
    w = Window.partitionBy("node", "feature")
    run = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c, one = F.col, 2.0**-PLACES
    rows = hist.select("*", *(F.sum(k).over(run).alias(f"l{k}") for k in "ghn"), *(F.sum(k).over(w).alias(f"t{k}") for k in "ghn"))
    part = lambda g, h: (g * one) * (g * one) / (h * one + ridge)
    gain = part(c("lg"), c("lh")) + part(c("tg") - c("lg"), c("th") - c("lh")) - part(c("tg"), c("th"))
    ok = (c("ln") >= least) & (c("tn") - c("ln") >= least) & (gain > least_gain)
    choice = F.when(ok, F.struct((-gain).alias("loss"), c("feature"), c("bin")))
    return rows.groupBy("node").agg(F.min(choice).alias("s"), F.max("tg").alias("g"), F.max("th").alias("h"), F.max("tn").alias("n")).select("node", "g", "h", "n", c("s.feature").alias("feature"), c("s.bin").alias("cut"), (-c("s.loss")).alias("gain"))


def grow(rows: DataFrame, depth: int, rate: float, ridge: float, least: int) -> Tree:
    """A tree on rows of bins, g, h: one pass a level."""
    splits: dict[int, tuple[int, int, float]] = {}
    values: dict[int, float] = {}
    for level in range(depth + 1):
        tree = Tree(splits, values)
        node = tree.node(F.col("bins"))
        open_ = node >= 2**level  # nodes of this level: the others are leaves already
        found = best_splits(histograms(rows.where(open_), node), ridge, least).collect()  # at most 2 ** level rows
        for r in found:
            values[r["node"]] = -rate * (r["g"] * 2.0**-PLACES) / (r["h"] * 2.0**-PLACES + ridge)
            if r["feature"] is not None and level < depth:
                splits[r["node"]] = (r["feature"], r["cut"], r["gain"])
        if level < depth and not any(k >= 2**level for k in splits):
            break
    return Tree(splits, values)


def with_gradients(rows: DataFrame) -> DataFrame:
    """g and h of the log loss at each row's score, fixed-point."""
    p = 1 / (1 + F.exp(-F.col("score")))
    fixed = lambda v: F.round(v * 2.0**PLACES).cast("long")
    return rows.withColumns({"g": fixed(p - F.col("y")), "h": fixed(p * (1 - p))})


def fit(rows: DataFrame, features: list[str], label: str, trees: int = 10, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, least: int = 20, bins: int = BINS) -> Model:
    """Trees on all rows with a label; the start is the log odds of the labels."""
    rows = rows.where(F.col(label).isNotNull())
    edges = edges_of(rows, features, bins)
    model = Model(features, edges, 0.0, [])
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0))).first()
    if not n:
        return model
    model.start = math.log((ones + 0.5) / (n - ones + 0.5))
    data = written(rows.select(model.bins().alias("bins"), F.col(label).cast("double").alias("y"), F.lit(model.start).alias("score")), "binned")
    for _ in range(trees):
        tree = grow(with_gradients(data), depth, rate, ridge, least)
        model.trees.append(tree)
        if not tree.splits:
            break
        data = written(data.withColumn("score", F.col("score") + tree.value(F.col("bins"))), "binned")
    return model


def described(model: Model) -> list[tuple[int, int, str | None, float | None, float | None, float | None]]:
    """tree, node, feature, at (rows up to it go left, null ones too), gain, value of every node; leaves have no feature."""
    out = []
    for k, t in enumerate(model.trees):
        for node in sorted(t.values):
            feature, cut, gain = t.splits.get(node, (None, None, None))
            edge = None if feature is None else None if cut < 1 else model.edges[feature][cut - 1] if cut <= len(model.edges[feature]) else math.inf
            out.append((k, node, None if feature is None else model.features[feature], edge, gain, t.values[node]))
    return out
