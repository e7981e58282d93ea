"""Near-duplicate embeddings by a forest of random-projection trees.

A node of a tree splits its vectors at the median of their projections on a random direction; vectors within SPILL of the
split, in units of what a linked pair differs by, go to both sides. Trees grow in rounds: a node of more than LEAF vectors
fits up to LEVELS levels on a bounded sample of about FIT_ROWS of its vectors, and every vector is routed down. Enough trees
are grown that a pair at the threshold meets in a leaf with probability `recall` (choose_trees). Every pair of a leaf is
compared in double precision, so no found link is below the threshold.

A node that splitting does not make smaller (most of it falls in the overlap: a dense group), or that is still larger after the
rounds that spread-out vectors need and one more, is a leaf whatever its size. A leaf
over LEAF is cut into blocks by a digest, and every pair of its blocks is one task's bounded work, so nothing is capped; a
vector then travels once for each block of its leaf. Equal vectors are one class with a number of copies. A pair that shares
several leaves counts in the least of them alone: every vector carries the list of its leaves. Tasks return a row for each
class with its links counted and a spanning edge, never the pairs; components of the edges are the groups.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; neither do vectors of different
lengths. Repeated rows are copies of each other. A null id is no group's least id; a group without any id has a null one.
Scale does not matter, only direction. An empty table gives an empty result. Other columns are ignored. A long vector is only
a longer row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import forget, join_small, materialise, table
from .graph import connected_components

SIMILARITY, RECALL = 0.95, 0.9999
LEAF, FIT_ROWS, LEVELS = 1024, 8192, 9
#: About so many vectors of a node are routed at a time.
ROUTED = 16_384
#: Half the overlap around a split, in standard deviations of the difference that a linked pair has along a direction.
SPILL = 0.5
#: A split of which a child keeps more than this share of its parent is no split; so many directions are tried.
MOST_SHARE, TRIES = 0.7, 3
#: Directions that nodes take theirs from, for each length of vectors.
DIRECTIONS = 1024
ONE = np.uint64(1)


def missed_at_a_split(similarity: float = SIMILARITY, spill: float = SPILL) -> float:
    """The chance that a split separates a pair at the threshold, for directions spread over the sphere: the expected
    difference beyond the overlap, times the density of projections at their median."""
    z = 2 * spill
    beyond = 2 * (math.exp(-z * z / 2) / math.sqrt(2 * math.pi) - z * (1 - math.erf(z / math.sqrt(2))) / 2)
    return math.sqrt(2 - 2 * similarity) * beyond / math.sqrt(2 * math.pi)


def levels_of(n: int, similarity: float = SIMILARITY, spill: float = SPILL) -> int:
    """Splits from n spread-out vectors to a leaf: a child keeps half of its parent and its part of the overlap."""
    share = 0.5 + spill * math.sqrt((2 - 2 * similarity) / (2 * math.pi))
    return max(0, math.ceil(math.log(max(1, n) / LEAF) / -math.log(share)))


def choose_trees(n: int, similarity: float = SIMILARITY, recall: float = RECALL, spill: float = SPILL) -> int:
    """Trees for n vectors: their depth grows with the logarithm of n, and a pair has to meet in one of them."""
    missed = 1 - (1 - missed_at_a_split(similarity, spill)) ** levels_of(n, similarity, spill)
    return max(1, math.ceil(math.log(1 - recall) / math.log(missed))) if missed > 0 else 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def child(node: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Ids of the nodes below: a digest of the node's and the place in its subtree."""
    with np.errstate(over="ignore"):
        return mix(node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) + ONE).view(np.int64)


def directions(length: int) -> np.ndarray:
    d = np.random.default_rng(length).standard_normal((DIRECTIONS, length))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def units(vecs: pd.Series, kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vecs), kind).reshape(len(vecs), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def margin(length: int, similarity: float, spill: float) -> float:
    return spill * math.sqrt((2 - 2 * similarity) / length)


def fit(x: np.ndarray, node: int, n: int, edge: float, pool: np.ndarray) -> tuple[list[float], list[int]]:
    """Splits of a node's subtree in heap order, fitted on its sample x; n is how many vectors the node has. A split that is
    none has a NaN."""
    at, which = [math.nan] * (2**LEVELS - 1), [0] * (2**LEVELS - 1)
    picks = (mix(np.arange(TRIES * len(at), dtype=np.uint64) + np.array([node], np.int64).view(np.uint64)) % np.uint64(DIRECTIONS)).astype(int)
    todo = [(0, np.arange(len(x)))]
    while todo:
        k, rows = todo.pop()
        if len(rows) < 16 or len(rows) / len(x) * n <= LEAF:
            continue
        best = (MOST_SHARE, math.nan, 0)
        for d in picks[TRIES * k : TRIES * (k + 1)].tolist():
            p = x[rows] @ pool[d]
            t = float(np.median(p))
            best = min(best, (max((p <= t + edge).mean(), (p >= t - edge).mean()), t, d), key=lambda b: b[0])
        if math.isnan(best[1]):
            continue
        at[k], which[k] = best[1], best[2]
        p = x[rows] @ pool[best[2]]
        if 2 * k + 2 < len(at):
            todo += [(2 * k + 1, rows[p <= best[1] + edge]), (2 * k + 2, rows[p >= best[1] - edge])]
    return at, which


def route(x: np.ndarray, at: np.ndarray, which: np.ndarray, edge: float, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place (heap number) of every vector at the bottom of a subtree, once for each side it falls on."""
    rows, places, todo = [], [], [(0, np.arange(len(x)))]
    while todo:
        k, mine = todo.pop()
        if k >= len(at) or math.isnan(at[k]):
            rows.append(mine)
            places.append(np.full(len(mine), k))
            continue
        p = x[mine] @ pool[which[k]]
        todo += [(m, r) for m, r in ((2 * k + 1, mine[p <= at[k] + edge]), (2 * k + 2, mine[p >= at[k] - edge])) if len(r)]
    return np.concatenate(rows), np.concatenate(places)


def classes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """vec_id, d1, d2 (digests of the vector, null where it cannot link) of every row; d1, d2, cls, copies, length, vec (its
    bytes) of every distinct vector that can link; and the bytes' kind. Both written."""
    v, element = F.col("embedding"), dict(rows.dtypes)["embedding"].removeprefix("array<").removesuffix(">")
    kind = "<f4" if element == "float" else "<f8"
    whole = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < math.inf)
    good = F.coalesce(F.forall(v, whole) & F.exists(v, lambda x: x != 0), F.lit(False))
    digest = lambda *first: F.when(good, F.xxhash64(*first, v))
    signed = materialise(rows.select("vec_id", digest().alias("d1"), digest(F.lit(7)).alias("d2"), F.when(good, v).alias("embedding")), "vectors")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vecs = [np.asarray(x, kind) for x in pdf["embedding"]]
            yield pdf.drop(columns="embedding").assign(length=[len(x) for x in vecs], vec=[x.tobytes() for x in vecs])

    own = signed.where("d1 is not null").groupBy("d1", "d2").agg(F.first("embedding").alias("embedding"), F.count("*").alias("copies"))
    own = own.mapInPandas(packed, "d1 long, d2 long, copies long, length long, vec binary")
    return signed.select("vec_id", "d1", "d2"), materialise(own.withColumn("cls", F.monotonically_increasing_id()), "classes"), kind


def grow(classes: DataFrame, kind: str, n: int, trees: int, similarity: float, spill: float) -> DataFrame:
    """leaf, n (its vectors), cls, vec, length, copies of every vector in every leaf that holds it; n vectors in all."""
    roots = F.explode(F.transform(F.sequence(F.lit(1), F.lit(trees)), lambda t: F.xxhash64("length", t)))
    columns = ["cls", "vec", "length", "copies"]
    rows, done = materialise(classes.select(*columns, roots.alias("node")), "nodes"), None
    schema = "cls long, vec binary, length long, copies long, node long"

    def fitted(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        node, n, length = (int(k) for k in key)
        at, which = fit(units(pdf["vec"], kind), node, n, margin(length, similarity, spill), directions(length))
        return pd.DataFrame({"node": [node], "n": [n], "at": [at], "which": [which]})

    def routed(mine: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(model):
            return mine[[*columns, "node"]].iloc[:0]
        node, length = int(mine["node"].iloc[0]), int(mine["length"].iloc[0])
        where, place = route(units(mine["vec"], kind), model["at"].iloc[0], model["which"].iloc[0], margin(length, similarity, spill), directions(length))
        out = mine[columns].iloc[where].copy()
        out["node"] = child(np.full(len(place), node), place)
        return out

    def closed(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("node").alias("leaf"), "n", *columns)

    for _ in range(1 + math.ceil(levels_of(n, similarity, spill) / LEVELS)):
        counts = materialise(rows.groupBy("node").agg(F.count("*").alias("n")), "counts")
        big = counts.where(F.col("n") > LEAF)
        if big.isEmpty():
            last = closed(join_small(rows, counts, "node", "inner"))
            return last if done is None else done.unionByName(last)
        chance = F.pmod(F.xxhash64("vec", "node"), F.lit(1 << 30)) < F.lit(float((1 << 30) * FIT_ROWS)) / F.col("n")
        sample = join_small(rows, big, "node", "inner").where(chance)
        model = materialise(sample.groupBy("node", "n", "length").applyInPandas(fitted, "node long, n long, at array<double>, which array<int>"), "splits")
        splits = model.where(~F.isnan(F.col("at")[0])).withColumn("parts", F.ceil(F.col("n") / ROUTED).cast("int"))
        keys = materialise(splits.select("node", "parts"), "splits")
        left = materialise(closed(join_small(join_small(rows, keys.select("node"), "node", "left_anti"), counts, "node", "inner")), "leaves")
        done = left if done is None else done.unionByName(left)
        # a node's vectors in parts, each beside the node's splits: these may be many in a late round, and are never broadcast
        dealt = join_small(rows, keys, "node", "inner").withColumn("part", F.pmod(F.xxhash64("cls"), "parts"))
        beside = splits.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))).select("node", "part", "at", "which")
        new = materialise(dealt.select(*columns, "node", "part").groupBy("node", "part").cogroup(beside.groupBy("node", "part")).applyInPandas(routed, schema), "nodes")
        forget(rows)
        rows = new
    return done.unionByName(closed(rows.join(rows.groupBy("node").agg(F.count("*").alias("n")), "node")))


def compare(similarity: float, kind: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links of a leaf, or between two of its blocks: of the pairs that no lesser leaf holds."""
        cls, copies, leaf = pdf["cls"].to_numpy(), pdf["copies"].to_numpy(), pdf["leaf"].iloc[0]
        x = units(pdf["vec"], kind)
        linked = x @ x.T >= similarity
        np.fill_diagonal(linked, False)
        side = pdf["side"].to_numpy()
        if (side != side[0]).any():
            linked &= side[:, None] != side[None, :]
        some = np.flatnonzero(linked.any(1))
        if not len(some):
            return pd.DataFrame({"cls": [], "root": [], "links": []}).astype("int64")
        linked, cls, copies = linked[np.ix_(some, some)], cls[some], copies[some]
        earlier = [np.array(x)[np.array(x) < leaf] for x in pdf["leaves"].iloc[some]]
        owner = np.repeat(np.arange(len(some)), [len(x) for x in earlier])
        _, ids, often = np.unique(np.concatenate(earlier), return_inverse=True, return_counts=True)
        keep = often[ids] > 1
        owner, ids = owner[keep], np.unique(ids[keep], return_inverse=True)[1]
        for low in range(0, int(ids.max()) + 1 if len(ids) else 0, 1024):
            here = (ids >= low) & (ids < low + 1024)
            held = np.zeros((len(some), 1024), np.float32)
            held[owner[here], ids[here] - low] = 1
            linked &= (held @ held.T) == 0
        root = np.arange(len(some))
        while True:
            new = np.minimum(root, np.where(linked, root[None, :], len(some)).min(1))
            new = new[new]  # a class takes its root's root: rounds grow with the logarithm of a chain
            if (new == root).all():
                break
            root = new
        there = linked.any(1)
        return pd.DataFrame({"cls": cls[there], "root": cls[root[there]], "links": (linked @ copies)[there]})

    return run


def links_of(classes: DataFrame, kind: str, similarity: float, recall: float, spill: float) -> DataFrame:
    """cls, root (a class that it is linked with, over others at times), links: of every class and unit of work. Written."""
    n = classes.count()
    leaves = grow(classes, kind, n, choose_trees(n, similarity, recall, spill), similarity, spill)
    lists = leaves.groupBy("cls").agg(F.collect_list("leaf").alias("leaves"))  # as many as the trees give, by their overlaps
    parts = F.ceil(F.col("n") / LEAF).cast("int")
    rows = leaves.where("n > 1").join(lists, "cls").withColumn("side", F.pmod(F.xxhash64("cls"), parts).cast("int"))
    unit = F.explode(F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.xxhash64("leaf", F.least("side", j), F.greatest("side", j))))
    rows = rows.select("cls", "copies", "vec", "leaf", "leaves", "side", unit.alias("unit"))
    return materialise(rows.groupBy("unit").applyInPandas(compare(similarity, kind), "cls long, root long, links long"), "links")


def near_vectors(rows: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, spill: float = SPILL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vec_id, embedding."""
    signed, classes, kind = classes_of(rows)
    found = links_of(classes, kind, similarity, recall, spill)
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select("cls", "root"), "cls", "root").withColumnsRenamed({"node": "cls", "root": "group"})
    known = classes.select("cls", "copies", F.col("d1").alias("k1"), F.col("d2").alias("k2")).join(counts, "cls", "left").join(groups, "cls", "left")
    known = materialise(known.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("group", "cls").alias("group")), "known")
    out = join_small(signed, known, (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2")))
    out = materialise(out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "group"), "rows")
    least = materialise(out.where("group is not null").groupBy("group").agg(F.min("vec_id").alias("least")), "least")
    component = F.when(F.col("group").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return join_small(out, least, "group").select("vec_id", "n_links", component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op12_embedding_near_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
