"""Synchronous training of small classifiers: one gradient over all rows a round, summed over the cluster, one step, repeat.

Rows are dealt to micro-batches by a digest of their key and packed, each as one row of bytes, in a written table; how many
there are follows from the row count alone. A round sends the weights to the tasks; every micro-batch gives its loss and
gradient as arrays, cut to fixed-point whole numbers; whole numbers add up to one sum in any order, so the weights after any
round are the same however the input is partitioned and whichever tasks run again. Sums are formed in the tasks, then in
SUM_PARTS parts; the driver adds these few and takes one step (plain gradient descent or Adam).

A share of the rows, by digest too, is never trained on; training stops when their loss has not fallen for `patience` rounds,
and the best weights count. After every `every` rounds the state (weights, step moments, best so far) is written as one row to
the checkpoint folder; a run with the same folder goes on from the last whole one.

Rows with a null label or a null or NaN feature are left out. Repeated rows count each. Without rows to train on there is no
model: an error. Features and labels travel as float64; the model and its gradient are a few hundred numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_folder, written

#: About so many rows are a micro-batch.
BATCH_ROWS = 1024
SUM_PARTS = 16
#: Fixed-point numbers have this many binary places; gradients are means, so sums stay far below 2 ** 63.
PLACES = 50
STATE = "round long, weights binary, first binary, second binary, best_loss double, best binary, best_round long"


class Logistic:
    """P(label = 1) = sigmoid(w . x + b); weights are w and then b."""

    def __init__(self, inputs: int):
        self.inputs, self.size = inputs, inputs + 1

    def start(self) -> np.ndarray:
        return np.zeros(self.size)

    def score(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ w[:-1] + w[-1]

    def gradient(self, w: np.ndarray, x: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Of a loss with derivative d by each row's score."""
        return np.concatenate([x.T @ d, [d.sum()]])


class Perceptron:
    """A hidden layer of tanh units before the logistic one; weights are hidden w, hidden b, output w, output b."""

    def __init__(self, inputs: int, hidden: int = 8, seed: int = 1):
        self.inputs, self.hidden, self.seed = inputs, hidden, seed
        self.size = (inputs + 2) * hidden + 1

    def start(self) -> np.ndarray:
        w = np.random.default_rng(self.seed).standard_normal(self.size) * 0.5
        w[self.inputs * self.hidden : (self.inputs + 1) * self.hidden] = 0
        w[-1] = 0
        return w

    def parts(self, w: np.ndarray) -> tuple[np.ndarray, ...]:
        a, b = self.inputs * self.hidden, (self.inputs + 1) * self.hidden
        return w[:a].reshape(self.inputs, self.hidden), w[a:b], w[b:-1], w[-1]

    def score(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.parts(w)
        return np.tanh(x @ w1 + b1) @ w2 + b2

    def gradient(self, w: np.ndarray, x: np.ndarray, d: np.ndarray) -> np.ndarray:
        w1, b1, w2, _ = self.parts(w)
        h = np.tanh(x @ w1 + b1)
        back = d[:, None] * w2 * (1 - h * h)
        return np.concatenate([(x.T @ back).ravel(), back.sum(0), h.T @ d, [d.sum()]])


def losses(score: np.ndarray, y: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Log loss of each row, labels 1 counting `weight` times, and its derivative by the score."""
    k = np.where(y > 0.5, weight, 1.0)
    p = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
    return k * (np.logaddexp(0, score) - y * score), k * (p - y)


def packed(rows: DataFrame, key: str, features: list[str], label: str, valid: float) -> DataFrame:
    """held (never trained on), n, x, y: micro-batches as bytes, rows by digest of the key. Written."""
    for c in [*features, label]:
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    digest = F.xxhash64(F.col(key).cast("string"))
    values = F.array(*(F.col(c).cast("double") for c in features))
    rows = written(rows.select(digest.alias("digest"), values.alias("x"), F.col(label).cast("double").alias("y")), "rows")
    parts = max(1, -(-rows.count() // BATCH_ROWS))
    held = F.pmod(F.xxhash64("digest", F.lit("held")), F.lit(1 << 20)) < int(valid * (1 << 20))
    rows = rows.withColumns({"held": held, "batch": F.pmod(F.xxhash64("digest", F.lit("batch")), F.lit(parts))})

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["x"].to_list())
        order = np.lexsort((pdf["y"].to_numpy(), *x.T, pdf["digest"].to_numpy()))
        return pd.DataFrame({"held": [bool(key[0])], "n": [len(pdf)], "x": [x[order].tobytes()], "y": [pdf["y"].to_numpy()[order].tobytes()]})

    return written(rows.groupBy("held", "batch").applyInPandas(pack, "held boolean, n long, x binary, y binary"), "batches")


def summed(batches: DataFrame, model, w: np.ndarray, totals: dict[bool, int], weight: float) -> tuple[dict[bool, float], np.ndarray]:
    """Mean loss of the held and the other rows, and the mean gradient of the others, as exact sums of fixed-point numbers."""
    start = batches.sparkSession.sparkContext.broadcast(w)
    fixed = lambda v: np.rint(v * 2.0**PLACES).astype(np.int64)

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(model.size + 2, np.int64)
        for pdf in parts:
            for held, x, y in zip(pdf["held"], pdf["x"], pdf["y"], strict=True):
                y = np.frombuffer(y)
                x = np.frombuffer(x).reshape(len(y), model.inputs)
                loss, d = losses(model.score(start.value, x), y, weight)
                total[int(held)] += fixed(loss.sum() / totals[bool(held)])
                if not held:
                    total[2:] += fixed(model.gradient(start.value, x, d) / totals[False])
        yield pd.DataFrame({"v": [total.tobytes()]})

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(model.size + 2, np.int64)
        for pdf in parts:
            for v in pdf["v"]:
                total += np.frombuffer(v, np.int64)
        yield pd.DataFrame({"v": [total.tobytes()]})

    rows = batches.select("held", "x", "y").mapInPandas(work, "v binary").repartition(SUM_PARTS).mapInPandas(add, "v binary").collect()  # SUM_PARTS rows
    start.unpersist()
    total = sum((np.frombuffer(bytes(r["v"]), np.int64) for r in rows), np.zeros(model.size + 2, np.int64)) / 2.0**PLACES
    return {False: float(total[0]), True: float(total[1])}, total[2:]


def saved(spark: SparkSession, folder: str) -> dict | None:
    """The last state in a checkpoint folder, or none."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = [f.getPath().getName() for f in store.listStatus(path) if store.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))] if store.exists(path) else []
    names = sorted(n for n in whole if n.startswith("round-"))
    return spark.read.schema(STATE).parquet(f"{folder}/{names[-1]}").first().asDict() if names else None


def fit(rows: DataFrame, key: str, features: list[str], label: str, model, rounds: int = 200, rate: float = 0.1, method: str = "adam", weight: float = 1.0, valid: float = 0.2, patience: int = 20, folder: str | None = None, every: int = 10, watch: Callable[[int, float, np.ndarray], None] | None = None) -> tuple[np.ndarray, list[dict]]:
    """The best weights, and a report: round, loss, held_loss (null without held rows) before each step, which `watch` is told
    with the weights."""
    if method not in ("adam", "descent"):
        raise ValueError("method is adam or descent")
    spark = rows.sparkSession
    batches = packed(rows, key, features, label, valid)
    totals = {False: 0, True: 0} | {r["held"]: r["n"] for r in batches.groupBy("held").agg(F.sum("n").alias("n")).collect()}
    if not totals[False]:
        raise ValueError("no rows to train on")
    old = saved(spark, folder) if folder else None
    array = lambda k: np.frombuffer(bytes(old[k])).copy()
    w, m, v = (array("weights"), array("first"), array("second")) if old else (model.start(), np.zeros(model.size), np.zeros(model.size))
    best, best_loss, best_round = (array("best"), old["best_loss"], old["best_round"]) if old else (w.copy(), np.inf, 0)
    report, first = [], old["round"] if old else 0

    def tell(k: int, loss: dict[bool, float]) -> None:
        report.append({"round": k, "loss": loss[False], "held_loss": loss[True] if totals[True] else None})
        if watch is not None:
            watch(k, loss[False], w)

    for k in range(first, rounds):
        loss, g = summed(batches, model, w, totals, weight)
        judged = loss[bool(totals[True])]
        tell(k, loss)
        if judged < best_loss:
            best, best_loss, best_round = w.copy(), judged, k
        elif k - best_round >= patience:
            break
        if method == "adam":
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9 ** (k + 1))) / (np.sqrt(v / (1 - 0.999 ** (k + 1))) + 1e-8)
        else:
            w = w - rate * g
        if folder and (k + 1) % every == 0:
            state = (k + 1, *(x.tobytes() for x in (w, m, v)), float(best_loss), best.tobytes(), best_round)
            spark.createDataFrame([tuple(bytearray(x) if isinstance(x, bytes) else x for x in state)], STATE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/round-{k + 1:09d}")
    else:
        loss, _ = summed(batches, model, w, totals, weight)
        judged = loss[bool(totals[True])]
        tell(max(first, rounds), loss)
        if judged < best_loss:
            best = w.copy()
    return best, report


def checkpoint_folder(spark: SparkSession) -> str:
    return shared_folder(spark, "training")


def predict(rows: DataFrame, features: list[str], model, w: np.ndarray, out: str = "p") -> DataFrame:
    """rows with the probability of label 1; null where a feature is null or NaN."""
    kept = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf["_x"].to_list()
            p = 1 / (1 + np.exp(-np.clip(model.score(w, np.array([[np.nan] * model.inputs if r is None else r for r in x], float).reshape(len(x), model.inputs)), -500, 500)))
            yield pdf.drop(columns="_x").assign(**{out: p})

    good = F.array(*(F.col(c).cast("double") for c in features))
    rows = rows.withColumn("_x", F.when(~F.exists(good, lambda v: v.isNull()), good))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*kept).dtypes) + f", {out} double"
    return rows.mapInPandas(run, schema).withColumn(out, F.nanvl(F.col(out), F.lit(None)))
