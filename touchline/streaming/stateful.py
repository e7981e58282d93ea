"""Stateful streams: sessions by gap and ball carriers by frame, with state for each key and event-time timers.

State lives in the RocksDB state store, one list for each key: the open sessions of a key, or the batches of rows of an open frame. A timer
closes what no row can join any more, when the watermark has passed it; closed results go to files in append mode, each once.
A query that starts again from its checkpoint goes on from its state and its files. Rows in any order within the watermark's
delay give what the batch operators (series.sessions, frames.infer_ball_carrier) give on all rows; rows behind the
watermark are dropped by Spark, as in every watermarked aggregation. Null keys are a key; rows with a null time are left out.

State is bounded by the rows and sessions inside the delay and the gap, not by the stream's length; keys are dealt over the
cluster by the group's exchange. A hot key is one task's work, since its sessions depend on each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import CARRIER_DISTANCE

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_store(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB store; a session that names another keeps it, and Spark says what is wrong."""
    if spark.conf.get(STORE, None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
        spark.conf.set(STORE, ROCKS)


class Sessions(StatefulProcessor):
    """start, stop, n, total of a key's sessions; times in microseconds. A row joins every session within `gap` of it."""

    def __init__(self, keys: list[str], gap: int):
        self.keys, self.gap = keys, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start long, stop long, n long, total double")

    def closes(self, stop: int) -> int:
        """The millisecond after which no row can join a session that ends here."""
        return (stop + self.gap) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = list(self.open.get())
        for pdf in rows:
            found += zip(pdf["at_us"].tolist(), pdf["at_us"].tolist(), [1] * len(pdf), pdf["amount"].tolist(), strict=True)
        merged: list[tuple] = []
        for start, stop, n, total in sorted((int(a), int(b), int(n), float(t)) for a, b, n, t in found):
            if merged and start - merged[-1][1] <= self.gap:
                a, b, m, t = merged[-1]
                merged[-1] = (a, max(b, stop), m + n, t + total)
            else:
                merged.append((start, stop, n, total))
        self.open.put(merged)
        if merged:  # one timer a key, for the session that closes first: it sets the next
            self.handle.registerTimer(self.closes(merged[0][1]))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, every = timerValues.getCurrentWatermarkInMs(), [tuple(r) for r in self.open.get()]
        closed = [r for r in every if self.closes(r[1]) <= now]
        rest = [r for r in every if self.closes(r[1]) > now]
        if rest:
            self.open.put(rest)
            self.handle.registerTimer(min(self.closes(r[1]) for r in rest))
        else:
            self.open.clear()
        if closed:
            out = pd.DataFrame(closed, columns=["start", "stop", "n", "total"])
            yield out.assign(**dict(zip(self.keys, key, strict=True)))[[*self.keys, "start", "stop", "n", "total"]]


def sessions(df: DataFrame, keys: list[str], time: str, value: str, gap: int, late: str = "10 minutes") -> DataFrame:
    """keys, start, stop (microseconds of the first and last row), n, total of every session that the watermark has closed: rows
    of a key whose neighbours are at most `gap` microseconds apart. A null value counts as 0."""
    with_store(df.sparkSession)
    kinds = dict(df.dtypes)
    rows = df.where(F.col(time).isNotNull()).withWatermark(time, late)
    rows = rows.select(*keys, time, F.unix_micros(time).alias("at_us"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("amount"))
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", start long, stop long, n long, total double"
    return rows.groupBy(*keys).transformWithStateInPandas(Sessions(keys, gap), schema, "Append", "EventTime")


ROW = ["id", "team_id", "x", "y", "ord", "noted"]


class Frames(StatefulProcessor):
    """The carrier of a frame, when the frame is complete: the same rows and rules as frames.infer_ball_carrier on a frame's rows.
    State is a value for each batch of a frame's rows (in Arrow's format) and the time of its last row, so that rows are never
    taken one by one."""

    def __init__(self, frame: list[str], limit: float, wait: int):
        self.frame, self.limit, self.wait = frame, limit, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "rows binary, us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in rows:
            if not len(pdf):
                continue
            sink = pa.BufferOutputStream()
            part = pa.RecordBatch.from_arrays([pa.array(pdf[c], kind, from_pandas=True) for c, kind in zip(ROW, (pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.string()), strict=True)], ROW)
            with pa.ipc.new_stream(sink, part.schema) as stream:
                stream.write_batch(part)
            us = int(pdf["at_us"].max())
            self.parts.appendValue((sink.getvalue().to_pybytes(), us))
            last = us if last is None else max(last, us)
        if last is not None:
            self.handle.registerTimer(last // 1000 + self.wait)
        return iter([])

    def carrier(self, rows: pa.Table) -> tuple | None:
        ids, teams, noted = (np.array(rows[c].to_pylist(), object) for c in ("id", "team_id", "noted"))
        x, y = (rows[c].to_numpy() for c in ("x", "y"))  # null is NaN
        order = rows["ord"].to_numpy()
        ball = ids == "ball"
        bx, by = min(zip(x[ball].tolist(), y[ball].tolist(), strict=True), key=lambda r: [-np.inf if np.isnan(v) else v for v in r], default=(np.nan, np.nan))
        player = ~ball
        d = np.sqrt((x - bx) ** 2 + (y - by) ** 2)

        def nearest(mine: np.ndarray) -> tuple | None:
            at = np.flatnonzero(mine & ~np.isnan(d))
            at = at[d[at] == d[at].min()] if len(at) else at
            return min(((d[k], order[k], ids[k], teams[k]) for k in at), key=lambda r: r[:3], default=None)

        named = np.flatnonzero(player & (noted != None))  # noqa: E711  element by element
        first = min(((order[k], noted[k]) for k in named), default=(0, None))[1]
        near = nearest(player)
        team = first if first not in (None, "neutral") else near[3] if near and near[0] < self.limit else None
        best = nearest(player & (teams == team)) if team is not None else None
        return (best[2], team, float(best[0])) if best is not None and best[0] < self.limit else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        parts = [tuple(r) for r in self.parts.get()]
        if parts and max(r[1] for r in parts) // 1000 + self.wait > timerValues.getCurrentWatermarkInMs():
            return  # a later row has a timer of its own
        self.parts.clear()
        rows = [pa.ipc.open_stream(bytes(r[0])).read_all() for r in parts]
        if rows and (found := self.carrier(pa.concat_tables(rows))) is not None:
            yield pd.DataFrame([(*key, *found)], columns=[*self.frame, "carrier_id", "owning_team", "distance"])


def frame_carriers(df: DataFrame, time: str, frame: list[str], late: str = "10 seconds", wait: int = 1, limit: float = CARRIER_DISTANCE) -> DataFrame:
    """frame, carrier_id, owning_team, distance of every frame with a carrier, once the watermark is `wait` milliseconds past the
    frame's last row. Rows: frame columns, time, id, team_id, x, y, ord, ball_owning_team_id. A frame's rows must bear times less
    than `late` apart; a frame whose rows come later than that is closed with the rows it has."""
    with_store(df.sparkSession)
    kinds = dict(df.dtypes)
    rows = df.where(F.col(time).isNotNull()).withWatermark(time, late)
    rows = rows.select(*frame, time, F.unix_micros(time).alias("at_us"), "id", "team_id", "x", "y", "ord", F.col("ball_owning_team_id").alias("noted"))
    schema = ", ".join(f"{k} {kinds[k]}" for k in frame) + ", carrier_id string, owning_team string, distance double"
    return rows.groupBy(*frame).transformWithStateInPandas(Frames(frame, limit, wait), schema, "Append", "EventTime")


def to_files(df: DataFrame, path: str, checkpoint: str) -> None:
    """Run over what is there now, appending closed results to Parquet files under `path`; state and progress stay in
    `checkpoint`, from which the next run goes on."""
    df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path).awaitTermination()


def closed_rows(df: DataFrame, folder: str) -> DataFrame:
    """The files that one run over what is there now has written to a new folder, as a table."""
    schema = df.schema
    to_files(df, f"{folder}/rows", f"{folder}/state")
    return df.sparkSession.read.schema(schema).parquet(f"{folder}/rows")


def all_rows(df: DataFrame, folder: str) -> DataFrame:
    """The whole result of a streaming aggregation over what is there now, groups that the watermark has not closed and late rows
    included: complete mode, each batch's table in files of its own, the last one read. State holds every group."""
    spark, seen = df.sparkSession, []

    def keep(table: DataFrame, batch: int) -> None:
        seen.append(f"{folder}/rows/{batch}")
        table.write.mode("overwrite").parquet(seen[-1])

    df.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(seen[-1]) if seen else spark.createDataFrame([], df.schema)
