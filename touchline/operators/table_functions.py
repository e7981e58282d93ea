"""Operators for SQL text: polymorphic table functions over TABLE(...) arguments.

    register(spark)
    SELECT * FROM gap_sessions(TABLE(t) PARTITION BY player ORDER BY (time), 'time', 125)
    SELECT * FROM pressing_pairs(TABLE(f) PARTITION BY (game_id, period_id, frame_id), 2.0)

Spark deals and sorts the table by what the query names, and a session's schema comes from the input's: all columns of the
table and the session's number. A session's rows pass one at a time, row by row in
Python. A frame's are held until its end, and its pairs leave as Arrow batches of about BLOCK, so that memory is a frame's agents and
a block. The column forms (series.sessions, pressure.pairwise) are the fast ones, and give the same rows.

Rows with a null time are in no session (null) and break none. A table without the named columns is an error when the query is
analysed. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, arrow_udtf, udtf
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from . import encounters as EN
from .encounters import AGENT
from .frames import FRAME

KINDS = dict(zip([*FRAME, "id"], (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True))
#: About so many pairs leave at a time.
BLOCK = 1 << 16


def needs(table: AnalyzeArgument, columns: list[str]) -> StructType:
    if not table.isTable:
        raise ValueError("the first argument is TABLE(...)")
    if missing := [c for c in columns if c not in table.dataType.fieldNames()]:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    return table.dataType


def constant(argument: AnalyzeArgument, name: str):
    if not argument.isConstantExpression or argument.value is None:
        raise ValueError(f"{name} is a constant")
    return argument.value


@udtf
class GapSessions:
    """Rows of the table with `session`, counted from 0 in each partition: a new one begins where `time` has moved by more than
    `gap` since the row before."""

    def __init__(self):
        self.last, self.session = None, 0

    @staticmethod
    def analyze(table: AnalyzeArgument, time: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        schema = needs(table, [constant(time, "time")])
        constant(gap, "gap")
        out = StructType([f for f in schema.fields if f.name != "session"])
        return AnalyzeResult(schema=out.add("session", LongType()))

    def eval(self, row, time: str, gap):
        values, t = row.asDict(), row[time]
        if t is not None:
            if self.last is not None and t - self.last > gap:
                self.session += 1
            self.last = t
        yield (*(v for k, v in values.items() if k != "session"), self.session if t is not None else None)


def pressing_pairs(frame: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """The pairs of one frame's agents, in batches."""
    yield from EN.pairs(frame, FRAME, EN.Rules(threshold), BLOCK)


@arrow_udtf(returnType="game_id string, period_id long, frame_id long, presser_id string, pressed_id string, tti double, p double")
class PressingPairs:
    """presser_id, pressed_id, tti, p of the opponents of each frame with a carrier: pressure.pairwise with its defaults (the
    carrier takes the larger of its own and the ball's value). Arrow functions have one schema, so a frame's columns are cast to it."""

    def __init__(self):
        self.parts, self.threshold = [], 0.0

    def eval(self, table, threshold):
        if missing := [c for c in [*FRAME, *AGENT] if c not in table.schema.names]:
            raise ValueError(f"the table has no column {', '.join(missing)}")
        self.parts.append(table.select([*FRAME, *AGENT]))
        self.threshold = float(threshold[0].as_py())
        return iter(())

    def terminate(self):
        if self.parts:
            frame = pa.Table.from_batches(self.parts)
            yield from pressing_pairs(frame.cast(pa.schema([f.with_type(KINDS.get(f.name, f.type)) for f in frame.schema])), self.threshold)


def register(spark: SparkSession) -> None:
    spark.udtf.register("gap_sessions", GapSessions)
    spark.udtf.register("pressing_pairs", PressingPairs)
