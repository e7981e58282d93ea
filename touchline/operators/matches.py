"""Whole-match compositions: raw frames to processed tracking, and events brought together with positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import scalars as S
from . import events as EV, frames as FR, series as R, tables as T, temporal as TM

AGENT = ["game_id", "period_id", "id"]
STEP = 40_000  # microseconds: 25 Hz


def process_tracking(rows: DataFrame, width: float, height: float) -> DataFrame:
    """Recorded rows (game_id, period_id, timestamp in microseconds of the period, id, x, y in metres from the corner, v,
    ball_state, ball_owning_team_id, team_id, position_name) to 25 Hz tracking with kinematics and carriers.

    Coordinates are centred, every agent is resampled (PCHIP) and smoothed by itself, ball and players with their own
    windows and limits, then each frame finds its carrier."""
    rows = rows.withColumns({"x": S.rescale(F.col("x"), width, S.PITCH_LENGTH), "y": S.rescale(F.col("y"), height, S.PITCH_WIDTH)})
    fill = ["ball_state", "ball_owning_team_id", "team_id", "position_name"]
    rows = R.resample(rows, AGENT, "timestamp", ["x", "y"], STEP, "pchip", fill).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    rows = rows.withColumn("frame_id", F.floor(F.col("timestamp") / STEP))
    ball = FR.is_ball()
    moved = R.kinematics(rows.where(~ball), AGENT, "timestamp", ["x", "y"], S.MAX_PLAYER_SPEED, S.MAX_PLAYER_ACCELERATION, 7, 1e6)
    rolled = R.kinematics(rows.where(ball), AGENT, "timestamp", ["x", "y"], S.MAX_BALL_SPEED, S.MAX_BALL_ACCELERATION, 3, 1e6)
    both = moved.unionByName(rolled).withColumns({c: F.lit(0.0) for c in ("z", "vz", "az")})
    return FR.infer_ball_carrier(both.withColumn("ord", F.col("id"))).drop("ord", "ball_dist")


def player_table(events: DataFrame) -> DataFrame:
    """game_id, team, player_id, code, and each player's first and last time and session."""
    seen = T.presence(events, ["game_id", "team", "player_id", "number"], "time", ["session"])
    return seen.withColumn("code", S.player_code(F.col("team"), F.col("number")))


def positions_wide(tracking: DataFrame, codes: list[str]) -> DataFrame:
    """A row for each frame, with <code>_x and <code>_y of every player: the mean where a code occurs twice."""
    return tracking.groupBy(*FR.FRAME).pivot("id", codes).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def events_on_frames(events: DataFrame, tracking: DataFrame, limit: float = 5.0) -> DataFrame:
    """Events (game_id, period_id, time, event_id, team_id, player_id, x, y) at the nearest frame in time, with mislabelled
    players corrected. tracking has timestamp on the same clock."""
    clock = tracking.groupBy(*FR.FRAME).agg(F.min("timestamp").alias("time")).select("game_id", "period_id", "time", "frame_id")
    placed = TM.as_of(events, clock, ["game_id", "period_id"], "time", ["frame_id"], "nearest")
    return EV.correct_mislabels(placed, tracking.where(~FR.is_ball()), limit)


def frames_with_events(tracking: DataFrame, placed: DataFrame) -> DataFrame:
    """Every frame, with its events where it has some."""
    frames = tracking.select(*FR.FRAME).distinct()
    return placed.select(*FR.FRAME, "event_id", F.col("corrected_id").alias("player_id")).join(frames, FR.FRAME, "right")


def parsed_events(events: DataFrame, tracking: DataFrame, limit: float = 5.0) -> DataFrame:
    """The parser's whole way from events and traces to corrected events: each event (game_id, period_id, time, event_id, team_id,
    player_id, x, y) at its nearest frame, its player corrected, with the frame's ball, the player's code and span in the game, and
    the phase: a number that counts the changes of the team with the ball along the period's events."""
    placed = events_on_frames(events, tracking, limit)
    balls = tracking.where(FR.is_ball()).groupBy(*FR.FRAME).agg(F.min(F.struct("x", "y", "ball_owning_team_id")).alias("b"))
    out = placed.join(balls, FR.FRAME, "left").withColumns({"ball_x": F.col("b.x"), "ball_y": F.col("b.y"), "owner": F.col("b.ball_owning_team_id")}).drop("b")
    along = R.along(["game_id", "period_id"], "time", "event_id")
    known = F.last("owner", True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("_new", F.coalesce((F.col("owner") != known).cast("long"), F.lit(0)))
    out = out.withColumn("phase", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")
    spans = placed.groupBy("game_id", F.col("corrected_id").alias("_p")).agg(F.min("time").alias("first_time"), F.max("time").alias("last_time"))
    return out.join(spans.withColumnRenamed("game_id", "_g"), (F.col("game_id") == F.col("_g")) & F.col("corrected_id").eqNullSafe(F.col("_p")), "left").drop("_g", "_p")
