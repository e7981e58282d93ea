"""Bindings of the operators' inputs to the fixture tables, in Spark and, under the same names, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import PITCH_LENGTH
from ..operators.series import velocity
from ..session import spread


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    """event_id, us (microseconds), d (day), h (hour), user_id, event_type, value, k, team_id."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").select("event_id", us.alias("us"), F.dayofmonth("ts").cast("long").alias("d"), F.hour("ts").cast("long").alias("h"), "user_id", "event_type", "value", F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("k"))
    return e.withColumn("team_id", F.when(F.col("user_id") % 2 == 0, "H").otherwise("A"))


def tracking(spark: SparkSession, d: str) -> DataFrame:
    """Frames of one game: game_id, period_id, frame_id, id, team_id, position_name, x, y, ord, ball_owning_team_id, vx, vy,
    v. A frame is an hour; its first event is the ball, the others are players."""
    e = events(spark, d)
    e = e.select(F.lit("g1").alias("game_id"), F.when(F.col("d") <= 15, 1).otherwise(2).cast("long").alias("period_id"), ((F.col("d") - 1) * 24 + F.col("h")).alias("frame_id"), F.col("event_id").alias("ord"), "user_id", "event_type", F.col("team_id").alias("t"), ((F.floor(F.col("value") * 10) % 1050) / 10 - PITCH_LENGTH / 2).alias("x"), (F.col("k") * 0.68 - 34).alias("y"))
    frame = ["game_id", "period_id", "frame_id"]
    first = e.groupBy(*frame).agg(F.min(F.struct("ord", "event_type")).alias("b"))
    e = e.join(first, frame)
    ball = F.col("ord") == F.col("b.ord")
    owner = F.when(F.col("b.event_type") == "purchase", "H").when(F.col("b.event_type") == "error", "neutral")
    who = F.when(ball, "ball").otherwise(F.col("user_id").cast("string"))
    rows = e.select(*frame, who.alias("id"), F.when(~ball, F.col("t")).alias("team_id"), F.when(~ball, F.when(F.col("user_id") % 11 == 0, "GK").otherwise("MF")).alias("position_name"), "x", "y", "ord", owner.alias("ball_owning_team_id"))
    rows = rows.repartition(spread(spark), "period_id", "id")  # by agent: for its first row in a frame and for velocities alike
    rows = rows.groupBy(*frame, "id").agg(F.min_by(F.struct("team_id", "position_name", "x", "y", "ball_owning_team_id"), "ord").alias("r"), F.min("ord").alias("ord")).select(*frame, "id", "r.*", "ord")
    for a in ("x", "y"):
        rows = velocity(rows, ["game_id", "period_id", "id"], "frame_id", a, f"v{a}")
    rows = rows.withColumns({"vx": F.coalesce("vx", F.lit(0.0)), "vy": F.coalesce("vy", F.lit(0.0))})
    return rows.withColumn("v", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")))


def series(spark: SparkSession, d: str) -> DataFrame:
    """user_id, us, x: an agent's signal, null at 'error' events."""
    return events(spark, d).select("user_id", "us", "event_id", "event_type", F.when(F.col("event_type") != "error", F.col("value")).alias("x"))


def actions(spark: SparkSession, d: str) -> DataFrame:
    """event_id, us, game (day), user_id, team_id, type_name, result_name, value."""
    return events(spark, d).select("event_id", "us", F.col("d").alias("game"), "user_id", "team_id", F.col("event_type").alias("type_name"), F.when(F.col("value") >= 50, "Successful").otherwise("Unsuccessful").alias("result_name"), "value")


def matrices(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, label, m: 64 numbers as 8 rows of 8."""
    m = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.col("embedding").cast("array<double>"), i * 8 + 1, F.lit(8)))
    return table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), m.alias("m"))


def scores(spark: SparkSession, d: str) -> DataFrame:
    """user_id, y, score."""
    e = events(spark, d)
    return e.select("user_id", (F.col("event_type") == "purchase").cast("long").alias("y"), (F.col("value") / (F.col("value") + 100)).alias("score"))


EV = """ev AS (SELECT event_id, epoch_us(ts) AS us, CAST(day(ts) AS BIGINT) AS d, CAST(hour(ts) AS BIGINT) AS h, user_id, event_type, value,
  CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, CASE WHEN user_id % 2 = 0 THEN 'H' ELSE 'A' END AS team_id FROM events)"""
TRACKING = EV + """,
tr0 AS (SELECT 'g1' AS game_id, CAST(CASE WHEN d <= 15 THEN 1 ELSE 2 END AS BIGINT) AS period_id, (d - 1) * 24 + h AS frame_id, event_id AS ord, user_id, event_type, team_id AS t,
  CAST(CAST(floor(value * 10) AS BIGINT) % 1050 AS DOUBLE) / 10e0 - 52.5e0 AS x, k * 0.68e0 - 34e0 AS y FROM ev),
tr1 AS (SELECT *, first_value(ord) OVER w AS b, first_value(event_type) OVER w AS bt FROM tr0 WINDOW w AS (PARTITION BY game_id, period_id, frame_id ORDER BY ord)),
tr2 AS (SELECT game_id, period_id, frame_id, CASE WHEN ord = b THEN 'ball' ELSE CAST(user_id AS VARCHAR) END AS id, CASE WHEN ord <> b THEN t END AS team_id,
  CASE WHEN ord <> b THEN CASE WHEN user_id % 11 = 0 THEN 'GK' ELSE 'MF' END END AS position_name, x, y, ord,
  CASE bt WHEN 'purchase' THEN 'H' WHEN 'error' THEN 'neutral' END AS ball_owning_team_id FROM tr1),
tr3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id, period_id, frame_id, id ORDER BY ord) AS rn FROM tr2) WHERE rn = 1),
tr4 AS (SELECT * EXCLUDE (rn), coalesce((x - lag(x) OVER w) / (frame_id - lag(frame_id) OVER w), 0e0) AS vx, coalesce((y - lag(y) OVER w) / (frame_id - lag(frame_id) OVER w), 0e0) AS vy
  FROM tr3 WINDOW w AS (PARTITION BY game_id, period_id, id ORDER BY frame_id)),
tr AS (SELECT *, sqrt(vx * vx + vy * vy) AS v FROM tr4)"""
BALL = TRACKING + """,
bd AS (SELECT tr.*, bx, by_, sqrt((x - bx) * (x - bx) + (y - by_) * (y - by_)) AS ball_dist FROM tr LEFT JOIN
  (SELECT game_id, period_id, frame_id, x AS bx, y AS by_ FROM tr WHERE id = 'ball') USING (game_id, period_id, frame_id))"""
CARRIER = BALL + """,
near AS (SELECT game_id, period_id, frame_id, arg_min(team_id, ball_dist * 1e9 + ord / 1e9) AS nt, min(ball_dist) AS nd, arg_min(ball_owning_team_id, ord) AS noted FROM bd WHERE id <> 'ball' GROUP BY ALL),
team AS (SELECT game_id, period_id, frame_id, CASE WHEN noted <> 'neutral' THEN noted WHEN nd < 25 THEN nt END AS team FROM near),
own AS (SELECT game_id, period_id, frame_id, first(id ORDER BY ball_dist, ord) AS pid, min(ball_dist) AS pd FROM bd JOIN team USING (game_id, period_id, frame_id) WHERE id <> 'ball' AND team_id = team GROUP BY ALL),
car AS (SELECT bd.*, team.team, coalesce(pd < 25 AND bd.id = pid, false) AS is_ball_carrier FROM bd JOIN team USING (game_id, period_id, frame_id) LEFT JOIN own USING (game_id, period_id, frame_id) WHERE team IS NOT NULL)"""
SERIES = EV + ", se AS (SELECT user_id, us, event_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS x FROM ev)"
ACTIONS = EV + ", ac AS (SELECT event_id, us, d AS game, user_id, team_id, event_type AS type_name, CASE WHEN value >= 50 THEN 'Successful' ELSE 'Unsuccessful' END AS result_name, value FROM ev)"
SCORES = EV + ", sc AS (SELECT user_id, CAST(event_type = 'purchase' AS BIGINT) AS y, value / (value + 100e0) AS score FROM ev)"
