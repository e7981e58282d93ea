"""Operators on tracking frames: rows of (game_id, period_id, frame_id, id), the ball among them as id 'ball'."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import CARRIER_DISTANCE, MAX_BALL_ACCELERATION, MAX_BALL_SPEED, MAX_PLAYER_ACCELERATION, MAX_PLAYER_SPEED, PITCH_LENGTH, PITCH_WIDTH, clip, grid_cell, min_max
from ..session import spread

FRAME = ["game_id", "period_id", "frame_id"]
#: About so many edges leave a task at a time.
EDGES = 1 << 16
FLIPPED = ["x", "y", "vx", "vy", "ax", "ay"]
#: Bounds of the features that are scaled alike for players and ball.
FEATURE_BOUNDS = {"x": (-52.5, 52.5), "y": (-34.0, 34.0), "distance_to_goal": (0.0, 110.0), "distance_to_ball": (0.0, 125.0)} | {f"{f}_{a}": (-1.0, 1.0) for f in ("sin", "cos") for a in ("angle_to_goal", "angle_to_ball", "velocity_angle")}


def of_frame():
    return Window.partitionBy(*FRAME)


def is_ball() -> Column:
    return F.col("id") == "ball"


def ball(col: str) -> Column:
    """`col` of the frame's (first) ball, for every row: a window, no join."""
    return F.min(F.when(is_ball(), F.struct(F.coalesce("id", F.lit("")), F.col(col).alias("c")))).over(of_frame())["c"]


def with_ball_distance(df: DataFrame, dims: int = 2) -> DataFrame:
    """ball_dist of every row; z counts as 0 where it is null."""
    d = [F.col(c) - ball(c) for c in ("x", "y")] + ([F.coalesce("z", F.lit(0.0)) - F.coalesce(ball("z"), F.lit(0.0))] if dims == 3 else [])
    return df.withColumn("ball_dist", F.sqrt(sum((x * x for x in d[1:]), d[0] * d[0])))


def infer_ball_carrier(df: DataFrame, order: str = "ord", limit: float = CARRIER_DISTANCE, dims: int = 2) -> DataFrame:
    """Who has the ball. The owning team is the frame's first noted one unless that is 'neutral', else the team of the
    nearest player within the limit; frames without a team go. The carrier is the first noted owner of that team unless
    'neutral', else its nearest player within the limit. Ties go to the lower `order`. Everything by windows of one frame."""
    for c in ("ball_owning_team_id", "ball_owning_player_id"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    df = with_ball_distance(df, dims)
    player, w = ~is_ball(), of_frame()
    first = lambda cond, c: F.min(F.when(player & cond & F.col(c).isNotNull(), F.struct(order, c))).over(w)[c]
    near = lambda cond: F.min(F.when(player & cond & F.col("ball_dist").isNotNull(), F.struct("ball_dist", order, "id", "team_id"))).over(w)
    df = df.withColumns({"_noted": first(F.lit(True), "ball_owning_team_id"), "_near": near(F.lit(True))})
    team = F.when(F.col("_noted") != "neutral", F.col("_noted")).when(F.col("_near.ball_dist") < limit, F.col("_near.team_id"))
    df = df.withColumn("_team", team).where(F.col("_team").isNotNull())
    mine = F.col("team_id") == F.col("_team")
    df = df.withColumns({"_owner": first(mine, "ball_owning_player_id"), "_best": near(mine)})
    owner = F.when(F.col("_owner") != "neutral", F.col("_owner")).when(F.col("_best.ball_dist") < limit, F.col("_best.id"))
    df = df.withColumn("_player", owner)
    return df.withColumns({"ori_ball_owning_team_id": F.col("ball_owning_team_id"), "ball_owning_team_id": F.col("_team"), "is_ball_carrier": F.coalesce(F.col("id") == F.col("_player"), F.lit(False))}).drop("_noted", "_near", "_team", "_owner", "_best", "_player", "ball_owning_player_id")


def leftmost_team(df: DataFrame, with_ball: bool = False) -> DataFrame:
    """A row for each game: the team of the least x in the first frame of period 1."""
    one = df.where("period_id = 1")
    top = one.groupBy("game_id").agg(F.min("frame_id").alias("frame_id"))  # a row for each game
    rows = one.join(top, ["game_id", "frame_id"]).where(F.col("x").isNotNull() & (F.lit(with_ball) | ~is_ball()))
    return rows.groupBy("game_id").agg(F.min_by("team_id", F.struct("x", "id")).alias("left_team"))


def alive(df: DataFrame) -> DataFrame:
    """Rows of frames in which the ball is in play."""
    return df.where(F.col("ball_state") == "alive")


def with_pressure(tracking: DataFrame, matrices: DataFrame) -> DataFrame:
    """Tracking rows with their frame's pressure matrix (rows, columns, probability) or its totals, null where it has none."""
    return tracking.join(matrices, FRAME, "left")


def orientation(df: DataFrame, home: str) -> DataFrame:
    """home_away if the home team stands left at kick-off (the ball may be the leftmost and is not home), else away_home."""
    left = leftmost_team(df, True)
    return left.select("game_id", F.when(F.col("left_team") == home, "home_away").otherwise("away_home").alias("orientation"))


def normalise_direction(df: DataFrame, home: str) -> DataFrame:
    """Period 2 is turned; then all is turned where the home team did not start on the left."""
    cols = [c for c in FLIPPED if c in df.columns]
    df = df.join(leftmost_team(df), "game_id", "left")
    turns = F.when(F.col("period_id") == 2, -1.0).otherwise(1.0) * F.when(F.col("left_team") == home, 1.0).otherwise(-1.0)
    return df.withColumns({c: F.col(c) * turns for c in cols}).drop("left_team")


def flip_when(df: DataFrame, cond: Column) -> DataFrame:
    return df.withColumns({c: F.when(cond, -F.col(c)).otherwise(F.col(c)) for c in FLIPPED if c in df.columns})


def high_press(x: Column, is_home: Column, line: float = 17.5) -> Column:
    return F.coalesce(F.when(is_home, x >= line).otherwise(x <= -line), F.lit(False))


def frame_features(df: DataFrame) -> DataFrame:
    """Ten features of every row against goal, ball and carrier; all 0 in frames without a ball or a carrier."""
    w = of_frame()
    carrier = F.min(F.when(F.col("is_ball_carrier"), F.struct("id", "team_id", "vx", "vy"))).over(w)
    df = df.withColumns({"_c": carrier, "_bx": ball("x"), "_by": ball("y"), "_has": F.max(is_ball().cast("int")).over(w) == 1})
    c = F.col
    gx, gy, bx, by = 52.5 - c("x"), -c("y"), c("_bx") - c("x"), c("_by") - c("y")
    norm = lambda a, b: F.sqrt(a * a + b * b)
    floor = norm(c("vx"), c("vy")) * norm(c("_c.vx"), c("_c.vy")) + 1e-8
    found = {
        "is_teammate": F.coalesce((c("team_id") == c("_c.team_id")).cast("double"), F.lit(0.0)),
        "is_goalkeeper": F.coalesce((c("position_name") == "GK").cast("double"), F.lit(0.0)),
        "distance_to_goal": norm(gx, gy),
        "sin_angle_to_goal": F.sin(F.atan2(gy, gx)),
        "cos_angle_to_goal": F.cos(F.atan2(gy, gx)),
        "distance_to_ball": norm(bx, by),
        "sin_angle_to_ball": F.sin(F.atan2(by, bx)),
        "cos_angle_to_ball": F.cos(F.atan2(by, bx)),
        "cos_velocity_angle": clip((c("vx") * c("_c.vx") + c("vy") * c("_c.vy")) / floor, -1.0, 1.0),
        "sin_velocity_angle": clip((c("vx") * c("_c.vy") - c("vy") * c("_c.vx")) / floor, -1.0, 1.0),
    }
    there = c("_has") & c("_c").isNotNull()
    return df.withColumns({k: F.when(there, v).otherwise(0.0) for k, v in found.items()}).drop("_c", "_bx", "_by", "_has")


def normalise_features(df: DataFrame) -> DataFrame:
    """Min-max of the continuous features: speeds and accelerations by the limits of players or ball, the rest by fixed
    bounds; what is categorical stays."""
    limit = lambda p, b: F.when(is_ball(), F.lit(b)).otherwise(F.lit(p))
    speed, acc = limit(MAX_PLAYER_SPEED, MAX_BALL_SPEED), limit(MAX_PLAYER_ACCELERATION, MAX_BALL_ACCELERATION)
    out = {c: min_max(F.col(c), -m, m) for m, cs in ((speed, ("vx", "vy")), (acc, ("ax", "ay"))) for c in cs}
    out |= {"v": min_max(F.col("v"), F.lit(0.0), speed), "a": min_max(F.col("a"), F.lit(0.0), acc)}
    out |= {c: min_max(F.col(c), *b) for c, b in FEATURE_BOUNDS.items()}
    return df.withColumns({c: e for c, e in out.items() if c in df.columns})


def without_velocity(df: DataFrame) -> DataFrame:
    return df.drop("vx", "vy", "v", "ax", "ay", "a", "cos_velocity_angle", "sin_velocity_angle")


def binned(df: DataFrame) -> DataFrame:
    cx, cy = grid_cell(F.col("x"), F.col("y"))
    return df.withColumns({"xbin": cx, "ybin": cy})


def surface(df: DataFrame, nx: int = 104, ny: int = 68) -> DataFrame:
    """Sparse channels (frame, channel, ybin, xbin, value) of frames whose rows have `role` pressed (carrier) or presser:
    0-4 the pressers' place, vx, vy, ax, ay; 5-9 the pressed side's. Of agents in one cell the last id counts."""
    rows = binned(df.where(~is_ball() & F.col("x").isNotNull() & F.col("y").isNotNull()))
    base = F.when(F.col("role") == "presser", 0).otherwise(5)
    values = F.array(F.lit(1.0), *(F.coalesce(c, F.lit(0.0)) for c in ("vx", "vy", "ax", "ay")))
    cells = rows.groupBy(*FRAME, "xbin", "ybin", base.alias("base")).agg(F.max_by(values, "id").alias("vs"))
    return cells.select(*FRAME, F.posexplode("vs").alias("k", "value"), "base", "ybin", "xbin").select(*FRAME, (F.col("base") + F.col("k")).alias("channel"), "ybin", "xbin", "value")


def surface_planes(frames: DataFrame, nx: int = 104, ny: int = 68) -> DataFrame:
    """Dense channels of frames with the ball's place (bx, by), in cells: 10 and 11 distance to the ball's and the goal's
    cell, 12 and 13 cosine and sine between them (over the sum of the norms, as the source has it), 14 angle to the goal."""
    ball_x, ball_y = grid_cell(F.col("bx"), F.col("by"), nx, ny)
    goal_x, goal_y = grid_cell(F.lit(52.5), F.lit(0.0), nx, ny)
    grid = F.explode(F.sequence(F.lit(0), F.lit(nx * ny - 1)))
    g = frames.select(*FRAME, (ball_x + 0.5).alias("u"), (ball_y + 0.5).alias("w"), grid.alias("cell"))
    g = g.select(*FRAME, "u", "w", (F.col("cell") % nx).alias("xbin"), F.floor(F.col("cell") / nx).cast("int").alias("ybin"))
    c = F.col
    x, y = c("xbin") + 0.5, c("ybin") + 0.5
    norm = lambda a, b: F.sqrt(a * a + b * b)
    bx, by, gx, gy = c("u") - x, c("w") - y, goal_x + 0.5 - x, goal_y + 0.5 - y
    both = norm(bx, by) + norm(gx, gy) + 1e-8
    planes = [norm(bx, by), norm(gx, gy), clip((bx * gx + by * gy) / both, -1.0, 1.0), clip((gx * by - gy * bx) / both, -1.0, 1.0), F.abs(F.atan2(gy, gx))]
    return g.select(*FRAME, "ybin", "xbin", F.posexplode(F.array(*planes)).alias("k", "value")).select(*FRAME, (c("k") + 10).alias("channel"), "ybin", "xbin", "value")


def surface_teammates(df: DataFrame) -> DataFrame:
    """Sparse channels 15 and 16 in the cells of the presser's teammates: cosine and sine between the presser's velocity and the
    line to them. Rows have is_presser and role."""
    p = F.max(F.when(F.col("is_presser"), F.struct("x", "y", "vx", "vy"))).over(of_frame())
    rows = binned(df.withColumn("_p", p).where((F.col("role") == "presser") & ~F.col("is_presser") & F.col("_p").isNotNull()))
    c = F.col
    tx, ty = c("x") - c("_p.x"), c("y") - c("_p.y")
    den = F.sqrt(c("_p.vx") * c("_p.vx") + c("_p.vy") * c("_p.vy")) * F.sqrt(tx * tx + ty * ty) + 1e-8
    values = F.array(clip((c("_p.vx") * tx + c("_p.vy") * ty) / den, -1.0, 1.0), clip((c("_p.vx") * ty - c("_p.vy") * tx) / den, -1.0, 1.0))
    cells = rows.groupBy(*FRAME, "xbin", "ybin").agg(F.max_by(values, "id").alias("vs"))
    return cells.select(*FRAME, F.posexplode("vs").alias("k", "value"), "ybin", "xbin").select(*FRAME, (F.col("k") + 15).alias("channel"), "ybin", "xbin", "value")


def same_size_frames(df: DataFrame, anchor: DataFrame) -> DataFrame:
    """Rows of the frames that have as many agents as their group's anchor frame; anchor: (game_id, period_id, anchor)."""
    sized = df.withColumn("_n", F.count("*").over(of_frame())).join(anchor, ["game_id", "period_id"])
    want = F.max(F.when(F.col("frame_id") == F.col("anchor"), F.col("_n"))).over(Window.partitionBy("game_id", "period_id", "anchor"))
    return sized.withColumn("_want", want).where("_n = _want").drop("_n", "_want")


def stride_sample(frames: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    """k - 1 evenly spaced rows of each key, floor(i * n / (k - 1)); all of them where there are fewer."""
    w = Window.partitionBy(*keys)
    f = frames.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 2)), lambda i: F.floor(i * (F.col("_n") / F.lit(float(k - 1)))))
    return f.where((F.col("_n") < k - 1) | F.array_contains(picks, F.col("_i").cast("long"))).drop("_i", "_n")


def pad_agents(df: DataFrame, size: int = 11) -> DataFrame:
    """Rows Missing_0, Missing_1, ... with zeros so that each frame and team has `size` agents: (frame, team_id, id, x, y, padded)."""
    have = df.where(~is_ball()).groupBy(*FRAME, "team_id").agg(F.count("*").alias("n"))
    gaps = have.where(F.col("n") < size).select(*FRAME, "team_id", F.explode(F.sequence(F.lit(0), F.lit(size - 1) - F.col("n").cast("int"))).alias("k"))
    gaps = gaps.select(*FRAME, "team_id", F.concat(F.lit("Missing_"), F.col("k")).alias("id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(True).alias("padded"))
    return df.where(~is_ball()).select(*FRAME, "team_id", "id", "x", "y", F.lit(False).alias("padded")).unionByName(gaps)


def tensor(df: DataFrame, features: list[str], order: list[str]) -> DataFrame:
    """A row for each frame: agents by `order`, each an array of float features."""
    row = F.struct(*order, F.array(*(F.col(f).cast("float") for f in features)).alias("f"))
    return df.groupBy(*FRAME).agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["f"]).alias("tensor"))


def edges_of(agents: pa.Table) -> Iterator[pa.RecordBatch]:
    """The edges of one frame's agents, in batches of about EDGES."""
    agents = agents.filter(agents["id"].is_valid()).combine_chunks()
    n = len(agents)
    if n < 2:
        return
    code, team = (agents[c].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in ("id", "team_id"))
    x, y = (agents[c].cast("double").to_numpy() for c in ("x", "y"))
    none = ~(agents["x"].is_valid().to_numpy() & agents["y"].is_valid().to_numpy())
    ids, size = agents["id"].combine_chunks(), max(1, EDGES // n)
    for low in range(0, n, size):
        a, b = np.nonzero(code[low : low + size, None] != code)
        if not len(a):
            continue
        a += low
        d = np.sqrt((x[a] - x[b]) * (x[a] - x[b]) + (y[a] - y[b]) * (y[a] - y[b]))
        same = ((team[a] == team[b]) & (team[a] >= 0)).astype(np.int32)
        edges = {"src": ids.take(pa.array(a)), "dst": ids.take(pa.array(b)), "same_team": pa.array(same), "distance": pa.array(d, mask=none[a] | none[b])}
        yield pa.RecordBatch.from_pydict({c: pa.repeat(agents[c][0], len(a)) for c in FRAME} | edges)


def agent_edges(df: DataFrame) -> DataFrame:
    """Every ordered pair of agents of a frame with same_team and distance. Frames are dealt over the session's shuffle partitions and
    pass one after the other: a task holds a frame's agents and a batch of its edges, and no pair is held by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            codes = [batch[c].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in FRAME]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                if low == high:
                    continue
                mine = tuple(batch[c][int(low)].as_py() for c in FRAME)
                if held and mine != key:
                    yield from edges_of(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(low, high - low))
                key = mine
        if held:
            yield from edges_of(pa.Table.from_batches(held))

    rows, kinds = df.select(*FRAME, "id", "team_id", "x", "y"), dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in FRAME) + f", src {kinds['id']}, dst {kinds['id']}, same_team int, distance double"
    return rows.repartition(spread(df.sparkSession), *FRAME).sortWithinPartitions(*FRAME).mapInArrow(run, schema)

