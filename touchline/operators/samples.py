"""Samples of presses: for each press start, evenly spaced frames before it as padded feature tensors, with a label."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written
from .frames import FRAME, flip_when, frame_features, stride_sample
from .temporal import as_of_filled

FEATURES = ["x", "y", "vx", "vy", "v", "ax", "ay", "a", "is_teammate", "is_goalkeeper", "distance_to_goal", "sin_angle_to_goal", "cos_angle_to_goal", "distance_to_ball", "sin_angle_to_ball", "cos_angle_to_ball", "cos_velocity_angle", "sin_velocity_angle", "type_id"]
PRESS = ["game_id", "period_id", "press_frame"]


def before(presses: DataFrame, rows: DataFrame, t: str, span: int) -> DataFrame:
    """rows of [press_frame - span, press_frame] beside each press: an equi join on time buckets, each press in two."""
    b = F.floor(F.col("press_frame") / span)
    p = presses.select(*PRESS, F.explode(F.array(b, b - 1)).alias("_b"))
    r = rows.withColumn("_b", F.floor(F.col(t) / span))
    return p.join(r, ["game_id", "period_id", "_b"]).where((F.col(t) <= F.col("press_frame")) & (F.col(t) >= F.col("press_frame") - span)).drop("_b")


def picked_frames(tracking: DataFrame, presses: DataFrame, span: int, k: int) -> DataFrame:
    """The press frame and up to k - 1 frames before it that have as many agents, evenly spaced."""
    sizes = tracking.groupBy(*FRAME).agg(F.count("*").alias("n"))
    near = before(presses, sizes, "frame_id", span)
    want = F.max(F.when(F.col("frame_id") == F.col("press_frame"), F.col("n"))).over(Window.partitionBy(*PRESS))
    near = near.withColumn("_want", want).where("n = _want").select(*PRESS, "frame_id")
    last = near.where("frame_id = press_frame")
    return stride_sample(near.where("frame_id < press_frame"), PRESS, "frame_id", k).unionByName(last)


def agents(side: str, features: list[str]):
    """Column: the feature arrays of one side's agents by id."""
    row = F.struct("id", F.array(*(F.coalesce(F.col(f).cast("float"), F.lit(0.0).cast("float")) for f in features)).alias("f"))
    return F.transform(F.array_sort(F.collect_list(F.when(F.col("_side") == side, row))), lambda r: r["f"])


def padded(rows: Column, size: Column, features: list[str]) -> Column:
    """An array of feature arrays, filled with zeros to `size`."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), len(features))
    return F.concat(rows, F.array_repeat(zero, size - F.size(rows)))


def unknown(df: DataFrame, features: list[str]) -> Column:
    """Whether a feature of the row is null or NaN."""
    kinds = dict(df.dtypes)
    return F.exists(F.array(*((F.col(f).isNull() | (F.isnan(f) if kinds[f] in ("double", "float") else F.lit(False))) for f in features)), lambda x: x)


def build_samples(tracking: DataFrame, presses: DataFrame, events: DataFrame, home: str, span: int = 125, k: int = 10, size: int = 11, matrices: DataFrame | Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """sample_id, pressed_id, presser_id, label, frames and features (time, 2 * n + 1 agents, 19 features), n being
    the most agents of a side in any picked frame, `size` at least: none is left out. A sample with a null or NaN feature of any
    agent in any of its frames is none.

    With `matrices` (FRAME, rows, columns, probability: pressure.matrices) also agent_order (ids of the press frame's rows and
    columns, filled with Missing_k to n each, and the ball) and pressing (frames with a matrix in order, n x n, zeros
    beyond the matrix and where it has no pair); a sample whose press frame has no matrix is none. `matrices` may be a function that
    takes the picked frames (FRAME, each once) and gives theirs. Where frames are so large that a sample's matrices are no row,
    give their digests (FRAME, rows, columns, digest: pressure.matrix_digests): the sample then has n_matrices and matrix_digest,
    of its frames' digests in order, agent_order and the size to which its matrices are filled with zeros.

    tracking: frames with carriers and kinematics. presses: game_id, period_id, frame_id, pressed_id, presser_id, label.
    events: game_id, period_id, frame_id, type_id. Coordinates turn so that the press goes from left to right; type_id is that
    of the next event up to the press, else of the last, plus 1, else 0."""
    for c in ("ax", "ay", "a"):
        if c not in tracking.columns:
            tracking = tracking.withColumn(c, F.lit(0.0))
    p = presses.withColumnRenamed("frame_id", "press_frame")
    frames = picked_frames(tracking, p, span, k)
    if callable(matrices):
        frames = written(frames, "frames")  # a few rows, read by the samples and by their matrices
        matrices = matrices(frames.select(*FRAME).distinct())
    known = before(p, events.select("game_id", "period_id", "frame_id", (F.col("type_id") + 1).alias("type_id")), "frame_id", span)
    frames = as_of_filled(frames, known, PRESS, "frame_id", "type_id")
    rows = frames.join(tracking, FRAME)
    turned = F.max(F.when((F.col("frame_id") == F.col("press_frame")) & F.col("is_ball_carrier"), F.col("team_id") == home)).over(Window.partitionBy(*PRESS))
    rows = rows.withColumn("_turn", F.coalesce(turned, F.lit(False)))
    rows = flip_when(rows, F.col("_turn"))
    # a frame may serve several presses: from here on a sample stands for its game
    rows = rows.withColumns({"_game": F.col("game_id"), "game_id": F.concat_ws("-", "game_id", "period_id", "press_frame")})
    rows = frame_features(rows)
    nulls = F.max(unknown(rows, FEATURES)).over(Window.partitionBy("game_id"))
    rows = rows.withColumn("_null", nulls).where(~F.col("_null")).withColumn("_side", F.when(F.col("id") == "ball", "ball").when(F.col("team_id") == home, "home").otherwise("away"))
    sides = rows.groupBy(*FRAME, "_game", "press_frame").agg(*(agents(k, FEATURES).alias(k) for k in ("home", "away", "ball")))
    sides = written(sides, "sides")  # read twice: for its largest side, and for itself
    most = sides.agg(F.greatest(F.lit(size), F.max(F.size("home")), F.max(F.size("away"))).alias("_n"), F.greatest(F.lit(1), F.max(F.size("ball"))).alias("_b")).first()
    n, balls = most["_n"] or size, most["_b"] or 1  # one row of two numbers
    full = F.concat(*(padded(F.col(k), F.lit(m), FEATURES) for k, m in (("home", n), ("away", n), ("ball", balls))))
    tensors = sides.select(*FRAME, "_game", "press_frame", full.alias("f"))
    seq = tensors.groupBy(F.col("game_id").alias("sample_id"), F.col("_game").alias("game_id"), "period_id", "press_frame").agg(F.array_sort(F.collect_list(F.struct("frame_id", "f"))).alias("s"))
    out = seq.join(p, PRESS).select(*PRESS, "sample_id", "pressed_id", "presser_id", "label", F.transform("s", lambda x: x["frame_id"]).alias("frames"), F.transform("s", lambda x: x["f"]).alias("features"))
    if matrices is not None:
        out = out.join(pressing(frames.select(*PRESS, "frame_id"), matrices, n), PRESS)
    return out.drop(*PRESS)


def own_order(n: int) -> Column:
    """Aggregate: agent_order of the press frame."""
    missing = lambda first, count: F.when(count > 0, F.transform(F.sequence(first, first + count - 1), lambda k: F.concat(F.lit("Missing_"), k))).otherwise(F.array().cast("array<string>"))
    more = F.lit(n) - F.size("rows")
    order = F.concat("rows", missing(F.lit(0), more), "columns", missing(F.greatest(F.lit(0), more), F.lit(n) - F.size("columns")), F.array(F.lit("ball")))
    return F.max(F.when(F.col("frame_id") == F.col("press_frame"), order))


def pressing_digests(m: DataFrame, n: int) -> DataFrame:
    """PRESS, n_matrices, matrix_digest of the samples whose press frame has a matrix: pressing() without its arrays."""
    size = [F.greatest(F.lit(n), F.max(F.size(c))) for c in ("rows", "columns")]
    digests = F.transform(F.array_sort(F.collect_list(F.struct("frame_id", "digest"))), lambda x: x["digest"])
    out = m.groupBy(*PRESS).agg(own_order(n).alias("_order"), digests.alias("_digests"), *(c.alias(k) for c, k in zip(size, ("_high", "_wide"), strict=True)))
    return out.where("_order is not null").select(*PRESS, F.size("_digests").alias("n_matrices"), F.xxhash64("_digests", "_high", "_wide", "_order").alias("matrix_digest"))


def pressing(frames: DataFrame, matrices: DataFrame, n: int) -> DataFrame:
    """PRESS, agent_order, pressing of the samples whose press frame has a matrix. Matrices larger than n widen all of theirs."""
    if "digest" in matrices.columns:
        return pressing_digests(frames.join(matrices.select(*FRAME, "rows", "columns", "digest"), FRAME), n)
    cell = F.transform("probability", lambda r: F.transform(r, lambda v: F.coalesce(v.cast("float"), F.lit(0.0).cast("float"))))
    m = frames.join(matrices.select(*FRAME, "rows", "columns", cell.alias("m")), FRAME)
    high, wide = F.greatest(F.lit(n), F.max(F.size("rows")).over(Window.partitionBy(*PRESS))), F.greatest(F.lit(n), F.max(F.size("columns")).over(Window.partitionBy(*PRESS)))
    m = m.withColumns({"_high": high, "_wide": wide})
    row = lambda r: F.concat(r, F.array_repeat(F.lit(0.0).cast("float"), F.col("_wide") - F.size(r)))
    none = F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), F.col("_wide")), F.col("_high") - F.size("m"))
    m = m.withColumn("m", F.concat(F.transform("m", row), none))
    own = own_order(n).alias("agent_order")
    out = m.groupBy(*PRESS).agg(own, F.transform(F.array_sort(F.collect_list(F.struct("frame_id", "m"))), lambda x: x["m"]).alias("pressing"))
    return out.where("agent_order is not null")
