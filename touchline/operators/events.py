"""Event logs to actions: nested event lists are filtered, renamed, merged, exploded by priority and given end points.

`events` is array<struct<event_name string, property map<string,string>>>. Rewrites are higher-order functions on the
row; what needs neighbours is one window over (game_id, period_id) in event order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S
from .duels import pair_duels
from .series import along, fill_backward, shifted
from .tables import keep_first

#: Names that are no actions.
DROPPED = ["HIR", "MAX_SPEED", "VHIR", "Assists", "Key Passes", "SPRINT", "Set Piece Defence"]
#: Action names by source name.
NAMES = {
    "Turnover": "Error",
    "Shots & Goals": "Shot",
    "Step-in": "Carry",
    "Aerial Control": "Aerial Clearance",
    "Passes": "Pass",
    "Tackles": "Tackle",
    "Blocks": "Block",
    "Set Pieces": "Set-piece",
    "Clearances": "Clearance",
    "Recoveries": "Recovery",
    "Mistakes": "Error",
    "Duels": "Duel",
    "Fouls": "Foul",
    "Crosses": "Cross",
    "Interceptions": "Interception",
    "Offsides": "Offside",
    "Passes Received": "Pass Received",
    "Crosses Received": "Cross Received",
    "Goals Conceded": "Goal Conceded",
    "Take-on": "Take-On",
    "Saves": "Save",
    "Defensive Line Supports": "Defensive Line Support",
    "Own Goals": "Own Goal",
}
#: Which of simultaneous actions comes first.
PRIORITY = {
    0: ["Pass_Freekick", "Shot_Freekick", "Pass_Corner", "Shot_Corner", "Penalty Kick", "Throw-In", "Goal Kick", "Catch", "Parry", "Own Goal", "Goal", "Goal Conceded", "Out", "Goal Post", "Goal Miss"],
    1: ["Defensive Line Support", "Aerial Clearance"],
    2: ["Duel"],
    3: ["Tackle"],
    4: ["Intervention", "Interception", "Block"],
    5: ["Pass Received", "Cross Received", "Ball Received", "Recovery"],
    6: ["Foul Won", "Error", "Carry", "Take-On", "Shot", "Clearance", "Foul", "Foul_Throw", "Handball_Foul", "Deflection", "Offside", "Hit", "Pass", "Cross"],
    7: ["Pause"],
}
#: Common action names; what is missing here is no action there.
COMMON = {
    "Pass_Freekick": "freekick_crossed",
    "Shot_Freekick": "shot_freekick",
    "Pass_Corner": "corner_crossed",
    "Shot_Corner": "corner_crossed",
    "Penalty Kick": "shot_penalty",
    "Throw-In": "throw_in",
    "Goal Kick": "goalkick",
    "Catch": "keeper_save",
    "Parry": "keeper_punch",
    "Interception": "interception",
    "Block": "block",
    "Recovery": "recovery",
    "Carry": "dribble",
    "Take-On": "take_on",
    "Shot": "shot",
    "Clearance": "clearance",
    "Foul": "foul",
    "Foul_Throw": "foul",
    "Handball_Foul": "foul",
    "Pass": "pass",
    "Cross": "cross",
}
#: Set pieces by their source type, as pass and as shot; shots, keeper's actions and passes.
SET_PIECES = {"Throw-Ins": ("Throw-In", None), "Corners": ("Pass_Corner", "Shot_Corner"), "Freekicks": ("Pass_Freekick", "Shot_Freekick"), "Goal Kicks": ("Goal Kick", None), "Penalty Kicks": (None, "Penalty Kick")}
SHOTS = ["Shot", "Shot_Freekick", "Shot_Corner", "Penalty Kick"]
KEEPER = ["Aerial Clearance", "Defensive Line Support", "Catch", "Parry"]
PASSES = ["Pass_Freekick", "Pass_Corner", "Throw-In", "Goal Kick", "Pass", "Cross"]
OWN_PERIOD = ["game_id", "period_id"]
EIGHTEEN_YARDS = 16.4592
LEFT_POST, RIGHT_POST = 0.449 * S.PITCH_WIDTH, 0.551 * S.PITCH_WIDTH


def named(e: Column, *names: str) -> Column:
    return e["event_name"].isin(*names)


def has(events: Column, *names: str) -> Column:
    return F.exists(events, lambda e: named(e, *names))


def as_named(e: Column, name: str | Column) -> Column:
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("event_name"), e["property"].alias("property"))


def prop(e: Column, key: str) -> Column:
    return F.element_at(e["property"], key)


def clean(df: DataFrame, dropped: list[str] = DROPPED) -> DataFrame:
    """Without the dropped names, then without rows left empty, then without repeated ids and rows."""
    df = df.withColumn("events", F.filter("events", lambda e: ~named(e, *dropped))).where(F.size("events") > 0)
    df = keep_first(df, ["game_id", "event_id"], ["event_time"])
    same = [F.to_json("events") if c == "events" else F.col(c) for c in df.columns if c != "event_id"]
    return keep_first(df, same, ["event_id"])


def renamed(events: Column, names: dict[str, str] = NAMES) -> Column:
    """Unknown names are errors."""
    known = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    one = lambda e: F.coalesce(F.try_element_at(known, e["event_name"]), F.raise_error(F.concat(F.lit("no action for "), e["event_name"])).cast("string"))
    return F.transform(events, lambda e: as_named(e, one(e)))


def simplified(events: Column) -> Column:
    """Set pieces take over their pass or shot; errors give way to what they qualify; crosses absorb passes; fouls suffered
    and saves get names of their own."""
    typed = lambda kind: lambda e: prop(e, "Type") == kind
    taken = lambda x, of, target: F.transform(F.filter(x, lambda e: named(e, *of)), lambda e: as_named(e, target))

    def set_piece(kind, of, target):
        return lambda x: F.when(has(x, "Set-piece") & F.exists(x, typed(kind)) & has(x, *of), taken(x, of, target)).otherwise(x)

    won = lambda e: named(e, "Foul") & (F.coalesce(prop(e, "Type") == "Fouls Won", F.lit(False)) | F.coalesce(prop(e, "Penalty Kick Won") == "True", F.lit(False)))
    save = lambda e: F.when(named(e, "Save") & (prop(e, "Type") == "Catches"), as_named(e, "Catch")).when(named(e, "Save") & (prop(e, "Type") == "Parries"), as_named(e, "Parry")).otherwise(e)
    steps = [set_piece(kind, of, target) for kind, pair in SET_PIECES.items() for of, target in zip((["Pass", "Cross"], ["Shot"]), pair, strict=True) if target]
    steps += [
        lambda x: F.when(F.size(x) > 1, F.filter(x, lambda e: ~named(e, "Error"))).otherwise(x),
        lambda x: F.when(has(x, "Cross"), F.filter(x, lambda e: ~named(e, "Pass"))).otherwise(x),
        lambda x: F.when(F.exists(x, won), F.transform(x, lambda e: F.when(named(e, "Foul"), as_named(e, "Foul Won")).otherwise(e))).otherwise(x),
        lambda x: F.transform(x, save),
    ]
    for step in steps:
        events = S.let(events, step)
    return events


def priority(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for p, names in PRIORITY.items():
        out = F.when(name.isin(*names), F.lit(p)).otherwise(out)
    return out


def by_priority(df: DataFrame) -> DataFrame:
    """A row for each event of a list, in priority order: type_name, outcome, step. Equal priorities are an error but for a
    pass or cross with a foul suffered, which follows it."""
    rank = F.transform("events", lambda e: F.struct(priority(e["event_name"]).alias("p"), named(e, "Foul Won").cast("int").alias("late"), e["event_name"].alias("n"), prop(e, "Outcome").alias("o")))
    ok = has(F.col("events"), "Pass", "Cross") & has(F.col("events"), "Foul Won")
    twice = (F.size(F.array_distinct(F.transform(rank, lambda r: r["p"]))) < F.size(rank)) & ~ok
    sorted_ = F.when(twice, F.raise_error(F.concat(F.lit("equal priorities in event "), F.col("event_id").cast("string"))).cast("array<struct<p:int,late:int,n:string,o:string>>")).otherwise(F.array_sort(rank))
    df = df.withColumn("_sorted", sorted_)
    out = df.select(*(c for c in df.columns if c not in ("events", "_sorted")), F.posexplode("_sorted").alias("step", "r"))
    return out.withColumns({"type_name": F.col("r.n"), "outcome": F.col("r.o")}).drop("r")


def taxonomy(df: DataFrame) -> DataFrame:
    """Adds type_id, the name's place in alphabetical order; names without a common action go."""
    known = F.create_map(*(F.lit(x) for kv in COMMON.items() for x in kv))
    common = sorted(set(COMMON.values()))
    df = df.withColumn("common_name", F.try_element_at(known, F.col("type_name"))).where(F.col("common_name").isNotNull())
    return df.withColumn("type_id", (F.array_position(F.array(*map(F.lit, common)), F.col("common_name")) - 1).cast("int"))


def with_receiver(df: DataFrame) -> DataFrame:
    """relative_id, relative_player_id, relative_time of a successful pass: the first reception in the next 9 rows of the game,
    unless the passer made it. The pass then ends where it was received."""
    cols = ["event_id", "player_id", "event_time", "type_name", "start_x", "start_y"]
    w = along(["game_id"], "period_id", "event_time", "event_id", "step").rowsBetween(1, 9)
    r = F.get(F.filter(F.collect_list(F.struct(*cols)).over(w), lambda r: r["type_name"].isin("Pass Received", "Cross Received")), F.lit(0))
    df = df.withColumn("_r", r)
    good = F.col("type_name").isin(*PASSES) & (F.col("outcome") == "Succeeded") & (F.col("_r.player_id") != F.col("player_id"))
    df = df.withColumns({"relative_id": F.when(good, F.col("_r.event_id")), "relative_player_id": F.when(good, F.col("_r.player_id")), "relative_time": F.when(good, F.col("_r.event_time"))})
    there = F.col("relative_id").isNotNull() & F.col("end_x").isNotNull() & F.col("end_y").isNotNull()
    return df.withColumns({"end_x": F.when(there, F.col("_r.start_x")).otherwise(F.col("end_x")), "end_y": F.when(there, F.col("_r.start_y")).otherwise(F.col("end_y"))}).drop("_r")


def fix_ends(df: DataFrame, order: list[str], home: Column) -> DataFrame:
    """End points of shots, clearances, carries and of what has none.

    Shots end beside or in the goal by the zone of start_x (as the source has it), mirrored for the away side; blocked ones
    and those a keeper answers end at the next action. Clearances and set pieces without an end go to the next start,
    carries to the next start that is not an opponent's failed tackle or interception; other actions end where they start."""
    nxt = shifted(["type_name", "result_name", "team_id", "start_x", "start_y"], 1, OWN_PERIOD, *order)
    df = df.withColumn("_n", nxt)
    c = F.col
    shot = c("type_name").isin(*SHOTS)
    low, high = LEFT_POST - EIGHTEEN_YARDS, RIGHT_POST + EIGHTEEN_YARDS
    aim = F.when(c("start_x") < low, low).when(c("start_x") > high, high).otherwise((LEFT_POST + RIGHT_POST) / 2)
    own = c("type_name") == "Own Goal"
    x = F.when(shot, F.lit(S.PITCH_LENGTH)).when(own, F.lit((LEFT_POST + RIGHT_POST) / 2))
    y = F.when(shot, aim).when(own, F.lit(0.0))
    x, y = F.when(home, x).otherwise(S.PITCH_LENGTH - x), F.when(home, y).otherwise(S.PITCH_WIDTH - y)
    answered = shot & ((c("result_name") == "Blocked") | c("_n.type_name").isin(*KEEPER))
    weak = c("_n.type_name").isin("Tackle", "Interception") & (c("_n.result_name") == "Unsuccessful") & (c("_n.team_id") != c("team_id"))
    df = df.withColumn("_free", F.when(~F.coalesce(weak, F.lit(False)), F.struct("_n.start_x", "_n.start_y")))
    df = df.withColumn("_after", fill_backward("_free", OWN_PERIOD, *order))
    pieces = c("type_name").isin("Pass_Freekick", "Shot_Freekick", "Pass_Corner", "Shot_Corner", "Penalty Kick", "Throw-In", "Goal Kick")
    apart = c("type_name").isin("Carry", "Clearance", "Shot", "Pass", "Cross")

    def end(axis: str, fixed: Column) -> Column:
        e, s, n = c(f"end_{axis}"), c(f"start_{axis}"), c(f"_n.start_{axis}")
        e = F.when(F.coalesce(answered, F.lit(False)), n).when(shot | own, fixed).when(c("type_name") == "Clearance", n).when(c("type_name") == "Carry", c(f"_after.start_{axis}")).otherwise(e)
        return F.when(e.isNotNull() | apart, e).when(pieces, n).otherwise(s)

    return df.withColumns({"end_x": end("x", x), "end_y": end("y", y)}).drop("_n", "_free", "_after")


def actions(events: DataFrame, home_team: str) -> DataFrame:
    """Raw nested events to actions: clean, pair duels, flip, simplify, explode, relate, fix.

    Input: game_id, event_id, period_order, event_time (ms), team_id, player_id, x, y, to_x, to_y in [0, 1],
    attack_direction, events. action_id counts a game's actions in order from 0; what has no partner, receiver or reactor has
    null there."""
    df = clean(events).withColumn("period_id", F.col("period_order") + 1)
    duels = df.where(has(F.col("events"), "Duels")).select(*OWN_PERIOD, "event_id", "event_time")
    df = df.join(pair_duels(duels, OWN_PERIOD, "event_id", "event_time"), [*OWN_PERIOD, "event_id"], "left")
    home = F.col("team_id") == home_team
    flip = lambda v, size: S.attack_flip(F.col(v), home, F.col("attack_direction")) * size
    df = df.withColumns({"start_x": flip("x", S.PITCH_LENGTH), "start_y": flip("y", S.PITCH_WIDTH), "end_x": flip("to_x", S.PITCH_LENGTH), "end_y": flip("to_y", S.PITCH_WIDTH), "time_seconds": S.period_seconds(F.col("event_time"), F.col("period_id"))})
    df = by_priority(df.withColumn("events", simplified(renamed(F.col("events")))))
    df = with_receiver(df.withColumn("result_name", S.result_name(F.col("outcome"))))
    order = ["event_time", "event_id", "step"]
    df = fix_ends(df, order, home)
    none = {"reactor_team_id": F.lit(None).cast("string"), "reactor_player_id": F.lit(None).cast("string")}
    more = {
        "action_id": F.row_number().over(along(["game_id"], "period_id", *order)) - 1,
        "relative_time": S.period_seconds(F.col("relative_time"), F.col("period_id")),
        "dx": F.col("end_x") - F.col("start_x"),
        "dy": F.col("end_y") - F.col("start_y"),
    }
    return df.withColumns(none | more).select("game_id", "event_id", "step", "action_id", "period_id", "time_seconds", "relative_time", "team_id", "player_id", "relative_player_id", "reactor_team_id", "reactor_player_id", "type_name", "result_name", "relative_id", "pair_id", "start_x", "start_y", "end_x", "end_y", "dx", "dy")


def violations(df: DataFrame) -> DataFrame:
    """Actions outside the bounds of the schema, with the rule they break."""
    rules = {
        "period": ~F.col("period_id").between(1, 5),
        "time": F.col("time_seconds") < 0,
        "x": ~(F.col("start_x").between(0, S.PITCH_LENGTH) & F.coalesce(F.col("end_x").between(0, S.PITCH_LENGTH), F.lit(True))),
        "y": ~(F.col("start_y").between(0, S.PITCH_WIDTH) & F.coalesce(F.col("end_y").between(0, S.PITCH_WIDTH), F.lit(True))),
        "type": F.col("type_name").isNull(),
    }
    broken = F.filter(F.array(*(F.when(F.coalesce(r, F.lit(True)), F.lit(n)) for n, r in rules.items())), lambda x: x.isNotNull())
    return df.withColumn("rule", F.explode(broken))


def valid_events(names: Column, valid: list[str]) -> Column:
    """Null lists and lists with any valid name."""
    return names.isNull() | F.arrays_overlap(names, F.array(*map(F.lit, valid)))


def nearest_points(ex, ey, px, py, rank, block: int = 256):
    """For each (ex, ey) the place of the nearest of the points (px, py) and its distance; of equally near ones the lower rank's. Both
    sides are sorted by x, so that a block of places meets only the points within reach: those as near in x as a first guess, then
    those as near as the farthest of the block's nearest, which can leave out none that is nearer."""
    import numpy as np

    near, far = np.zeros(len(ex), np.int64), np.zeros(len(ex))
    by_x, order = np.argsort(px, kind="stable"), np.argsort(ex, kind="stable")
    px, py, rank = px[by_x], py[by_x], rank[by_x]
    guess = 2 * np.sqrt((np.ptp(px) + 1) * (np.ptp(py) + 1) / len(px))
    for at in range(0, len(order), block):
        mine = order[at : at + block]
        low, high, reach = ex[mine[0]], ex[mine[-1]], guess
        for _ in range(3):
            a, b = np.searchsorted(px, low - reach, "left"), np.searchsorted(px, high + reach, "right")
            if a == b:
                reach = np.inf
                continue
            dx, dy = ex[mine, None] - px[a:b], ey[mine, None] - py[a:b]
            d = np.sqrt(dx * dx + dy * dy)
            best = d.min(axis=1)
            if best.max() <= reach:
                break
            reach = best.max() * (1 + 1e-9)
        first = np.where(d == best[:, None], rank[a:b], len(rank)).argmin(axis=1)
        near[mine], far[mine] = by_x[a + first], best
    return near, far


def correct_mislabels(events: DataFrame, positions: DataFrame, limit: float = 5.0) -> DataFrame:
    """event rows (game_id, period_id, frame_id, event_id, team_id, player_id, x, y) with player_id set to the nearest player of
    the team in that frame where the labelled one is `limit` or more away, or has no position. Each frame's and team's places of
    events meet its places of players in one task, as numbers: a pair is never a row."""
    import numpy as np
    import pandas as pd

    place = ["game_id", "period_id", "frame_id", "team_id"]
    known = positions.where(F.col("team_id").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    spots = known.groupBy(*place, F.col("x").alias("_px"), F.col("y").alias("_py")).agg(F.min("id").alias("_near"))
    spots = spots.select(*(F.col(c).alias(c) for c in spots.columns))  # both sides may come from one table
    asked = events.where(F.col("team_id").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()).select(*place, "x", "y").distinct()

    def meet(e: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(e) or not len(p):
            return e.assign(_near=None).iloc[:0]
        names = p["_near"].to_numpy()
        rank = np.empty(len(p), np.int64)
        rank[np.argsort(names, kind="stable")] = np.arange(len(p))
        at, _ = nearest_points(*(e[c].to_numpy(float) for c in ("x", "y")), *(p[c].to_numpy(float) for c in ("_px", "_py")), rank)
        return e.assign(_near=names[at])

    kinds = dict(asked.dtypes) | {"_near": dict(positions.dtypes)["id"]}
    found = asked.groupBy(*place).cogroup(spots.groupBy(*place)).applyInPandas(meet, ", ".join(f"{c} {kinds[c]}" for c in [*asked.columns, "_near"]))
    mine = known.select(*place, F.col("id").alias("player_id"), F.col("x").alias("_px"), F.col("y").alias("_py"))
    own = F.sqrt((F.col("x") - F.col("_px")) * (F.col("x") - F.col("_px")) + (F.col("y") - F.col("_py")) * (F.col("y") - F.col("_py")))
    best = events.join(mine, [*place, "player_id"], "left").withColumn("_d", own).groupBy(*events.columns).agg(F.min("_d").alias("_own"))
    wrong = F.coalesce(F.col("_own") >= limit, F.lit(True))
    best = best.join(found, [*place, "x", "y"], "left").select(*events.columns, "_own", "_near")
    return best.withColumns({"corrected_id": F.when(wrong, F.coalesce("_near", "player_id")).otherwise(F.col("player_id")), "was_wrong": wrong}).drop("_near", "_own")
