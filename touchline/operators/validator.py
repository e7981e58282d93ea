"""Repair of action sequences by a state machine: each (game, period) is replayed in order, and what the rules of play
do not allow is merged, completed or noted.

This is the one truly sequential operator: a repair changes what later rows see. Spark deals rows by period and sorts them; a
period's rows stream through one task, which holds only those that a rule can still see (BACK behind, some more ahead), so
time is linear and memory does not grow with the period. Games and periods run in parallel. Rules are tables; code applies
them.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

POSSESSION, TRANSITION, NEUTRAL, SET_PIECE, SHOT, KICK_OFF, PAUSE = "in_possession", "in_transition", "ball_neutral", "set_piece", "post_shot", "kick_off", "pause"
#: The states of play.
BALL_STATES = (POSSESSION, TRANSITION, NEUTRAL, SET_PIECE, SHOT, KICK_OFF, PAUSE)
OPEN = (POSSESSION, TRANSITION, NEUTRAL, SHOT)
BACK, AHEAD = 5, 6
#: Rows that are read ahead at once, many times AHEAD; rows of an output batch.
PART, BATCH = 256, 8192
NEAR = 3.0

#: Type -> (states it may come in, state after it or None for the same, condition).
RULES: dict[str, list[tuple[tuple[str, ...], str | None, str | None]]] = {
    "Pass": [((POSSESSION, KICK_OFF), TRANSITION, None)],
    "Cross": [((POSSESSION,), TRANSITION, None)],
    "Clearance": [((POSSESSION,), TRANSITION, None)],
    "Pass Received": [((TRANSITION, NEUTRAL), POSSESSION, "intended")],
    "Cross Received": [((TRANSITION,), POSSESSION, "intended")],
    "Ball Received": [((TRANSITION, POSSESSION, NEUTRAL), POSSESSION, None)],
    "Recovery": [((NEUTRAL, TRANSITION), POSSESSION, None)],
    "Interception": [((POSSESSION, TRANSITION, NEUTRAL, SHOT), POSSESSION, None)],
    "Intervention": [((NEUTRAL, TRANSITION, POSSESSION), NEUTRAL, None)],
    "Block": [((TRANSITION, NEUTRAL, SHOT), NEUTRAL, None)],
    "Deflection": [((SHOT, TRANSITION), NEUTRAL, None)],
    "Hit": [(OPEN, NEUTRAL, None)],
    "Error": [(OPEN, NEUTRAL, None)],
    "Duel": [((TRANSITION, POSSESSION, NEUTRAL), None, None)],
    "Tackle": [(OPEN, None, "tackle")],
    "Carry": [((POSSESSION,), POSSESSION, None)],
    "Take-On": [((POSSESSION,), POSSESSION, None)],
    "Shot": [((POSSESSION, SET_PIECE), SHOT, None)],
    "Catch": [((SHOT, NEUTRAL, TRANSITION), POSSESSION, None)],
    "Parry": [((SHOT, NEUTRAL, TRANSITION), NEUTRAL, None)],
    "Defensive Line Support": [(OPEN, None, "keeper")],
    "Aerial Clearance": [((TRANSITION, NEUTRAL, SHOT), None, "keeper")],
    "Out": [(OPEN, SET_PIECE, None)],
    "Offside": [(OPEN, SET_PIECE, None)],
    "Handball_Foul": [(OPEN, SET_PIECE, None)],
    "Foul_Throw": [((SET_PIECE,), SET_PIECE, None)],
    "Foul": [(OPEN, SET_PIECE, None), ((KICK_OFF, PAUSE), None, None)],
    "Pass_Corner": [((SET_PIECE,), TRANSITION, None)],
    "Pass_Freekick": [((SET_PIECE,), TRANSITION, None)],
    "Goal Kick": [((SET_PIECE,), TRANSITION, None)],
    "Throw-In": [((SET_PIECE,), TRANSITION, None)],
    "Shot_Corner": [((SET_PIECE,), SHOT, None)],
    "Shot_Freekick": [((SET_PIECE,), SHOT, None)],
    "Penalty Kick": [((SET_PIECE,), SHOT, None)],
    "Goal Post": [((SHOT,), NEUTRAL, None)],
    "Goal Miss": [((SHOT,), NEUTRAL, None)],
    "Goal": [((SHOT, NEUTRAL), KICK_OFF, None)],
    "Own Goal": [((*OPEN, SET_PIECE), KICK_OFF, None)],
    "Pause": [((KICK_OFF, *OPEN, SET_PIECE, PAUSE), PAUSE, None)],
}
#: The state to go on from after a type that came where it may not; others keep the state.
FORCED = (
    dict.fromkeys(["Pass Received", "Recovery", "Interception", "Carry", "Take-On", "Cross Received", "Catch", "Ball Received"], POSSESSION)
    | dict.fromkeys(["Pass", "Cross", "Clearance", "Pass_Corner", "Pass_Freekick", "Goal Kick", "Throw-In"], TRANSITION)
    | dict.fromkeys(["Block", "Intervention", "Parry", "Hit", "Deflection", "Error", "Goal Post", "Goal Miss"], NEUTRAL)
    | dict.fromkeys(["Offside", "Foul", "Foul_Throw", "Handball_Foul", "Foul Won", "Out"], SET_PIECE)
    | dict.fromkeys(["Shot", "Shot_Freekick", "Penalty Kick", "Shot_Corner"], SHOT)
    | dict.fromkeys(["Goal", "Goal Conceded", "Own Goal"], KICK_OFF)
    | {"Pause": PAUSE}
)
SETS = ("Pass_Freekick", "Pass_Corner", "Throw-In", "Shot_Freekick", "Shot_Corner", "Penalty Kick", "Goal Kick")
PASSES = ("Pass", "Cross", "Throw-In", "Pass_Freekick", "Pass_Corner", "Goal Kick")
SHOTS = ("Shot", "Shot_Freekick", "Shot_Corner", "Penalty Kick")
LOOSE, FOULS = ("Deflection", "Block", "Hit"), ("Foul", "Foul Won")
BESIDE = ("Duel", "Aerial Clearance", "Defensive Line Support")
#: What may follow a tackle or a keeper's action, by state.
AFTER_TACKLE = {TRANSITION: ("Interception", "Intervention", *LOOSE, *FOULS), POSSESSION: ("Interception", "Intervention", *FOULS), NEUTRAL: ("Interception", "Intervention", "Ball Received", "Recovery", *FOULS), SHOT: (*LOOSE, *FOULS)}
AFTER_KEEPER = (*SETS, "Catch", "Parry", *LOOSE, *FOULS)
#: Types that need the ball: in transition or with a free ball their possession is made up.
NEEDS_BALL = ("Pass", "Cross", "Carry", "Take-On", "Shot", "Clearance")
#: Types that cannot follow a shot at once: what became of the shot is put before them, by its result.
AFTER_SHOT = ("Duel", "Tackle", "Intervention", "Interception", "Ball Received", "Recovery", "Error", "Clearance", "Pass", "Cross")
OUTCOME_OF_SHOT = {"Blocked": "Block", "Off Target": "Goal Post", "Low Quality Shot": "Goal Miss"}
RESTARTS = ("Pass_Corner", "Shot_Corner", "Throw-In", "Goal Kick")
#: What shows where a shot ended.
FOLLOW_SHOT = ("Deflection", "Hit", "Block", "Parry", "Catch", "Error", "Clearance", "Recovery", "Interception", "Ball Received", "Offside", "Foul", "Intervention")
COLUMNS = ["game_id", "period_id", "event_id", "step", "time_seconds", "team_id", "player_id", "reactor_player_id", "type_name", "result_name", "start_x", "start_y", "end_x", "end_y", "relative_id", "relative_player_id", "relative_time", "pair_id"]
TEXT, WHOLE = {"team_id", "player_id", "reactor_player_id", "type_name", "result_name", "relative_player_id"}, {"event_id", "step", "relative_id", "pair_id"}
KEYS = ["game_id", "period_id"]
NOTE = ["current_state", "next_state", "event", "error"]


class Replay:
    """One period's rows, the state, and the notes. Rows are dicts; a position is an index into those that are held."""

    def __init__(self, rows: Iterable[dict]):
        self.rows, self.state, self.notes = rows, KICK_OFF, []
        self.done: dict[int, dict] = {}  # rows that were repaired or made, by identity: no row is repaired twice

    def ahead(self, i: int) -> list[dict]:
        return self.rows[i + 1 : i + 1 + AHEAD]

    def last(self, i: int, types: tuple[str, ...]) -> dict | None:
        return next((r for r in reversed(self.rows[max(0, i - BACK) : i]) if r["type_name"] in types), None)

    def note(self, row: dict, after: str, error: str) -> None:
        self.notes.append((row["event_id"], self.state, after, row["type_name"], error))

    def made(self, like: dict, name: str, **own) -> dict:
        """An event that the log lacks: null id, an end where it starts."""
        new = dict.fromkeys(COLUMNS) | {k: like[k] for k in ("game_id", "period_id", "time_seconds", "team_id", "player_id", "start_x", "start_y")} | {"type_name": name, "result_name": "Successful"} | own
        new |= {"end_x": own.get("end_x", new["start_x"]), "end_y": own.get("end_y", new["start_y"])}
        self.done[id(new)] = new
        return new

    # conditions

    def allowed(self, i: int) -> str | None:
        """The state after row i, or None if it may not come now."""
        row = self.rows[i]
        for states, after, condition in RULES.get(row["type_name"], ()):
            if self.state in states and (condition is None or getattr(self, f"_{condition}")(i)):
                return after or self.state
        return None

    def _follows(self, i: int, types: tuple[str, ...]) -> bool:
        return i + 1 >= len(self.rows) or self.rows[i + 1]["type_name"] in types

    def _intended(self, i: int) -> bool:
        p = self.last(i, PASSES)
        return self.rows[i]["result_name"] == "Unsuccessful" or (p is not None and p["relative_id"] is not None and p["relative_id"] == self.rows[i]["event_id"])

    def _tackle(self, i: int) -> bool:
        return self.rows[i]["result_name"] == "Unsuccessful" or self._follows(i, AFTER_TACKLE[self.state])

    def _keeper(self, i: int) -> bool:
        return self.rows[i]["result_name"] == "Unsuccessful" or self._follows(i, AFTER_KEEPER)

    # merging of rows that tell one happening

    def unify(self, i: int) -> bool:
        row, later = self.rows[i], self.ahead(i)
        kind = row["type_name"]

        def find(types, ok: Callable[[dict], bool] = lambda r: True):
            return next((k for k, r in enumerate(later) if r["type_name"] in types and ok(r)), None)

        def join(k, name, actor, reactor):
            other = later[k]
            self.rows[i] = row | {"type_name": name, "team_id": actor["team_id"], "player_id": actor["player_id"], "reactor_player_id": reactor["player_id"]}
            self.rows[:] = [r for r in self.rows if r is not other]
            return True

        rival = lambda r: r["team_id"] != row["team_id"]
        if kind in SHOTS and row["result_name"] == "Goal" and (k := find(("Goal Conceded",), rival)) is not None:
            goal = self.made(row, "Goal", reactor_player_id=later[k]["player_id"], start_x=row["end_x"] if row["end_x"] is not None else row["start_x"], start_y=row["end_y"] if row["end_y"] is not None else row["start_y"], time_seconds=later[k]["time_seconds"])
            other = later[k]
            self.rows[:] = [goal if r is other else r for r in self.rows]
            return True
        if kind == "Own Goal" and (k := find(("Goal Conceded",), lambda r: not rival(r))) is not None:
            return join(k, "Own Goal", row, later[k])
        if kind in FOULS and row["reactor_player_id"] is None and (k := find(tuple(f for f in FOULS if f != kind), rival)) is not None and later[k]["reactor_player_id"] is None:
            foul, won = (row, later[k]) if kind == "Foul" else (later[k], row)
            return join(k, "Foul", foul, won)
        if kind == "Duel" and row["pair_id"] is not None and (k := find(("Duel",), lambda r: r["event_id"] == row["pair_id"])) is not None:
            winner, loser = (later[k], row) if later[k]["result_name"] == "Successful" else (row, later[k])
            return join(k, "Duel", winner, loser)
        if kind == "Offside" and (k := find(SETS)) is not None and any(r["type_name"] != "Foul" for r in later[:k]):
            gone = [r for r in later[:k] if r["type_name"] != "Foul"]
            self.rows[:] = [r for r in self.rows if not any(r is g for g in gone)]
            return True
        return False

    # repairs: each returns rows to stand instead of row i, or None

    def repaired(self, i: int) -> list[dict] | None:
        row = self.rows[i]
        kind, before = row["type_name"], self.rows[i - 1] if i else None
        middle = lambda r: (r["time_seconds"] + row["time_seconds"]) / 2
        if kind in RESTARTS and self.state in OPEN and before is not None:
            at = {"start_x": row["start_x"], "start_y": row["start_y"]} if kind == "Throw-In" or before["end_x"] is None else {"start_x": before["end_x"], "start_y": before["end_y"]}
            time = before["relative_time"] if before["relative_time"] is not None else min(before["time_seconds"] + 3, middle(before))
            return [self.made(before, "Out", time_seconds=time, **at), row]
        if self.state == SHOT and kind in AFTER_SHOT and (shot := self.last(i, SHOTS)) is not None:
            return self._answer(i, shot, middle(shot))
        if self.state == SHOT and kind == "Shot":
            return [self.made(row, "Recovery", time_seconds=middle(before) if before else row["time_seconds"]), row]
        if kind in NEEDS_BALL and self.state == TRANSITION and (p := self.last(i, PASSES)) is not None:
            if p["result_name"] == "Successful":
                k = next((k for k, r in enumerate(self.ahead(i)) if p["relative_id"] is not None and r["event_id"] == p["relative_id"]), None)
                if k is not None:
                    got = self.rows.pop(i + 1 + k)
                else:
                    got = self.made(p, "Pass Received", player_id=p["relative_player_id"], time_seconds=p["relative_time"] if p["relative_time"] is not None else middle(p), start_x=p["end_x"], start_y=p["end_y"])
                return [got, row]
            return [self.made(row, "Recovery", time_seconds=middle(p)) if p["team_id"] == row["team_id"] else self.made(row, "Interception"), row]
        if kind in NEEDS_BALL and self.state == NEUTRAL and before is not None:
            mine = before["team_id"] == row["team_id"]
            return [self.made(row, "Ball Received") if mine else self.made(row, "Recovery", time_seconds=middle(before)), row]
        if kind == "Tackle" and self.state in (TRANSITION, POSSESSION, NEUTRAL) and i + 1 < len(self.rows):
            keeps = self.rows[i + 1]["player_id"] == row["player_id"]
            return [row, self.made(row, "Interception" if keeps else "Intervention")]
        if kind in ("Defensive Line Support", "Aerial Clearance") and i + 1 < len(self.rows):
            return [row, self.made(row, "Catch" if self.rows[i + 1]["player_id"] == row["player_id"] else "Parry")]
        if kind == "Recovery" and self.state == POSSESSION and before is not None:
            x, y = (before["end_x"], before["end_y"]) if before["end_x"] is not None else (before["start_x"], before["start_y"])
            return [self.made(before, "Intervention", time_seconds=middle(before), start_x=x, start_y=y), row]
        if kind == "Block" and self.state == POSSESSION:
            k = min((k for k, r in enumerate(self.ahead(i)) if r["type_name"] in (*PASSES, *SHOTS)), key=lambda k: abs(self.ahead(i)[k]["time_seconds"] - row["time_seconds"]), default=None)
            if k is not None:
                hit = self.rows.pop(i + 1 + k)
                return [hit, row]
        if kind in ("Pass Received", "Cross Received"):
            p = self.last(i, PASSES)
            k = next((k for k, r in enumerate(self.ahead(i)) if p is not None and p["relative_id"] is not None and r["event_id"] == p["relative_id"]), None)
            return [self.rows.pop(i + 1 + k), row] if k is not None else []
        if kind == "Foul Won":
            return []
        if kind == "Goal Conceded":
            return self._goal(i)
        return None

    def _answer(self, i: int, shot: dict, time: float) -> list[dict] | None:
        """What became of the shot before row i."""
        row = self.rows[i]
        name = OUTCOME_OF_SHOT.get(shot["result_name"]) or ("Block" if shot["result_name"] == "On Target" and row["type_name"] in ("Clearance", "Pass", "Cross") else None)
        if name is None:
            return None
        who = shot
        if name == "Block":
            rival = row if row["team_id"] != shot["team_id"] else next((r for r in reversed(self.rows[max(0, i - BACK) : i + 1 + AHEAD]) if r["team_id"] != shot["team_id"]), None)
            if rival is None:
                return None
            who = rival if rival is row else rival | {"player_id": None}
        x, y = (shot["end_x"], shot["end_y"]) if shot["end_x"] is not None else (shot["start_x"], shot["start_y"])
        return [self.made(who, name, time_seconds=time, start_x=x, start_y=y), row]

    def _goal(self, i: int) -> list[dict]:
        """A conceded goal without one scored: the last shot scored it, else an own goal, else a shot is made up."""
        row = self.rows[i]
        shot = self.last(i, SHOTS)
        if shot is not None and shot["team_id"] != row["team_id"]:
            return [self.made(shot, "Goal", time_seconds=row["time_seconds"], reactor_player_id=row["player_id"])]
        last = self.rows[i - 1] if i else None
        if last is None or last["team_id"] == row["team_id"]:
            return [self.made(row, "Own Goal", player_id=last["player_id"] if last else None, reactor_player_id=row["player_id"])]
        return [self.made(last, "Shot", result_name="Goal"), self.made(last, "Goal", time_seconds=row["time_seconds"], reactor_player_id=row["player_id"])]

    # what legal rows bring with them

    def _next_move(self, i: int) -> dict | None:
        return next((r for r in self.ahead(i) if r["type_name"] not in ("Goal Conceded", *BESIDE) and not (r["type_name"] == "Tackle" and r["result_name"] == "Unsuccessful")), None)

    def add_carry(self, i: int) -> None:
        row = self.rows[i]
        if i + 1 >= len(self.rows) or row["type_name"] in ("Carry", "Catch", "Tackle", *BESIDE):
            return
        nxt = self._next_move(i) or self.rows[i + 1]
        if None in (row["start_x"], nxt["start_x"]) or np.hypot(nxt["start_x"] - row["start_x"], nxt["start_y"] - row["start_y"]) < NEAR:
            return
        merged = self.rows[i + 1]["type_name"] == "Carry"
        end = ("end_x", "end_y") if merged and nxt["end_x"] is not None else ("start_x", "start_y")
        carry = self.made(row, "Carry", time_seconds=row["time_seconds"] + 1e-3, end_x=nxt[end[0]], end_y=nxt[end[1]])
        self.note(carry | {"event_id": row["event_id"]}, self.state, "Dribble Add")
        self.rows[i + 1 : i + 1 + merged] = [carry]

    def check_end(self, i: int) -> None:
        row, nxt = self.rows[i], self._next_move(i)
        if nxt is None or row["type_name"] not in NEEDS_BALL or None in (row["end_x"], nxt["start_x"]):
            return
        far = np.hypot(row["end_x"] - nxt["start_x"], row["end_y"] - nxt["start_y"]) > NEAR
        moved = self.state == TRANSITION or (self.state == POSSESSION and row["type_name"] == "Carry") or (self.state == SHOT and nxt["type_name"] in FOLLOW_SHOT)
        if far and moved:
            self.rows[i] = row | {"end_x": nxt["start_x"], "end_y": nxt["start_y"]}

    def run(self) -> Replay:
        self.rows = [r for part in self.parts() for r in part]
        return self

    def parts(self) -> Iterator[list[dict]]:
        """The repaired rows in order, part by part; notes are added before the part they belong to."""
        rest, self.rows, i = iter(self.rows), [], 0
        while True:
            if i >= PART + BACK:
                part = self.rows[: i - BACK]
                del self.rows[: i - BACK]
                self.done = {id(r): r for r in self.rows if id(r) in self.done}
                i = BACK
                yield part
            if len(self.rows) - i < PART:
                self.rows += itertools.islice(rest, PART)
            if i >= len(self.rows):
                break
            if self.unify(i):  # a row less, or a goal for a goal conceded: never without end
                continue
            row = self.rows[i]
            after = self.allowed(i)
            if after is not None:
                self.state = after
                if after == POSSESSION:
                    self.add_carry(i)
                self.check_end(i)
                i += 1
                continue
            new = self.repaired(i) if id(row) not in self.done else None
            if new is not None:
                self.note(row, self.state, "Resolved")
                self.done[id(row)] = row
                self.rows[i : i + 1] = new
                continue
            self.note(row, FORCED.get(row["type_name"], self.state), "Impossible trigger" if row["type_name"] in FORCED or row["type_name"] in RULES else "Unknown trigger")
            self.state = FORCED.get(row["type_name"], self.state)
            i += 1
        yield self.rows


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows with null for NaN."""
    return ({k: None if v != v else v for k, v in r.items()} for b in batches for r in b.to_pylist())


def _schema(df: DataFrame) -> str:
    types = dict(df.dtypes)
    kind = lambda c: "string" if c in TEXT else "long" if c in WHOLE else types[c] if c in KEYS else "double"
    return ", ".join(f"{c} {kind(c)}" for c in COLUMNS)


def complete(df: DataFrame) -> DataFrame:
    """df with every column of COLUMNS, null where it has none."""
    missing = {c: F.lit(None).cast("string" if c in TEXT else "long" if c in WHOLE else "double") for c in COLUMNS if c not in df.columns}
    return df.withColumns(missing).select(*COLUMNS) if missing else df.select(*COLUMNS)


def replayed(df: DataFrame) -> DataFrame:
    """One replay of each (game_id, period_id): the repaired rows with action_id in order, and the notes as rows without one
    (event_id, current_state, next_state, event, error)."""
    df = complete(df)
    order = ["game_id", "period_id", *(F.col(c).asc_nulls_last() for c in ("time_seconds", "event_id", "step"))]

    def lines(replay: Replay, key: dict) -> Iterator[dict]:
        n = itertools.count()
        for part in replay.parts():
            yield from (r | {"action_id": next(n)} for r in part)
            yield from (key | dict(zip(["event_id", *NOTE], note, strict=True)) for note in replay.notes)
            replay.notes.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (first := next(batches, None)) is None:
            return
        kind = lambda c: pa.string() if c in TEXT or c in NOTE else pa.int64() if c in WHOLE or c == "action_id" else first.schema.field(c).type if c in KEYS else pa.float64()
        schema = pa.schema([(c, kind(c)) for c in [*COLUMNS, "action_id", *NOTE]])
        periods = itertools.groupby(_rows(itertools.chain([first], batches)), key=lambda r: tuple(r[k] for k in KEYS))
        out = itertools.chain.from_iterable(lines(Replay(rows), dict(zip(KEYS, key, strict=True))) for key, rows in periods)
        while block := list(itertools.islice(out, BATCH)):
            yield pa.RecordBatch.from_pylist(block, schema=schema)

    return df.repartition(*KEYS).sortWithinPartitions(*order).mapInArrow(run, _schema(df) + ", action_id long, " + ", ".join(f"{c} string" for c in NOTE))


def validate(df: DataFrame) -> DataFrame:
    """The repaired rows, with action_id in order inside each (game_id, period_id)."""
    return replayed(df).where("action_id is not null").drop(*NOTE)


def validation_errors(df: DataFrame) -> DataFrame:
    """(game_id, period_id, event_id, current_state, next_state, event, error) of every repair and impossible row."""
    return replayed(df).where("action_id is null").select("event_id", *NOTE, "game_id", "period_id")
