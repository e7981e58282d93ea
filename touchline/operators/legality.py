"""Which events of a sequence the rules of play allow, as a prefix scan.

An event is a function from the STATES to themselves: where the rules let it come it leads to their next state, elsewhere to
the one that play goes on from. Such functions compose, and composing is associative, so the state before every event is a
scan: a period's events are cut into blocks of BLOCK, each block's functions are composed, the blocks' compositions are
followed from the kick-off, and each block then follows its own events. No step looks at more than a block or a period's block
compositions, and all is column expressions on arrays of seven numbers. One exchange by period serves every step.

Rules and states are those of the validator, which repairs what this finds. Its replay changes rows as it goes; this reports
on the sequence as it stands. Rows with null types are unknown types: not allowed, the state stays. Ties in time go to
event_id and step; rows alike in all three are in any order. An empty table gives an empty result; other columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import let
from .validator import AFTER_KEEPER, AFTER_TACKLE, BACK, BALL_STATES, FORCED, KICK_OFF, PASSES, RULES

STATES = BALL_STATES
BLOCK = 256
PERIOD = ["game_id", "period_id"]


def conditions(order: list[str]) -> dict[str, list[Column]]:
    """For each condition of the rules whether it holds, state by state."""
    w = Window.partitionBy(*PERIOD).orderBy(*order)
    failed = F.coalesce(F.col("result_name") == "Unsuccessful", F.lit(False))
    last = F.last(F.when(F.col("type_name").isin(*PASSES), F.struct("relative_id")), True).over(w.rowsBetween(-BACK, -1))
    nxt = F.lead(F.coalesce("type_name", F.lit(""))).over(w)
    meant = F.coalesce(last["relative_id"] == F.col("event_id"), F.lit(False))
    follows = lambda types: F.coalesce(nxt.isin(*types), F.lit(True))
    every = lambda c: [c] * len(STATES)
    return {"intended": every(failed | meant), "keeper": every(failed | follows(AFTER_KEEPER)), "tackle": [failed | follows(AFTER_TACKLE[s]) if s in AFTER_TACKLE else F.lit(False) for s in STATES]}


def step_function(order: list[str]) -> Column:
    """array<int>: for each state before the event, the place of the state after it; -1 - place where it may not come."""
    at = {s: k for k, s in enumerate(STATES)}
    holds, kind = conditions(order), F.coalesce("type_name", F.lit(""))
    out = []
    for s in STATES:
        forced = F.create_map(*(F.lit(x) for t, after in FORCED.items() for x in (t, -1 - at[after])))
        value = F.coalesce(F.try_element_at(forced, kind), F.lit(-1 - at[s]))
        for condition in (None, *holds):  # types by what they ask for and where they lead: few branches a state
            leads: dict[str, list[str]] = {}
            for t, rules in RULES.items():
                for states, after, asked in rules:
                    if s in states and asked == condition:
                        leads.setdefault(after or s, []).append(t)
            for after, types in leads.items():
                ok = kind.isin(*types) if condition is None else kind.isin(*types) & holds[condition][at[s]]
                value = F.when(ok, F.lit(at[after])).otherwise(value)
        out.append(value.cast("int"))
    return F.array(*out)


def after(f: Column, state: Column) -> Column:
    """The place of the state that an event leads to from a state's place."""
    return let(F.get(f, state), lambda v: F.when(v < 0, -1 - v).otherwise(v))


def transitions(df: DataFrame, order: tuple[str, ...] = ("time_seconds", "event_id", "step"), block: int = BLOCK) -> DataFrame:
    """df with _before and _after (places in STATES), _legal and _n (the row's number in its period)."""
    order = list(order)
    w = Window.partitionBy(*PERIOD).orderBy(*order)
    rows = df.withColumns({"_f": step_function(order), "_n": F.row_number().over(w) - 1})
    rows = rows.withColumn("_block", F.floor(F.col("_n") / block).cast("int"))
    identity = F.array(*(F.lit(k) for k in range(len(STATES))))
    packed = F.array_sort(F.collect_list(F.struct("_n", "_f", F.struct(*df.columns).alias("row"))))
    blocks = rows.groupBy(*PERIOD, "_block").agg(packed.alias("rows"))
    composed = F.aggregate("rows", identity, lambda acc, r: F.transform(acc, lambda s: after(r["_f"], s)))
    # the state before each block: a period's compositions, followed from the kick-off; the rows stay out of this pass
    chain = blocks.groupBy(*PERIOD).agg(F.array_sort(F.collect_list(F.struct("_block", composed.alias("whole")))).alias("chain"))
    starts = follow(F.transform("chain", lambda b: b["whole"]), F.lit(STATES.index(KICK_OFF)))
    starts = chain.select(*PERIOD, F.posexplode(starts).alias("_block", "start"))
    blocks = blocks.join(starts, [*PERIOD, "_block"])
    states = follow(F.transform("rows", lambda r: r["_f"]), F.col("start"))
    out = blocks.select(F.explode(F.arrays_zip("rows", states.alias("states"))).alias("x"))
    x = F.col("x")
    value = F.get(x["rows"]["_f"], x["states"])
    return out.select("x.rows.row.*", x["rows"]["_n"].alias("_n"), x["states"].alias("_before"), F.when(value < 0, -1 - value).otherwise(value).alias("_after"), (value >= 0).alias("_legal"))


def follow(functions: Column, start: Column) -> Column:
    """The state before each function of an array, from a start."""
    zero = F.struct(start.cast("int").alias("s"), F.array().cast("array<int>").alias("seen"))
    return F.aggregate(functions, zero, lambda a, f: F.struct(after(f, a["s"]).cast("int").alias("s"), F.concat(a["seen"], F.array(a["s"])).alias("seen")))["seen"]


def state_name(place: Column) -> Column:
    return F.get(F.array(*map(F.lit, STATES)), place)


def illegal(df: DataFrame, **how) -> DataFrame:
    """game_id, period_id, event_id, step, type_name, current_state, next_state, error of every event that may not come when
    it does."""
    out = transitions(df, **how).where("not _legal")
    known = F.col("type_name").isin(*sorted({*RULES, *FORCED}))
    error = F.when(F.coalesce(known, F.lit(False)), "Impossible trigger").otherwise("Unknown trigger")
    return out.select(*PERIOD, "event_id", "step", "type_name", state_name(F.col("_before")).alias("current_state"), state_name(F.col("_after")).alias("next_state"), error.alias("error"))
