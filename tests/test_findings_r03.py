"""Each test failed before the finding named in it was settled."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.oracle import connect
from touchline.operators import metrics as M
from touchline.functions import scalars as S
from touchline.plans import catalogue, compositions, mechanisms  # noqa: F401


def test_losses_at_a_score_of_zero(spark):
    """what SQL gives for a probability of 0."""
    df = spark.createDataFrame([("miss", 1, 0.0), ("miss", 1, 0.5), ("right", 0, 0.0), ("usual", 1, 0.5)], "k string, y long, p double")
    got = {r.k: (r.log_loss, r.brier) for r in M.brier_log_loss(df, "p", "y", ["k"]).collect()}
    assert got["miss"] == (math.inf, 0.625) and math.isnan(got["right"][0]) and math.isclose(got["usual"][0], math.log(2))
    got = [r[0] for r in df.orderBy("k", "p").select(S.weighted_log_loss(F.col("p"), F.col("y"), 3.0)).collect()]
    assert got[0] == math.inf and math.isnan(got[2]) and math.isclose(got[3], 3 * math.log(2))


def test_every_window_is_counted(spark, sf):
    """no row is missing from the windows."""
    got = catalogue.QUERIES["stream_window_counts"](spark, sf).agg(F.sum("n"), F.max("start")).first()
    want = connect(sf).execute("SELECT count(*), max(time_bucket(INTERVAL 6 HOURS, ts)) FROM events").fetchone()
    assert tuple(got) == want


def test_a_period_of_many_duels(spark):
    """pairing is linear in a period's duels, and its cut is the cheapest over more than one block of steps."""
    from touchline.operators import duels as DU

    rng = random.Random(5)
    times = sorted(float(rng.randrange(10**7)) for _ in range(6000))
    best = [0.0, math.inf]
    for i in range(2, len(times) + 1):
        best.append(min(best[i - 2] + times[i - 1] - times[i - 2], best[i - 3] + times[i - 1] - times[i - 3] if i > 2 else math.inf))
    cut = DU.runs(DU.cuts(F.from_json(F.lit(str(times)), "array<double>")))
    got = spark.range(1).select(F.explode(cut).alias("r")).select("r.*").collect()
    assert sum(r["size"] for r in got) == 6000 and [r["start"] + r["size"] for r in got] == [6000, *(r["start"] for r in got[:-1])]
    assert sum(times[r["start"] + r["size"] - 1] - times[r["start"]] for r in got) == best[-1]


def test_a_long_period_is_replayed_in_parts():
    """the work of a replay is linear in the period, and parts give what the whole gives."""
    import time

    from touchline.operators import validator as V

    rng = random.Random(3)
    kinds = ["Pass", "Pass Received", "Duel", "Tackle", "Offside", "Throw-In", "Shot", "Foul", "Foul Won", "Goal Conceded", "Block", "Recovery"]

    def period(n):
        for k in range(n):
            own = {"event_id": k, "step": 0, "time_seconds": float(k), "team_id": rng.choice("HA"), "player_id": str(rng.randrange(22)), "type_name": rng.choice(kinds), "result_name": rng.choice(["Successful", "Unsuccessful"])}
            yield dict.fromkeys(V.COLUMNS) | own | {"pair_id": k + 1 if k % 2 else k - 1, "start_x": rng.random() * 100, "start_y": rng.random() * 60}

    rows = list(period(40_000))
    began = time.time()
    replay = V.Replay(iter(rows))
    held, seen = 0, 0
    for part in replay.parts():
        held, seen = max(held, len(replay.rows), len(part)), seen + len(part)
    assert held < 4 * V.PART and seen > 20_000 and time.time() - began < 30
    short = rows[:3000]
    one = V.Replay(short).run()
    V.PART, kept = 10**6, V.PART
    try:
        two = V.Replay(short).run()
    finally:
        V.PART = kept
    assert one.rows == two.rows and one.notes == two.notes


def test_pairs_are_streamed_and_repeated_ids_put_together(spark):
    """No aggregate over all pairs; the carrier and the ball, and repeated ids, are still one pair."""
    from touchline.operators import pressure as P

    rows = [("g", 1, 1, i, t, float(k), float(k * k % 7), 1.0 + k, 0.5, i == "a1") for k, (i, t) in enumerate([("a1", "A"), ("a2", "A"), ("b1", "B"), ("b2", "B"), ("b2", "B"), ("ball", None)])]
    df = spark.createDataFrame(rows, "game_id string, period_id int, frame_id int, id string, team_id string, x double, y double, vx double, vy double, is_ball_carrier boolean")
    got = sorted((r.presser_id, r.pressed_id) for r in P.pairwise(df, 2.0).collect())
    assert got == [("a1", "b1"), ("a1", "b2"), ("a2", "b1"), ("a2", "b2"), ("b1", "a1"), ("b1", "a2"), ("b2", "a1"), ("b2", "a2")]
    cells = {(r.presser_id, r.pressed_id): r.p for r in P.pairwise(df, 2.0, cells=True).collect()}
    assert len(cells) == 16 and {k for k, p in cells.items() if p is not None} == set(got)
    m = P.matrices(P.pairwise(df, 2.0)).first()
    assert m.rows == m.columns == ["a1", "a2", "b1", "b2"] and all(m.probability[i][j] == cells[a, b] for i, a in enumerate(m.rows) for j, b in enumerate(m.columns))
    t = P.matrix_totals(P.pairwise(df, 2.0)).first()
    assert (t.n_rows, t.n_cols) == (4, 4) and math.isclose(t.total, sum(p for p in cells.values() if p is not None))


def test_nearest_players_by_brute_force(spark):
    """Nearest players are found without a row for each pair; ties go to the lower id."""
    from touchline.operators import events as EV

    rng = random.Random(8)
    spot = lambda: (float(rng.randrange(30)), float(rng.randrange(20)))
    p = [("g", 1, 1, rng.choice("HA"), f"p{k:03}", *spot()) for k in range(400)]
    e = [("g", 1, 1 + (k % 50 == 0), rng.choice(["H", "A", None]), f"p{rng.randrange(420):03}", *spot(), k) for k in range(900)]
    frame = "game_id string, period_id int, frame_id int, team_id string, "
    out = EV.correct_mislabels(spark.createDataFrame(e, frame + "player_id string, x double, y double, event_id long"), spark.createDataFrame(p, frame + "id string, x double, y double"))
    got = {r.event_id: (r.corrected_id, r.was_wrong) for r in out.collect()}
    assert len(got) == 900
    for g, per, f, team, who, x, y, k in e:
        near = sorted((math.sqrt((x - q[5]) ** 2 + (y - q[6]) ** 2), q[4]) for q in p if (g, per, f, team) == q[:4])
        own = next((d for d, i in near if i == who), None)
        wrong = own is None or own >= 5
        assert got[k] == ((near[0][1] if near else who) if wrong else who, wrong)


def test_tracking_is_dealt_in_the_session_s_parts(spark, sf):
    """rows packed to a small part of their size are not joined into few tasks."""
    from touchline.plans import adapters as A

    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert A.tracking(spark, sf).select("frame_id", "id", "x").rdd.getNumPartitions() == 13
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_attention_over_a_large_frame():
    """a frame's pairs are taken in blocks of bounded size, and blocks of any size give the same."""
    import numpy as np

    from touchline.operators import attention as AT

    rng = np.random.default_rng(4)
    n, head = 700, AT.Head([[0.5, -0.25], [1.0, 0.5]], [0.3, -0.7], [0.2, 0.9], [0.5, -0.05])
    x, y, team = rng.uniform(-50, 50, n), rng.uniform(-30, 30, n), rng.integers(-1, 2, n)
    h = np.stack([x, y], 1) @ np.asarray(head.w).T
    s = (h @ head.a)[:, None] + (h @ head.b) + head.c[0] * ((team[:, None] == team) & (team >= 0)) + head.c[1] * np.hypot(x[:, None] - x, y[:, None] - y)
    s = np.where(s > 0, s, 0.2 * s)
    np.fill_diagonal(s, -np.inf)
    e = np.exp(s - s.max(1, keepdims=True))
    want, kept = e @ h / e.sum(1, keepdims=True), AT.BLOCK
    try:
        for AT.BLOCK in (1, 5000, 10**7):
            assert np.allclose(AT.attended([h], [head], team, x, y, 0.2), want, rtol=1e-12)
    finally:
        AT.BLOCK = kept


def test_pairs_of_a_frame_in_sql_leave_in_batches(spark):
    """no frame's pairs are held at once; repeated ids are put together as in the column form, whatever a batch holds."""
    import pyarrow as pa

    from touchline.operators import pressure as P, table_functions as TF

    rng = random.Random(9)
    rows = [("g", 1, 1, "ball" if k == 0 else f"p{k % 40:02}", None if k == 0 else "HA"[k % 2], *(rng.uniform(-9, 9) for _ in range(4)), k in (3, 7)) for k in range(60)]
    names = "game_id string, period_id long, frame_id long, id string, team_id string, x double, y double, vx double, vy double, is_ball_carrier boolean"
    want = {(r.presser_id, r.pressed_id): (r.tti, r.p) for r in P.pairwise(spark.createDataFrame(rows, names), 2.0).collect()}
    table, kept = pa.Table.from_pylist([dict(zip([n.split()[0] for n in names.split(", ")], r, strict=True)) for r in rows]), TF.BLOCK
    try:
        for TF.BLOCK in (1, 200, kept):
            parts = list(TF.pressing_pairs(table, 2.0))
            got = {(r["presser_id"], r["pressed_id"]): (r["tti"], r["p"]) for part in parts for r in part.to_pylist()}
            assert sum(map(len, parts)) == len(got) == len(want) and max(map(len, parts)) <= max(60, TF.BLOCK)
            assert all(math.isclose(a, b, rel_tol=1e-9) for k in want for a, b in zip(got[k], want[k], strict=True))
    finally:
        TF.BLOCK = kept


def test_edges_of_a_frame_leave_in_batches(spark):
    """a frame's edges are never held at once, and batches of any size give all of them."""
    import pyarrow as pa

    from touchline.operators import frames as FR

    rows = [("g", 1, f, None if k == 9 else f"p{k % 21}", [None, "H", "A"][k % 3], None if k == 5 else float(k), float(k * k % 7)) for f in (1, 2, 3) for k in range(24 if f != 2 else 1)]
    pairs = [(a, b) for a in rows for b in rows if a[2] == b[2] and None not in (a[3], b[3]) and a[3] != b[3]]
    want = sorted((a[2], a[3], b[3], int(a[4] is not None and a[4] == b[4]), -1.0 if None in (a[5], b[5]) else round(math.dist(a[5:], b[5:]), 9)) for a, b in pairs)
    df = spark.createDataFrame(rows, "game_id string, period_id int, frame_id long, id string, team_id string, x double, y double")
    got = sorted((r.frame_id, r.src, r.dst, r.same_team, -1.0 if r.distance is None else round(r.distance, 9)) for r in FR.agent_edges(df).collect())
    assert got == want and len(got) > 800
    table, kept = pa.Table.from_pylist([dict(zip(df.columns, r, strict=True)) for r in rows if r[2] == 1]), FR.EDGES
    try:
        FR.EDGES = 50
        parts = list(FR.edges_of(table))
        assert max(map(len, parts)) <= 50 and sum(map(len, parts)) == sum(r[0] == 1 for r in want)
    finally:
        FR.EDGES = kept


def test_a_frame_s_rows_are_state_in_batches():
    """state takes a value for each batch of rows, and the carrier is the one of the rows taken one by one."""
    import pandas as pd

    from touchline.streaming import stateful as SF

    class State(list):
        appendValue, get = list.append, list.copy

    class Handle:
        registerTimer, getListState = (lambda self, t: None), (lambda self, *a: State())

    class Late:
        getCurrentWatermarkInMs = lambda self: 10**9

    rng = random.Random(2)
    for turn in range(60):
        spot = lambda: None if rng.random() < 0.05 else float(rng.randrange(-12, 12))
        note = lambda: rng.choice([None] * 9 + ["H", "neutral"]) if turn % 2 else None
        rows = [(f"p{k:02}" if k else "ball", rng.choice("HA") if k else None, spot(), spot(), rng.randrange(10**6), note(), 5) for k in range(turn == 7, 30)]
        rng.shuffle(rows)
        f = SF.Frames(["frame_id"], 6.0, 1)
        f.init(Handle())
        pdf = pd.DataFrame(rows, columns=[*SF.ROW[:6], "at_us"])
        list(f.handleInputRows((1,), iter([pdf[:11], pdf[11:]]), None))
        assert len(f.parts) == 2
        got = [tuple(r) for out in f.handleExpiredTimer((1,), Late(), None) for r in out.itertuples(index=False)]
        _, _, bx, by, *_ = next((r for r in rows if r[0] == "ball"), (None,) * 7)
        players = [r for r in rows if r[0] != "ball"]
        near = sorted((math.sqrt((r[2] - bx) ** 2 + (r[3] - by) ** 2), r[4], r[0], r[1]) for r in players if None not in (r[2], r[3], bx, by))
        noted = min(((r[4], r[5]) for r in players if r[5] is not None), default=(0, None))[1]
        team = noted if noted not in (None, "neutral") else near[0][3] if near and near[0][0] < 6 else None
        best = next((r for r in near if r[3] == team), None)
        assert got == ([(1, best[2], team, best[0])] if best and best[0] < 6 else [])
