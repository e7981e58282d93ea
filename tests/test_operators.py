"""Hand-made cases of the operators, against definitions."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from touchline.functions import scalars as S
from touchline.operators import duels as DU, events as EV, frames as FR, metrics as M, pressure as P, series as R, tables as T, temporal as TM, validator as V
from touchline.sources import readers, sinks

COLS = "game_id string, period_id long, frame_id long, id string, team_id string, x double, y double, ord long, ball_owning_team_id string, ball_owning_player_id string"


def frame(spark, rows, f=1):
    return spark.createDataFrame([("g", 1, f, i, t, x, y, k, o, p) for k, (i, t, x, y, o, p) in enumerate(rows)], COLS)


def carrier(spark, rows):
    out = FR.infer_ball_carrier(frame(spark, rows)).collect()
    return ([r.id for r in out if r.is_ball_carrier], out[0].ball_owning_team_id if out else None)


def test_carrier_cases(spark):
    ball = ("ball", None, 0.0, 0.0, None, None)
    assert carrier(spark, [ball, ("a", "H", 24.999, 0.0, None, None)]) == (["a"], "H")
    assert carrier(spark, [ball, ("a", "H", 25.0, 0.0, None, None)]) == ([], None)
    assert carrier(spark, [ball, ("a", "H", 3.0, 0.0, None, None), ("b", "A", 0.0, 3.0, None, None)]) == (["a"], "H")  # a tie: the first
    assert carrier(spark, [ball, ("a", "H", 1.0, 0.0, "A", None), ("b", "A", 9.0, 0.0, "A", None)]) == (["b"], "A")  # a noted team
    assert carrier(spark, [ball, ("a", "H", 1.0, 0.0, "neutral", None), ("b", "A", 9.0, 0.0, "neutral", None)]) == (["a"], "H")
    assert carrier(spark, [ball, ("a", "H", 1.0, 0.0, "H", None), ("b", "H", 9.0, 0.0, "H", "b")]) == (["b"], "H")  # a noted player
    assert carrier(spark, [ball]) == ([], None)
    assert carrier(spark, [("a", "H", 1.0, 0.0, "Unknown", None)]) == ([], "Unknown")  # kept, without a carrier


def series(spark, values):
    return spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, t long, x double")


def ordered(df, col):
    return [r[col] for r in df.orderBy("t").collect()]


def test_interpolation(spark):
    n = None
    assert ordered(R.interpolate(series(spark, [n, 1.0, n, n, 4.0, n]), ["k"], "t", "x", "x"), "x") == [1, 1, 2, 3, 4, 4]
    assert ordered(R.interpolate(series(spark, [n, 1.0, n, 3.0, n]), ["k"], "t", "x", "x", both=False), "x") == [None, 1, 2, 3, 3]
    assert ordered(R.interpolate(series(spark, [n, n]), ["k"], "t", "x", "x"), "x") == [None, None]


@pytest.mark.parametrize("n", [1, 2, 3, 6, 7, 8, 20])
def test_smoothing_is_a_moving_line_fit(spark, n):
    v = np.random.default_rng(n).normal(size=n)
    got = np.array(ordered(R.smooth(series(spark, v.tolist()), ["k"], "t", "x", "x", 7), "x"))
    w = min(7, n if n % 2 else n - 1)
    if w < 3:
        want = v
    else:
        h = w // 2
        want = np.array([v[i - h : i + h + 1].mean() if h <= i < n - h else 0 for i in range(n)])
        for low, span in ((0, range(h)), (n - w, range(n - h, n))):
            line = np.polyfit(np.arange(low, low + w), v[low : low + w], 1)
            for i in span:
                want[i] = np.polyval(line, i)
    assert np.allclose(got, want)


def test_outliers_keep_the_limit_and_null(spark):
    df = spark.createDataFrame([(1, 12.0), (2, 12.01), (3, None), (4, float("nan"))], "t long, v double")
    assert [r.v if r.v is None or not math.isnan(r.v) else "nan" for r in R.mask_outliers(df, "v", 12.0, ["v"]).orderBy("t").collect()] == [12.0, None, None, "nan"]


def test_sessions_split_above_the_gap(spark):
    df = spark.createDataFrame([(1, t) for t in (0, 125, 251, 252)], "k int, t long")
    assert ordered(R.sessions(df, ["k"], "t", 125), "session") == [0, 0, 1, 1]


def test_resample_of_a_grid_is_itself(spark):
    v = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0]
    df = spark.createDataFrame([(1, 40 * i, x) for i, x in enumerate(v)], "k int, t long, x double")
    for how in ("linear", "pchip"):
        assert ordered(R.resample(df, ["k"], "t", "x", 40, how), "x") == v


def test_pchip_keeps_monotone_and_known_slopes(spark):
    df = spark.createDataFrame([(1, t, x) for t, x in ((0, 0.0), (10, 1.0), (20, 4.0), (30, 4.0))], "k int, t long, x double")
    got = ordered(R.resample(df, ["k"], "t", "x", 5, "pchip"), "x")
    assert all(b >= a for a, b in itertools.pairwise(got)) and got[4] == 4.0 and got[5] == 4.0
    # slope at 10: harmonic mean of 0.1 and 0.3; at 0: (3 * 0.1 - 0.3) / 2 = 0
    d1 = 2 / (1 / 0.1 + 1 / 0.3)
    assert math.isclose(got[1], 0.5 - 10 * d1 / 8)


def test_as_of(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (1, 21)], "k int, t long")
    right = spark.createDataFrame([(1, 0, "a"), (1, 10, "b"), (1, 20, "c")], "k int, t long, v string")
    assert ordered(TM.as_of(left, right, ["k"], "t", ["v"], "backward"), "v") == ["a", "b", "c"]
    assert ordered(TM.as_of(left, right, ["k"], "t", ["v"], "forward"), "v") == ["b", "b", None]
    assert ordered(TM.as_of(left, right, ["k"], "t", ["v"], "nearest"), "v") == ["a", "b", "c"]  # 5 is as near to both: the earlier
    assert ordered(TM.as_of_filled(left, right.withColumn("v", F.lit(7)), ["k"], "t", "v"), "v") == [7, 7, 7]


def test_followed_by_includes_both_ends(spark):
    left = spark.createDataFrame([(1, 0, "H"), (1, 100, "H"), (1, 200, "A")], "k int, t long, o string")
    right = spark.createDataFrame([(1, 50, "A"), (1, 151, "A")], "k int, t long, o string")
    assert ordered(TM.followed_by(left, right, ["k"], "t", 50, "o", "hit"), "hit") == [True, False, False]


def test_plan_of_windows_has_one_exchange(spark):
    df = R.kinematics(series(spark, [1.0, 2.0, 4.0]), ["k"], "t", ["x"], 12.0, 6.0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    df.collect()


def test_pairs_need_one_exchange(spark, tmp_path):
    cols = "game_id string, period_id long, frame_id long, id string, team_id string, x double, y double, vx double, vy double, ord long"
    spark.createDataFrame([("g", 1, 1, "ball", None, 0.0, 0.0, 0.0, 0.0, 1), ("g", 1, 1, "a", "H", 1.0, 0.0, 0.0, 0.0, 2)], cols).write.parquet(str(tmp_path / "t"))
    df = P.pairwise(FR.infer_ball_carrier(spark.read.parquet(str(tmp_path / "t"))), 2.0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_pressure_bounds_and_symmetry(spark):
    rows = [("g", 1, 1, "ball", None, 0.0, 0.0, 0.0, 0.0, False), ("g", 1, 1, "c", "H", 0.0, 0.0, 0.0, 0.0, True), ("g", 1, 1, "p", "A", 3.0, 0.0, -4.0, 0.0, False), ("g", 1, 1, "q", "A", 30.0, 0.0, 0.0, 0.0, False)]
    df = spark.createDataFrame(rows, "game_id string, period_id long, frame_id long, id string, team_id string, x double, y double, vx double, vy double, is_ball_carrier boolean")
    got = {(r.presser_id, r.pressed_id): r.p for r in P.pairwise(df, 2.0).collect()}
    assert got["p", "c"] > 0.9 and got["q", "c"] == 0.0 and ("ball", "c") not in got
    assert len(P.pairwise(df, 2.0, method="full", ball_method="exclude").collect()) == 6
    with pytest.raises(ValueError):
        P.pairwise(df, method="none")
    m = P.matrices(P.pairwise(df, 2.0)).first()
    assert m.rows == ["c", "p", "q"] and len(m.probability) == 3


def test_stride_sampling(spark):
    for n in (3, 9, 10, 57):
        df = spark.createDataFrame([(1, i) for i in range(n)], "k int, t long")
        want = list(range(n)) if n < 9 else [int(i * (n / 9)) for i in range(9)]
        assert ordered(FR.stride_sample(df, ["k"], "t", 10), "t") == want


def test_direction_is_settled_once(spark):
    rows = [("g", p, f, i, t, x, 0.0) for p, f in ((1, 1), (2, 2)) for i, t, x in (("ball", None, -50.0), ("a", "A", -40.0), ("h", "H", 40.0))]
    df = spark.createDataFrame(rows, "game_id string, period_id long, frame_id long, id string, team_id string, x double, y double")
    once = FR.normalise_direction(df, "H")
    got = {(r.period_id, r.id): r.x for r in once.collect()}
    assert got[1, "h"] == -40 and got[2, "h"] == 40
    assert FR.leftmost_team(once).first().left_team == "H"


def test_padding_and_tensor(spark):
    df = spark.createDataFrame([("g", 1, 1, "a", "H", 1.0, 2.0), ("g", 1, 1, "ball", None, 0.0, 0.0)], "game_id string, period_id long, frame_id long, id string, team_id string, x double, y double")
    assert FR.pad_agents(df).count() == 11
    assert FR.tensor(df, ["x", "y"], ["id"]).first().tensor == [[1.0, 2.0], [0.0, 0.0]]


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.9), (1, 1, 0.2), (1, 0, 0.1), (2, 1, 0.5)], "k int, y int, s double")
    got = {r.k: r.auroc for r in M.auroc(df, "s", "y", ["k"]).collect()}
    assert got == {1: 0.625, 2: None}
    c = {r.k: r for r in M.confusion(df.where("s < 0.5"), "s", "y", ["k"]).collect()}
    assert (c[1].precision, c[1].recall, c[1].f1) == (0.0, 0.0, 0.0)


def test_tables(spark):
    df = spark.createDataFrame([(1, 1, None, [1]), (1, 2, "b", [1]), (1, 3, "c", [2])], "k int, t int, v string, a array<int>")
    assert T.first_non_null(df, ["k"], ["t"], ["v"]).first().v == "b"
    assert sorted(r.t for r in T.distinct_but(df.drop("v"), ["t"], ["t"]).collect()) == [1, 3]
    assert T.require_matched(df, df.select("k"), "k", set()) is df
    with pytest.raises(ValueError):
        T.require_matched(df.withColumn("k", F.lit(9)), df.select("k"), "k", set())
    f = T.folds(list(range(13)), 6)
    assert all(sorted(i for k, i, _ in f if k == n) == list(range(13)) for n in range(6))
    assert sorted(i for _, i, p in f if p == "test") == list(range(13))


def paired(spark, times):
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(times)], "g int, id long, t double")
    return {r.id: r.pair_id for r in DU.pair_duels(rows, ["g"], "id", "t").collect()}


def test_duels_cost_as_little_as_any_assignment(spark):
    """The runs of the linear programme against every permutation without a fixed point."""
    rng = np.random.default_rng(3)
    for n in range(2, 8):
        for _ in range(3):
            t = np.sort(rng.exponential(1, n).cumsum()).round(2).tolist()
            best = min(sum(abs(t[i] - t[p[i]]) for i in range(n)) for p in itertools.permutations(range(n)) if all(i != p[i] for i in range(n)))
            got = spark.range(1).select(F.explode(DU.runs(DU.cuts(F.array(*map(F.lit, t))))).alias("r")).select("r.*").collect()
            assert sorted(k for r in got for k in range(r["start"], r["start"] + r["size"])) == list(range(n))
            assert math.isclose(sum(2 * (t[r["start"] + r["size"] - 1] - t[r["start"]]) for r in got), best)


def test_duel_pairs(spark):
    assert paired(spark, [0.0, 1.0, 100.0, 103.0]) == {0: 1, 1: 0, 2: 3, 3: 2}
    assert paired(spark, [5.0]) == {0: None} and paired(spark, []) == {}
    assert paired(spark, [0.0, 3.0, 4.0]) == {0: None, 1: 2, 2: 1} and paired(spark, [0.0, 1.0, 2.0]) == {0: 1, 1: 0, 2: None}
    assert paired(spark, [2.0, 2.0, None, 9.0, 2.0]) == {0: 1, 1: 0, 2: None, 3: 4, 4: 3}


def test_duels_of_one_long_period(spark):
    import time

    rows = spark.range(10_000).select(F.lit(1).alias("g"), "id", (F.col("id") * 37 % 10_007).cast("double").alias("t"))
    began = time.time()
    assert DU.pair_duels(rows, ["g"], "id", "t").where("pair_id is not null").count() == 10_000
    assert time.time() - began < 30


NESTED = "event_id int, game_id int, events array<struct<event_name:string,property:map<string,string>>>"


def nested(spark, *lists):
    return spark.createDataFrame([(i, 1, x) for i, x in enumerate(lists)], NESTED)


def names(df):
    return [[e.event_name for e in r.e] for r in df.orderBy("event_id").collect()]


def test_rewrites(spark):
    e = lambda n, **p: (n, p)
    df = nested(spark, [e("Passes"), e("Set Pieces", Type="Corners"), e("Mistakes")], [e("Shots & Goals"), e("Set Pieces", Type="Freekicks")], [e("Crosses"), e("Passes")], [e("Mistakes")], [e("Fouls", Type="Fouls Won")], [e("Saves", Type="Parries")], [e("Fouls", **{"Penalty Kick Won": "True"})], [])
    got = names(df.withColumn("e", EV.simplified(EV.renamed(F.col("events")))))
    assert got == [["Pass_Corner"], ["Shot_Freekick"], ["Cross"], ["Error"], ["Foul Won"], ["Parry"], ["Foul Won"], []]
    with pytest.raises(Exception, match="no action for"):
        nested(spark, [e("Nonsense")]).select(EV.renamed(F.col("events"))).collect()


def test_priorities(spark):
    e = lambda n: (n, {})
    got = EV.by_priority(nested(spark, [e("Pass"), e("Tackle")], [e("Foul Won"), e("Pass")])).orderBy("event_id", "step").collect()
    assert [r.type_name for r in got] == ["Tackle", "Pass", "Pass", "Foul Won"]
    with pytest.raises(Exception, match="equal priorities"):
        EV.by_priority(nested(spark, [e("Pass"), e("Shot")])).collect()


def act(i, t, kind, team="H", player="h1", result="Successful", x=50.0, y=30.0, ex=None, ey=None, rel=None):
    return {"game_id": 1, "period_id": 1, "event_id": i, "time_seconds": float(t), "team_id": team, "player_id": player, "type_name": kind, "result_name": result, "start_x": x, "start_y": y, "end_x": ex, "end_y": ey, "relative_id": rel}


def replay(*acts):
    r = V.Replay([dict.fromkeys(V.COLUMNS) | a for a in acts]).run()
    return [x["type_name"] for x in r.rows], [n[4] for n in r.notes]


def test_validator_families():
    kick = act(1, 0, "Pass", rel=2, ex=50.0, ey=30.0)
    got = act(2, 1, "Pass Received", player="h2")
    assert replay(kick, got) == (["Pass", "Pass Received"], [])
    assert replay(kick, act(3, 1, "Pass", player="h2"))[0] == ["Pass", "Pass Received", "Pass"]
    failed = act(1, 0, "Pass", result="Unsuccessful", ex=50.0, ey=30.0)
    assert replay(failed, act(3, 1, "Pass", "A", "a1"))[0] == ["Pass", "Interception", "Pass"]
    assert replay(failed, act(3, 1, "Pass", "H", "h3"))[0] == ["Pass", "Recovery", "Pass"]
    assert replay(failed, act(3, 1, "Throw-In", "A", "a1"))[0] == ["Pass", "Out", "Throw-In"]
    shot = act(3, 2, "Shot", player="h2", result="Blocked", ex=50.0, ey=30.0)
    assert replay(kick, got, shot, act(4, 3, "Recovery", "A", "a1"))[0] == ["Pass", "Pass Received", "Shot", "Block", "Recovery"]
    assert replay(kick, got, shot | {"result_name": "Off Target"}, act(4, 3, "Recovery", "A", "a1"))[0][3] == "Goal Post"
    assert replay(kick, got, shot | {"result_name": "Goal"}, act(4, 3, "Goal Conceded", "A", "a1"))[0] == ["Pass", "Pass Received", "Shot", "Goal"]
    assert replay(kick, got, act(3, 2, "Foul", "A", "a1"), act(4, 2, "Foul Won", "H", "h2"))[0] == ["Pass", "Pass Received", "Foul"]
    duels = act(3, 1, "Duel", "H", "h3") | {"pair_id": 4}, act(4, 1, "Duel", "A", "a3", "Unsuccessful") | {"pair_id": 3}
    assert replay(kick, *duels)[0] == ["Pass", "Duel"] and replay(kick, *(d | {"pair_id": None} for d in duels))[0] == ["Pass", "Duel", "Duel"]
    r = V.Replay([dict.fromkeys(V.COLUMNS) | a for a in (kick, *duels)]).run().rows[1]
    assert (r["player_id"], r["reactor_player_id"]) == ("h3", "a3")
    assert replay(kick, got, act(3, 5, "Pass", player="h2", x=60.0))[0] == ["Pass", "Pass Received", "Carry", "Pass"]  # far apart
    assert replay(kick, got, act(3, 2, "Goal Post"))[1] == ["Impossible trigger"]


def test_validator_output_replays_clean(spark, sf):
    from touchline.plans import catalogue

    out = V.validate(EV.actions(catalogue.raw_events(spark, sf), "H"))
    rows = [r.asDict() for r in out.orderBy("game_id", "period_id", "action_id").collect()]
    assert len(rows) > 0 and len({(r["game_id"], r["period_id"], r["action_id"]) for r in rows}) == len(rows)


def test_scalars(spark):
    r = spark.range(1).select(S.quantise(F.lit(0.06)).alias("q"), S.quantise(F.lit(0.02)).alias("h"), S.player_code(F.lit("Home"), F.lit(7)).alias("c"), S.min_max(F.lit(3.0), 3.0, 3.0).alias("z"), S.period_seconds(F.lit(6_000_000), F.lit(4)).alias("p")).first()
    assert math.isclose(r.q, 0.08) and r.h == 0.0 and r.c == "H07" and r.z == 0.0 and r.p == 6000 - 5400 - 900
    cell = spark.range(1).select(*S.grid_cell(F.lit(52.5), F.lit(34.0))).first()
    assert tuple(cell) == (103, 0)


def test_readers(spark, tmp_path):
    player = lambda i: {"full_name_en": f"P{i}", "initial_position_name": "GK", "shirt_number": i, "player_id": str(i)}
    meta = {"ground_width": 105.0, "ground_height": 68.0, "home_team": {"team_id": "10", "team_name": "X", "players": [player(1)]}, "away_team": {"team_id": "20", "team_name": "Y", "players": [player(2)]}}
    (tmp_path / "meta.json").write_text(json.dumps(meta))
    (tmp_path / "bad.json").write_text("{no")
    assert readers.json_document(spark, str(tmp_path / "bad.json"), readers.META).count() == 0
    sheet = readers.team_sheet(readers.meta_data(spark, str(tmp_path / "meta.json")))
    assert [(r.team, r.pID, r.xID) for r in sheet.orderBy("pID").collect()] == [("Home", "1", 0), ("Away", "2", 0)]
    f = {"period_order": 0, "match_time": 40, "frame_index": 1, "ball_state": "away", "players": [{"object": "p", "player_id": "1", "x": 1.0, "y": 2.0, "speed": 0.5}], "balls": [{"object": "b", "player_id": None, "x": 3.0, "y": 4.0, "speed": 1.0}]}
    (tmp_path / "frames.jsonl").write_text(json.dumps(f) + "\n\nbroken{\n" + json.dumps(f | {"ball_state": None, "frame_index": 2}) + "\n")
    rows, bad = readers.json_lines(spark, str(tmp_path / "frames.jsonl"), readers.FRAMES)
    assert (rows.count(), bad.count()) == (2, 1)
    t = {(r.frame_id, r.id): r for r in readers.tracking_frames(rows, sheet).collect()}
    assert t[1, "ball"].ball_owning_team_id == "20" and t[1, "1"].team_id == "10" and t[2, "1"].ball_state == "dead" and t[1, "1"].timestamp == 40000
    ev = lambda k: {"data": [{"event_id": k, "period_order": k, "event_time": 5, "events": [{"event_name": "Passes", "property": {"Type": "x"}}]}]}
    for k in (1, 2):
        (tmp_path / f"m_{k}_event.json").write_text(json.dumps(ev(k)))
    assert readers.event_halves(spark, str(tmp_path)).count() == 2


def test_many_matches_at_once(spark, tmp_path):
    for game, home in (("m1", "10"), ("m2", "30")):
        (tmp_path / game).mkdir()
        team = lambda t, p: {"team_id": t, "team_name": t, "players": [{"full_name_en": p, "initial_position_name": "GK", "shirt_number": 1, "player_id": p}]}
        (tmp_path / game / "meta.json").write_text(json.dumps({"ground_width": 105.0, "ground_height": 68.0, "home_team": team(home, "p"), "away_team": team("20", "q")}))
        (tmp_path / game / "frames.jsonl").write_text(json.dumps({"period_order": 0, "match_time": 40, "frame_index": 1, "ball_state": "home", "players": [{"object": "p", "player_id": "p", "x": 1.0, "y": 2.0, "speed": 0.5}], "balls": []}) + "\n")
    sheet = readers.team_sheet(readers.meta_data(spark, str(tmp_path / "*" / "meta.json")))
    t = readers.tracking_frames(readers.json_lines(spark, str(tmp_path / "*" / "frames.jsonl"), readers.FRAMES)[0], sheet)
    assert sorted((r.game_id, r.team_id, r.ball_owning_team_id) for r in t.collect()) == [("m1", "10", "10"), ("m2", "30", "30")]


def test_smoothing_and_series_of_any_length(spark):
    import numpy as np

    for n in (1, 2, 3, 4, 5, 6, 7, 8, 12):
        v = [float((7 * i * i + 3 * i) % 11) for i in range(n)]
        got = [r.s for r in R.smooth(spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "k int, t int, v double"), ["k"], "t", "v", "s", 7).orderBy("t").collect()]
        size = min(7, n - 1 + n % 2)
        for i in range(n):
            low = max(0, min(i - size // 2, n - size))
            want = v[i] if n < 3 else np.polyval(np.polyfit(range(low, low + size), v[low : low + size], 1), i)
            assert abs(got[i] - want) < 1e-9
    long = spark.range(200_000).select(F.lit(1).alias("k"), "id", F.when(F.col("id") % 1000 == 0, F.col("id").cast("double")).alias("v"))  # in linear time
    r = R.interpolate(long, ["k"], "id", "v", "w").agg(F.max(F.abs(F.col("w") - F.least("id", F.lit(199_000)))).alias("off")).first()
    assert r.off < 1e-6


def test_xml(spark, tmp_path):
    events = ["""<Event EventId="1" MatchId="M" EventTime="2023-05-01T15:00:00"><KickOff GameSection="firstHalf" Team="T"><Play Team="T" Player="k" Evaluation="successfullyCompleted"><Pass/></Play></KickOff></Event>""", """<Event EventId="9" EventTime="2023-05-01T15:00:30"/><Event EventId="2" MatchId="M" EventTime="2023-05-01T15:01:05">\n  <Substitution Team="T" PlayerIn="i" PlayerOut="o&amp;&gt;"/></Event>"""]
    events += ["""<Event EventId="3" MatchId="M" EventTime="2023-05-01T15:02:00"><Play Team="U" Player="u" Evaluation="unsuccessful"/></Event>""", """<Event EventId="4" MatchId="M" EventTime="2023-05-01T15:03:00"><OutOfPlay/></Event>""", """<Event EventId="5" MatchId="M" EventTime="2023-05-01T15:45:00"><FinalWhistle GameSection="firstHalf"/></Event>"""]
    (tmp_path / "e.xml").write_text("<P>" + "".join(events) + "</P>")
    (tmp_path / "f.xml").write_text("<P>" + "".join(events).replace('"M"', '"N"').replace("T15", "T18") + "</P>")
    e = readers.event_xml(spark, str(tmp_path / "[ef].xml"))
    mine = sorted((r.event_id, r.eID, r.pID or "", r.outcome) for r in e.where("game_id = 'M'").collect())
    assert mine == [("1", "KickOff_Play_Pass", "k", 1), ("2", "InSubstitution", "i", None), ("2", "OutSubstitution", "o&>", None), ("3", "Play", "u", 0), ("4", "OutOfPlay", "", None), ("5", "FinalWhistle", "", None)]
    k = readers.segments(e)
    assert sorted((r.game_id, r.segment, r.start.minute, r.stop.minute) for r in k.collect()) == [("M", "firstHalf", 0, 45), ("N", "firstHalf", 0, 45)]
    timed = readers.segmented(e, k)
    got = timed.where("event_id = '2' and game_id = 'N'").first()
    assert (got.segment, got.gameclock, got.minute, got.second, got.qualifier["PlayerIn"]) == ("firstHalf", 65.0, 1, 5, "i")
    assert sorted((r.event_id, r.team) for r in readers.by_team(timed).where("game_id = 'M' and tID is null").collect()) == [("4", "T"), ("4", "U"), ("5", "T"), ("5", "U")]
    (tmp_path / "p.xml").write_text('<P><FrameSet GameSection="firstHalf" TeamId="BALL" PersonId="x"><Frame N="1" T="2023-05-01T15:00:00" X="1.0" Y="2.0" Z="0.1" D="0" S="3.0" BallStatus="1" BallPossession="2"/></FrameSet></P>')
    r = readers.position_xml(spark, str(tmp_path / "p.xml")).first()
    assert (r.id, r.x, r.ball_state, r.ball_owner) == ("ball", 1.0, "alive", "away")
    (tmp_path / "i.xml").write_text('<P><General MatchId="7"/><Environment PitchX="105"/></P>')
    assert {(r.section, r.key, r.value) for r in readers.match_info_xml(spark, str(tmp_path / "i.xml")).collect()} == {("General", "MatchId", "7"), ("Environment", "PitchX", "105")}
    assert {r.game_id for r in readers.match_info_xml(spark, str(tmp_path / "i.xml")).collect()} == {"7"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "game_id string, v int")
    sinks.by_match(df, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).where("game_id = 'a'").count() == 1
    sinks.csv(df, str(tmp_path / "c"))
    assert readers.csv_table(spark, str(tmp_path / "c"), "game_id string, v int").count() == 2
    assert sinks.without_matches(df, ["a"]).count() == 1
    assert readers.files_like(spark, str(tmp_path / "c"), "*.csv").count() >= 1


def test_folds_without_the_driver(spark):
    rows = T.fold_parts(spark.range(101), "id", 6).collect()
    for f in range(6):
        mine = [r for r in rows if r.fold == f]
        sizes = {p: sum(r.part == p for r in mine) for p in ("train", "valid", "test")}
        assert len(mine) == 101 and sizes["test"] in (16, 17) and 15 <= sizes["valid"] <= 18
    assert sorted(r.id for r in rows if r.part == "test") == list(range(101))
    assert T.fold_parts(spark.range(0), "id", 6).count() == 0


def test_team_less_events_without_a_segment(spark):
    rows = [("g", "1", "a"), ("g", None, "a"), ("g", None, None), ("g", "1", None)]
    got = readers.by_team(spark.createDataFrame(rows, "game_id string, segment string, tID string")).collect()
    assert sorted((r.segment or "", r.tID or "", r.team) for r in got) == [("", "", "a"), ("", "a", "a"), ("1", "", "a"), ("1", "a", "a")]


def test_stream_forms(spark, tmp_path):
    from touchline.streaming import streams as ST

    from touchline.streaming import stateful as SF

    rows = [("2024-01-02 00:00:00.000", 2, "z", "H", 0.0, 0.0), ("2024-01-01 00:00:00.100", 1, "ball", None, 0.0, 0.0), ("2024-01-01 00:00:00.100", 1, "a", "H", 3.0, 0.0), ("2024-01-01 00:00:00.100", 1, "b", "A", 2.0, 0.0)]
    df = spark.createDataFrame(rows, "s string, frame_id int, id string, team_id string, x double, y double").withColumn("t", F.to_timestamp("s")).drop("s")
    df.write.parquet(str(tmp_path / "in"))
    s = ST.arriving(spark, str(tmp_path / "in"), df.schema)
    assert SF.closed_rows(ST.frame_carriers(s, "t", ["frame_id"]), f"file://{tmp_path}/carriers").first().carrier_id == "b"
    assert SF.closed_rows(ST.session_spans(s, "t", "10 seconds", ["id"]), f"file://{tmp_path}/spans").count() == 3
    assert Window is not None


def test_planes_of_every_carrier_frame(spark, sf):
    from touchline.plans import catalogue as C

    out = C.QUERIES["surface_planes_full"](spark, sf).persist()
    frames = {(r.game_id, r.period_id, r.frame_id): (r.bx, r.by) for r in C.carriers(spark, sf).withColumns({"bx": FR.ball("x"), "by": FR.ball("y")}).where("is_ball_carrier").collect()}
    sizes = {(r.game_id, r.period_id, r.frame_id): r["count"] for r in out.groupBy("game_id", "period_id", "frame_id").count().collect()}
    assert sizes == dict.fromkeys(frames, 5 * 104 * 68)
    for key in (min(frames), max(frames)):
        bx, by = frames[key]
        u, w = int(min(103, max(0, (bx + 52.5) / 105 * 104))) + 0.5, int(min(67, max(0, 68 - (by + 34) / 68 * 68))) + 0.5
        got = {(r.channel, r.ybin, r.xbin): r.value for r in out.where((F.col("game_id") == key[0]) & (F.col("period_id") == key[1]) & (F.col("frame_id") == key[2])).collect()}
        for j in range(68):
            for i in range(104):
                a, b = (103.5 - i - 0.5, 34.5 - j - 0.5), (u - i - 0.5, w - j - 0.5)
                na, nb = math.hypot(*a), math.hypot(*b)
                turn = [(a[0] * b[0] + a[1] * b[1]) / (na + nb + 1e-8), (a[0] * b[1] - a[1] * b[0]) / (na + nb + 1e-8)]
                want = [nb, na, *(min(1.0, max(-1.0, x)) for x in turn), abs(math.atan2(a[1], a[0]))]
                assert all(abs(got[10 + k, j, i] - want[k]) < 2e-6 for k in range(5))
    out.unpersist()


def test_samples_are_padded_and_turned(spark):
    from touchline.operators import samples as SA

    rows = []
    for f in range(1, 8):
        agents = [("ball", None, 1.0, 0.0), ("c", "H", 2.0, 0.0), ("p", "A", 4.0, 0.0)] + ([("x", "A", 9.0, 9.0)] if f == 3 else [])
        rows += [("g", 1, f, i, t, x, y, 1.0, 0.0, 1.0, "MF", i == "c") for i, t, x, y in agents]
    t = spark.createDataFrame(rows, "game_id string, period_id long, frame_id long, id string, team_id string, x double, y double, vx double, vy double, v double, position_name string, is_ball_carrier boolean")
    press = spark.createDataFrame([("g", 1, 7, "c", "p", 1)], "game_id string, period_id long, frame_id long, pressed_id string, presser_id string, label int")
    events = spark.createDataFrame([("g", 1, 5, 3)], "game_id string, period_id long, frame_id long, type_id int")
    s = SA.build_samples(t, press, events, "H", span=5, k=4, size=2).first()
    assert s.frames == [2, 4, 5, 7]  # 3 has another agent count; 2, 4, 5, 6 sampled by stride 4/3
    assert [len(a) for a in s.features] == [5] * 4 and len(s.features[0][0]) == 19
    assert s.features[0][0][0] == -2.0 and s.features[0][1] == [0.0] * 19  # turned, as the carrier is at home; a missing agent
    assert [f[0][18] for f in s.features] == [4.0] * 4
    # pressure matrices of the picked frames, filled up; a sample without one in its press frame, or with an unknown feature, is none
    m = spark.createDataFrame([("g", 1, f, ["c", "p"], ["c", "p", "x"], [[None, 0.25, 0.5], [float(f), None, None]]) for f in (2, 5, 6, 7)], "game_id string, period_id long, frame_id long, rows array<string>, columns array<string>, probability array<array<double>>")
    r = SA.build_samples(t, press, events, "H", span=5, k=4, size=4, matrices=m).first()
    assert r.agent_order == ["c", "p", "Missing_0", "Missing_1", "c", "p", "x", "Missing_2", "ball"]
    assert [p[1][0] for p in r.pressing] == [2.0, 5.0, 7.0] and all(p[0] == [0.0, 0.25, 0.5, 0.0] and p[2] == [0.0] * 4 and len(p) == 4 for p in r.pressing)
    assert SA.build_samples(t, press, events, "H", span=5, k=4, matrices=m.where("frame_id < 7")).count() == 0
    hole = t.withColumn("vx", F.when((F.col("frame_id") != 4) | (F.col("id") != "p"), F.col("vx")))
    assert SA.build_samples(hole, press, events, "H", span=5, k=4).count() == 0
    assert SA.build_samples(hole, press.withColumn("frame_id", F.lit(3).cast("long")), events, "H", span=5, k=4).count() == 1


def test_no_agent_and_no_value_is_cut(spark):
    from touchline.operators import samples as SA

    players = [("ball", None, 1.0, 0.0), ("c", "H", 2.0, 0.0), *((f"p{k:02}", "A", 4.0 + k, 0.0) for k in range(13))]
    rows = [("g", 1, f, i, t, x, y, 1.0, 0.0, 1.0, "MF", i == "c") for f in (6, 7) for i, t, x, y in players]
    t = spark.createDataFrame(rows, "game_id string, period_id long, frame_id long, id string, team_id string, x double, y double, vx double, vy double, v double, position_name string, is_ball_carrier boolean")
    press = spark.createDataFrame([("g", 1, 7, "c", "p12", 1)], "game_id string, period_id long, frame_id long, pressed_id string, presser_id string, label int")
    s = SA.build_samples(t, press, spark.createDataFrame([("g", 1, 5, 3)], "game_id string, period_id long, frame_id long, type_id int"), "H", span=5, k=4).first()
    assert [len(a) for a in s.features] == [27, 27]
    assert [a[0] for a in s.features[0][13:26]] == [-4.0 - k for k in range(13)] and s.features[0][1] == [0.0] * 19
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [4.0])], "k int, vs array<double>")
    assert {r.k: (r.length, r.vs) for r in T.pad_ragged(df, "vs", 2).collect()} == {1: (3, [1.0, 2.0, 3.0]), 2: (1, [4.0, 0.0, 0.0])}
    assert all(len(r.vs) == 5 for r in T.pad_ragged(df, "vs", 5).collect())


def test_raw_frames_to_carriers_and_events(spark):
    from touchline.operators import matches as MA

    rows = [("g", 1, int(t * 50_000), i, 52.5 + dx + t * v, 34.0, 0.0, "alive", None, team, "MF") for t in range(40) for i, dx, v, team in (("ball", 0.0, 0.1, None), ("a", 1.0, 0.1, "H"), ("b", 30.0, 0.0, "A"))]
    raw = spark.createDataFrame(rows, "game_id string, period_id long, timestamp long, id string, x double, y double, v double, ball_state string, ball_owning_team_id string, team_id string, position_name string")
    t = MA.process_tracking(raw, 105.0, 68.0)
    got = t.where("id = 'a'").orderBy("timestamp").collect()
    assert all(r.is_ball_carrier for r in got) and abs(got[20].vx - 2.0) < 1e-6 and abs(got[20].a) < 1e-6 and got[1].frame_id == 1
    assert abs(got[10].x - (1.0 + 10 * 0.08)) < 1e-9
    ev = spark.createDataFrame([("g", 1, 61_000, 1, "H", "b", 1.0, 0.0), ("g", 1, 5_000_000, 2, "H", "a", 4.0, 0.0)], "game_id string, period_id long, time long, event_id long, team_id string, player_id string, x double, y double")
    placed = {r.event_id: r for r in MA.events_on_frames(ev, t).collect()}
    assert (placed[1].frame_id, placed[1].corrected_id, placed[1].was_wrong) == (2, "a", True) and placed[2].frame_id == 48
    assert MA.frames_with_events(t, MA.events_on_frames(ev, t)).count() == 49
    assert "a_x" in MA.positions_wide(t, ["a", "b"]).columns
    e = spark.createDataFrame([("g", "Home", "p", 7, 5, 1), ("g", "Home", "p", 7, 9, 2)], "game_id string, team string, player_id string, number int, time int, session int")
    r = MA.player_table(e).first()
    assert (r.code, r.t0, r.t1, r.session0, r.session1) == ("H07", 5, 9, 1, 2)


def test_results_do_not_follow_the_partitions(spark, sf):
    left = spark.createDataFrame([(1, 0, "a", 7), (1, 0, "a", 7), (1, 5, "b", 8), (1, 3, None, 9)], "g int, t long, o string, x int")
    right = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 16, None)], "g int, t long, o string")
    for n in (1, 4):
        got = TM.followed_by(left.repartition(n), right.repartition(n), ["g"], "t", 10, "o", "hit").collect()
        assert sorted((r.x, r.hit) for r in got) == [(7, True), (7, True), (8, True), (9, False)]
    rows = spark.createDataFrame([(1, 0, 5.0, 2), (1, 0, 3.0, 1), (1, 2, 4.0, 1), (1, 2, 9.0, 2)], "g int, t long, v double, i int")
    for n in (1, 3):
        got = R.resample(rows.repartition(n), ["g"], "t", "v", 1, first_by=["i"]).orderBy("t").collect()
        assert [r.v for r in got] == [3.0, 3.5, 4.0]


def test_replay_does_not_follow_the_partitions(spark, sf):
    from touchline.plans import catalogue

    a = EV.actions(catalogue.raw_events(spark, sf), "H")
    assert {"pair_id", "relative_time", "reactor_team_id", "dx", "dy", "action_id"} <= set(a.columns)
    assert a.where("pair_id is not null").count() > 0 and a.where("relative_time is not null and relative_time < 0").count() == 0
    keys = ["game_id", "period_id", "action_id", "event_id", "type_name", "step"]
    one, two = (sorted(map(tuple, V.validate(x).select(*keys).collect()), key=repr) for x in (a.repartition(3), a.repartition(7, "step")))
    assert one == two
    notes = V.validation_errors(a).collect()
    assert notes and all(n.error for n in notes)


def test_violations_are_found(spark):
    rows = [(1, 10.0, 0.0, 0.0, None, None, "Pass"), (6, 10.0, 0.0, 0.0, 1.0, 1.0, "Pass"), (1, -1.0, 106.0, 0.0, None, 69.0, None)]
    got = EV.violations(spark.createDataFrame(rows, "period_id int, time_seconds double, start_x double, start_y double, end_x double, end_y double, type_name string"))
    assert sorted((r.period_id, r.rule) for r in got.collect()) == [(1, "time"), (1, "type"), (1, "x"), (1, "y"), (6, "period")]
