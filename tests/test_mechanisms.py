"""The operators that carry a Spark mechanism of their own, against plain loops, restarts and other layouts."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import attention as AT, boosting as BO, frames as FR, legality as L, pressure as P, sketches as SK, table_functions as TF, training as TR, validator as V, variants as VA
from touchline.session import shared_folder
from touchline.sources import position_feed as PF, readers
from touchline.streaming import stateful as SF, streams as ST

ACTION = "game_id long, period_id int, event_id long, step int, time_seconds double, type_name string, result_name string, relative_id long"


# legality

def sequence(seed, n, period=1):
    rng = np.random.default_rng(seed)
    names = [*V.RULES, "Foul Won", "No Such Type", None]
    common = ["Pass", "Pass Received", "Shot", "Out", "Throw-In", "Recovery"]
    out = []
    for i in range(n):
        name = rng.choice(common) if rng.random() < 0.6 else names[int(rng.integers(len(names)))]
        out.append((1, period, i, 0, float(i // 2), None if name is None else str(name), str(rng.choice(["Successful", "Unsuccessful"])), int(i + rng.integers(1, 3)) if rng.random() < 0.5 else None))
    return out


def replayed(rows):
    """Before, after, legal of each event, by the validator's own rules, one event at a time."""
    r = V.Replay([dict.fromkeys(V.COLUMNS) | dict(zip([c.split()[0] for c in ACTION.split(", ")], row)) for row in rows])
    out = []
    for i, row in enumerate(r.rows):
        after = r.allowed(i)
        before = r.state
        r.state = after if after is not None else V.FORCED.get(row["type_name"], before)
        out.append((row["event_id"], before, r.state, after is not None))
    return out


@pytest.mark.parametrize("block", [1, 3, 16, 256])
def test_legality_is_the_replay_without_repairs(spark, block):
    rows = sequence(1, 150) + sequence(2, 40, 2) + sequence(3, 1, 3)
    want = sorted([(p, *x) for p in (1, 2, 3) for x in replayed([r for r in rows if r[1] == p])])
    df = L.transitions(spark.createDataFrame(rows, ACTION).repartition(5), block=block)
    got = df.select("period_id", "event_id", L.state_name(F.col("_before")), L.state_name(F.col("_after")), "_legal").collect()
    assert sorted(map(tuple, got)) == want
    assert {True, False} == {w[-1] for w in want} and len({w[2] for w in want}) >= 6


def test_legality_runs_in_the_jvm(spark):
    df = L.illegal(spark.createDataFrame(sequence(4, 30), ACTION))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert {r.error for r in df.collect()} == {"Impossible trigger", "Unknown trigger"}
    assert L.illegal(spark.createDataFrame([], ACTION)).count() == 0


# stateful streams

def write_part(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def at(seconds):
    return dt.datetime.fromtimestamp(1_000_000 + seconds, dt.timezone.utc)


def test_sessions_go_on_after_a_restart_and_with_late_rows(spark, tmp_path):
    """Three runs from one checkpoint; rows come late within the delay, join sessions and join two into one."""
    schema, folder, state = "k string, t timestamp, v double", f"file://{tmp_path}/in", f"file://{tmp_path}/state"
    parts = [
        [("a", at(0), 1.0), ("a", at(50), 2.0), ("a", at(300), 4.0), ("b", at(10), None), (None, at(5), 1.0)],
        [("a", at(100), 8.0), ("b", at(350), 16.0), ("a", at(390), 0.5), ("b", None, 3.0)],  # 100 is late and joins the first session
        [("a", at(330), 32.0), ("a", at(900), 64.0), ("b", at(425), 128.0), ("b", at(340), 3.0)],
        [("z", at(100_000), 0.0)],  # moves the watermark past all of them
    ]
    for i, part in enumerate(parts):
        write_part(spark, folder, part, schema)
        s = SF.sessions(ST.arriving(spark, folder, schema), ["k"], "t", "v", 60_000_000, "400 seconds")
        SF.to_files(s, f"file://{tmp_path}/out", state)
    got = sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/out").collect()), key=repr)

    def batch(rows):
        out = []
        for k in ("a", "b", None, "z"):
            run = None
            for t, v in sorted((int(t.timestamp() * 1e6), v or 0.0) for q, t, v in rows if q == k and t is not None):
                if run and t - run[2] <= 60_000_000:
                    run = (k, run[1], t, run[3] + 1, run[4] + v)
                else:
                    out += [run] if run else []
                    run = (k, t, t, 1, v)
            out += [run] if run else []
        return out

    want = batch([r for p in parts for r in p])
    assert got == sorted((w for w in want if w[0] != "z"), key=repr)


def test_stream_carriers_are_the_batch_operators(spark, tmp_path):
    rng = np.random.default_rng(8)
    schema = "game_id string, period_id long, frame_id long, time timestamp, id string, team_id string, x double, y double, ord long, ball_owning_team_id string"
    rows = []
    for f in range(40):
        owner = [None, "H", "A", "neutral"][f % 4]
        rows += [("g", 1, f, at(f), "ball", None, float(rng.uniform(-50, 50)), float(rng.uniform(-30, 30)), 0, owner)] if f % 9 else []
        rows += [("g", 1, f, at(f), f"p{k}", "HA"[k % 2], None if rng.random() < 0.1 else float(rng.uniform(-50, 50)), float(rng.uniform(-30, 30)), k + 1, owner) for k in range(int(rng.integers(0, 9)))]
    folder = f"file://{tmp_path}/in"
    for i in range(0, 40, 20):  # two files, one run each
        part = [r for r in rows if i <= r[2] < i + 20]
        write_part(spark, folder, part, schema)
        SF.to_files(SF.frame_carriers(ST.arriving(spark, folder, schema), "time", FR.FRAME), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    write_part(spark, folder, [("z", 1, 0, at(10_000), "ball", None, 0.0, 0.0, 0, None)], schema)
    SF.to_files(SF.frame_carriers(ST.arriving(spark, folder, schema), "time", FR.FRAME), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    got = {(r.frame_id, r.carrier_id, r.owning_team) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    batch = FR.infer_ball_carrier(spark.createDataFrame(rows, schema).drop("time")).where("is_ball_carrier")
    assert got == {(r.frame_id, r.id, r.ball_owning_team_id) for r in batch.collect()} and len(got) > 10


# training

def labelled(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 3))
    y = (x[:, 0] - 2 * x[:, 1] * x[:, 2] + rng.standard_normal(n) * 0.5 > 0).astype(float)
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows + [(n, None, 1.0, 1.0, 1.0), (n + 1, math.nan, 1.0, 1.0, 0.0), (n + 2, 1.0, 1.0, 1.0, None)], "id long, a double, b double, c double, y double"), x, y


def test_weights_are_the_same_in_every_layout(spark, monkeypatch):
    monkeypatch.setattr(TR, "BATCH_ROWS", 100)
    df, _, _ = labelled(spark)
    found = [TR.fit(df.repartition(n), "id", ["a", "b", "c"], "y", TR.Perceptron(3), rounds=6) for n in (1, 7)]
    assert np.array_equal(found[0][0], found[1][0]) and found[0][1] == found[1][1]


def test_descent_is_the_plain_gradient(spark):
    df, x, y = labelled(spark, 500)
    w, report = TR.fit(df, "id", ["a", "b", "c"], "y", TR.Logistic(3), rounds=15, rate=0.5, method="descent", valid=0.0)
    v, best, low = np.zeros(4), None, math.inf
    ones = np.c_[x, np.ones(len(x))]
    for k in range(16):
        s = ones @ v
        loss = float(np.mean(np.logaddexp(0, s) - y * s))
        assert math.isclose(report[k]["loss"], loss, rel_tol=1e-9) and report[k]["held_loss"] is None
        best, low = (v.copy(), loss) if loss < low else (best, low)
        v = v - 0.5 * (ones.T @ (1 / (1 + np.exp(-s)) - y)) / len(y)
    assert np.allclose(w, best, atol=1e-9)


def test_perceptron_gradient():
    m = TR.Perceptron(3, 4)
    rng = np.random.default_rng(2)
    x, y, w = rng.standard_normal((9, 3)), rng.integers(0, 2, 9).astype(float), rng.standard_normal(m.size)
    loss = lambda w: TR.losses(m.score(w, x), y, 1.7)[0].sum()
    g = m.gradient(w, x, TR.losses(m.score(w, x), y, 1.7)[1])
    for i in range(m.size):
        e = np.eye(m.size)[i] * 1e-6
        assert math.isclose((loss(w + e) - loss(w - e)) / 2e-6, g[i], rel_tol=1e-4, abs_tol=1e-6)


def test_training_goes_on_from_its_checkpoint_and_stops_early(spark):
    df, _, _ = labelled(spark)
    how = {"key": "id", "features": ["a", "b", "c"], "label": "y", "rate": 0.05}
    folder = shared_folder(spark, "resume")
    whole, report = TR.fit(df, model=TR.Perceptron(3), rounds=12, **how)
    TR.fit(df, model=TR.Perceptron(3), rounds=7, folder=folder, every=5, **how)
    again, rest = TR.fit(df, model=TR.Perceptron(3), rounds=12, folder=folder, every=5, **how)
    assert [r["round"] for r in rest] == list(range(5, 13)) and rest == report[5:] and np.array_equal(whole, again)
    w, stopped = TR.fit(df, "id", ["a", "b", "c"], "y", TR.Logistic(3), rounds=60, rate=3.0, patience=3)
    losses = [r["held_loss"] for r in stopped]
    assert len(stopped) < 61 and min(losses) == losses[-4]
    p = TR.predict(df.where("id < 100 or id >= 3000"), ["a", "b", "c"], TR.Logistic(3), w)
    assert p.where("p is null").count() == 2 and p.where("p between 0 and 1").count() == 101
    with pytest.raises(ValueError):
        TR.fit(df.limit(0), "id", ["a"], "y", TR.Logistic(1))


# boosted trees

def brute_tree(bins, g, h, depth, rate, ridge, least, node=1):
    """Splits and leaf values by trying every cut."""
    scale = 2.0**-BO.PLACES
    part = lambda a, b: (a * scale) * (a * scale) / (b * scale + ridge)
    splits, values = {}, {node: -rate * (g.sum() * scale) / (h.sum() * scale + ridge)}
    best = (1e-9, None)
    if depth:
        for f in range(bins.shape[1]):
            for cut in sorted(set(bins[:, f])):
                left = bins[:, f] <= cut
                if min(left.sum(), (~left).sum()) < least:
                    continue
                gain = part(g[left].sum(), h[left].sum()) + part(g.sum() - g[left].sum(), h.sum() - h[left].sum()) - part(g.sum(), h.sum())
                if gain > best[0]:
                    best = (gain, (f, int(cut), left))
    if best[1] is None:
        return splits, values
    f, cut, left = best[1]
    splits[node] = (f, cut, best[0])
    for k, rows in ((2 * node, left), (2 * node + 1, ~left)):
        s, v = brute_tree(bins[rows], g[rows], h[rows], depth - 1, rate, ridge, least, k)
        splits |= s
        values |= v
    return splits, values


def test_trees_are_brute_force(spark):
    rng = np.random.default_rng(5)
    bins, g, h = rng.integers(0, 6, (400, 3)), rng.integers(-(2**24), 2**24, 400), rng.integers(1, 2**23, 400)
    g = g + (bins[:, 1] > 2) * 2**23 - ((bins[:, 0] == 2) & (bins[:, 2] < 3)) * 2**24
    rows = spark.createDataFrame([(list(map(int, b)), int(x), int(y)) for b, x, y in zip(bins, g, h)], "bins array<int>, g long, h long")
    splits, values = brute_tree(bins, g, h, 3, 0.3, 1.0, 10)
    tree = BO.grow(rows.repartition(3), 3, 0.3, 1.0, 10)
    assert {k: v[:2] for k, v in tree.splits.items()} == {k: v[:2] for k, v in splits.items()} and len(splits) >= 5
    assert all(math.isclose(tree.values[k], v, rel_tol=1e-9) for k, v in values.items()) and tree.values.keys() == values.keys()


def test_boosting_learns_from_all_labelled_rows(spark):
    df, _, y = labelled(spark)
    features = ["a", "b", "c"]
    model, again = (BO.fit(df.repartition(n), features, "y", trees=4, depth=3) for n in (1, 6))
    assert BO.described(model) == BO.described(again)
    scored = model.score(df.where("y is not null and id < 3000")).collect()
    loss = np.mean([math.log1p(math.exp(-r.score if r.y else r.score)) for r in scored])
    assert len(scored) == 3000 and loss < 0.62 and math.isclose(model.start, math.log((y.sum() + 1.5) / (3002 - y.sum() - 1 + 0.5)))
    assert model.score(df.where("id >= 3000")).where("score is null").count() == 0  # null and NaN features have a bin
    none = BO.fit(df.where("y is null"), features, "y")
    assert none.trees == [] and none.score(df.limit(3)).where("score = 0").count() == 3
    one = BO.fit(df.where("y = 1"), features, "y", trees=3)
    assert len(one.trees) <= 1


# graph attention

def test_attention_is_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    head = AT.Head(rng.standard_normal((2, 3)).tolist(), [0.5, -1.0], [1.0, 0.25], [0.7, -0.1])
    rows = [("g", 1, f, f"p{k}", [None, "H", "A"][k % 3], *map(float, rng.uniform(-30, 30, 2)), None if k == 4 else float(rng.uniform(0, 5))) for f in (1, 2, 3) for k in range([6, 1, 9][f - 1])]
    df = spark.createDataFrame(rows, "game_id string, period_id long, frame_id long, id string, team_id string, x double, y double, v double")
    got = {(r.frame_id, r.id): r.message for r in AT.graph_attention(df.repartition(3), ["x", "y", "v"], [head, head]).collect()}
    assert len(got) == len(rows)
    for f in (1, 2, 3):
        mine = [r for r in rows if r[2] == f]
        h = [np.array(head.w) @ np.array([r[5], r[6], r[7] or 0.0]) for r in mine]
        for i, a in enumerate(mine):
            score = {j: np.dot(head.a, h[i]) + np.dot(head.b, h[j]) + head.c[0] * (a[4] is not None and a[4] == b[4]) + head.c[1] * math.hypot(a[5] - b[5], a[6] - b[6]) for j, b in enumerate(mine) if j != i}
            e = {j: math.exp(s if s > 0 else 0.2 * s) for j, s in score.items()}
            want = sum((e[j] * h[j] for j in e), np.zeros(2)) / (sum(e.values()) or 1)
            assert np.allclose(got[f, a[3]], [*want, *want])
    far = df.withColumn("x", F.col("x") * 1e5)
    assert AT.graph_attention(far, ["x", "y", "v"], [head]).where(F.exists("message", F.isnan)).count() == 0
    assert AT.graph_attention(df.limit(0), ["x"], [AT.Head([[1.0]], [1.0], [1.0], [0.0, 0.0])]).count() == 0
    with pytest.raises(ValueError):
        AT.Head([[1.0]], [1.0, 2.0], [1.0], [0.0, 0.0])


# position feed

FEED = """<?xml version="1.0" encoding="utf-8"?>
<PutDataRequest><Positions>
<FrameSet TeamId="BALL" PersonId="b" MatchId="m1" GameSection="firstHalf">{ball}</FrameSet>
 <FrameSet GameSection='firstHalf' MatchId="m1" TeamId="t&amp;1" PersonId="p1">
{one}
</FrameSet><FrameSet MatchId="m1" GameSection="firstHalf" TeamId="t2" PersonId="p2"></FrameSet>
<FrameSet MatchId="m1" GameSection="secondHalf" TeamId="t2" PersonId="p2">{two}</FrameSet>
</Positions></PutDataRequest>
"""


@pytest.fixture(scope="module")
def feed(tmp_path_factory):
    d = tmp_path_factory.mktemp("feed")
    frame = lambda n, more="": f'<Frame N="{n}" T="2023-05-27T15:30:{n % 60:02d}.040+02:00" X="{n / 7}" Y="-{n}.5" S="{n % 9}.25" D="1.0" M="3" {more}/>'
    text = FEED.format(ball="".join(frame(n, f'Z="0.{n}" BallStatus="{n % 2}" BallPossession="{n % 3}"') for n in range(40)), one="\n".join(frame(n) for n in range(60)), two="".join(frame(n) for n in range(25)))
    (d / "a.xml").write_text(text)
    (d / "b.xml").write_text(text.replace('"m1"', '"m2"'))
    (d / "_c.xml").write_text(text)
    return f"file://{d}"


@pytest.mark.parametrize("split", [37, 101, 1000, 1 << 20])
def test_position_feed_is_the_same_for_every_split(spark, feed, split, monkeypatch):
    monkeypatch.setattr(PF, "BLOCK", 64 if split < 200 else 1 << 20)
    monkeypatch.setattr(PF, "TAG_BYTES", 512)
    parts = PF.planned(feed, split, ".xml")
    reader = PF.PositionReader(feed, split, ".xml")
    rows = [r for p in parts for r in reader.read(p)]
    assert len(parts) > 100 if split < 200 else parts
    whole = PF.PositionReader(feed, 1 << 30, ".xml")
    assert sorted(rows, key=repr) == sorted((r for p in PF.planned(feed, 1 << 30, ".xml") for r in whole.read(p)), key=repr) and len(rows) == 250


def test_position_feed_gives_the_xml_readers_rows(spark, feed):
    spark.dataSource.register(PF.PositionFeed)
    for split in (5000, 1 << 25):
        got = spark.read.format("position_feed").option("split_bytes", split).load(feed)
        want = readers.position_xml(spark, feed)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert spark.read.format("position_feed").option("split_bytes", 700).load(feed + "/a.xml").rdd.getNumPartitions() > 10


# table functions

def test_table_functions(spark):
    TF.register(spark)
    spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("a", None, "n"), ("a", 20, "z"), ("b", 3, "w")], "k string, t long, more string").createOrReplaceTempView("tf_series")
    got = spark.sql("SELECT * FROM gap_sessions(TABLE(tf_series) PARTITION BY k ORDER BY (t), 't', 10)")
    assert got.columns == ["k", "t", "more", "session"]
    assert {(r.k, r.t, r.more): r.session for r in got.collect()} == {("a", 1, "x"): 0, ("a", 5, "y"): 0, ("a", None, "n"): None, ("a", 20, "z"): 1, ("b", 3, "w"): 0}
    assert spark.sql("SELECT * FROM gap_sessions(TABLE(SELECT * FROM tf_series WHERE false) PARTITION BY k ORDER BY (t), 't', 10)").count() == 0
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM gap_sessions(TABLE(tf_series) PARTITION BY k ORDER BY (t), 'when', 10)").collect()


def test_pressing_pairs_in_sql_are_the_column_form(spark):
    rng = np.random.default_rng(6)
    rows = [("g", 1, f, "ball" if k == 0 else f"p{k}", None if k == 0 else "HA"[k % 2], *map(float, rng.uniform(-20, 20, 2)), *map(float, rng.uniform(-4, 4, 2)), k == 3 and f != 2) for f in (1, 2, 3) for k in range(8)]
    df = spark.createDataFrame(rows, "game_id string, period_id long, frame_id long, id string, team_id string, x double, y double, vx double, vy double, is_ball_carrier boolean")
    TF.register(spark)
    df.createOrReplaceTempView("tf_frames")
    got = spark.sql("SELECT * FROM pressing_pairs(TABLE(tf_frames) PARTITION BY (game_id, period_id, frame_id), 2.0)")
    key = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, P.pairwise(df, speed_threshold=2.0).collect())) and got.count() > 20


# orientation of the pressing fit

def test_the_pressing_side(spark):
    rows = [("g", 1, 1, i, t, x, 0.0, 3.0, 0.0, i == "h1") for i, t, x in (("h1", "H", 0.0), ("h2", "H", 4.0), ("a1", "A", 2.0), ("a2", "A", 9.0), ("ball", None, 0.5))]
    df = spark.createDataFrame(rows, "game_id string, period_id long, frame_id long, id string, team_id string, x double, y double, vx double, vy double, is_ball_carrier boolean")
    sides = lambda **how: {(r.presser_id[0], r.pressed_id[0]) for r in P.pairwise(df, **how).collect()}
    assert sides() == {("h", "a"), ("a", "h")}
    assert sides(orient="ball_owning", ball_method="exclude") == {("h", "a")} and sides(orient="pressing") == {("a", "h")}
    assert sides(orient="home_away", home="A", ball_method="exclude") == {("a", "h")} and sides(orient="away_home", home="A", ball_method="exclude") == {("h", "a")}
    assert sides(orient="pressing", method="full", ball_method="exclude") == {("a", "h")}
    for how in ({"orient": "left"}, {"orient": "home_away"}, {"orient": "pressing", "home": "H"}):
        with pytest.raises(ValueError):
            P.pairwise(df, **how)


# documents as VARIANT

def test_documents_keep_what_is_not_known(spark):
    texts = ['{"events":[{"event_name":"Passes","property":{"Outcome":"Succeeded","n":3,"flag":true}}],"new":{"deep":[1,null]}}', "{broken", None, "[1]", '{"events":"none","Events":1}', '{"events":[]}']
    doc = VA.parsed(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text")
    got = {r.i: r.e for r in doc.select("i", VA.events_of("document").alias("e")).collect()}
    assert [tuple(x) for x in got[0]] == [("Passes", {"Outcome": "Succeeded", "n": "3", "flag": "true"})] and not any(got[i] for i in range(1, 6))
    assert [r.i for r in VA.rejected(doc, "text").collect()] == [1]
    assert {(r.i, r.key, r.value) for r in VA.unknown_keys(doc, ["events"], ["i"]).collect()} == {(0, "new", '{"deep":[1,null]}'), (4, "Events", "1")}
    assert doc.select(VA.at("document", "$.new.deep[0]", "int").alias("v")).where("v = 1").count() == 1
    assert "new" in VA.schema_of(doc.where("i = 0"))


# sketches

def test_sketches_merge_and_keep_their_bound(spark, tmp_path):
    rng = np.random.default_rng(7)
    v = np.concatenate([rng.lognormal(0, 2, 4000), -rng.exponential(3, 1500), np.zeros(500)])
    rows = [(int(i % 5), int(i % 3), float(x)) for i, x in enumerate(v)] + [(0, 0, None), (0, 0, math.nan), (None, 1, 2.0)]
    df = spark.createDataFrame(rows, "k int, phase int, v double")
    SK.sketch(df, ["k", "phase"], ["v"]).write.parquet(f"{tmp_path}/sketch")
    stored = spark.read.parquet(f"{tmp_path}/sketch")
    key = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    for keys in (["k"], ["phase"], []):
        assert sorted(map(key, SK.merge(stored, keys).collect()), key=repr) == sorted(map(key, SK.sketch(df, keys, ["v"]).collect()), key=repr)
    halves = SK.sketch(df.where("k < 2"), ["phase"], ["v"]).unionByName(SK.sketch(df.where("k >= 2 or k is null"), ["phase"], ["v"]))
    assert sorted(map(key, SK.merge(halves, []).collect())) == sorted(map(key, SK.sketch(df, [], ["v"]).collect()))
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    exact = np.sort(np.append(v, 2.0))
    got = {r.share: r.value for r in SK.quantiles(SK.merge(stored, []), [], shares).collect()}
    for s in shares:
        want = exact[max(1, math.ceil(s * len(exact))) - 1]
        assert abs(got[s] - want) <= SK.ERROR * abs(want) + 1e-9
    assert stored.count() < 6000 and SK.quantiles(SK.sketch(df.limit(0), [], ["v"]), [], shares).count() == 0
    edge = spark.createDataFrame([(math.inf,), (-math.inf,), (1e-300,)], "v double")
    assert [r.value for r in SK.quantiles(SK.sketch(edge, [], ["v"]), [], [0.0, 0.5, 1.0]).orderBy("share").collect()] == [-math.inf, 0.0, math.inf]
