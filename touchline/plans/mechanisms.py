"""Queries of the operators that carry a Spark mechanism of their own: scans, state, tables, learning. Same catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import attention as AT, boosting as BO, events as EV, frames as FR, legality as L, sketches as SK, table_functions as TF, training as TR, validator as V, variants as VA
from ..session import shared_folder, written
from ..sources import position_feed as PF
from ..streaming import stateful as SF, streams as ST
from . import adapters as A
from .catalogue import GAP as GAP_OF_SESSIONS, SQL, carriers, query, raw_events, rounded, rounded_pairs

# legality as a prefix scan

NAMES = [*sorted(V.RULES), "Foul Won", "Goal Conceded"]
USUAL = {"click": "Pass", "view": "Pass Received", "purchase": "Shot", "signup": "Recovery", "error": "Out"}
PLAY = A.EV + f""",
pl0 AS (SELECT d AS game_id, CASE WHEN h < 12 THEN 1 ELSE 2 END AS period_id, event_id, 0 AS step, us / 1000000e0 AS time_seconds, (k * 7 + user_id) % {2 * len(NAMES)} AS c, event_type, CASE WHEN value >= 50 THEN 'Successful' ELSE 'Unsuccessful' END AS result_name, k FROM ev),
pl1 AS (SELECT *, CASE WHEN c < {len(NAMES)} THEN [{", ".join(f"'{n}'" for n in NAMES)}][c + 1] ELSE CASE event_type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in USUAL.items())} END END AS type_name FROM pl0),
pl AS (SELECT *, CASE k % 3 WHEN 0 THEN lead(event_id, 1) OVER w WHEN 1 THEN lead(event_id, 2) OVER w END AS relative_id, row_number() OVER w AS n FROM pl1 WINDOW w AS (PARTITION BY game_id, period_id ORDER BY time_seconds, event_id, step))"""


def play(spark, d) -> DataFrame:
    """Sequences of actions: two periods a day; half of the names follow the source's event type, half are any name."""
    e = A.events(spark, d)
    c = (F.col("k") * 7 + F.col("user_id")) % (2 * len(NAMES))
    usual = F.element_at(F.create_map(*(F.lit(x) for kv in USUAL.items() for x in kv)), F.col("event_type"))
    name = F.when(c < len(NAMES), F.get(F.array(*map(F.lit, NAMES)), c.cast("int"))).otherwise(usual)
    result = F.when(F.col("value") >= 50, "Successful").otherwise("Unsuccessful")
    rows = e.select(F.col("d").alias("game_id"), F.when(F.col("h") < 12, 1).otherwise(2).alias("period_id"), "event_id", F.lit(0).alias("step"), (F.col("us") / 1e6).alias("time_seconds"), name.alias("type_name"), result.alias("result_name"), "k")
    w = L.Window.partitionBy(*L.PERIOD).orderBy("time_seconds", "event_id", "step")
    later = F.when(F.col("k") % 3 == 0, F.lead("event_id", 1).over(w)).when(F.col("k") % 3 == 1, F.lead("event_id", 2).over(w))
    return rows.withColumn("relative_id", later).drop("k")


def _values(rows) -> str:
    cell = lambda x: "NULL" if x is None else f"'{x}'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


_RULES = _values([(t, s, a or s, c) for t, rules in V.RULES.items() for states, a, c in rules for s in states])
_FORCED = _values(list(V.FORCED.items()))
_TACKLE = _values([(s, t) for s, ts in V.AFTER_TACKLE.items() for t in ts])
_KEEPER = ", ".join(f"'{t}'" for t in V.AFTER_KEEPER)
_PASSES = ", ".join(f"'{t}'" for t in V.PASSES)
_STATES = ", ".join(f"('{s}')" for s in L.STATES)
#: Each event as a table of its seven transitions, then followed one event at a time from the kick-off.
LEGAL = f"""WITH RECURSIVE {PLAY},
co AS (SELECT *, result_name = 'Unsuccessful' AS failed, coalesce(last_value(CASE WHEN type_name IN ({_PASSES}) THEN {{'r': relative_id}} END IGNORE NULLS) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) = {{'r': event_id}}, false) AS meant,
 lead(coalesce(type_name, '')) OVER w AS nxt FROM pl WINDOW w AS (PARTITION BY game_id, period_id ORDER BY n)),
tr AS (SELECT game_id, period_id, n, s.state, coalesce(max(r.after_), f.after_, s.state) AS after_, max(r.after_) IS NOT NULL AS legal FROM co, (VALUES {_STATES}) s(state)
 LEFT JOIN {_RULES} r(kind, state, after_, cond) ON r.kind = co.type_name AND r.state = s.state AND (r.cond IS NULL OR failed OR (r.cond = 'intended' AND meant) OR (r.cond = 'keeper' AND (nxt IS NULL OR nxt IN ({_KEEPER})))
  OR (r.cond = 'tackle' AND (nxt IS NULL OR (s.state, nxt) IN (SELECT (a, b) FROM {_TACKLE} t(a, b)))))
 LEFT JOIN {_FORCED} f(kind, after_) ON f.kind = co.type_name GROUP BY game_id, period_id, n, s.state, f.after_),
re AS (SELECT game_id, period_id, n, state AS before_, after_, legal FROM tr WHERE n = 1 AND state = '{V.KICK_OFF}' UNION ALL SELECT tr.game_id, tr.period_id, tr.n, tr.state, tr.after_, tr.legal FROM re JOIN tr ON tr.game_id = re.game_id AND tr.period_id = re.period_id AND tr.n = re.n + 1 AND tr.state = re.after_)"""


@query(LEGAL + " SELECT game_id, period_id, event_id, step, type_name, before_ AS current_state, after_ AS next_state, 'Impossible trigger' AS error FROM re JOIN pl USING (game_id, period_id, n) WHERE NOT legal")
def illegal_transitions(spark, d):
    """Every event that may not come in the state that play is in."""
    return L.illegal(play(spark, d))


@query(LEGAL + " SELECT game_id, period_id, before_ AS state, after_ AS next_state, count(*) AS n, count(*) FILTER (legal) AS legal FROM re GROUP BY ALL")
def state_transitions(spark, d):
    """How often play goes from state to state, and how often by a legal event."""
    t = L.transitions(play(spark, d)).groupBy("game_id", "period_id", L.state_name(F.col("_before")).alias("state"), L.state_name(F.col("_after")).alias("next_state"))
    return t.agg(F.count("*").alias("n"), F.sum(F.col("_legal").cast("long")).alias("legal"))


# stateful streams

GAP, LATE = 21_600_000_000, "1 hour"
CLOSED = f"""WITH {A.EV}, mx AS (SELECT max(us) // 1000 - 3600000 AS w FROM ev), ga AS (SELECT *, us - lag(us) OVER w AS gap FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
se AS (SELECT *, sum(CASE WHEN gap > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS s FROM ga)"""


@query(CLOSED + f" SELECT user_id, min(us) AS start, max(us) AS stop, count(*) AS n, round(sum(value), 4) AS total FROM se, mx GROUP BY user_id, s, w HAVING (max(us) + {GAP}) // 1000 + 1 <= w")
def stream_sessions(spark, d):
    """Each user's sessions, as a stream closes them."""
    rows = ST.arriving(spark, d, A.table(spark, d, "events").schema, "events.parquet")
    rows = rows.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    out = SF.closed_rows(SF.sessions(rows, ["user_id"], "ts", "value", GAP, LATE), shared_folder(spark, "sessions"))
    return rounded(out, "total", digits=4)


@query(f"WITH {A.CARRIER}, mx AS (SELECT max(frame_id) - 1 AS w FROM tr) SELECT game_id, period_id, frame_id, id AS carrier_id, team AS owning_team, round(ball_dist, 6) AS distance FROM car, mx WHERE is_ball_carrier AND frame_id < w")
def stream_frame_carriers(spark, d):
    """Each frame's carrier, as a stream of positions closes the frame; frames are an hour apart, the last two stay open."""
    t = A.tracking(spark, d).withColumn("time", F.timestamp_seconds((F.col("frame_id") + 24) * 3600))  # a stream takes the epoch itself for late
    folder = shared_folder(spark, "positions")
    t.select(*FR.FRAME, "time", "id", "team_id", "x", "y", "ord", "ball_owning_team_id").write.parquet(f"{folder}/rows")
    rows = ST.arriving(spark, f"{folder}/rows", spark.read.parquet(f"{folder}/rows").schema, files_at_once=1_000_000)
    return rounded(SF.closed_rows(SF.frame_carriers(rows, "time", FR.FRAME, LATE), f"{folder}/carriers"), "distance")


# synchronous training

LEARN = A.EV + ", le AS (SELECT event_id, value / 100e0 AS x1, k / 100e0 AS x2, h / 24e0 AS x3, CAST(event_type = 'purchase' AS DOUBLE) AS y FROM ev)"
INPUTS = ["x1", "x2", "x3"]


def learnable(spark, d) -> DataFrame:
    """event_id, three inputs and y: whether an event is a purchase."""
    return A.events(spark, d).select("event_id", (F.col("value") / 100).alias("x1"), (F.col("k") / 100).alias("x2"), (F.col("h") / 24).alias("x3"), (F.col("event_type") == "purchase").cast("double").alias("y"))


@query(f"""WITH RECURSIVE {LEARN}, r AS (SELECT 0 AS round, 0e0 AS w1, 0e0 AS w2, 0e0 AS w3, 0e0 AS b UNION ALL
 SELECT round + 1, w1 - avg(d * x1), w2 - avg(d * x2), w3 - avg(d * x3), b - avg(d) FROM (SELECT r.*, x1, x2, x3, (CASE WHEN y > 0.5 THEN 2e0 ELSE 1e0 END) * (1 / (1 + exp(-(x1 * w1 + x2 * w2 + x3 * w3 + b))) - y) AS d FROM r, le WHERE round < 12) GROUP BY round, w1, w2, w3, b)
SELECT round, round(avg((CASE WHEN y > 0.5 THEN 2e0 ELSE 1e0 END) * (ln(1 + exp(x1 * w1 + x2 * w2 + x3 * w3 + b)) - y * (x1 * w1 + x2 * w2 + x3 * w3 + b))), 6) AS loss, round(w1, 6) + 0e0 AS w1, round(w2, 6) + 0e0 AS w2, round(w3, 6) + 0e0 AS w3, round(b, 6) + 0e0 AS b FROM r, le GROUP BY round, w1, w2, w3, b""")
def logistic_descent(spark, d):
    """Loss and weights of a logistic model in each round of gradient descent over all rows."""
    model, rows = TR.Logistic(3), learnable(spark, d)
    seen: list = []
    TR.fit(rows, "event_id", INPUTS, "y", model, rounds=12, rate=1.0, method="descent", weight=2.0, valid=0.0, watch=lambda k, loss, w: seen.append((k, round(loss, 6), *(round(float(x), 6) + 0.0 for x in w))))
    return spark.createDataFrame(seen, "round int, loss double, w1 double, w2 double, w3 double, b double")


@query()
def perceptron_fit(spark, d):
    """Report of a hidden layer trained with Adam, a fifth of the rows held back, until their loss stops falling; and how the
    best weights score them."""
    model, rows = TR.Perceptron(3), learnable(spark, d)
    w, report = TR.fit(rows, "event_id", INPUTS, "y", model, rounds=40, rate=0.05, patience=5, folder=TR.checkpoint_folder(spark))
    scored = TR.predict(rows, INPUTS, model, w)
    last = scored.agg(F.lit(-1).alias("round"), F.avg("p").alias("loss"), F.avg("y").alias("held_loss"))
    return rounded(spark.createDataFrame(report, "round int, loss double, held_loss double").unionByName(last), "loss", "held_loss")


# boosted trees

EDGES = {"x1": [0.25 * k for k in range(1, 13)], "x2": [0.1 * k for k in range(1, 10)], "x3": [0.125 * k for k in range(1, 8)]}
_BINS = " UNION ALL ".join(f"SELECT node, g, h, {i} AS feature, 1 + len(list_filter([{', '.join(f'{e!r}e0' for e in es)}], lambda e: e < {f})) AS bin FROM gh" for i, (f, es) in enumerate(EDGES.items()))
_PART = "(({g}) * {u}) * (({g}) * {u}) / (({h}) * {u} + 1e0)"


def _part(g: str, h: str) -> str:
    return _PART.format(g=g, h=h, u=f"{2.0**-BO.PLACES!r}::DOUBLE")


@query(f"""WITH {LEARN}, pr AS (SELECT avg(y) AS p FROM le), gh AS (SELECT event_id % 7 + 1 AS node, x1, x2, x3, CAST(round((p - y) * {2.0**BO.PLACES!r}) AS BIGINT) AS g, CAST(round((p * (1 - p)) * {2.0**BO.PLACES!r}) AS BIGINT) AS h FROM le, pr),
hi AS (SELECT node, feature, bin, sum(g)::BIGINT AS g, sum(h)::BIGINT AS h, count(*) AS n FROM ({_BINS}) GROUP BY ALL),
ru AS (SELECT *, sum(g) OVER w AS lg, sum(h) OVER w AS lh, sum(n) OVER w AS ln_, sum(g) OVER v AS tg, sum(h) OVER v AS th, sum(n) OVER v AS tn FROM hi WINDOW w AS (PARTITION BY node, feature ORDER BY bin), v AS (PARTITION BY node, feature)),
ga AS (SELECT *, {_part("lg", "lh")} + {_part("tg - lg", "th - lh")} - {_part("tg", "th")} AS gain FROM ru)
SELECT node, any_value(tn)::BIGINT AS n, first(feature ORDER BY gain DESC, feature, bin) FILTER (ok) AS feature, first(bin ORDER BY gain DESC, feature, bin) FILTER (ok) AS cut, round(max(gain) FILTER (ok), 6) AS gain FROM (SELECT *, ln_ >= 20 AND tn - ln_ >= 20 AND gain > 1e-9 AS ok FROM ga) GROUP BY node""")
def split_search(spark, d):
    """The best split of each of seven groups of rows, from merged histograms and prefix sums."""
    rows = learnable(spark, d)
    p = rows.agg(F.avg("y")).first()[0] or 0.0
    fixed = lambda v: F.round(v * 2.0**BO.PLACES).cast("long")
    rows = rows.select((F.col("event_id") % 7 + 1).alias("node"), F.array(*(BO.bin_of(F.col(f), e) for f, e in EDGES.items())).alias("bins"), fixed(F.lit(p) - F.col("y")).alias("g"), fixed(F.lit(p) * (1 - F.lit(p))).alias("h"))
    out = BO.best_splits(BO.histograms(rows, F.col("node")), 1.0, 20)
    return rounded(out.select("node", "n", "feature", F.col("cut").cast("long").alias("cut"), "gain"), "gain")


@query()
def boosted_trees(spark, d):
    """Every node of five boosted trees on all labelled rows."""
    model = BO.fit(learnable(spark, d), INPUTS, "y", trees=5, depth=3)
    return spark.createDataFrame(BO.described(model), "tree int, node int, feature string, at double, gain double, value double")


# graph attention

HEADS = [AT.Head([[0.5, -0.25, 0.75], [0.125, 1.0, -0.5]], [0.3, -0.7], [0.2, 0.9], [0.5, -0.05]), AT.Head([[-1.0, 0.5, 0.25]], [1.5], [-0.5], [-0.25, 0.02])]


def _attention_sql() -> str:
    lin = lambda ws, xs: " + ".join(f"({w!r}e0 * {x})" for w, x in zip(ws, xs))
    parts, names = [], []
    for k, hd in enumerate(HEADS):
        hs = [f"h{k}_{m}" for m in range(len(hd.w))]
        parts.append(f"""l{k} AS (SELECT *, {lin(hd.a, hs)} AS p, {lin(hd.b, hs)} AS q FROM (SELECT tr.*, {", ".join(f"{lin(w, ['x', 'y', 'v'])} AS {h}" for w, h in zip(hd.w, hs))} FROM tr)),
e{k} AS (SELECT i.game_id, i.period_id, i.frame_id, i.id, {", ".join(f"j.{h}" for h in hs)}, i.p + j.q + {hd.c[0]!r}e0 * coalesce(CAST(i.team_id = j.team_id AS DOUBLE), 0e0) + {hd.c[1]!r}e0 * sqrt((i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y)) AS s FROM l{k} i LEFT JOIN l{k} j ON i.game_id = j.game_id AND i.period_id = j.period_id AND i.frame_id = j.frame_id AND i.id <> j.id),
m{k} AS (SELECT game_id, period_id, frame_id, id, {", ".join(f"coalesce(sum(exp(s - t) * {h}) / sum(exp(s - t)), 0e0) AS {h}" for h in hs)} FROM (SELECT *, max(s) OVER (PARTITION BY game_id, period_id, frame_id, id) AS t FROM (SELECT * REPLACE (CASE WHEN s > 0 THEN s ELSE s * 0.2e0 END AS s) FROM e{k})) GROUP BY ALL)""")
        names += hs
    return f"WITH {A.TRACKING}, {', '.join(parts)} SELECT game_id, period_id, frame_id, id, {', '.join(f'round({h}, 6) + 0e0 AS {h}' for h in names)} FROM m0 JOIN m1 USING (game_id, period_id, frame_id, id)"


@query(_attention_sql())
def graph_attention(spark, d):
    """Two heads' messages of every agent, over all other agents of its frame."""
    out = AT.graph_attention(A.tracking(spark, d), ["x", "y", "v"], HEADS)
    names = [f"h{k}_{m}" for k, hd in enumerate(HEADS) for m in range(len(hd.w))]
    return rounded(out.select(*FR.FRAME, "id", *(F.col("message")[i].alias(n) for i, n in enumerate(names))), *names)


# position feed

@query(f"WITH {A.TRACKING} SELECT game_id, CASE period_id WHEN 1 THEN 'firstHalf' ELSE 'secondHalf' END AS section, team_id, id, frame_id, x, y, v, CASE WHEN ball_owning_team_id IS NULL THEN 'dead' ELSE 'alive' END AS ball_state, CASE ball_owning_team_id WHEN 'H' THEN 'home' END AS ball_owner FROM tr")
def position_feed(spark, d):
    """All positions, written as FrameSets of XML and read back by byte ranges smaller than a set."""
    t = A.tracking(spark, d)
    attr = lambda n, v: F.coalesce(F.concat(F.lit(f' {n}="'), v.cast("string"), F.lit('"')), F.lit(""))
    state = F.when(F.col("ball_owning_team_id").isNull(), 0).otherwise(1)
    frame = F.concat(F.lit("<Frame"), attr("N", F.col("frame_id")), attr("X", F.col("x")), attr("Y", F.col("y")), attr("S", F.col("v")), attr("BallStatus", state), attr("BallPossession", F.when(F.col("ball_owning_team_id") == "H", 1)), F.lit("/>"))
    ball = F.col("id") == "ball"
    sets = t.groupBy("game_id", "period_id", "id", F.when(ball, "BALL").otherwise(F.col("team_id")).alias("team")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame_id", frame.alias("f")))), lambda x: x["f"]), "").alias("f"))
    head = F.concat(F.lit("<FrameSet"), attr("MatchId", F.col("game_id")), attr("GameSection", F.when(F.col("period_id") == 1, "firstHalf").otherwise("secondHalf")), attr("TeamId", F.col("team")), attr("PersonId", F.col("id")), F.lit(">"))
    folder = shared_folder(spark, "feed")
    sets.select(F.concat(head, "f", F.lit("</FrameSet>"))).write.text(folder)
    spark.dataSource.register(PF.PositionFeed)
    out = spark.read.format("position_feed").option("suffix", ".txt").option("split_bytes", 1 << 18).load(folder)
    return out.select("game_id", "section", "team_id", "id", "frame_id", "x", "y", "v", "ball_state", "ball_owner")


# table functions in SQL

@query(SQL["gap_sessions"])
def sql_gap_sessions(spark, d):
    """gap_sessions, asked for in SQL text."""
    TF.register(spark)
    A.series(spark, d).select("user_id", "us").createOrReplaceTempView("touchline_series")
    return spark.sql(f"SELECT user_id, us, session FROM gap_sessions(TABLE(touchline_series) PARTITION BY user_id ORDER BY (us), 'us', {GAP_OF_SESSIONS})")


@query(SQL["pairwise_pressure"])
def sql_pressing_pairs(spark, d):
    """pairwise_pressure, asked for in SQL text."""
    TF.register(spark)
    carriers(spark, d).select(*FR.FRAME, *TF.AGENT).createOrReplaceTempView("touchline_frames")
    out = spark.sql("SELECT * FROM pressing_pairs(TABLE(touchline_frames) PARTITION BY (game_id, period_id, frame_id), 2.0)")
    return rounded_pairs(out, "tti", "p")


# raw documents as VARIANT

def documents_of_events(spark, d) -> DataFrame:
    """event_id and a JSON document of each raw event, with keys that no operator knows."""
    e = raw_events(spark, d)
    more = [F.concat(F.lit("p"), F.col("event_id") % 3).alias("provider"), F.struct((F.col("event_id") % 2 + 2024).alias("year"), F.array(F.lit(1), F.lit(None)).alias("tags")).alias("season")]
    return e.select("event_id", F.to_json(F.struct("events", "attack_direction", *more)).alias("text"))


@query(SQL["rename_and_simplify"])
def variant_rename_and_simplify(spark, d):
    """rename_and_simplify on raw JSON, through VARIANT."""
    doc = VA.parsed(documents_of_events(spark, d), "text")
    doc = doc.select("event_id", VA.events_of("document").alias("events"), VA.at("document", "$.attack_direction", "string").alias("attack_direction"))
    doc = doc.where((F.col("attack_direction") != "") & ~EV.has(F.col("events"), "HIR"))
    renamed = EV.renamed(F.col("events"))
    return doc.select("event_id", renamed[0]["event_name"].alias("renamed"), EV.simplified(renamed)[0]["event_name"].alias("simplified"))


@query("""SELECT event_id, 'provider' AS key, '"p' || event_id % 3 || '"' AS value FROM events UNION ALL SELECT event_id, 'season', '{"tags":[1,null],"year":' || (event_id % 2 + 2024) || '}' FROM events""")
def variant_unknown_keys(spark, d):
    """What the raw documents hold beyond what the operators know."""
    doc = VA.parsed(documents_of_events(spark, d), "text")
    return VA.unknown_keys(doc, ["events", "attack_direction"], ["event_id"])


# stored sketches

SHARES = [0.1, 0.5, 0.9, 1.0]
_STEP = f"ln((1 + {SK.ERROR!r}e0) / (1 - {SK.ERROR!r}e0))"
_BIN = f"CASE WHEN abs(v) < {SK.LEAST!r} THEN 0 ELSE (CASE WHEN v < 0 THEN -1 ELSE 1 END) * CAST(ceil(ln(abs(v) / {SK.LEAST!r}) / {_STEP}) + 1 AS INTEGER) END"
_MIDDLE = f"CASE WHEN bin = 0 THEN 0e0 ELSE sign(bin) * exp((abs(bin) - 1) * {_STEP}) * {SK.LEAST!r} * (1 - {SK.ERROR!r}e0) END"


@query(f"""WITH {A.BALL}, vs AS (SELECT period_id, team_id, unnest(['v', 'ball_dist', 'vx']) AS measure, unnest([v, ball_dist, vx]) AS v FROM bd),
sk AS (SELECT period_id, team_id, measure, {_BIN} AS bin, count(*) AS n, min(v) AS low, max(v) AS high FROM vs WHERE v IS NOT NULL GROUP BY ALL),
cu AS (SELECT *, sum(n) OVER (w ORDER BY bin) AS upto, sum(n) OVER w AS size, min(low) OVER w AS least, max(high) OVER w AS most FROM sk WINDOW w AS (PARTITION BY period_id, team_id, measure))
SELECT period_id, team_id, measure, size::BIGINT AS n, share, round(least(most, greatest(least, {_MIDDLE})), 4) + 0e0 AS value FROM cu, (SELECT unnest([0.1e0, 0.5e0, 0.9e0, 1e0]) AS share) WHERE upto >= greatest(1, ceil(share * size)) AND upto - n < greatest(1, ceil(share * size))""")
def sketch_rollup(spark, d):
    """Quantiles of speed and distance by period and team, from sketches stored by player and rolled up."""
    rows = FR.with_ball_distance(A.tracking(spark, d))
    stored = written(SK.sketch(rows, ["game_id", "period_id", "team_id", "id"], ["v", "ball_dist", "vx"]), "sketches")
    out = SK.quantiles(SK.merge(stored, ["period_id", "team_id"]), ["period_id", "team_id"], SHARES)
    return rounded(out.select("period_id", "team_id", "measure", "n", "share", "value"), "value", digits=4)
