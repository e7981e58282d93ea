"""Readers of match files: JSON documents and lines, XML event and position feeds, CSV; all through Spark's sources.

A path may name many matches (a folder, a pattern). Rows carry game_id: the folder of a JSON file, the MatchId of an XML one.
No schema is inferred, so no file is read twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.scalars import let

PLAYER = "full_name_en string, initial_position_name string, shirt_number int, player_id string"
TEAM = f"struct<team_id:string,team_name:string,players:array<struct<full_name_en:string,initial_position_name:string,shirt_number:int,player_id:string>>>"
META = f"ground_width double, ground_height double, home_team {TEAM}, away_team {TEAM}"
OBJECT = "struct<object:string,player_id:string,x:double,y:double,speed:double>"
FRAMES = f"period_order int, match_time long, frame_index long, ball_state string, players array<{OBJECT}>, balls array<{OBJECT}>"
EVENT = "struct<event_name:string,property:map<string,string>>"
EVENTS = f"data array<struct<event_id:bigint,period_type:string,period_name:string,period_order:int,period_duration:bigint,period_start_time:bigint,event_time:bigint,player_name:string,player_shirt_number:int,team_name:string,x:double,y:double,to_x:double,to_y:double,attack_direction:string,events:array<{EVENT}>>>"


FOLDER = r"([^/]+)/[^/]+$"


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    row = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.select(F.regexp_extract("_metadata.file_path", FOLDER, 1).alias("game_id"), "value", row.alias("r"))


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """game_id and the columns of whole-file JSON documents; files that don't parse give no row."""
    return _parsed(spark.read.text(path, wholetext=True), schema).where("r._bad is null").select("game_id", "r.*").drop("_bad")


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows with game_id, malformed lines). Blank lines are skipped."""
    rows = _parsed(spark.read.text(path).where(F.trim("value") != ""), schema)
    return rows.where("r._bad is null").select("game_id", "r.*").drop("_bad"), rows.where("r._bad is not null").select("value")


def meta_data(spark: SparkSession, path: str) -> DataFrame:
    return json_document(spark, path, META)


def team_sheet(meta: DataFrame) -> DataFrame:
    """game_id, player, position, team, jID, pID, tID, xID of every player; xID counts inside the team from 0."""
    side = lambda c, name: meta.select("game_id", F.lit(name).alias("team"), F.col(f"{c}.team_id").alias("tID"), F.posexplode(f"{c}.players").alias("xID", "p"))
    both = side("home_team", "Home").unionByName(side("away_team", "Away"))
    return both.select("game_id", F.col("p.full_name_en").alias("player"), F.col("p.initial_position_name").alias("position"), "team", F.col("p.shirt_number").alias("jID"), F.col("p.player_id").cast("string").alias("pID"), F.col("tID").cast("string").alias("tID"), "xID")


def event_halves(spark: SparkSession, folder: str) -> DataFrame:
    """The events of both halves, *1_event*.json and *2_event*.json."""
    return json_document(spark, f"{folder}/*[12]_event*.json", EVENTS).select("game_id", F.explode("data").alias("e")).select("game_id", "e.*")


def tracking_frames(frames: DataFrame, sheet: DataFrame) -> DataFrame:
    """A row for each object of each frame. A null or 'out' ball state is dead without an owner, other states are alive;
    'home' and 'away' become team ids. Positions are in [0, size] as recorded."""
    tag = lambda c, b: F.transform(F.coalesce(c, F.array().cast(f"array<{OBJECT}>")), lambda o: F.struct(F.lit(b).alias("ball"), o.alias("o")))
    rows = frames.select("game_id", (F.col("period_order") + 1).alias("period_id"), (F.col("match_time") * 1000).alias("timestamp"), F.col("frame_index").alias("frame_id"), "ball_state", F.explode(F.concat(tag(F.col("players"), False), tag(F.col("balls"), True))).alias("z"))
    out = F.col("ball_state").isNull() | (F.col("ball_state") == "out")
    teams = sheet.groupBy("game_id").agg(F.max(F.when(F.col("team") == "Home", F.col("tID"))).alias("_h"), F.max(F.when(F.col("team") == "Away", F.col("tID"))).alias("_a"))
    who = sheet.select("game_id", F.col("pID").alias("id"), F.col("tID").alias("team_id"), F.col("position").alias("position_name"))
    rows = rows.join(teams, "game_id", "left")
    rows = rows.withColumns({"id": F.when(F.col("z.ball"), "ball").otherwise(F.col("z.o.player_id")), "ball_owning_team_id": F.when(F.col("ball_state") == "home", F.col("_h")).when(F.col("ball_state") == "away", F.col("_a")), "ball_state": F.when(out, "dead").otherwise("alive")})
    rows = rows.join(who, ["game_id", "id"], "left")
    return rows.select("game_id", "period_id", "timestamp", "frame_id", "ball_state", "ball_owning_team_id", F.col("z.o.x").alias("x"), F.col("z.o.y").alias("y"), F.col("z.o.speed").alias("v"), "id", "team_id", "position_name")


INSIDE = r'(?:[^<>"]++|"[^"]*+")*+'
EVENT_TAG = rf"<Event\s{INSIDE}(?<!/)>"
EMPTY_EVENT = rf"<Event\b{INSIDE}(?<=/)>"
#: The first child, its first child and so on.
CHAIN = rf"^(?:\s*<[A-Za-z]{INSIDE}(?<!/)>)*\s*<[A-Za-z]{INSIDE}>"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def _attributes(tags: Column) -> Column:
    """Attribute names and values in the tags as a map; of a name that occurs twice the last counts."""
    each = lambda k: F.regexp_extract_all(tags, F.lit(r'([\w:.-]+)\s*=\s*"([^"]*)"'), F.lit(k))
    value = F.transform(each(2), lambda v: _decoded(v))
    pairs = F.zip_with(each(1), value, lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    return let(pairs, lambda p: F.map_from_entries(F.filter(p, lambda x, i: ~F.exists(F.slice(p, i + 2, F.size(p)), lambda y: y["key"] == x["key"]))))


def _decoded(v: Column) -> Column:
    for entity, sign in ENTITIES.items():
        v = F.replace(v, F.lit(entity), F.lit(sign))
    return v


def event_xml(spark: SparkSession, path: str) -> DataFrame:
    """game_id, event_id, time, eID, tID, pID, outcome, qualifier of every Event of the files, cut at their ends by the text
    source. eID joins the names of the first child and of its first children with _, qualifier has their attributes. outcome
    is 1 or 0 by the Evaluation or, of shots, by whether it was a SuccessfulShot; else null. A substitution gives one row
    InSubstitution and one OutSubstitution, equal but for the player."""
    text = spark.read.option("lineSep", "</Event>").text(path).select(F.regexp_replace("value", EMPTY_EVENT, "").alias("value"))
    text = text.where(F.col("value").rlike(EVENT_TAG))
    head = F.regexp_extract("value", f"({EVENT_TAG})", 1)
    chain = F.regexp_extract(F.regexp_replace("value", rf"(?s)^.*?{EVENT_TAG}", ""), f"({CHAIN})", 1)
    rows = text.select(_attributes(head).alias("h"), chain.alias("c")).where("c != ''")
    rows = rows.select("h", F.array_join(F.regexp_extract_all("c", F.lit(r"<([A-Za-z][\w:.-]*)"), F.lit(1)), "_").alias("e"), _attributes(F.col("c")).alias("qualifier"))
    of = lambda k: F.try_element_at("qualifier", F.lit(k))
    side = lambda name, who: F.struct(name.alias("eID"), who.alias("pID"))
    own = F.array(side(F.col("e"), of("Player")))
    sides = F.when(F.col("e") == "Substitution", F.array(side(F.lit("InSubstitution"), of("PlayerIn")), side(F.lit("OutSubstitution"), of("PlayerOut")))).otherwise(own)
    shot = F.when(F.col("e").contains("ShotAtGoal"), F.col("e").contains("SuccessfulShot").cast("int"))
    outcome = F.when(of("Evaluation").isin("successfullyCompleted", "successful"), 1).when(of("Evaluation") == "unsuccessful", 0).otherwise(shot)
    at = lambda k: F.try_element_at("h", F.lit(k))
    out = rows.select(at("MatchId").alias("game_id"), at("EventId").alias("event_id"), F.to_timestamp(at("EventTime")).alias("time"), of("Team").alias("tID"), outcome.alias("outcome"), "qualifier", F.explode(sides).alias("s"))
    return out.select("game_id", "event_id", "time", "s.eID", "tID", "s.pID", "outcome", "qualifier")


def segments(events: DataFrame) -> DataFrame:
    """game_id, segment, start, stop of event_xml's rows. Starts are the game's KickoffWhistle, else Kickoff, else KickOff with a
    section, stops its FinalWhistle."""
    first = F.substring_index("eID", "_", 1)
    rank = F.when(first == "KickoffWhistle", 0).when(first == "Kickoff", 1).when(first == "KickOff", 2)
    rows = events.select("game_id", F.try_element_at("qualifier", F.lit("GameSection")).alias("segment"), "time", rank.alias("rank"), (first == "FinalWhistle").alias("last")).where("segment is not null and (rank is not null or last)")
    ends = rows.groupBy("game_id", "segment", "rank").agg(F.max("time").alias("t"))
    kind = F.min("rank").over(Window.partitionBy("game_id"))
    return ends.withColumn("kind", kind).groupBy("game_id", "segment").agg(F.max(F.when(F.col("rank") == F.col("kind"), F.col("t"))).alias("start"), F.max(F.when(F.col("rank").isNull(), F.col("t"))).alias("stop")).where("start is not null")


def segmented(events: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds segment and gameclock (seconds since its start), minute and second. spans: game_id, segment, start, stop; an event
    outside all of its game's belongs to that of the nearest start. Games without spans give nulls."""
    k = spans.groupBy("game_id").agg(F.collect_list(F.struct("segment", "start", "stop")).alias("_spans"))  # two to five a game
    t = F.col("time").cast("double")

    def option(x: Column) -> Column:
        clock = t - x["start"].cast("double")
        outside = ~F.coalesce(F.col("time").between(x["start"], x["stop"]), F.lit(False))
        return F.struct(outside.alias("outside"), F.when(outside, F.abs(clock)).otherwise(clock).alias("gap"), x["segment"].alias("segment"), clock.alias("gameclock"))

    best = F.array_min(F.transform("_spans", option))
    out = events.join(k, "game_id", "left").withColumn("_best", best).select(*events.columns, F.col("_best.segment").alias("segment"), F.col("_best.gameclock").alias("gameclock"))
    return out.withColumns({"minute": F.floor(F.col("gameclock") / 60), "second": F.floor(F.col("gameclock")) % 60})


def by_team(events: DataFrame) -> DataFrame:
    """The rows of segmented with the team in whose list they stand: their own, or, without one, each of the segment's teams."""
    teams = events.where(F.col("tID").isNotNull()).select(F.col("game_id").alias("_g"), F.col("segment").alias("_s"), F.col("tID").alias("team")).distinct()
    both = events.where(F.col("tID").isNull()).join(teams, F.col("game_id").eqNullSafe(F.col("_g")) & F.col("segment").eqNullSafe(F.col("_s"))).drop("_g", "_s")
    return events.where(F.col("tID").isNotNull()).withColumn("team", F.col("tID")).unionByName(both)


FRAME_XML = "_MatchId string, _GameSection string, _TeamId string, _PersonId string, Frame array<struct<_N:bigint,_T:string,_X:double,_Y:double,_Z:double,_D:double,_S:double,_BallStatus:int,_BallPossession:int>>"


def position_xml(spark: SparkSession, path: str) -> DataFrame:
    """A row for each object and frame, long from the start: game_id, section, team_id, id, frame_id, time, x, y, z, v, ball state and owner."""
    raw = spark.read.option("rowTag", "FrameSet").schema(FRAME_XML).xml(path)
    f = raw.select("_MatchId", "_GameSection", "_TeamId", "_PersonId", F.explode("Frame").alias("f"))
    ball = F.lower("_TeamId") == "ball"
    return f.select(F.col("_MatchId").alias("game_id"), F.col("_GameSection").alias("section"), F.when(~ball, F.col("_TeamId")).alias("team_id"), F.when(ball, "ball").otherwise(F.col("_PersonId")).alias("id"), F.col("f._N").alias("frame_id"), F.to_timestamp("f._T").alias("time"), F.col("f._X").alias("x"), F.col("f._Y").alias("y"), F.col("f._Z").alias("z"), F.col("f._S").alias("v"), F.when(F.col("f._BallStatus") == 1, "alive").when(F.col("f._BallStatus") == 0, "dead").alias("ball_state"), F.when(F.col("f._BallPossession") == 1, "home").when(F.col("f._BallPossession") == 2, "away").alias("ball_owner"))


def match_info_xml(spark: SparkSession, path: str) -> DataFrame:
    """The attributes of General, Environment and OtherGameInformation as (game_id, section, key, value)."""
    tags = F.regexp_extract_all("value", F.lit(rf"(<(?:General|Environment|OtherGameInformation)\s{INSIDE}>)"), F.lit(1))
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.transform(tags, lambda x: F.struct(F.regexp_extract(x, r"<(\w+)", 1).alias("section"), _attributes(x).alias("a")))).alias("t"), F.regexp_extract("value", r'<General\s[^<>]*?\bMatchId\s*=\s*"([^"]*)"', 1).alias("game_id"))
    return rows.select("game_id", "t.section", F.explode("t.a").alias("key", "value"))


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def files_like(spark: SparkSession, folder: str, *patterns: str) -> DataFrame:
    """path, size of the files whose names fit any pattern."""
    out = None
    for p in patterns:
        part = spark.read.format("binaryFile").option("pathGlobFilter", p).option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()
