"""Position XML as a Python data source: byte ranges of the files are the partitions, cut at frames.

    spark.dataSource.register(PositionFeed)
    spark.read.format("position_feed").option("split_bytes", 32 << 20).load(path)

A FrameSet (one object's half, some ten MB) is cut wherever a range ends: a frame belongs to the range in which its tag
begins, and a range that begins inside a FrameSet looks back for that set's tag, block by block, no further than the set. So a
task holds BLOCK bytes of text whatever the size of a file or a set, and rows are the same for every split size. Ranges are
planned from names and sizes alone. `path` is a file, or a folder whose files with the option `suffix` (.xml) are read (names that begin
with _ or . are not); pyarrow.fs must know its scheme, from driver and executors.

Rows are those of readers.position_xml, frame for frame: game_id, section, team_id, id, frame_id, time, x, y, z, v, ball_state,
ball_owner. A missing attribute is null; a number that does not parse is null; the feed has no
< or > inside attributes, and no tags inside comments. Frames outside any FrameSet are left out.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "game_id string, section string, team_id string, id string, frame_id long, time timestamp, x double, y double, z double, v double, ball_state string, ball_owner string"
SPLIT_BYTES = 32 << 20
BLOCK = 1 << 20
#: The longest tag that the feed has: what a block keeps of the one before it.
TAG_BYTES = 1 << 16
TAG = re.compile(rb"<(FrameSet|Frame|/FrameSet)\b([^<>]*)>")
ATTRIBUTE = re.compile(rb"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
#: What the feed's codes mean.
BALL_STATE = {"0": "dead", "1": "alive"}
OWNER = {"1": "home", "2": "away"}
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


class Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int, size: int):
        super().__init__((path, start, stop))
        self.path, self.start, self.stop, self.size = path, start, stop, size


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def planned(path: str, split: int, suffix: str) -> list[Range]:
    from pyarrow import fs

    store, root = _store(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and f.base_name.endswith(suffix) and f.base_name[0] not in "_."]
    out = []
    for f in files:
        base = path if info.type == fs.FileType.File else f"{path.rstrip('/')}/{f.base_name}"
        out += [Range(base, at, min(at + split, f.size), f.size) for at in range(0, f.size, split)]
    return out


def attributes(text: bytes) -> dict[str, str]:
    def plain(v: bytes) -> str:
        s = v.decode("utf-8", "replace")
        return re.sub("|".join(REFERENCES), lambda m: REFERENCES[m[0]], s) if "&" in s else s

    return {k.decode(): plain(a or b) for k, a, b in ATTRIBUTE.findall(text)}


def set_before(f, start: int, size: int) -> dict[str, str] | None:
    """The attributes of the FrameSet whose tag is the last to begin before `start`, looking back block by block; none if that
    set is closed, or there is none."""
    stop, kept = start, f.read_at(min(TAG_BYTES, size - start), start)
    while stop > 0:
        low = max(0, stop - BLOCK)
        text = f.read_at(stop - low, low) + kept
        inside = text[: stop - low + TAG_BYTES]
        last = None
        for m in TAG.finditer(inside):
            if m[1] != b"Frame" and low + m.start() < start:
                last = m
        if last is not None:
            return attributes(last[2]) if last[1] == b"FrameSet" else None
        stop, kept = low, text[:TAG_BYTES]
    return None


def tags(f, start: int, stop: int, size: int) -> Iterator[tuple[bytes, bytes]]:
    """Name and attributes of every tag that begins in [start, stop); one block of text is held at a time."""
    at, kept = start, b""
    while at < stop or (kept and at < min(size, stop + TAG_BYTES)):
        block = f.read_at(min(BLOCK, size - at), at)
        if not block:
            break
        text, first = kept + block, at - len(kept)
        at += len(block)
        done = 0
        for m in TAG.finditer(text):
            if first + m.start() >= stop:
                return
            yield m[1], m[2]
            done = m.end()
        # what may be the beginning of a tag stays
        cut = text.rfind(b"<", done)
        kept = text[cut:] if cut >= 0 and len(text) - cut < TAG_BYTES and first + cut < stop else b""


def number(text: str | None) -> float | None:
    try:
        return float(text) if text is not None else None
    except ValueError:
        return None


def moment(text: str | None) -> dt.datetime | None:
    try:
        t = dt.datetime.fromisoformat(text) if text else None
    except ValueError:
        return None
    return t if t is None or t.tzinfo else t.replace(tzinfo=dt.timezone.utc)


def row(owner: dict[str, str], a: dict[str, str]) -> tuple:
    ball = owner.get("TeamId", "").lower() == "ball"
    n = a.get("N", "").strip()
    return (owner.get("MatchId"), owner.get("GameSection"), None if ball else owner.get("TeamId"), "ball" if ball else owner.get("PersonId"), int(n) if n.lstrip("-").isdigit() else None, moment(a.get("T")), *(number(a.get(k)) for k in ("X", "Y", "Z", "S")), BALL_STATE.get(a.get("BallStatus", "")), OWNER.get(a.get("BallPossession", "")))


class PositionReader(DataSourceReader):
    def __init__(self, path: str, split: int, suffix: str):
        self.path, self.split, self.suffix = path, split, suffix

    def partitions(self) -> list[Range]:
        return planned(self.path, self.split, self.suffix) or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        if not part.path:
            return
        store, root = _store(part.path)
        with store.open_input_file(root) as f:
            owner = set_before(f, part.start, part.size)
            for name, text in tags(f, part.start, part.stop, part.size):
                if name == b"Frame":
                    if owner is not None:
                        yield row(owner, attributes(text))
                else:
                    owner = attributes(text) if name == b"FrameSet" else None


class PositionFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "position_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PositionReader:
        split = int(self.options.get("split_bytes", SPLIT_BYTES))
        if split < 1:
            raise ValueError("split_bytes is positive")
        return PositionReader(self.options["path"], split, self.options.get("suffix", ".xml"))
