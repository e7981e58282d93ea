"""Near-duplicate documents: MinHash banding proposes, the full n-gram sets decide.

Texts with equal n-gram sets form one class, and only classes are compared. Bands and rows follow from the similarity and
the recall asked for. Every class is put in a block by the largest band bucket around it; blocks that share a bucket are compared
pair by pair of blocks, each pair in one task of bounded size: a sparse product of the two blocks' n-gram sets gives
every intersection exactly. Tasks return a row per class with its links counted and a spanning edge, never the pairs, so
large groups lose no link and cost no rows. Components of the spanning edges are the groups. Sets hold 64-bit digests of
n-grams, and a set's class a 128-bit digest of these: two n-grams or sets are taken for equal if their digests are.

Null texts are empty. A document without words is alone; one of fewer than five words has one n-gram, all its words.
Words are lower-cased runs of letters, digits and marks. Repeated rows are copies of each other. Of equal copies the least
doc_id stands for its group, null before all. An empty table gives an empty result. Other columns are ignored, or carried
but for names that start with _near_. A long text is one set; blocks are bounded by n-grams too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import as_number, join_small, key_hash, materialise, slices, table
from .graph import connected_components

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9995
#: A block holds about so many classes, and about so many n-grams.
BLOCK_ROWS = 1024
BLOCK_NGRAMS = 1_000_000
TOKEN = re.compile(r"\w+")


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = 256) -> tuple[int, int]:
    """bands, rows: the most selective layout (most rows) that finds a pair of this similarity with this recall, in at
    most 24 bands and `most` hashes."""
    found = []
    for rows in range(1, 9):
        bands = 1
        while 1 - (1 - similarity**rows) ** bands < recall and bands * rows <= most:
            bands += 1
        if bands * rows <= most and bands <= 24:
            found.append((rows, -bands * rows, bands))
    rows, _, bands = max(found)
    return bands, rows


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class NGrams:
    """Sorted distinct 64-bit n-gram hashes of a text. Word hashes are kept between texts, up to a bound."""

    def __init__(self, n: int = WORDS, most: int = 150_000):
        self.n, self.most, self.known = n, most, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = TOKEN.findall((text or "").lower())
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if new := [w for w in set(words) if w not in known]:
            if len(known) + len(new) > self.most:
                known.clear()
                new = list(set(words))
            known.update(zip(new, pd.util.hash_array(np.array(new, object)).tolist(), strict=True))
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        out = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
        return np.unique(_mix(out))


def _signatures(bands: int, rows: int):
    rng = np.random.default_rng(20_01)
    seeds = rng.integers(1, 2**63, bands * rows, dtype=np.uint64)
    factors = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1)

    def of(grams: np.ndarray) -> np.ndarray:
        low = np.full(bands * rows, np.uint64(2**64 - 1), np.uint64)
        for start in range(0, len(grams), 512):
            np.minimum(low, ((grams[None, start : start + 512] ^ seeds[:, None]) * factors[:, None]).min(1), out=low)
        out = np.zeros(bands, np.uint64)
        low = _mix(low).reshape(bands, rows)
        for k in range(rows):
            out = _mix(out * np.uint64(31) + low[:, k])
        return out

    return of


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """_id, _hash, set (16-byte digest of the n-gram set, null without words), size, bands of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, of = NGrams(), _signatures(bands, rows)
        a, b = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
        for pdf in slices(batches):
            found = [grams(t) for t in pdf["text"]]
            digest = [np.array([_mix(g ^ a).sum(dtype=np.uint64), _mix(g ^ b).sum(dtype=np.uint64)]).tobytes() if len(g) else None for g in found]
            yield pd.DataFrame({"_id": pdf["_id"], "_hash": pdf["_hash"], "set": digest, "size": [len(g) for g in found], "bands": [of(g).view(np.int64) if len(g) else None for g in found]})

    rows_in = docs.select(F.col("doc_id").cast("string").alias("_id"), key_hash(F.col("text")).alias("_hash"), "text")
    return as_number(rows_in.mapInPandas(run, "_id string, _hash long, set binary, size long, bands array<long>"), "_id")


def blocks_of(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of the classes that share a bucket, and the pairs of blocks (a <= b) to compare. Both written."""
    rows = classes.select("set", "size", F.posexplode("bands").alias("band", "h"))
    rows = materialise(rows.select("set", "size", F.xxhash64("band", "h").alias("bucket")), "bands")
    buckets = materialise(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = materialise(join_small(rows, buckets, "bucket", "inner"), "shared")
    home = materialise(shared.groupBy("set").agg(F.max(F.struct("n", "bucket")).alias("top")), "home")
    # a bucket passes the largest of its members' homes on to all of them, so that one group of copies has one home
    near = materialise(shared.select("set", "bucket").join(home, "set").groupBy("bucket").agg(F.max("top").alias("top")), "home")
    home = materialise(join_small(shared.select("set", "size", "bucket"), near, "bucket", "inner").groupBy("set").agg(F.max("top")["bucket"].alias("home"), F.max("size").alias("size")), "home")
    sizes = home.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_NGRAMS)).alias("parts"))
    sizes = materialise(sizes, "sizes")
    part = F.pmod(F.xxhash64("set"), F.col("parts"))
    placed = materialise(join_small(home, sizes, "home", "inner").select("set", F.xxhash64("home", part).alias("block")), "placed")
    spread = shared.select("set", "bucket").join(placed, "set").select("bucket", "block").distinct()
    spread = materialise(spread, "spread")
    other = spread.select("bucket", F.col("block").alias("other"))
    pairs = spread.join(other, "bucket").where("block <= other").select("block", "other").distinct()
    return placed, materialise(pairs, "pairs")


def _compare(similarity: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """All links between the two blocks of a pair, or inside the one."""
        sets, copies = pdf["set"].to_numpy(), pdf["copies"].to_numpy()
        grams = [np.frombuffer(x, np.uint64) for x in pdf["grams"]]
        sizes = np.array([len(g) for g in grams])
        n = len(sets)
        owner = np.repeat(np.arange(n), sizes)
        values, ids = np.unique(np.concatenate(grams), return_inverse=True)
        common = np.bincount(ids, minlength=len(values))
        keep = common[ids] > 1  # n-grams of one class alone add to no intersection
        owner, ids = owner[keep], np.unique(ids[keep], return_inverse=True)[1]
        both = np.zeros((n, n), np.float32)
        order = np.argsort(ids, kind="stable")
        owner, ids = owner[order], ids[order]
        for low in range(0, int(ids[-1]) + 1 if len(ids) else 0, 2048):
            i, j = np.searchsorted(ids, (low, low + 2048))
            x = np.zeros((n, 2048), np.float32)
            x[owner[i:j], ids[i:j] - low] = 1
            both += x @ x.T
        linked = both >= (similarity * (sizes[:, None] + sizes[None, :] - both)) - 1e-6
        np.fill_diagonal(linked, False)
        side = pdf["side"].to_numpy()
        if (side != side[0]).any():
            linked &= side[:, None] != side[None, :]
        root = np.arange(n)
        for _ in range(n):
            new = np.minimum(root, np.where(linked, root[None, :], n).min(1))
            new = new[new]  # a class takes its root's root: rounds grow with the logarithm of a chain
            if (new == root).all():
                break
            root = new
        some = linked.any(1)
        return pd.DataFrame({"set": sets[some], "root": sets[root[some]], "links": (linked @ copies)[some], "partners": linked.sum(1)[some]})

    return run


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """_id, _hash, set, group, n_links, n_partners for every document row.

    set is the class of equal n-gram sets; group the least set of its component (null without words); n_links counts
    the other documents of this similarity or more, copies included; n_partners the other classes."""
    signed = materialise(signatures(docs, *choose_bands(similarity, recall)), "signatures")
    classes = signed.where("set is not null").groupBy("set").agg(F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    classes = materialise(classes, "classes")
    placed, pairs = blocks_of(classes)

    # the n-grams of one document for each placed class, made again from its text
    same = signed.where("set is not null").groupBy("set", "_id", "_hash").agg(F.count("*").alias("n"))
    least = same.groupBy("set").agg(F.min(F.struct("_id", "_hash", "n")).alias("d"), F.sum("n").alias("copies"))
    chosen = materialise(placed.join(least, "set").select("set", "block", "copies", F.col("d._id").alias("cid"), F.col("d._hash").alias("chash"), (F.col("d.n") > 1).alias("again")), "chosen")

    def grams_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = NGrams()
        for pdf in slices(batches):
            yield pdf.drop(columns="text").assign(grams=[grams(t).tobytes() for t in pdf["text"]])

    texts = docs.select("doc_id", key_hash(F.col("text")).alias("h"), "text")
    mine = F.col("doc_id").eqNullSafe(F.col("cid")) & (F.col("h") == F.col("chash"))
    held = join_small(texts, chosen, mine, "inner").select("set", "block", "copies", "again", "text")
    held = materialise(held.mapInPandas(grams_of, "set binary, block long, copies long, again boolean, grams binary"), "grams")
    held = held.where("not again").unionByName(held.where("again").dropDuplicates(["set"]))  # a repeated row stands for its class once
    asked = pairs.select(F.xxhash64("block", "other").alias("pair"), F.explode(F.array_distinct(F.array("block", "other"))).alias("block"))
    rows = held.join(asked, "block")
    found = rows.select("pair", F.col("block").alias("side"), "set", "copies", "grams").groupBy("pair").applyInPandas(_compare(similarity), "set binary, root binary, links long, partners long")
    found = materialise(found, "found")
    counts = materialise(found.groupBy("set").agg(F.sum("links").alias("links"), F.sum("partners").alias("partners")), "counts")
    groups = connected_components(found.select("set", "root"), "set", "root").withColumnsRenamed({"node": "set", "root": "group"})
    known = materialise(classes.select("set", "copies").join(counts, "set", "left").join(groups, "set", "left").select(F.col("set").alias("s"), "copies", "links", "partners", "group"), "known")
    out = signed.select("_id", "_hash", "set").join(known, F.col("set") == F.col("s"), "left")
    n_links = F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))
    return out.select("_id", "_hash", "set", F.coalesce("group", "set").alias("group"), n_links.cast("long").alias("n_links"), F.coalesce("partners", F.lit(0)).cast("long").alias("n_partners"))


def grouped(docs: DataFrame, **how) -> DataFrame:
    """_id, _hash, class_id (the least doc_id of the group; its own for a document without words), n_links, n_partners."""
    rows = materialise(near_duplicates(docs, **how), "rows")
    ids = materialise(rows.where(F.col("group").isNotNull()).groupBy("group").agg(F.min("_id").alias("class_id")), "ids")
    return rows.join(ids, "group", "left").select("_id", "_hash", F.coalesce("class_id", "_id").alias("class_id"), "n_links", "n_partners")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each group of near duplicates (the least doc_id); rows without words all stay."""
    rows = materialise(near_duplicates(docs.select("doc_id", "text"), **how), "rows")
    several = rows.where(F.col("group").isNotNull()).groupBy("group").agg(F.min(F.struct("_id", "_hash")).alias("first"), F.count("*").alias("n")).where("n > 1")
    several = materialise(several.select(F.col("group").alias("g"), "first"), "several")
    rest = join_small(rows, several, F.col("group") == F.col("g"), "inner").select(F.struct("_id", "_hash").alias("me"), "first")
    dropped = materialise(rest.where(~F.col("me").eqNullSafe(F.col("first"))).select(F.col("me._id").alias("_near_id"), F.col("me._hash").alias("_near_hash")).distinct(), "dropped")
    again = rest.where(F.col("me").eqNullSafe(F.col("first"))).groupBy("me").agg(F.count("*").alias("n")).where("n > 1")
    again = materialise(again.select(F.col("me._id").alias("_near_id"), F.col("me._hash").alias("_near_hash")), "again")
    h = key_hash(F.col("text"))
    left = join_small(docs, dropped, F.col("doc_id").eqNullSafe(F.col("_near_id")) & (h == F.col("_near_hash")), "left_anti")
    repeated = F.col("doc_id").eqNullSafe(F.col("_near_id")) & (h == F.col("_near_hash"))
    one = join_small(left, again, repeated, "left_semi").dropDuplicates(["doc_id", "text"])
    return join_small(left, again, repeated, "left_anti").unionByName(one)


def op3_ngram_join(spark, sf_dir):
    out = grouped(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("_id").alias("doc_id"), "class_id", "n_links", "n_partners")
