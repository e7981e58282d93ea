"""Phrase collocations by Apriori level-wise passes over the corpus, scored from the level tables.

Level 1 counts words; a pass for each level k counts phrases of k words. The frequent phrases of the level below travel to
the tasks, which emit a phrase only where both phrases of k - 1 words that overlap in it are frequent. Texts are cut into
words twice: to count them, and to write the numbers of the frequent ones; the passes read these numbers alone. A phrase of
level k is the pair of its two overlapping phrases of level k - 1, so its code has 64 bits at every level.

A level travels only if it has at most MOST_SHIPPED rows of at most SHIPPED_BYTES (checked on the written table). Beyond that
phrases are counted by shuffle and joined with the level below, with the same result. Every phrase of two words or more is
then cut after each of its words; the counts of the two parts come from the level tables by joins.

Everything is per lang; a null lang is `und`, as if the text said so. Null and blank texts have no words. Repeated rows count
each. Equal scores are ordered by count, then by the phrase's bytes. An empty table gives an empty result. Other columns are
ignored. A long text is cut like any other: tasks hold texts of 2 million characters, or one text, at a time.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, is_small, join_small, materialise, table, text_runs, top_rows

LONGEST, LEAST, TOP = 3, 10, 2000
#: A phrase goes if a longer candidate around it has so many hundredths of its count.
COVERED = 50
MOST_SHIPPED, SHIPPED_BYTES = 1_000_000, 24 << 20
#: Distinct words or codes that a task counts before it passes their counts on.
MOST_COUNTED = 200_000
MOST_CODES = 1_000_000
#: Words in a row of numbers, about, and rows that are looked at together.
ROW_WORDS, AT_ONCE = 512, 512
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Bytes as the cut sees them: A-Z lower-cased, tabs as blanks, and every break as a full stop, which no word holds.
SEEN = bytes(46 if c in BREAKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_and_breaks(texts: list[str]) -> list[bytes]:
    """The words of all texts in order, with b"." between pieces and texts."""
    return ".".join(texts).encode("utf-8", "replace").translate(SEEN).replace(b".", b" . ").split()


def by_lang(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list[bytes]]]:
    for pdf in batches:
        for part in text_runs(pdf):
            for lang, rows in part.groupby("lang", sort=False):
                yield lang, words_and_breaks(rows["text"].tolist())


def prepared(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def word_table(docs: DataFrame) -> DataFrame:
    """lang, phrase, c of every word; tasks add up counts of MOST_COUNTED words at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, Counter[bytes]] = defaultdict(Counter)

        def flush() -> Iterator[pd.DataFrame]:
            for lang, found in counts.items():
                found.pop(b".", None)
                if found:
                    yield pd.DataFrame({"lang": [lang] * len(found), "phrase": [w.decode() for w in found], "c": list(found.values())})
            counts.clear()

        for lang, words in by_lang(batches):
            counts[lang].update(words)
            if sum(map(len, counts.values())) > MOST_COUNTED:
                yield from flush()
        yield from flush()

    return docs.mapInPandas(run, "lang string, phrase string, c long").groupBy("lang", "phrase").agg(F.sum("c").alias("c"))


class Words:
    """The frequent words as the tasks need them: one Arrow array by lang and word, and where each lang's part ends. A word's
    number is its place. These three travel, not the object: broadcasts carry no classes of this package."""

    def __init__(self, words: pa.Array, langs: list[str], ends: np.ndarray):
        self.words, self.langs, self.ends = words, langs, ends

    def parts(self) -> tuple[pa.Array, list[str], np.ndarray]:
        return self.words, self.langs, self.ends

    @classmethod
    def of(cls, rows: DataFrame) -> Words:
        found = rows.select("lang", "phrase").toArrow().sort_by([("lang", "ascending"), ("phrase", "ascending")])  # checked by is_small()
        langs = pc.run_end_encode(found["lang"].combine_chunks()) if len(found) else None
        ends = np.array(langs.run_ends.to_pylist() if langs else [], np.int64)
        return cls(found["phrase"].cast(pa.large_binary()).combine_chunks(), langs.values.to_pylist() if langs else [], ends)

    def numbers(self, lang: str, words: list[bytes]) -> np.ndarray:
        """The number of each word, or -1."""
        if lang not in self.langs:
            return np.full(len(words), -1, np.int32)
        k = self.langs.index(lang)
        first = int(self.ends[k - 1]) if k else 0
        at = pc.index_in(pa.array(words, pa.large_binary()), value_set=self.words.slice(first, int(self.ends[k]) - first))
        return pc.fill_null(pc.add(at, pa.scalar(first, pa.int32())), -1).to_numpy(zero_copy_only=False)

    def spelled(self, numbers: np.ndarray) -> tuple[list[str], pa.Array]:
        """Lang and phrase of each row of numbers."""
        parts = [self.words.take(pa.array(col)).cast(pa.large_string()) for col in numbers.T]
        phrases = parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
        return [self.langs[k] for k in np.searchsorted(self.ends, numbers[:, 0], side="right")], phrases


def sorted_codes(rows: DataFrame) -> np.ndarray:
    return np.sort(rows.select("code").toArrow()["code"].to_numpy())  # checked by is_small()


def numbered(docs: DataFrame, words: Words) -> DataFrame:
    """ids: 32-bit numbers of the frequent words of some texts in order, with one -1 wherever a phrase cannot go on, and at the
    end of each row. Written. Rows are short, as tasks get them by number."""
    shared = docs.sparkSession.sparkContext.broadcast(words.parts())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(*shared.value)
        for lang, found in by_lang(batches):
            ids = np.append(words.numbers(lang, found), np.int32(-1))
            ids = ids[(ids >= 0) | (np.concatenate(([-1], ids[:-1])) >= 0)]
            ends = np.flatnonzero(ids < 0) + 1
            if len(ends):  # rows of about ROW_WORDS words, cut where no phrase goes on
                cuts = np.unique(ends[np.searchsorted(ends, np.arange(ROW_WORDS, ends[-1], ROW_WORDS))])
                yield pd.DataFrame({"ids": [x.tobytes() for x in np.split(ids, cuts) if len(x)]})

    return materialise(docs.mapInPandas(run, "ids binary"), "ids")


def pair_codes(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two phrases follow each other by one word, and the codes of these pairs. places: the number of the frequent
    phrase that begins at each word, or -1."""
    at = np.flatnonzero((places[:-1] >= 0) & (places[1:] >= 0))
    return at, places[at] << 32 | places[at + 1]


def places_of(ids: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """The frequent phrase of the last table's level that begins at each word, or -1."""
    places = ids.astype(np.int64)
    for codes in tables:
        at, found = pair_codes(places)
        places = np.full(len(places), -1, np.int64)
        if len(codes):
            k = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
            hit = codes[k] == found
            places[at[hit]] = k[hit]
    return places


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.empty(0, int)
    return codes[first], np.add.reduceat(counts, first) if len(codes) else counts


def code_table(ids: DataFrame, tables: list[np.ndarray], least: int) -> DataFrame:
    """code, c of the frequent phrases one word longer than those of the last table. Written."""
    shared = ids.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held = [], 0
        for pdf in batches:
            for k in range(0, len(pdf), AT_ONCE):
                _, codes = pair_codes(places_of(np.frombuffer(b"".join(pdf["ids"].iloc[k : k + AT_ONCE]), np.int32), shared.value))
                found = np.unique(codes, return_counts=True)
                parts.append(found)
                held += len(found[0])
                if held > MOST_CODES:
                    parts = [summed(parts)]
                    held = len(parts[0][0])
                    if 2 * held > MOST_CODES:
                        yield pd.DataFrame(dict(zip(("code", "c"), parts[0], strict=True)))
                        parts, held = [], 0
        if parts:
            yield pd.DataFrame(dict(zip(("code", "c"), summed(parts), strict=True)))

    return materialise(ids.mapInPandas(run, "code long, c long").groupBy("code").agg(F.sum("c").alias("c")).where(F.col("c") >= least), "level")


def spelled(rows: DataFrame, words: Words, tables: list[np.ndarray]) -> DataFrame:
    """code, c -> lang, phrase, c. tables: the codes of the levels below."""
    shared = rows.sparkSession.sparkContext.broadcast((words.parts(), tables))

    def numbers(codes: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """A row of word numbers for each code."""
        first, second = codes >> 32, codes & 0xFFFFFFFF
        if not tables:
            return np.stack([first, second], 1)
        return np.concatenate([numbers(tables[-1][first], tables[:-1]), numbers(tables[-1][second], tables[:-1])[:, -1:]], 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, tables = shared.value
        words = Words(*parts)
        for pdf in batches:
            langs, phrases = words.spelled(numbers(pdf["code"].to_numpy(), tables))
            yield pd.DataFrame({"lang": langs, "phrase": phrases.to_pylist(), "c": pdf["c"]})

    return rows.mapInPandas(run, "lang string, phrase string, c long")


def counted_by_shuffle(docs: DataFrame, below: DataFrame, size: int, least: int) -> DataFrame:
    """The same level without a broadcast: all phrases of so many words, counted and joined with the level below."""
    pieces = F.explode(F.split(ascii_lower(F.col("text")), r"[.,;:!?\n-\r]"))
    rows = docs.select("lang", pieces.alias("piece")).select("lang", F.array_remove(F.split(F.replace("piece", F.lit("\t"), F.lit(" ")), " "), "").alias("w"))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.array_join(F.slice("w", i, size), " "))
    rows = rows.where(F.size("w") >= size).select("lang", F.explode(grams).alias("phrase")).groupBy("lang", "phrase").agg(F.count("*").alias("c")).where(F.col("c") >= least)
    for name, part in (("head", head(F.col("phrase"), size - 1)), ("tail", tail(F.col("phrase"), size - 1))):
        rows = rows.withColumn(name, part).join(below.select("lang", F.col("phrase").alias(name)), ["lang", name], "left_semi").drop(name)
    return rows


def head(phrase: Column, k) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), 1, k), " ")


def tail(phrase: Column, k) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), -k, k), " ")


def level_tables(docs: DataFrame, words: DataFrame, longest: int, least: int, most: int) -> list[DataFrame]:
    """Written tables lang, phrase, c of the frequent phrases of 1 to `longest` words."""
    out = [materialise(words.where(F.col("c") >= least), "words")]
    shipped, tables, ids, level = is_small(out[0], most, SHIPPED_BYTES), [], None, None
    for size in range(2, longest + 1):
        if shipped and size > 2:
            shipped = is_small(level, most, SHIPPED_BYTES)
            tables = [*tables, sorted_codes(level)] if shipped else tables
        if not shipped:
            out.append(materialise(counted_by_shuffle(docs, out[-1], size, least), "level"))
            continue
        if ids is None:
            first = Words.of(out[0])
            ids = numbered(docs, first)
        level = code_table(ids, tables, least)
        out.append(materialise(spelled(level, first, tables), "level"))
    return out


def scored(levels: list[DataFrame], covered: int = COVERED) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer one covers."""
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    longer = levels[1]
    for x in levels[2:]:
        longer = longer.unionByName(x)
    c, size = F.col, F.size(F.split("phrase", " "))
    cuts = longer.select("lang", "phrase", c("c").alias("a"), size.alias("size"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"first": head(c("phrase"), c("k")), "rest": tail(c("phrase"), c("size") - c("k"))})
    cuts = cuts.join(every.select("lang", c("phrase").alias("first"), c("c").alias("l")), ["lang", "first"]).join(every.select("lang", c("phrase").alias("rest"), c("c").alias("r")), ["lang", "rest"])
    score = F.expr("(1000000BD * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")  # exact: div of decimals cuts to a whole number
    best = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    n_words = F.size(F.split("phrase", " "))
    inner = longer.where(n_words > 2).select("lang", c("c").alias("around"), F.split("phrase", " ").alias("w"))
    inner = inner.select("lang", "around", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("s"))
    inner = inner.select("lang", "around", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - c("s") + 1), lambda i: F.array_join(F.slice("w", i, c("s")), " "))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    best = best.join(inner, ["lang", "phrase"], "left").where(~F.coalesce(100 * c("around") >= covered * c("a"), F.lit(False)))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, most: int = MOST_SHIPPED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's first phrases of 2 to `longest` words."""
    docs = prepared(docs)
    words = materialise(word_table(docs), "counts")
    n = materialise(words.groupBy("lang").agg(F.sum("c").alias("n")), "totals")
    found = materialise(scored(level_tables(docs, words, longest, least, most)), "scored")
    ranked = top_rows(found, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return join_small(ranked, n, "lang", "inner").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))
