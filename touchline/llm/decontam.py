"""Benchmark decontamination through a positional inverted index.

The index holds postings (term, document, position) of the corpus. Each benchmark window is looked up from its rarest
terms: the shortest posting lists are shifted by the term's offset in the window and intersected, and what survives is
compared word for word with the document. Lists that are much longer than a window's shortest one are not fetched: the
comparison with the text settles them.

A proximity match has at least 4 in 5 of a window's words within `SLOP` positions of their places from some start. It must
hold one of the window's rarest words that occur in the corpus, one more of them than may be missing (words that occur
nowhere are missing already); every posting of theirs is compared with the text around it.

Every text is cut into words once and written; a row repeated alike enters the index once. Null texts have no words. An
item without words has no window. Repeated documents get equal rows. Empty tables give no hits. Other columns are ignored
or carried, but for names that start with _leak_. Long texts stay in their row; a document's candidates are bounded by its
length. Ties between equally rare terms go to the earlier one in the window; no result depends on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ascii_lower, is_small, join_small, key_hash, materialise, table

SEPARATOR_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
LISTS = 3
LIST_RATIO = 20
SLOP = 3
#: Windows of one anchor that stand in a row of the anchor table.
ANCHORED = 256
COPIES = 100_000
MOST_PARTS = 10_000
KEY = ["_id", "_hash"]


def tokens_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATOR_RUN), "")


def windows_of(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """wid, words of every distinct window; and wid, item. Both written."""
    w = F.when(F.size("t") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("t") - WINDOW + 1), lambda i: F.slice("t", i, F.lit(WINDOW)))).when(F.size("t") > 0, F.array("t"))
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), tokens_of(F.col("text")).alias("t")).select("item", F.explode(w).alias("words"))
    items = materialise(rows.select(F.xxhash64("words").alias("wid"), "item", "words").distinct(), "items")
    return materialise(items.select("wid", "words").distinct(), "windows"), items.select("wid", "item")


def word_table(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """_id, _hash, t: the words of every document, rows alike in doc_id and text being one; and r_id, r_hash, n of the rows
    that are repeated. Both written."""
    mine = docs.select(F.col("doc_id").alias("_id"), key_hash(F.col("text")).alias("_hash"), "text")
    again = mine.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").select(*(F.col(k).alias(f"r{k}") for k in KEY), "n")
    again = materialise(again, "again")
    words = lambda rows: rows.select(*KEY, tokens_of(F.col("text")).alias("t"))
    once = words(join_small(mine, again, same("r"), "left_semi").dropDuplicates(KEY))
    return materialise(words(join_small(mine, again, same("r"), "left_anti")).unionByName(once), "words"), again


def same(prefix: str) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in KEY]


def repeated(rows: DataFrame, again: DataFrame) -> DataFrame:
    """Rows by key, each as often as the documents repeat it: COPIES at a time, so that many copies are many tasks' work (a
    number of tasks, which AQE does not coalesce)."""
    more = join_small(rows, again, same("r"), "inner")
    more = more.select(*rows.columns, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))).alias("from"))
    parts = max(1, int(again.agg(F.coalesce(F.sum(F.ceil(F.col("n") / COPIES)), F.lit(1))).first()[0]))
    more = more.repartition(min(MOST_PARTS, parts), "from", *KEY).select(*rows.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES).cast("long"), F.col("n") - F.col("from")))))
    return join_small(rows, again, same("r"), "left_anti").unionByName(more.select(*rows.columns))


def term_counts(words: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: how long each posting list is, for the terms asked for."""
    rows = words.select(F.explode("t").alias("term"))
    return join_small(rows, terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def anchors_of(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """wid, term, off, bit, full: the rarest terms of each window all of whose terms occur in the corpus."""
    rows = windows.select("wid", F.size("words").alias("len"), F.posexplode("words").alias("off", "term"))
    rows = rows.join(counts, "term").withColumn("have", F.count("*").over(Window.partitionBy("wid"))).where("have >= len")
    rare = Window.partitionBy("wid").orderBy("n", "off")
    rows = rows.withColumn("k", F.row_number().over(rare)).withColumn("least", F.min("n").over(Window.partitionBy("wid")))
    rows = rows.where((F.col("k") <= LISTS) & ((F.col("k") == 1) | (F.col("n") <= LIST_RATIO * F.col("least"))))
    bit = F.call_function("shiftleft", F.lit(1), F.col("k") - 1)
    return rows.withColumn("bit", bit).withColumn("full", F.sum("bit").over(Window.partitionBy("wid")).cast("int")).select("wid", "term", "off", "k", "bit", "full")


def postings(words: DataFrame, terms: DataFrame) -> DataFrame:
    """The index of the terms asked for: term, document, position."""
    rows = words.select(*KEY, F.posexplode("t").alias("pos", "term"))
    return join_small(rows, terms, "term", "left_semi")


def lookup(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """document, wid, start: alignments of all lists of a window at one start."""
    rows = join_small(index, anchors, "term", "inner").select(*KEY, "wid", (F.col("pos") - F.col("off")).alias("start"), "k", "bit", "full")
    w = Window.partitionBy(*KEY, "wid").orderBy("start")
    rows = rows.withColumn("here", F.bit_or("bit").over(w.rangeBetween(0, 0)))
    return rows.where((F.col("k") == 1) & (F.col("here") == F.col("full")) & (F.col("start") >= 0)).select(*KEY, "wid", "start")


def verified(words: DataFrame, found: DataFrame, windows: DataFrame) -> DataFrame:
    """document, wid, start, len of the alignments whose words are the document's."""
    sure = join_small(found, windows, "wid", "inner")
    there = sure.groupBy(*(F.col(k).alias(f"c{k}") for k in KEY)).agg(F.collect_list(F.struct("start", "wid", "words")).alias("c"))
    there = materialise(there, "candidates")
    good = F.filter("c", lambda c: F.slice("t", c["start"] + 1, F.size(c["words"])) == c["words"])
    asked = join_small(words, there.select(*(f"c{k}" for k in KEY)), same("c"), "left_semi")  # the keys may travel, the candidates are joined by shuffle
    rows = asked.join(there.hint("shuffle_hash"), same("c")).select(*KEY, F.explode(good).alias("g"))
    return rows.select(*KEY, F.col("g.wid").alias("wid"), F.col("g.start").alias("start"), F.size("g.words").alias("len"))


def may_miss(words: Column) -> Column:
    """How many of a window's words a proximity match may lack."""
    return F.floor(F.size(words) / 5).cast("int")


def near_anchors(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """term, ws (wid, words and the term's place of some ANCHORED windows that it anchors), all their words, and how many of
    these a match has at least. A term of more windows has more rows."""
    rows = windows.select("wid", "words", F.posexplode("words").alias("off", "term")).join(counts, "term")
    w = Window.partitionBy("wid")
    absent = F.size("words") - F.count("*").over(w)
    rows = rows.withColumns({"k": F.row_number().over(w.orderBy("n", "off")), "spare": may_miss(F.col("words")) - absent}).where("k <= spare + 1")
    least = F.min(F.size(F.array_distinct("words")) - may_miss(F.col("words")))
    parts = F.ceil(F.count("*").over(Window.partitionBy("term")) / ANCHORED)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("wid"), parts))
    return rows.groupBy("term", "part").agg(F.collect_list(F.struct("wid", "off", "words")).alias("ws"), F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"), least.alias("least"))


def near_matches(words: DataFrame, windows: DataFrame, counts: DataFrame) -> DataFrame:
    """document, wid of every proximity match."""
    anchors = materialise(near_anchors(windows, counts), "near")
    c, reach = F.col, WINDOW - 1 + 2 * SLOP
    base = F.greatest(F.lit(0), c("pos") - reach)
    around = F.slice("t", base + 1, c("pos") + reach + 1 - base)
    terms = anchors.select("term").distinct()
    if is_small(anchors):  # the words around a posting are cut where it is found, so no text moves
        rows = words.select(*KEY, "t", F.posexplode("t").alias("pos", "term")).join(F.broadcast(terms), "term", "left_semi")
        rows = rows.select(*KEY, "term", "pos", base.alias("base"), around.alias("text"))
    else:  # postings by shuffle, then back to their documents
        spots = postings(words, terms).groupBy(*(c(k).alias(f"c{k}") for k in KEY)).agg(F.collect_set("pos").alias("spots"))
        rows = words.join(spots, same("c")).select(*KEY, "t", F.explode("spots").alias("pos"))
        rows = rows.select(*KEY, F.get("t", c("pos")).alias("term"), "pos", base.alias("base"), around.alias("text"))
    rows = join_small(rows, anchors, "term", "inner").where(F.size(F.array_intersect("words", "text")) >= c("least"))
    rows = rows.select(*KEY, "pos", "base", "text", F.explode("ws").alias("w")).select(*KEY, "pos", "base", "text", "w.*")
    rows = rows.where(F.size(F.array_except("words", "text")) <= may_miss(c("words")))
    low = lambda at: F.greatest(F.lit(0), at - SLOP - c("base"))
    there = lambda x, at: F.array_contains(F.slice("text", low(at) + 1, F.greatest(F.lit(0), at + SLOP - c("base") + 1 - low(at))), x)
    missing = lambda s: F.size(F.filter("words", lambda x, i: ~there(x, s + i)))
    first = c("pos") - c("off")
    return rows.where(F.exists(F.sequence(first - SLOP, first + SLOP), lambda s: missing(s) <= may_miss(c("words")))).select(*KEY, "wid").distinct()


def covered(spans: Column) -> Column:
    """Positions in the union of struct(start, len) spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(a["end"], x["start"]))).alias("n"), F.greatest(a["end"], x["start"] + x["len"]).alias("end"))
    return F.aggregate(F.array_sort(spans), zero, step)["n"]


def exact_matches(words: DataFrame, windows: DataFrame, counts: DataFrame) -> DataFrame:
    """document, wid, start, len of every exact match; written."""
    anchors = materialise(anchors_of(windows, counts), "anchors")
    index = materialise(postings(words, materialise(anchors.select("term").distinct(), "terms")), "index")
    return materialise(verified(words, materialise(lookup(index, anchors), "found"), windows), "exact")


def looked_for(words: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The windows, their items, and how often their terms occur."""
    windows, items = windows_of(benchmark)
    counts = materialise(term_counts(words, materialise(windows.select(F.explode("words").alias("term")).distinct(), "terms")), "counts")
    return windows, items, counts


def matches(words: DataFrame, benchmark: DataFrame) -> DataFrame:
    """_id, _hash, n_hit, items (sorted), n_near for every document of word_table() with an exact or proximity match."""
    windows, items, counts = looked_for(words, benchmark)
    exact = exact_matches(words, windows, counts)
    found = materialise(near_matches(words, windows, counts), "found")
    of = lambda rows: join_small(rows.select(*KEY, "wid").distinct(), items, "wid", "inner")
    hits = exact.groupBy(*KEY).agg(F.collect_set(F.struct("start", "len")).alias("s")).select(*KEY, covered(F.col("s")).cast("long").alias("n_hit"))
    named = of(exact).groupBy(*KEY).agg(F.array_sort(F.collect_set("item")).alias("items"))
    near = of(found).groupBy(*KEY).agg(F.count_distinct("item").alias("n_near"))
    link = lambda x, y: [F.col(f"{x}.{k}").eqNullSafe(F.col(f"{y}.{k}")) for k in KEY]
    out = near.alias("n").join(hits.alias("h"), link("n", "h"), "left").join(named.alias("i"), link("n", "i"), "left")
    return materialise(out.select("n._id", "n._hash", "h.n_hit", "i.items", "n.n_near"), "matches")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark window."""
    words, _ = word_table(docs.select("doc_id", "text"))
    windows, _, counts = looked_for(words, benchmark)
    bad = exact_matches(words, windows, counts).select(F.col("_id").alias("_leak_id"), F.col("_hash").alias("_leak_hash")).distinct()
    bad = materialise(bad, "bad")
    return join_small(docs, bad, F.col("doc_id").eqNullSafe(F.col("_leak_id")) & (key_hash(F.col("text")) == F.col("_leak_hash")), "left_anti")


def op10_decontaminate(spark, sf_dir):
    words, again = word_table(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = matches(words, table(spark, sf_dir, "benchmark")).select(*(F.col(c).alias(f"m{c}") for c in (*KEY, "n_hit", "items", "n_near")))
    each = join_small(words.select(*KEY, F.size("t").cast("long").alias("n_words")), found, same("m"))
    items = F.coalesce("mitems", F.array().cast("array<string>"))
    n_hit = F.coalesce("mn_hit", F.lit(0)).cast("long")
    each = each.select(*KEY, "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("mn_near", F.lit(0)).cast("long").alias("n_near_items"))
    return repeated(each, again).select(F.col("_id").alias("doc_id"), *each.columns[2:])
