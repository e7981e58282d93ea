"""Quality rules whose thresholds come from the corpus: a mergeable quantile sketch per language and source.

The sketch is a log-linear histogram: counts of bins that are exact below 64 and 1/32 wide above. Sketches of parts
merge by adding counts, in any order and with one result, so they are built by a plain partial aggregation and merged
upwards: groups of fewer than `min_group` documents use the sketch of their language, small languages that of the corpus.

Null texts count as empty. Null languages and sources form groups of their own. Repeated rows are judged alike. An
empty table gives an empty result. Columns other than doc_id, text, lang and source are ignored or carried untouched, but
for names that start with _quality_. A value equal to its bound is kept. Long texts are measured whole in their row; the windows
of one are sorted only if some repeat.

A text's share of symbols, repeated lines or repeated words enters sketch and verdict as the lower end of its confidence
interval (Wilson's, Z deviations wide), so that one line of six that stands twice is no evidence while twenty of sixty are;
every repeat counts, none is free. Where a group's quartiles are equal, the fence still is WIDTH wide on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACES, join_small, let, materialise, table, without, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Deviations of the confidence interval of a text's shares: chance alone passes it in one text of 30 000.
Z = 4.0
#: Metric: the least distance of a bound from its quartile (shares per 10 000; word length in hundredths).
WIDTH = {"symbols": 500, "dup_lines": 500, "repeats": 500, "word_chars": 250}
FENCE = 3
MIN_GROUP = 100
METRICS = list(WIDTH)
P = "_quality_"


def _repeated_exact(words: Column) -> Column:
    """Words covered by windows that occur at least twice: sort the windows, keep those equal to a neighbour, join spans."""
    grams = F.array_sort(F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.struct(F.array_join(F.slice(words, i, F.lit(WINDOW)), " ").alias("g"), i.alias("i"))))
    starts = let(grams, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, k: (F.get(s, k - 1)["g"] == x["g"]) | F.coalesce(F.get(s, k + 1)["g"] == x["g"], F.lit(False))), lambda x: x["i"])))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(starts, zero, lambda a, x: F.struct((a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - x)).alias("n"), (x + WINDOW).alias("end")))["n"]


def n_repeat_words(words: Column) -> Column:
    """Words inside 8-word windows found twice or more. Hashes only clear texts without any repeat; the rest is exact."""
    hashes = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW))))
    some = lambda w: let(hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_repeated_exact(w)))
    return let(words, lambda w: F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(some(w)))


def with_measures(docs: DataFrame) -> DataFrame:
    """The documents with the counts behind each rule, under names that start with _quality_."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    one = F.struct(words_of(F.col("text")).alias("w"), lines.alias("l"), without(text, SPACES).alias("c"))
    found = let(one, lambda x: F.struct(
        F.size(x["w"]).cast("long").alias("n_words"),
        F.length(x["c"]).cast("long").alias("word_chars"),
        (F.length(x["c"]) - F.length(without(x["c"], SYMBOLS))).cast("long").alias("n_symbols"),
        F.size(x["l"]).cast("long").alias("n_lines"),
        (F.size(x["l"]) - F.size(F.array_distinct(x["l"]))).cast("long").alias("n_dup_lines"),
        n_repeat_words(x["w"]).cast("long").alias("n_repeat_words"),
    ))
    return docs.withColumn(f"{P}m", found)


def evident(k: Column, n: Column) -> Column:
    """The lower end of the confidence interval of the share k of n, per 10 000; 0 where n is."""
    k, n = k.cast("double"), n.cast("double")
    p, a = F.least(F.lit(1.0), k / n), F.lit(Z * Z) / n
    low = (p + a / 2 - F.lit(Z) * F.sqrt(p * (1 - p) / n + a / (4 * n))) / (1 + a)
    return F.when(n > 0, F.floor(10_000 * F.greatest(F.lit(0.0), low))).otherwise(0).cast("long")


def _values() -> list[Column]:
    """The metrics of a text. Words in repeated windows count as one event for each WINDOW of them."""
    m = F.col(f"{P}m")
    return [
        evident(m["n_symbols"], m["word_chars"]).alias("symbols"),
        evident(m["n_dup_lines"], m["n_lines"]).alias("dup_lines"),
        evident(m["n_repeat_words"] / WINDOW, m["n_words"] / WINDOW).alias("repeats"),
        F.when(m["n_words"] > 0, F.floor(m["word_chars"] * 100 / m["n_words"])).otherwise(0).cast("long").alias("word_chars"),
    ]


def base_failed() -> Column:
    m = F.col(f"{P}m")
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def sketch(measured: DataFrame) -> DataFrame:
    """Counts by lang, source, metric and bin, over the documents that pass the fixed rules."""
    rows = measured.where(~base_failed()).select("lang", "source", F.explode(F.map_from_arrays(F.array(*map(F.lit, METRICS)), F.array(*_values()))).alias("metric", "v"))
    bits = F.length(F.bin("v")) - 6
    binned = F.when(F.col("v") < 64, F.col("v")).otherwise(F.call_function("shiftright", F.col("v"), bits) + 32 * bits)
    return rows.groupBy("lang", "source", "metric", binned.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def lower_edge(b: Column) -> Column:
    """The least value of a bin."""
    e = F.floor(b / 32).cast("int") - 1
    return F.when(b < 64, b).otherwise(F.call_function("shiftleft", b - 32 * e, e)).cast("long")


def quantiles(bins: DataFrame, keys: list[str]) -> DataFrame:
    """First and third quartile of each merged sketch, and how many documents it holds."""
    merged = bins.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "metric")
    part = merged.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    at = lambda num, den: lower_edge(F.min(F.when(den * F.col("upto") >= num * F.col("total"), F.col("bin"))))
    return part.groupBy(*keys, "metric").agg(at(1, 4).alias("q1"), at(3, 4).alias("q3"), F.max("total").alias("size"))


def thresholds(bins: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """A row for each lang and source: the bounds of each metric, from the nearest sketch that is large enough."""
    own, lang, every = quantiles(bins, ["lang", "source"]), quantiles(bins, ["lang"]), quantiles(bins, [])
    lang = lang.select(F.col("lang").alias("lang_l"), F.col("metric").alias("metric_l"), *(F.col(c).alias(f"{c}_l") for c in ("q1", "q3", "size")))
    every = every.select(F.col("metric").alias("metric_e"), F.col("q1").alias("q1_e"), F.col("q3").alias("q3_e"))
    t = own.join(lang, F.col("lang").eqNullSafe(F.col("lang_l")) & (F.col("metric") == F.col("metric_l"))).join(every, F.col("metric") == F.col("metric_e"))
    pick = lambda c: F.when(F.col("size") >= min_group, F.col(c)).when(F.col("size_l") >= min_group, F.col(f"{c}_l")).otherwise(F.col(f"{c}_e"))
    t = t.select("lang", "source", "metric", pick("q1").alias("q1"), pick("q3").alias("q3"))
    width = F.element_at(F.create_map(*(F.lit(x) for kv in WIDTH.items() for x in kv)), F.col("metric"))
    bound = t.withColumns({"lo": F.col("q1") - FENCE * (F.col("q3") - F.col("q1")) - width, "hi": F.col("q3") + FENCE * (F.col("q3") - F.col("q1")) + width})
    pick_metric = lambda c, m: F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{P}{c}_{m}")
    return bound.groupBy(F.col("lang").alias(f"{P}lang"), F.col("source").alias(f"{P}source")).agg(*(pick_metric(c, m) for m in METRICS for c in ("lo", "hi")))


def judge(measured: DataFrame, bounds: DataFrame) -> DataFrame:
    """measured, with _quality_failed (fixed rules) and _quality_kept (they and the bounds). Groups without bounds have only failures."""
    joined = join_small(measured, bounds, F.col("lang").eqNullSafe(F.col(f"{P}lang")) & F.col("source").eqNullSafe(F.col(f"{P}source")))
    value = dict(zip(METRICS, _values(), strict=True))
    over = [value[m] > F.col(f"{P}hi_{m}") for m in METRICS] + [value["word_chars"] < F.col(f"{P}lo_word_chars")]
    bad = F.coalesce(F.greatest(*over), F.lit(False))
    return joined.withColumn(f"{P}failed", base_failed()).withColumn(f"{P}kept", ~base_failed() & ~bad)


def quality_rules(docs: DataFrame, carry: list[str], min_group: int = MIN_GROUP) -> DataFrame:
    """Measure every text once, sketch, and judge; the result has the `carry` columns, lang, source and the _quality_ columns."""
    keep = list(dict.fromkeys([*carry, "lang", "source"]))
    measured = materialise(with_measures(docs.select(*keep, *[c for c in ["text"] if c not in keep])).select(*keep, f"{P}m"), "quality")
    return judge(measured, materialise(thresholds(sketch(measured), min_group), "bounds"))


def op5_quality_rules(spark, sf_dir):
    out = quality_rules(table(spark, sf_dir, "documents"), ["doc_id"])
    m = F.col(f"{P}m")
    return out.select("doc_id", *(m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), F.col(f"{P}failed").alias("base_failed"), F.col(f"{P}kept").alias("kept"))
