"""Helpers shared by the corpus operators: tokens, row keys, written intermediates, size-checked joins."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: A word is a maximal run of anything but these six white-space characters.
SPACES = " \t\n\x0b\x0c\r"

#: A table of at most so many rows, and by Spark's estimate so many bytes, is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 8 << 20

_written: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all
    runs on one machine. On a cluster a missing setting is an error: its machines share no temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="corpus-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def materialise(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write df (in folders by a column, if asked) to the shared folder and read it back: lineage ends here and a lost
    executor costs nothing."""
    path = new_path(df.sparkSession, tag)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._corpus_path = path
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _written.discard(path)


def forget(df: DataFrame) -> None:
    """Delete what materialise() wrote for df; nothing may read it afterwards."""
    if path := getattr(df, "_corpus_path", None):
        delete_path(df.sparkSession, path)


@atexit.register
def _forget_all() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_written) if spark else []:
        with contextlib.suppress(Exception):
            delete_path(spark, path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes what is written inside, but for the tables that are appended to the list it gives."""
    before, kept = set(_written), []
    yield kept
    for path in _written - before - {df._corpus_path for df in kept}:
        delete_path(spark, path)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a written table may be broadcast: bounded in bytes (the planner's figure, from its files) and in rows."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return int(plan.stats().sizeInBytes()) <= size and df.count() <= rows


def join_small(big: DataFrame, small: DataFrame, on, how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a written table: broadcast if it is small, else by shuffle, where AQE splits skewed keys."""
    return big.join(F.broadcast(small) if is_small(small, limit) else small, on, how)


def let(value: Column, body) -> Column:
    """body(value), with value computed once; else the optimiser copies it into inner lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """All words of a text in order; an empty array for null or blank texts. Splitting at one character needs no pattern."""
    spaced = F.coalesce(text, F.lit(""))
    for c in SPACES[1:]:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def n_words_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def as_text(docs: DataFrame, *cols: str) -> DataFrame:
    """docs with doc_id as text beside `cols`: pandas turns whole numbers beside nulls into floats, text it leaves alone."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), *cols)


def as_number(rows: DataFrame, col: str = "doc_id") -> DataFrame:
    return rows.withColumn(col, F.col(col).cast("long"))


def slices(batches, rows: int = 1000):
    """Pandas batches cut to so many rows, so that what a task makes of them stays small."""
    for pdf in batches:
        for k in range(0, len(pdf), rows):
            yield pdf.iloc[k : k + rows]


def key_hash(text: Column) -> Column:
    """Tells rows apart that share a doc_id; equal rows stay equal."""
    return F.xxhash64(F.coalesce(text, F.lit("\x00null")))


def text_runs(pdf, chars: int = 2_000_000):
    """A pandas batch cut after every so many characters of its texts, whole texts at a time."""
    upto = pdf["text"].str.len().fillna(0).cumsum() // chars
    for _, part in pdf.groupby(upto.astype("int64"), sort=False):
        yield part


def top_rows(rows: DataFrame, by: str, order: list[Column], most: int, name: str = "rank") -> DataFrame:
    """The first `most` rows of each value of `by` in the given order, numbered from 1: a large group is cut down in many
    parts by a digest of the row, then in fewer, so that no task sorts more than `most` rows of some parts."""
    digest = F.xxhash64(*rows.columns)
    for parts in (4096, 64):
        w = Window.partitionBy(by, "_part").orderBy(*order)
        rows = rows.withColumn("_part", F.pmod(digest, F.lit(parts))).withColumn(name, F.row_number().over(w)).where(F.col(name) <= most).drop("_part", name)
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(name) <= most)
