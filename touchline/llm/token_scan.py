"""Token counts of documents in flat token files without an index, by scanning for the end-of-document id.

Files are cut into blocks of fixed size. Every block is searched for separators by one vectorised comparison. A document
may begin in one block and end in a later one: a prefix scan over the blocks (first over runs of SPAN blocks, then inside
each run) carries how many documents have ended and where the last one did, so no block waits for another and no file is
read by one task.

The writer makes such files from texts: each partition writes one file under a temporary name and renames it, so tasks
that are run again leave the same file. The tokenizer's vocabulary file is a parameter: the driver reads it and sends its some
ten thousand entries to the tasks. The folder must be one that pyarrow.fs opens from driver and executors; only names and
sizes of its files pass the driver. A long text is tokenised whole. Null texts are empty documents: a separator alone, 0 tokens. Repeated rows are
documents of their own. Empty tables and empty files give no rows. Tokens after a file's last separator are a document
that is not closed. A file whose size is no multiple of the id's width is an error.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import as_number, as_text, delete_path, materialise, new_path, table

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SEPARATOR = 50256
WIDTH = 2
BLOCK_BYTES = 4 << 20
SPAN = 1024
#: Blocks that a task searches, where there are more than the cluster has cores.
TASK_BLOCKS = 16
#: Fixed value: how byte-level BPE vocabularies of this family cut a text.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokenise `docs` into flat files under `path`; returns, written, file, seq and doc_id of every document."""
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
    store, root = _store(path)
    store.create_dir(root, recursive=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken
        from pyspark import TaskContext

        encode = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={}).encode_ordinary
        task = TaskContext.get()
        store, root = _store(path)
        name = f"{task.partitionId():06d}.tokens"
        draft, seq = f"{root}/_{name}.{task.taskAttemptId()}", 0
        with store.open_output_stream(draft) as out:
            for pdf in batches:
                for text in pdf["text"]:
                    ids = encode(text or "")
                    ids.append(SEPARATOR)
                    out.write(np.array(ids, f"<u{WIDTH}").tobytes())
                yield pd.DataFrame({"file": name, "seq": np.arange(seq, seq + len(pdf)), "doc_id": pdf["doc_id"]})
                seq += len(pdf)
        store.move(draft, f"{root}/{name}")

    return materialise(as_number(as_text(docs, "text").mapInPandas(run, "file string, seq long, doc_id string")), "manifest")


def blocks_of(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, block, from, size of every block of every file; only names and sizes pass the driver."""
    from pyarrow import fs

    store, root = _store(path)
    files = [(x.base_name, x.size) for x in store.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.File and x.base_name.endswith(".tokens")]
    if bad := [n for n, size in files if size % WIDTH]:
        raise ValueError(f"not whole ids of {WIDTH} bytes: {bad[:3]}")
    rows = spark.createDataFrame(files, "file string, bytes long").where("bytes > 0")
    rows = rows.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / block_bytes))).alias("block"))
    return rows.select("file", "block", (F.col("block") * block_bytes).alias("from"), F.least(F.lit(block_bytes), F.col("bytes") - F.col("block") * block_bytes).alias("size"))


def separators(blocks: DataFrame, path: str, separator: int = SEPARATOR) -> DataFrame:
    """The blocks with `ends`: token positions of the separators, counted from the block's start."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(path)
        for pdf in batches:
            for name, rows in groupby(pdf.itertuples(index=False), key=lambda r: r.file):
                with store.open_input_file(f"{root}/{name}") as f:
                    for r in rows:
                        ids = np.frombuffer(f.read_at(r.size, r[2]), f"<u{WIDTH}")
                        yield pd.DataFrame({"file": [name], "block": [r.block], "first": [r[2] // WIDTH], "n": [len(ids)], "ends": [np.flatnonzero(ids == separator).astype(np.int32)]})

    n = blocks.agg(F.coalesce(F.sum(F.ceil(F.col("size") / F.lit(BLOCK_BYTES))), F.lit(1))).first()[0]
    tasks = max(blocks.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_BLOCKS))  # a number, or the few rows would be coalesced into one task
    return blocks.repartition(min(tasks, max(1, n)), "file", "block").mapInPandas(run, "file string, block long, first long, n long, ends array<int>")


def token_counts(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES, separator: int = SEPARATOR) -> DataFrame:
    """file, seq, n_tokens, closed of every document, in the order in which the files hold them."""
    found = materialise(separators(blocks_of(spark, path, block_bytes), path, separator), "separators")
    last = F.when(F.size("ends") > 0, F.col("first") + F.element_at("ends", -1))
    heads = found.select("file", "block", F.floor(F.col("block") / SPAN).alias("span"), F.size("ends").cast("long").alias("k"), last.alias("last"))

    def before(w):
        w = w.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("k").over(w), F.lit(0)), F.max("last").over(w)

    k, p = before(Window.partitionBy("file").orderBy("span"))
    spans = heads.groupBy("file", "span").agg(F.sum("k").alias("k"), F.max("last").alias("last")).select("file", "span", k.alias("k0"), p.alias("p0"))
    k, p = before(Window.partitionBy("file", "span").orderBy("block"))
    inside = heads.select("file", "span", "block", k.alias("k1"), p.alias("p1"))
    carried = inside.join(spans, ["file", "span"]).select("file", "block", (F.col("k0") + F.col("k1")).alias("seq0"), F.coalesce("p1", "p0", F.lit(-1).cast("long")).alias("prev"))
    carried = materialise(carried, "carried")
    rows = found.where(F.size("ends") > 0).join(carried, ["file", "block"])
    starts = F.concat(F.array(F.col("prev") - F.col("first")), F.slice(F.col("ends").cast("array<long>"), 1, F.greatest(F.lit(0), F.size("ends") - 1)))
    sizes = F.zip_with(F.col("ends").cast("array<long>"), starts, lambda e, s: e - s - 1)
    docs = rows.select("file", "seq0", F.posexplode(sizes).alias("i", "n_tokens")).select("file", (F.col("seq0") + F.col("i")).alias("seq"), "n_tokens", F.lit(True).alias("closed"))
    ends = found.groupBy("file").agg(F.sum("n").alias("n"), F.sum(F.size("ends")).cast("long").alias("seq"), F.max(last).alias("last"))
    rest = ends.select("file", "seq", (F.col("n") - F.coalesce("last", F.lit(-1)) - 1).alias("n_tokens"), F.lit(False).alias("closed")).where("n_tokens > 0")
    return docs.unionByName(rest)


def op6_token_counts(spark, sf_dir):
    path = new_path(spark, "tokens")
    manifest = write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    counts = materialise(token_counts(spark, path), "counts")
    delete_path(spark, path)
    return manifest.join(counts, ["file", "seq"]).select("doc_id", "n_tokens")
