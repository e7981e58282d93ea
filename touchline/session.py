"""A session with the settings the operators expect: UTC, adaptive execution."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", app: str = "touchline", **conf: str) -> SparkSession:
    """Further settings by name with dots as double underscores, as in spark__sql__shuffle__partitions="64"."""
    builder = SparkSession.builder.master(master).appName(app)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.enabled": "false"}
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def spread(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, to name it in repartition(): adaptive execution joins small partitions by their
    bytes, which says nothing of pairs to be made from them, nor of rows packed to a small part of their size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder's name in spark.checkpoint.dir, which driver and executors share. Where that is unset it is a temporary
    folder on one machine, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='touchline-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written to a new shared folder and read back: lineage ends here and a lost executor costs nothing."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
