"""Writers: Parquet by match, CSV for exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame


def by_match(df: DataFrame, path: str, key: str = "game_id", mode: str = "overwrite") -> None:
    """One folder a match; later reads of some matches prune the others."""
    df.repartition(key).write.mode(mode).partitionBy(key).parquet(path)


def without_matches(df: DataFrame, excluded: list, key: str = "game_id") -> DataFrame:
    return df.where(~df[key].isin(*excluded)) if excluded else df


def csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)
