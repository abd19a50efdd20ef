"""Panels of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import Panel


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_parquet(spark: SparkSession, path: str, index: str, values: list[str], keys: list[str] = [], order: list[str] = []) -> Panel:  # noqa: B006
    """Only the columns named are scanned."""
    return Panel.of(spark.read.parquet(path), index, values, keys, order)


def events(spark: SparkSession, sf_dir: str, gaps: bool = True, keyed: bool = True, names: tuple[str, ...] = ("x",)) -> Panel:
    """Event values by event type in order of time; with gaps, every seventh event's value is missing."""
    df = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    x = F.when(F.col("event_id") % 7 != 0, F.col("value")) if gaps else F.col("value")
    columns = {"x": x, "y": F.when(F.col("event_id") % 5 != 0, F.col("value") * 0.5 + 1), "z": F.col("event_id").cast("double") / 1000, "u": F.col("value") - 10}
    df = df.select("event_id", "event_type", "ts", *[columns[n].alias(n) for n in names])
    return Panel.of(df, "ts", names, ["event_type"] if keyed else [], ["event_id"])
