"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with seconds for each.

Beside them, operators over the events repeated to BENCH_ROWS rows (10 million unless set), from a Parquet file, with rows
a second: fixed costs of a query are small against those.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seriesloom.queries import QUERIES
from seriesloom.sources.tables import read_parquet

HEADLINE = ("flagship", "dlog", "cs1", "rolling_mean", "rolling_mean_250", "rolling_std", "rolling_std_250", "rolling_zscore", "ft_zscore", "add_frame", "mapr", "asofr", "asofr_keyed", "blocked_cs1", "blocked_rolling_mean")
LONG = {
    "add": lambda p: p.add(2.5), "dlog": lambda p: p.dlog(), "cs1": lambda p: p.cs1(),
    "rolling_mean_250": lambda p: p.rolling_mean(250), "rolling_std_250": lambda p: p.rolling_std(250),
}


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def consumed(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def long_rows(spark: SparkSession, sf_dir: str, rows: int, path: str) -> int:
    """The events, again and again under other ids, as 64 series."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "value")
    times = max(1, rows // max(1, events.count()))
    again = events.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("event_id", F.col("event_id") * times + F.col("k"))
    again.select("event_id", "ts", "value", (F.col("event_id") % 64).alias("series")).write.parquet(path)
    return spark.read.parquet(path).count()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda q: consumed(QUERIES[q](spark, sf_dir))
    run("cs1")  # start-up is not counted
    seconds = {q: round(min(timed(lambda: run(q)) for _ in range(2)), 3) for q in HEADLINE}
    folder = tempfile.mkdtemp(prefix="bench-")
    try:
        path = f"{folder}/long"
        n = long_rows(spark, sf_dir, int(os.environ.get("BENCH_ROWS", "10000000")), path)
        panel = lambda: read_parquet(spark, path, "ts", ["value"], ["series"], ["event_id"])
        long_seconds = {q: round(timed(lambda: consumed(f(panel()).df)), 3) for q, f in LONG.items()}
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({
        "metric": "total of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "long_rows": n, "long_seconds": long_seconds, "long_rows_per_second": {q: round(n / s) for q, s in long_seconds.items()},
    }))


if __name__ == "__main__":
    main()
