"""Do two delimited files say the same? Header, number of rows, and every cell within a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.blocked import numbered
from .csvfile import _lines


def differences(spark: SparkSession, a: str, b: str, tol: float = 1e-6, sep: str = ";") -> DataFrame:
    """row, column, left, right of cells that differ; a row that one file lacks differs in all cells."""
    left, right = _lines(spark, a, sep), _lines(spark, b, sep)
    names = [c.strip() for c in left.columns]
    if names != [c.strip() for c in right.columns]:
        raise ValueError(f"headers differ: {names} and {right.columns}")

    def cells(df: DataFrame, side: str) -> DataFrame:
        rows = numbered(df.toDF(*names).withColumn("__mono", F.monotonically_increasing_id()), "__mono", "row")
        return rows.select("row", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias("cell")) for c in names])).alias("x")).select("row", "x.column", F.col("x.cell").alias(side))

    both = cells(left, "left").join(cells(right, "right"), ["row", "column"], "full")
    x, y = F.col("left").try_cast("double"), F.col("right").try_cast("double")
    close = (F.isnan(x) & F.isnan(y)) | (x == y) | (F.abs(x - y) <= tol)
    same = F.when(x.isNotNull() & y.isNotNull(), close).otherwise(F.col("left").eqNullSafe(F.col("right")))
    return both.where(~F.coalesce(same, F.lit(False)))


def verify(spark: SparkSession, a: str, b: str, tol: float = 1e-6, sep: str = ";") -> bool:
    try:
        return differences(spark, a, b, tol, sep).isEmpty()
    except ValueError:
        return False
