"""Delimited text: schema inference from the first rows, then one typed, distributed read.

A column's type is that of its first value that is there among the first SAMPLE rows: timestamp, date, else
double. Cells that do not fit are missing. The first column is the index if it holds dates or timestamps or is
named so; otherwise a running number is.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import sys
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import POS, Panel

SAMPLE = 8
#: Cells that say a value is missing, and names that make a first column the index.
MISSING = ("", "NA", "NaN", "N/A")
INDEX_NAMES = ("DATE", "TIMESTAMP", "TIME")
_date = re.compile(r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])")
_stamp = re.compile(r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01]) ([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,9})?")


def kind_of(cells: list[str | None]) -> str:
    for c in cells:
        c = (c or "").strip()
        if c not in MISSING:
            return "timestamp" if _stamp.fullmatch(c) else "date" if _date.fullmatch(c) else "double"
    return "double"


def cell(name: str, kind: str) -> Column:
    """A trimmed cell as its type; what does not fit is NULL."""
    raw = F.trim(F.col(f"`{name}`"))
    there = F.when(~raw.isin(*MISSING), raw)
    if kind == "timestamp":
        return F.when(there.rlike(f"^{_stamp.pattern}$"), there.try_cast("timestamp"))
    if kind == "date":
        # days past the end of a month run on into the next one
        parts = [F.substring(there, a, n).try_cast("int") for a, n in ((1, 4), (6, 2), (9, 2))]
        first = F.make_date(parts[0], parts[1], F.lit(1))
        return F.when(there.rlike(f"^{_date.pattern}$"), F.date_add(first, parts[2] - 1))
    number = F.lower(there)
    special = F.when(number.isin("inf", "+inf", "infinity", "+infinity"), F.lit(float("inf"))).when(number.isin("-inf", "-infinity"), F.lit(float("-inf")))
    return F.coalesce(special, F.nanvl(there.try_cast("double"), F.lit(None).cast("double")))


def _lines(spark: SparkSession, path: str, sep: str) -> DataFrame:
    return spark.read.option("sep", sep).option("header", True).option("inferSchema", False).option("quote", "").csv(path)


def read_csv(spark: SparkSession, path: str, sep: str = ";", columns: list[str] | None = None, head: int | None = None) -> Panel:
    """The panel of one delimited file with a header; with columns, only those values and the index are read."""
    raw = _lines(spark, path, sep)
    names = [c.strip() for c in raw.columns]
    raw = raw.toDF(*names)
    sample = raw.limit(SAMPLE).collect()
    kinds = {c: kind_of([r[i] for r in sample]) for i, c in enumerate(names)}
    if columns is not None and (unknown := [c for c in columns if c not in names]):
        raise KeyError(f"no columns {unknown}; the header has {names}")
    first = names[0]
    indexed = kinds[first] != "double" or first.upper() in INDEX_NAMES
    values = [c for c in (columns or names) if not (indexed and c == first)]
    # file order is the order of rows: one split after the other, and lines inside a split
    order = raw.withColumn("__mono", F.monotonically_increasing_id())
    if not indexed:
        index, key = "ROW", None
    else:
        index, key = first, (F.trim(F.col(f"`{first}`")) if kinds[first] == "double" else cell(first, kinds[first]))
    from ..plans.blocked import numbered

    if head is not None:  # the file's first rows are among the first of each split
        order = order.where(F.col("__mono").bitwiseAND(F.lit((1 << 33) - 1)) < head)
    rows = numbered(order, "__mono", POS)
    chosen = [(key if key is not None else F.col(POS).cast("string")).alias(index)]
    chosen += [cell(c, kinds[c]).alias(c) for c in values]
    p = Panel.positioned(rows.select(*chosen, F.col(POS)), index, [c for c in values if kinds[c] == "double"])
    return p if head is None else p.file_head(head)


load_csv_cols = read_csv


def read_stdin(spark: SparkSession, sep: str = ";", stream=None) -> Panel:
    """The whole of standard input, through a file of the driver: for input of a size the driver can hold."""
    text = (stream or sys.stdin).read()
    lines = text.splitlines()
    if not lines:
        return Panel.positioned(spark.createDataFrame([], f"DATE date, {POS} long"), "DATE", [])
    names = [c.strip() for c in lines[0].split(sep)]
    cells = [tuple((x.split(sep) + [""] * len(names))[: len(names)]) for x in lines[1:] if x.strip()]
    kinds = {c: kind_of([r[i] for r in cells[:SAMPLE]]) for i, c in enumerate(names)}
    raw = spark.createDataFrame([(*r, i) for i, r in enumerate(cells)], ", ".join([*(f"`{c}` string" for c in names), f"{POS} long"]))
    first = names[0]
    indexed = kinds[first] != "double" or first.upper() in INDEX_NAMES
    key = (F.trim(F.col(f"`{first}`")) if kinds[first] == "double" else cell(first, kinds[first])) if indexed else F.col(POS).cast("string")
    values = [c for c in names if not (indexed and c == first)]
    return Panel.positioned(raw.select(key.alias(first if indexed else "ROW"), *[cell(c, kinds[c]).alias(c) for c in values], F.col(POS)), first if indexed else "ROW", [c for c in values if kinds[c] == "double"])


def text_columns(p: Panel, missing: str) -> list[Column]:
    index = F.coalesce(F.col(f"`{p.index}`").cast("string"), F.lit("NA")).alias(p.index)
    return [index, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(missing)).alias(c) for c in p.values]]


def write_csv(p: Panel, path: str, sep: str = ";", missing: str = "NaN", single: bool = False) -> None:
    """Part files in row order, each with a header; cells as text. With single, one part, written by one task."""
    if not p.values:
        raise ValueError("nothing to write")
    rows = p.df.orderBy(*p.keys, POS)
    rows = (rows.coalesce(1) if single else rows).select(*text_columns(p, missing))
    rows.write.mode("overwrite").option("sep", sep).option("header", True).option("quote", "").csv(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder all executors share; a temporary one only on one machine where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="seriesloom-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save_file(p: Panel, path: str, sep: str = ";", missing: str = "NaN") -> None:
    """One ordered file on the driver's own disk, a partition at a time; it takes its name when it is whole."""
    if not p.values:
        raise ValueError("nothing to write")
    half = f"{path}.{uuid.uuid4().hex}"
    with open(half, "w") as out:
        print_table(p, out, sep, missing)
    os.replace(half, path)


def print_table(p: Panel, out=None, sep: str = ";", missing: str = "NA") -> None:
    """Stream the rows in order, a partition at a time."""
    out = out or sys.stdout
    print(sep.join([p.index, *p.values]), file=out)
    for r in p.df.orderBy(*p.keys, POS).select(*text_columns(p, missing)).toLocalIterator():
        print(sep.join(r), file=out)

