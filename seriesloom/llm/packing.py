"""Packing documents into sequences of one length: histogram packing by non-negative least squares.

Each document's ids are cut into whole sequences and one remainder. Remainders are counted by
length in units of UNIT ids (LENGTH / UNIT numbers, whatever the corpus size). All combinations
of up to three such lengths that fill a sequence exactly are enumerated; non-negative least
squares finds how often to use each so that together they use up the histogram. The solution
is rounded and never exceeds what there is; what is left over is packed greedily, first as further
fitting combinations of the histogram, then by laying remainders end to end and cutting them where a
sequence is full. So only units' last ids, and the end of the very last sequence, are padding.

Which document gets which place follows from ranks inside a length, taken as two-level prefix
sums over (part of the input, row), so that no key gathers the corpus in one task.

Defined results: null text is an empty document, which still has its end id; repeated rows are
packed each; an empty table gives no pieces; a document longer than a sequence has several pieces.
Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base
from .tokens import token_table

LENGTH = 2048
UNIT = 8
DEPTH = 4
END = 1


def combinations(units: int) -> np.ndarray:
    """Rows of three lengths in units, in descending order and 0 for none, that sum to `units`."""
    rows = [(units, 0, 0)]
    rows += [(a, units - a, 0) for a in range(units - 1, (units - 1) // 2, -1) if a >= units - a > 0]
    for a in range(units - 2, 0, -1):
        rest = units - a
        rows += [(a, b, rest - b) for b in range(min(a, rest - 1), 0, -1) if b >= rest - b > 0]
    return np.array(rows, np.int64)


def nnls(columns: np.ndarray, target: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """min |A x - target| over x >= 0, by active sets; A's column j counts each length in columns[j]."""
    n, m = len(target), len(columns)

    def dense(js) -> np.ndarray:
        a = np.zeros((n, len(js)))
        for c in range(columns.shape[1]):
            v = columns[js, c]
            ok = v > 0
            np.add.at(a, (v[ok] - 1, np.flatnonzero(ok)), 1.0)
        return a

    def gradient(r) -> np.ndarray:
        padded = np.concatenate([[0.0], r])
        return padded[columns].sum(1)

    x, active = np.zeros(m), np.zeros(m, bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(target).sum()))
    for _ in range(rounds):
        js = np.flatnonzero(active)
        w = gradient(target - (dense(js) @ x[js] if len(js) else 0.0))
        w[active] = -np.inf
        best = int(np.argmax(w))
        if not w[best] > tolerance:
            break
        active[best] = True
        while True:
            js = np.flatnonzero(active)
            a = dense(js)
            s = np.linalg.solve(a.T @ a + 1e-9 * np.eye(len(js)), a.T @ target)
            if (s > 0).all():
                x[:] = 0
                x[js] = s
                break
            old = x[js]
            bad = s <= 0
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.where(bad, old / (old - s), np.inf)
            alpha = float(np.nanmin(step))
            new = old + min(1.0, max(0.0, alpha)) * (s - old)
            new[bad & (step <= alpha)] = 0
            x[:] = 0
            x[js] = np.maximum(new, 0)
            active[js] = x[js] > 0
            if not active.any():
                return x
    return x


def recipes(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in units, how often): combinations that fit the histogram, by least squares and then greedily."""
    units = len(histogram)
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def use(parts: tuple[int, ...], most: int | None = None) -> int:
        need = np.bincount(np.array(parts) - 1, minlength=units)
        times = int((left[need > 0] // need[need > 0]).min())
        times = times if most is None else min(times, most)
        if times > 0:
            left[:] -= times * need
            out.append((parts, times))
        return times

    if not left.any():
        return out
    columns = combinations(units)
    x = nnls(columns, histogram.astype(float))
    for j in np.argsort(-x, kind="stable"):
        if (most := int(x[j] + 0.5)) < 1:
            break
        use(tuple(int(v) for v in columns[j] if v), most)
    for b in range(units, 0, -1):
        while left[b - 1]:
            parts, space, have = [b], units - b, left.copy()
            have[b - 1] -= 1
            while space and len(parts) < DEPTH:
                fits = np.flatnonzero(have[:space])
                if not len(fits):
                    break
                c = int(fits[-1]) + 1
                parts.append(c)
                have[c - 1] -= 1
                space -= c
            if space or not use(tuple(parts)):
                break  # the rest of this length is laid end to end
    return out


def pack(docs: DataFrame, end_id: int = END, length: int = LENGTH, unit: int = UNIT, path: str | None = None) -> DataFrame:
    """A row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32)."""
    spark = docs.sparkSession
    tokens = base.stored(token_table(docs, end_id, path).drop("counts"), "tokens")
    remainder = F.col("n") % length
    meta = tokens.select("part", "row", (F.col("n") / length).cast("long").alias("whole"), remainder.alias("rest"), F.ceil(remainder / unit).cast("int").alias("bin"))
    sums = base.stored(meta.groupBy("part", "bin").agg(F.count("*").alias("rows"), F.sum("whole").alias("whole")), "packing-sums")
    per_bin = {r["bin"]: (r["rows"], r["whole"]) for r in sums.groupBy("bin").agg(F.sum("rows").alias("rows"), F.sum("whole").alias("whole")).collect()}
    units = length // unit
    histogram = np.zeros(units, np.int64)
    for b, (rows, _) in per_bin.items():
        if b:
            histogram[b - 1] = rows
    n_whole = sum(w for _, w in per_bin.values())
    used, segments, made = np.zeros(units + 1, np.int64), [], 0
    for parts, times in recipes(histogram):
        for slot, b in enumerate(parts):
            segments.append((b, int(used[b]), int(used[b]) + times, n_whole + made, slot))
            used[b] += times
        made += times
    places = spark.createDataFrame(segments, "_bin int, _from long, _to long, _sequence long, slot int")

    earlier = (Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    by_bin = sums.withColumn("_before", F.coalesce(F.sum("rows").over(Window.partitionBy("bin").orderBy("part").rowsBetween(*earlier)), zero)).select("part", "bin", "_before")
    by_part = sums.groupBy("part").agg(F.sum("whole").alias("_w")).withColumn("_whole_before", F.coalesce(F.sum("_w").over(Window.orderBy("part").rowsBetween(*earlier)), zero)).drop("_w")
    inside = Window.partitionBy("part").orderBy("row")
    ranked = (
        meta.join(by_bin, ["part", "bin"])
        .join(by_part, "part")
        .withColumn("rank", F.col("_before") + F.row_number().over(Window.partitionBy("part", "bin").orderBy("row")) - 1)
        .withColumn("whole_base", F.col("_whole_before") + F.coalesce(F.sum("whole").over(inside.rowsBetween(*earlier)), zero))
    )
    # the table of places has at most DEPTH rows for each recipe, and a recipe uses up a length or stems from NNLS
    found = ranked.join(F.broadcast(places), (F.col("bin") == F.col("_bin")) & (F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_to")), "left")
    assigned = base.stored(
        found.select("part", "row", "whole", "rest", "whole_base", (F.col("_sequence") + F.col("rank") - F.col("_from")).alias("sequence"), "slot"), "packing-places"
    )
    whole = assigned.where("whole > 0").select("part", "row", F.posexplode(F.sequence(F.lit(0), F.col("whole").cast("int") - 1)).alias("k", "_i"), "whole_base")
    whole = whole.select("part", "row", (F.col("k") * length).cast("long").alias("start"), F.lit(length).cast("long").alias("length"), (F.col("whole_base") + F.col("k")).alias("sequence_id"), zero.alias("offset"))
    placed = assigned.where("sequence is not null").select(
        "part", "row", (F.col("whole") * length).alias("start"), F.col("rest").alias("length"), F.col("sequence").alias("sequence_id"),
        F.coalesce(F.sum("rest").over(Window.partitionBy("sequence").orderBy("slot").rowsBetween(*earlier)), zero).alias("offset"),
    )
    loose = assigned.where("sequence is null and rest > 0")
    loose_before = loose.groupBy("part").agg(F.sum("rest").alias("_r")).withColumn("_loose_before", F.coalesce(F.sum("_r").over(Window.orderBy("part").rowsBetween(*earlier)), zero)).drop("_r")
    loose = loose.join(loose_before, "part").withColumn("at", F.col("_loose_before") + F.coalesce(F.sum("rest").over(inside.rowsBetween(*earlier)), zero))
    loose = loose.withColumn("k", F.explode(F.sequence((F.col("at") / length).cast("long"), ((F.col("at") + F.col("rest") - 1) / length).cast("long"))))
    first, last = F.greatest(F.col("at"), F.col("k") * length), F.least(F.col("at") + F.col("rest"), (F.col("k") + 1) * length)
    cut = loose.select("part", "row", (F.col("whole") * length + first - F.col("at")).alias("start"), (last - first).alias("length"), (F.lit(n_whole + made) + F.col("k")).alias("sequence_id"), (first - F.col("k") * length).alias("offset"))
    pieces = whole.unionByName(placed).unionByName(cut).groupBy("part", "row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])

    def run(batches):
        for whole_batch in batches:
            for b in base.slices(whole_batch, "ids", 4 << 20):
                out: dict[str, list] = {f.name: [] for f in schema}
                for doc, n, raw, own in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "ids", "pieces"))):
                    ids = np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                    for p in own:
                        for column, v in zip(out.values(), (doc, p["start"], p["length"], n, p["sequence_id"], p["offset"], ids[4 * p["start"] : 4 * (p["start"] + p["length"])])):
                            column.append(v)
                yield base.batch(schema, **out)

    ddl = ", ".join(f"{f.name} {'binary' if f.name == 'ids' else 'long'}" for f in schema)
    return base.arrow_map(tokens.join(pieces, ["part", "row"]).select("doc_id", "n", "ids", "pieces"), run, ddl)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    pieces = pack(base.documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
