"""Mixing sources to target weights along a time-varying curriculum. DataFrame operations only.

A source's weight at training time t in [0, 1] is a linear schedule; its integral is the
source's share of all words. Shares that exceed `most` times a source's own words are cut to
that and the excess is dealt out again by weight (water filling, closed form over the sorted
ratios). A source's documents form a stream in md5 order of doc_id, repeated whole as often as
its target asks for; the last pass stops in one document, of which only the words up to the
target are taken. A place in the stream is a cumulative demand for words, and inverting the integrated
schedule there gives the training position, by which documents are range-sorted.

Prefix sums are two-level (buckets of the md5, then inside a bucket), so a source that holds
most rows is spread over many tasks.

Defined results: null text has size 0; null sources form one source, ordered last; documents of
size 0 take 0 words and have no position; null doc_id hashes as the empty string; repeated rows
are separate documents; an empty table gives an empty result. Other columns are carried by
mix_documents() unchanged, ones named like its own working columns included.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base

WORD = r"[^\x20\x09-\x0D]+"
IN_BUCKET = 4096


def targets(sizes: DataFrame, weights=(1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size -> weight, target: one row per source (the sums, never documents)."""
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights)).cast("int") + 1)
    ranked = ranked.withColumn("weight", weight).withColumn("_cap", float(most) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("weight"), "_rank")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("_level", level).withColumn("_capped", F.col("_level") * F.col("weight") >= F.col("_cap"))
    open_level = F.min(F.when(~F.col("_capped"), F.struct(F.col("_cap") / F.col("weight"), "_rank", "_level"))).over(everything.partitionBy())
    return ranked.withColumn("_open", open_level["_level"]).select(
        "source", "source_size", "weight", "_rank", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_open") * F.col("weight")).alias("target")
    )


def invert(u, slope):
    """t with t + slope * (t * t - t) = u: the inverse of the integral of 1 + slope * (2 t - 1)."""
    root = (F.sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / (2 * slope)
    return F.when(F.abs(slope) < 1e-9, u).otherwise(root)


def plan(docs: DataFrame, weights=(1, 2, 3), slopes=(-0.5, 0.0, 0.5), most: int = 3) -> DataFrame:
    """The rows of docs with _size, _source_size, _target, _taken, _place (words of the stream before) and _slope."""
    facts = docs.withColumn("_size", F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long"))
    facts = facts.withColumn("_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    light = facts.select(F.col("source").cast("string").alias("source"), "_size", "_key")
    sums = base.stored(light.groupBy("source", F.substring("_key", 1, 6).alias("_fine")).agg(F.sum("_size").alias("_words"), F.count("*").alias("_rows")), "mixing")
    rows = sums.agg(F.sum("_rows")).first()[0] or 0
    digits = min(6, max(1, math.ceil(math.log(max(rows, 1) / IN_BUCKET, 16))) if rows > IN_BUCKET else 1)
    per_source = targets(sums.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, most)
    slope = F.element_at(F.array(*[F.lit(float(x)) for x in slopes]), (F.col("_rank") % len(slopes)).cast("int") + 1)
    starts = sums.groupBy("source", F.substring("_fine", 1, digits).alias("_bucket")).agg(F.sum("_words").alias("_words"))
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_start", F.coalesce(F.sum("_words").over(earlier), F.lit(0))).drop("_words")
    starts = starts.join(per_source, starts["source"].eqNullSafe(per_source["source"])).select(
        starts["source"].alias("_s"), F.col("_bucket").alias("_b"), "_start", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), slope.alias("_slope")
    )
    facts = facts.withColumn("_bucket", F.substring("_key", 1, digits))
    within = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    facts = facts.withColumn("_inside", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    joined = facts.join(starts, facts["source"].cast("string").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    place = F.col("_start") + F.col("_inside")
    whole = F.floor(F.col("_target") / F.greatest(F.col("_source_size"), F.lit(1))).cast("long")
    rest = F.floor(F.col("_target") - whole * F.col("_source_size")).cast("long")
    return (
        joined.withColumn("_place", place)
        .withColumn("_taken", F.least(whole * F.col("_size") + F.least(F.greatest(rest - place, F.lit(0)), F.col("_size")), most * F.col("_size")).cast("long"))
        .drop("_s", "_b", "_start", "_inside", "_bucket", "_key")
    )


def position(place):
    """Training position in [0, 1] of a cumulative demand of `place` words of the source's stream."""
    share = place / F.greatest(F.col("_target"), F.lit(1.0))
    return F.round(invert(F.least(share, F.lit(1.0)), F.col("_slope")), 9) + F.lit(0.0)


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """docs in training order: a row for each time a document is taken, range-sorted by position.

    The one document per source in which the last pass stops comes with its text cut after the
    words taken; n_chars, if there, follows the text.
    """
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"in_{i}") if c not in ("doc_id", "text", "source") else F.col(c) for i, c in enumerate(names)])
    p = plan(inner, **how).where("_taken > 0")
    p = p.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_taken") / F.col("_size")).cast("int") - 1)))
    left = F.col("_taken") - F.col("_pass") * F.col("_size")
    words = F.slice(F.regexp_extract_all("text", F.lit(f"[\\x20\\x09-\\x0D]*{WORD}"), F.lit(0)), F.lit(1), left.cast("int"))
    p = p.withColumn("_cut", left < F.col("_size")).withColumn("text", F.when(F.col("_cut"), F.array_join(words, "")).otherwise(F.col("text")))
    p = p.withColumn("_position", position(F.col("_place") + F.col("_pass") * F.col("_source_size")))
    p = p.orderBy("_position", "doc_id", "_pass")
    out = []
    for i, c in enumerate(names):
        source = F.col(c) if c in ("doc_id", "text", "source") else F.col(f"in_{i}")
        out.append((F.when(F.col("_cut"), F.length("text")).otherwise(source).cast(docs.schema[c].dataType) if c == "n_chars" else source).alias(c))
    return p.select(*out)


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = base.documents(spark, sf_dir).select("doc_id", "text", "source")
    p = plan(docs).withColumn("position", F.when(F.col("_taken") > 0, position(F.col("_place"))))
    return p.orderBy("position", "doc_id").select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"), "position")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM s),
w AS (SELECT *, CAST(rk % 3 + 1 AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS cap FROM r),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
c AS (SELECT *, level * weight >= cap AS capped FROM l),
o AS (SELECT level AS open FROM c WHERE NOT capped ORDER BY cap / weight, rk LIMIT 1),
t AS (SELECT source, source_size, rk, CASE WHEN capped THEN cap ELSE (SELECT open FROM o) * weight END AS target FROM c),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE t.rk % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS a,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place,
    CAST(floor(t.target / greatest(t.source_size, 1)) AS BIGINT) AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CAST(floor(target - whole * source_size) AS BIGINT) AS rest, least(place / greatest(target, 1.0::DOUBLE), 1.0::DOUBLE) AS u FROM p),
z AS (SELECT *, least(whole * size + least(greatest(rest - place, 0), size), 3 * size) AS take FROM q)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(take AS BIGINT) AS taken,
  CASE WHEN take > 0 THEN round(CASE WHEN abs(a) < 1e-9 THEN u ELSE (sqrt((1 - a) * (1 - a) + 4 * a * u) - (1 - a)) / (2 * a) END, 9) + 0.0 END AS position
FROM z
"""
