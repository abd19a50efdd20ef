import re

import duckdb
from pyspark.sql import functions as F
from seriesloom.llm import mixing as M


def rows():
    out = [(i, " ".join(f"w{j}" for j in range((i * 37) % 90))) for i in range(160)]
    return out + [(None, "a b c"), (5, "again five"), (5, "again five"), (900, None), (901, ""), (902, " \n x y ")]


def source(k):
    return None if k % 11 == 0 else ["b", "a", "é", "c"][0 if k % 3 == 0 else k % 4]


def test_plan_agrees_with_sql(spark, documents):
    df = documents(rows(), source)
    own = M.plan(df.select("doc_id", "text", "source"))
    got = sorted((str(r.doc_id), r["_size"], r["_source_size"], round(r["_target"], 6), r["_taken"]) for r in own.collect())
    c = duckdb.connect()
    documents_ = df.select("doc_id", "text", "source").toPandas()
    c.register("documents", documents_)
    sql = M.OP4_SQL.replace("FROM documents", "FROM (SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source FROM documents)")
    want = sorted((str(None if r[0] is None else int(r[0])), r[1], r[2], round(r[3], 6), r[4]) for r in c.sql(sql).fetchall())
    assert got == want


def test_targets_and_limits(documents):
    df = documents(rows(), source).select("doc_id", "text", "source")
    p = M.plan(df).collect()
    by = {}
    for r in p:
        by.setdefault(r.source, []).append(r)
        assert r["_size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert 0 <= r["_taken"] <= 3 * r["_size"]
    assert abs(sum(v[0]["_target"] for v in by.values()) - sum(r["_size"] for r in p)) < 1e-6
    order = sorted((k for k in by if k is not None), key=lambda s: s.encode()) + [None]
    level = None
    for i, s in enumerate(order):
        target, size = by[s][0]["_target"], by[s][0]["_source_size"]
        assert size == sum(r["_size"] for r in by[s]) and target <= 3 * size + 1e-9
        assert abs(sum(r["_taken"] for r in by[s]) - target) < 1
        if target < 3 * size - 1e-9:
            level = level or target / (i % 3 + 1)
            assert abs(target / (i % 3 + 1) - level) < 1e-6


def test_positions_invert_the_schedule(spark):
    for slope in (-0.9, -0.5, 0.0, 0.5, 0.9):
        u = spark.range(0, 11).select((F.col("id") / 10).alias("u"), F.lit(slope).alias("a"))
        for r in u.select("u", M.invert(F.col("u"), F.col("a")).alias("t")).collect():
            assert abs(r.t + slope * (r.t * r.t - r.t) - r.u) < 1e-9


def test_mixed_documents(documents):
    df = documents(rows(), source)
    mixed = M.mix_documents(df)
    assert mixed.columns == df.columns and mixed.schema == df.schema
    taken = {}
    for r in M.plan(df.select("doc_id", "text", "source")).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r["_taken"]
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.n_chars == len(r.text)
    assert got == {k: v for k, v in taken.items() if v}
    assert M.mix_documents(df.where("doc_id < -1")).count() == 0
    assert M.plan(df.where("doc_id < -1")).count() == 0
