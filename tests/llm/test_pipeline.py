import random

import corpus_pipeline as C
from pyspark.sql import functions as F
from seriesloom.llm import base, mixing


def test_stages(spark, tmp_path):
    r = random.Random(7)
    vocabulary = ["".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(900)]
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    rows, labels, passage = [], [], prose(70)
    for i in range(240):
        w = prose(r.randint(60, 150))
        if i % 6 == 0:
            w[10:10] = ["zorkhead"] * 2
        elif i % 6 == 1:
            w[20:20] = passage
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(i % 6 == 0)))
    copy = rows[2][1].split()
    rows += [(900, " ".join(copy), "en", "s0", 0), (901, " ".join([*copy[:-1], "other"]), "en", "s1", 0), (902, None, "en", None, 0), (903, "", "en", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.length("text").cast("long"))
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    assert [k for k, _ in C.STAGES] == ["toxicity", "ngram_jaccard", "substring_dedup", "mixing", "packing"]
    for name, stage in C.STAGES:
        at = base.stored(stage(spark, at, str(tmp_path)), f"test-{name}")
        kept[name] = at.collect()
        if name != "packing":
            assert at.columns == docs.columns
    ids = {k: {r.doc_id for r in v} for k, v in kept.items()}
    assert ids["toxicity"] == {i for i, *_ in rows if not (i < 240 and i % 6 == 0)}
    assert ids["ngram_jaccard"] == ids["toxicity"] - {900, 901}
    assert ids["substring_dedup"] == ids["ngram_jaccard"]
    holders = [r.doc_id for r in kept["substring_dedup"] if " ".join(passage) in (r.text or "")]
    assert holders == [1]
    size = lambda t: len((t or "").split())
    assert abs(sum(size(x.text) for x in kept["mixing"]) - sum(size(x.text) for x in kept["substring_dedup"])) <= 4
    assert ids["packing"] == ids["mixing"]
    taken = mixing.plan(spark.createDataFrame(kept["substring_dedup"], docs.schema)).where("_taken > 0").count()
    assert len(ids["mixing"]) == taken
    assert len(C.run(spark, str(tmp_path)).collect()) == len(kept["packing"])


def test_registered(spark):
    import __spark_entry__ as e
    from seriesloom.llm.queries import ORACLES, QUERIES

    assert set(QUERIES) | {"pipeline"} <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))
