import itertools
import random
import zlib

import numpy as np
from seriesloom.llm import toxicity as T


def test_forward_backward_agrees_with_all_paths():
    r = np.random.default_rng(0)
    for lengths in ([5, 3, 1], [1], [7]):
        n = sum(lengths)
        energy, trans, start = r.normal(size=n), r.normal(size=(2, 2)), 0.3
        starts = np.cumsum([0] + lengths)[:-1]
        p, pairs = T.forward_backward(energy, starts, np.array(lengths), start, trans, pairs=True)
        want, total = np.zeros(n), np.zeros((2, 2))
        for s, k in zip(starts, lengths):
            z, marg, tr = 0.0, np.zeros(k), np.zeros((2, 2))
            for path in itertools.product((0, 1), repeat=k):
                w = np.exp(sum(energy[s + i] for i in range(k) if path[i]) + start * path[0] + sum(trans[path[i - 1], path[i]] for i in range(1, k)))
                z += w
                marg += w * np.array(path)
                for i in range(1, k):
                    tr[path[i - 1], path[i]] += w
            want[s : s + k] = marg / z
            total += tr / z
        assert np.allclose(p, want) and np.allclose(pairs, total)


def test_chains_cover_every_token_once():
    r = np.random.default_rng(1)
    ends, offsets = r.random(1000) < 0.02, np.array([0, 0, 10, 500, 500, 1000])
    starts, lengths = T.chains(ends, offsets)
    covered = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, lengths)])
    assert sorted(covered) == list(range(1000)) and lengths.max() <= T.CHAIN and set(offsets[:-1]) - set(starts) == set()


def corpus():
    r = random.Random(5)
    vowels, out = "aeiou", []
    word = lambda: "".join(r.choice("bdfgklmnprst") + r.choice(vowels) for _ in range(r.randint(1, 3)))
    for i in range(900):
        words = [word() for _ in range(r.randint(20, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(r.randint(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(["zorkhead,", "Zorkhead", "vexling", "quxish" + word()]))
        out.append((i, " ".join(words) + ".", int(toxic)))
    return out


def test_held_out_rows(spark, documents):
    rows = corpus()
    extra = [(5000, None), (5001, ""), (5002, "zorkhead " * 20000), (None, "you zorkhead"), (0, rows[0][1])]
    docs = documents([(i, x) for i, x, _ in rows] + extra)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(7, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = T.fit(docs, labels)
    got = T.score(docs, model).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((by[i].score >= 0.7) == bool(y) for i, y in held)
    assert right / len(held) > 0.97
    assert by[5002].score > 0.9 and by[5000].score == by[5001].score < 0.5
    texts = {i: x for i, x, _ in rows}
    for i, y in held:
        for s in by[i].spans:
            assert y and texts[i][s.start : s.end].lower().startswith(("zork", "vex", "qux"))
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    again = {r.doc_id: r.score for r in T.score(docs, T.fit(docs, flipped), spans=False).collect()}
    assert all(again[r.doc_id] == r.score for r in got if r.doc_id)  # labels of held-out rows have no effect
    kept = T.without_toxic(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(r.score < 0.7 for r in got)


def test_without_labels_or_rows(spark, documents):
    docs = documents([(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert T.fit(docs, none) is None
    assert [r.score for r in T.score(docs, None).collect()] == [0.0, 0.0]
    assert T.without_toxic(docs, None).count() == 2
    assert T.score(docs.where("doc_id < 0"), None).count() == 0
