import collections
import random

import numpy as np
from seriesloom.llm import base, passages


def fresh(r, n):
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def dealt(spark, rows, parts):
    return spark.createDataFrame(spark.sparkContext.parallelize([(i, " ".join(w)) for i, w in rows], parts), "doc_id long, text string")


def covered(docs):
    words = collections.defaultdict(set)
    for x in passages.passages(docs).collect():
        words[x.d, x.rd] |= set(range(x.start, x.end))
    return words


def test_a_passage_whose_parts_are_in_earlier_documents(spark):
    r = random.Random(1)
    p = fresh(r, 90)
    rows = [(1, fresh(r, 20) + p[0:37] + fresh(r, 20)), (2, fresh(r, 20) + p[22:69] + fresh(r, 20)), (3, fresh(r, 20) + p[54:90] + fresh(r, 20))]
    rows += [(10, fresh(r, 30) + p + fresh(r, 30)), (11, fresh(r, 50) + p + fresh(r, 10))]
    for parts in (1, 3):
        assert covered(dealt(spark, rows, parts)) == {(11, 10): set(range(50, 140))}


def test_a_fuzzy_passage_behind_a_long_equal_one(spark):
    r = random.Random(2)
    long, p = fresh(r, 100), fresh(r, 70)
    q = p[:30] + fresh(r, 1) + p[31:50] + fresh(r, 2) + p[50:]
    rows = [(1, long + fresh(r, 200) + p + fresh(r, 20)), (2, fresh(r, 7) + long + fresh(r, 170) + q + fresh(r, 20))]
    found = covered(dealt(spark, rows, 2))[2, 1]
    assert set(range(7, 107)) <= found and set(range(277, 349)) <= found


def test_a_fuzzy_passage_whose_parts_are_in_earlier_documents(spark):
    """Every seed has its first holder elsewhere, and no 50 words in a row are equal."""
    r = random.Random(7)
    p = fresh(r, 90)
    q = list(p)
    for k in (14, 29, 44, 59, 74):
        q[k] = f"x{k}"
    parts = [p[k : k + 25] for k in range(0, 90, 13)]
    rows = [(i, fresh(r, 20) + x + fresh(r, 20)) for i, x in enumerate(parts)]
    rows += [(10, fresh(r, 30) + p + fresh(r, 30)), (11, fresh(r, 50) + q + fresh(r, 10))]
    shifted = q[:29] + ["in", "between"] + q[29:]
    rows += [(12, fresh(r, 40) + shifted + fresh(r, 10))]
    for n in (1, 3):
        found = covered(dealt(spark, rows, n))
        assert set(range(50, 140)) <= found[11, 10] and set(range(40, 132)) <= found[12, 10] | found[12, 11]
        assert {i for i, _ in found} == {11, 12}


def test_earlier_places_with_like_words_around():
    r = np.random.default_rng(8)
    n = 700
    words = r.integers(0, 2**32, (n, 2 * passages.REACH + passages.K), dtype=np.uint32)
    words[:, 60:80] = words[0, 60:80]
    near = r.integers(0, n, 60)
    words[near, 20:100] = words[near[0], 20:100]
    ctx = passages.once(np.stack([passages.pair_codes(x) for x in words]))
    d = np.arange(n) // 2
    want = {(b, a) for b in range(n) for a in range(n) if d[a] < d[b] and b % 3 and len(np.intersect1d(ctx[a], ctx[b][ctx[b] > 0])) >= passages.ALIKE}
    whole = np.zeros(n, np.int32)
    for m in (n, passages.DIRECT - 100):
        got = {(b, int(a)) for b, x in passages.earlier_like(ctx[:m], d[:m], d[:m], np.arange(m) % 3 > 0, whole[:m]) for a in x}
        assert got == {(b, a) for b, a in want if b < m} and got
    side = np.arange(n, dtype=np.int32) // 2 % 2
    got = {(b, int(a)) for b, x in passages.earlier_like(ctx, d, d, np.arange(n) % 3 > 0, side) for a in x}
    assert got == {(b, a) for b, a in want if side[a] != side[b]}


def test_a_phrase_said_over_and_over(spark):
    r = random.Random(3)
    rows = [(1, fresh(r, 30) + ["so"] * 80 + fresh(r, 30)), (2, fresh(r, 9) + ["so"] * 300 + fresh(r, 9)), (3, fresh(r, 60) + ["so", "on"] * 10 + fresh(r, 60)), (4, fresh(r, 30) + ["so", "on"] * 100), (5, ["so", "on"] * 90)]
    found = covered(dealt(spark, rows, 2))
    assert found[2, 1] == set(range(9, 309)) and found[5, 4] == set(range(180)) and set(found) == {(2, 1), (5, 4)}
    assert len(passages.passages(dealt(spark, rows, 2)).collect()) < 40


def test_picks_of_equal_seeds_are_thinned():
    at = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 20, 22, 24, 26, 28, 30, 32, 34, 40])
    h = np.array([1] * 12 + [2] * 8 + [3])
    keep = at[passages.thin(at, h, np.zeros(len(at), int))]
    assert keep.tolist() == [0, 8, 11, 20, 28, 34, 40]


def test_equal_texts_are_whole_passages_of_the_first(spark):
    r = random.Random(4)
    a, b = fresh(r, 60), fresh(r, 40)
    rows = [(5, a), (2, a), (9, a), (1, b), (3, b), (7, a[:55] + fresh(r, 50)), (5, a)]
    for parts in (1, 4):
        got = sorted((x.d, x.start, x.end, x.rd) for x in passages.passages(dealt(spark, rows, parts)).collect())
        assert got == [(5, 0, 60, 2), (7, 0, 55, 2), (9, 0, 60, 2)]


def test_a_seed_in_very_many_texts(spark):
    r = random.Random(5)
    p, q = fresh(r, 60), fresh(r, 20)
    rows = [(i, fresh(r, i % 7) + p + fresh(r, 3) + (q if i % 2 else []) + fresh(r, 20)) for i in range(100, 0, -1)]
    want = {i: set(range(i % 7, i % 7 + 60)) for i in range(2, 101)}
    most = {i: set(range(i % 7, i % 7 + (83 if i % 2 else 60))) for i in range(2, 101)}
    results = []
    for parts in (1, 5):
        found = covered(dealt(spark, rows, parts))
        assert all(want[i] <= found[i, 1] for i in want) and all(words <= most[i] for (i, _), words in found.items())
        results.append(found)
    assert results[0] == results[1]


def test_rows_do_not_depend_on_how_documents_are_dealt_out(spark):
    docs = base.documents(spark, "/root/testdata/sf0.001")
    results = [sorted(map(tuple, passages.passages(docs.repartition(n)).collect())) for n in (1, 7, 16)]
    assert results[0] == results[1] == results[2] and results[0]


def test_recall_against_all_diagonals(spark):
    """Every diagonal of every two texts, searched for a range of 50 words that is 80 % equal."""
    r = random.Random(6)
    shared = [fresh(r, r.randint(52, 120)) for _ in range(8)]
    rows = []
    for i in range(64):
        w = fresh(r, r.randint(20, 120))
        p = list(shared[i % 8])
        for k in r.sample(range(1, len(p) - 1), int(len(p) * r.uniform(0, 0.2))):
            p[k] = f"x{r.randrange(10**6)}"
        at = r.randint(0, len(w))
        rows.append((i, w[:at] + p + w[at:]))
    truth = collections.defaultdict(set)
    codes: dict[str, int] = {}
    texts = [np.array([codes.setdefault(x, len(codes)) for x in w]) for _, w in rows]
    for i in range(len(texts)):
        for j in range(i):
            places = {x: k for k, x in enumerate(texts[j])}
            shifts = collections.Counter(k - places[x] for k, x in enumerate(texts[i]) if x in places)
            for s in (s for s, n in shifts.items() if n >= 40):
                lo, hi = max(0, s), min(len(texts[i]), len(texts[j]) + s)
                same = texts[i][lo:hi] == texts[j][lo - s : hi - s]
                if found := passages.longest(same, np.ones(len(same), bool)):
                    truth[i] |= set(range(lo + found[0], lo + found[1]))
    mine = collections.defaultdict(set)
    for x in passages.passages(dealt(spark, rows, 4)).collect():
        mine[x.d] |= set(range(x.start, x.end))
    assert len(truth) > 40
    recall = sum(len(truth[i] & mine[i]) for i in truth) / sum(map(len, truth.values()))
    assert recall >= 0.95, recall
