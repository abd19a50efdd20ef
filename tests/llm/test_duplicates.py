import collections
import random

import numpy as np
import pytest
from seriesloom.llm import base, jaccard, passages, suffixes
from seriesloom.llm.components import components
from seriesloom.llm.rolling import Sums, sliding_min, winnow


def test_hashes_of_slices_do_not_depend_on_place():
    r = np.random.default_rng(0)
    a = r.integers(0, 256, 500).astype(np.uint8)
    b = np.concatenate([r.integers(0, 256, 77).astype(np.uint8), a])
    x, y = Sums(a).windows(40), Sums(b).windows(40)
    assert (x == y[77:]).all() and len(set(x.tolist())) == len(x)
    assert Sums(a).of(np.array([5]), np.array([9]))[0] == Sums(a[5:9]).of(np.array([0]), np.array([4]))[0]
    for w in (1, 2, 7, 16):
        assert (sliding_min(x, w) == [x[i : i + w].min() for i in range(len(x) - w + 1)]).all()


def test_winnowing_picks_in_every_window():
    x = np.random.default_rng(1).integers(1, 50, 400).astype(np.uint64)
    for w in (1, 3, 8):
        picked = set(winnow(x, w).tolist())
        want = {i + int(j) for i in range(len(x) - w + 1) for j in np.flatnonzero(x[i : i + w] == x[i : i + w].min())}
        assert picked == want


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {x.v: x.comp for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingled(t):
    w = (t or "").encode().split()
    return set(zip(w, w[1:], w[2:], w[3:], w[4:])) if len(w) >= 5 else ({tuple(w)} if w else set())


def linked(rows):
    sets = [shingled(t) for _, t in rows]
    links = [[j for j in range(len(rows)) if j != i and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(rows))]
    seen, out = {}, []
    for i in range(len(rows)):
        if i not in seen:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen[x] = i
                    todo += links[x]
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if seen[j] == seen[i] and rows[j][0] is not None]
        out.append((rows[i][0], min(ids) if ids else None, len(links[i])))
    return out


def near_copies():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[r.choice(vocabulary) for _ in range(r.randint(3, 90))] for _ in range(10)]
    rows = []
    for i in range(220):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((None if i % 41 == 0 else i // 2 if i % 29 == 0 else i, " ".join(w)))
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "a b"), (1005, "a"), (1006, "a b"), (1006, "a b"), (1007, "long words " * 20000)]


@pytest.mark.parametrize("block", [500_000, 1500])
def test_jaccard_join_agrees_with_all_pairs(documents, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies()
    got = [(None if r.d == base.NO_ID else r.d, r.class_id, r.n_links) for r in jaccard.join(documents(rows)).collect()]
    assert collections.Counter(got) == collections.Counter(linked(rows))


def test_one_representative_of_each_class(documents):
    rows = [(n if i is not None and i < 900 else i, t) for n, (i, t) in enumerate(near_copies())]
    docs = documents(rows)
    kept = jaccard.representatives(docs)
    assert kept.schema == docs.schema
    want = linked(rows)
    texts = {i: t for i, t in rows}
    solid = {c for (i, c, _), (_, t) in zip(want, rows) if shingled(t) and c is not None}
    got = collections.Counter(r.doc_id for r in kept.collect())
    assert {i for i in got if i is not None and shingled(texts[i])} == solid and all(got[i] == 1 for i in solid)
    assert all(got[i] == 1 for i in (1000, 1001, 1002))
    assert jaccard.representatives(docs.where("doc_id < 0")).count() == 0


def test_posterior_bounds():
    need = jaccard.least_matches(0.8)
    assert all(0 < need[n] <= 0.8 * n for n in need) and list(need) == sorted(need)


def byte_cases():
    r = random.Random(5)
    bases = ["".join(r.choice("ab cd") for _ in range(600)) for _ in range(8)] + ["x" * 700, "ab" * 400, "é" * 300, "日本語" * 120]

    def one():
        t = r.choice(bases)[r.randint(0, 300) : r.randint(300, 700)]
        for _ in range(r.randint(0, 2)):
            p = r.randint(0, len(t))
            t = t[:p] + r.choice(["", "Z", "q q", r.choice(bases)[:250]]) + t[p + r.randint(0, 2) :]
        return t

    rows = [(i // 2 if i % 17 == 0 else i if i % 23 else None, one()) for i in range(150)]
    return rows + [(900, None), (901, ""), (901, ""), (902, "same" * 80), (902, "same" * 80), (903, "y" * 199), (904, "y" * 199), (905, "z" * 60000)]


def test_repeated_bytes_agree_with_a_table_of_windows(documents):
    rows = byte_cases()
    got = collections.Counter((r.doc_id, r.n_bytes, tuple(map(tuple, r.spans)), bytes(r.kept)) for r in suffixes.remove(documents(rows)).collect())
    want = collections.Counter()
    for (i, t), spans in zip(rows, suffixes.brute([t for _, t in rows])):
        raw, kept, at = (t or "").encode(), b"", 0
        for a, b in spans:
            kept, at = kept + raw[at:a], b
        want[(i, len(raw), tuple(spans), kept + raw[at:])] += 1
    assert got == want
    assert suffixes.remove(documents(rows).where("doc_id < -1")).count() == 0


def test_chains_follow_order_and_shun_gaps():
    x0, x1, y0 = (np.array(v) for v in ([0, 20, 40, 300], [12, 32, 52, 320], [100, 121, 60, 420]))
    got = passages.chain(x0, x1, y0)
    assert sorted(map(sorted, got)) == [[0, 1], [2], [3]]


def test_fenwick_is_a_prefix_maximum():
    r = random.Random(6)
    tree, plain = passages.Fenwick(50), []
    for i in range(300):
        at, value = r.randrange(50), r.random()
        tree.put(at, value, i)
        plain.append((at, value, i))
        below = r.randrange(51)
        best = max(((v, k) for a, v, k in plain if a < below), default=(float("-inf"), -1))
        assert tree.best(below) == best


def planted():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    fresh = lambda n: [r.choice(vocabulary) for _ in range(n)]
    shared, line = [fresh(r.choice([55, 60, 80, 120])) for _ in range(6)], fresh(14)
    rows, truth = [], {}
    for i in range(120):
        w = fresh(r.randint(30, 300))
        if i % 3 == 0:
            w[5:5] = line
        if i % 4 == 0:
            k = r.randrange(6)
            p = list(shared[k])
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                q = r.randrange(len(p))
                p[q : q + r.choice([0, 1])] = r.choice([[], [r.choice(vocabulary)]])
            at = r.randint(0, len(w))
            w[at:at] = p
            truth[i] = (k, at, at + len(p))
        rows.append((i, " ".join(w)))
    return rows, truth


def test_planted_passages_are_found_and_cut(documents):
    rows, truth = planted()
    extra = [(500, None), (501, ""), (502, "short text"), (504, "the " * 400), (505, "the " * 300), (3, rows[3][1]), (None, "n " + rows[5][1])]
    docs = documents(rows + extra)
    found = collections.defaultdict(list)
    for r in passages.passages(docs).collect():
        assert (r.rd, r.rt) != (r.d, r.t) and r.rd <= r.d and r.end - r.start >= 50 and r.equal >= 0.8 * r.columns
        found[r.d].append((r.start, r.end))
    first = {}
    for i, (k, a, z) in truth.items():
        if first.setdefault(k, i) == i:
            continue
        inside = [(max(a, s), min(z, e)) for s, e in found[i]]
        assert sum(max(0, e - s) for s, e in inside) >= 0.8 * (z - a), i
    clean = set(range(120)) - set(truth) - {5}
    assert not clean & set(found)
    cut = passages.without_passages(docs)
    assert cut.schema == docs.schema and cut.count() == docs.count()
    texts = {r.doc_id: r.text for r in cut.collect() if r.doc_id is not None}
    assert all(texts[i] == dict(rows)[i] for i in clean)
    assert passages.passages(docs.where("doc_id < -1")).count() == 0


def test_alignment_of_runs():
    a, b = np.array([1, 2, 3, 4, 5]), np.array([1, 3, 4, 9, 5])
    x, y, same = passages.gap_columns(a, b, shifts=True)
    assert same.sum() == 4 and sorted(x[x >= 0]) == list(range(5)) and sorted(y[y >= 0]) == list(range(5))
    assert passages.gap_columns(a, a[:0])[2].tolist() == [False] * 5


def test_texts_without_id_are_told_apart_by_all_of_their_hash(documents):
    import xxhash

    low = lambda t: xxhash.xxh64_intdigest(t, 42) & 0xFFFF
    passage = " ".join(f"p{i}" for i in range(70))
    one = "begin " + passage
    two = next(t for t in (f"{passage} end{i}" for i in range(10_000_000)) if low(t) == low(one))
    cut = passages.without_passages(documents([(None, one), (None, two)])).collect()
    assert sum("p35" in r.text for r in cut) == 1


def test_a_long_segment_far_behind_does_not_hide_a_near_one():
    x0, x1, y0 = (np.array(v) for v in ([0, 600, 631], [500, 630, 661], [0, 600, 630]))
    assert sorted(passages.chain(x0, x1, y0)) == [[0], [1, 2]]


def test_the_longest_range_that_is_equal_enough():
    a = np.arange(62)
    b = np.where((a >= 40) & (a < 46), a + 1000, a)
    assert passages.align(a, 0, b, 0, np.array([[0, 40, 0], [46, 62, 46]])) == [(0, 62, 0, 62, 56, 62)]
    c = np.where(np.arange(59) % 13 == 12, np.arange(59) + 1000, np.arange(59))  # runs of 12, of which one has a seed
    assert passages.align(np.arange(59), 0, c, 0, np.array([[15, 21, 15]])) == [(0, 59, 0, 59, 55, 59)]
    r = random.Random(7)
    for _ in range(300):
        same = np.array([r.random() < 0.82 for _ in range(r.randint(40, 90))])
        word = np.array([s or r.random() < 0.8 for s in same])
        n = len(same)
        fits = lambda i, j: same[i] and same[j - 1] and word[i:j].sum() >= 50 and 5 * same[i:j].sum() >= 4 * (j - i)
        got = passages.longest(same, word)
        assert (got is not None) == any(fits(i, j) for i in range(n) for j in range(i + 1, n + 1))
        assert got is None or fits(*got)


def test_chains_of_one_seed_are_aligned(spark):
    links = spark.createDataFrame([(2, 0, 15, 1, 0, 15)], "d long, t long, pos long, rd long, rt long, rpos long")
    assert [(r.lo, r.hi) for r in passages.chains(links).collect()] == [(15, 21)]


def test_all_copies_in_the_first_holder_of_a_task_are_found(spark):
    r = random.Random(8)
    fresh = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    p = fresh(70)
    rows = [(1, f"{fresh(9)} {p} {fresh(9)}"), (2, f"{fresh(30)} {p} {fresh(200)} {p} {fresh(30)}")]
    for parts in (1, 2):
        docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string")
        got = sorted((x.d, x.start, x.end) for x in passages.passages(docs).collect())
        assert got == [(2, 30, 100), (2, 300, 370)]


def test_passages_of_parts_that_stand_alone_elsewhere(spark):
    r = random.Random(9)
    fresh = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    lines, halves = [fresh(40) for _ in range(3)], [fresh(25) for _ in range(2)]
    rows = [(i + 1, f"{fresh(20)} {x} {fresh(20)}") for i, x in enumerate(lines + halves)]
    rows += [(100, f"{fresh(30)} {' '.join(lines)} {fresh(30)}"), (200, f"{fresh(60)} {' '.join(lines)} {fresh(5)}")]
    rows += [(300, f"{fresh(30)} {' '.join(halves)} {fresh(30)}"), (400, f"{fresh(60)} {' '.join(halves)} {fresh(5)}")]
    for parts in (1, 4):
        docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string")
        words = collections.defaultdict(set)
        for x in passages.passages(docs).collect():
            words[x.d, x.rd] |= set(range(x.start, x.end))
        assert words == {(200, 100): set(range(60, 180)), (400, 300): set(range(60, 110))}
