import random

import numpy as np
from seriesloom.llm import quality as Q


def counts(text):
    """The five counts, by the letter of their definitions."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, dup, seen = (text or "").split("\n"), 0, set()
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def texts():
    r = random.Random(1)
    out = [None, "", " \n\t", "a", "a b a b a b", "x\nx\n \n\ny\nx", "é ü z q", "#$ <|> a&b", "A\r\nA\r\n", "\x1c \x85 \x0b"]
    return out + [" ".join(r.choice(["a", "b", "c#", "\n", "dd.", "E!"]) for _ in range(r.randint(0, 80))) for _ in range(60)] + ["long " * 30000]


def test_counts_and_base_rule(documents):
    rows = [(i, x) for i, x in enumerate(texts())]
    rows += [rows[12], (None, "null id " * 40)]
    got = sorted((str(r.doc_id), *[r[c] for c in Q.STATS], r.base_failed, r.kept) for r in Q.quality(documents(rows)).collect())
    assert len(got) == len(rows)
    for r, (i, x) in zip(sorted(got, key=lambda g: g[0]), sorted(rows, key=lambda g: str(g[0]))):
        if x and len(x) > 10000:
            continue
        assert r[1:6] == counts(x), x
        assert r[6] == (r[1] < 50 or 100 * r[5] > 50 * r[1])
        assert not (r[6] and r[7])


def test_empty_table(documents):
    df = documents([(1, "x")])
    assert Q.quality(df.where("doc_id < 0")).count() == 0


def test_em_finds_rules_that_vote_against_bad_documents():
    r = np.random.default_rng(0)
    good = r.random(4000) < 0.85
    hit, false = np.full(len(Q.RULES), 0.5), np.full(len(Q.RULES), 0.01)
    bad = r.random((4000, len(Q.RULES))) < np.where(good[:, None], false, hit)
    votes = np.where(r.random(bad.shape) < 0.2, 0, np.where(bad, -1, 1))
    patterns, counts_ = np.unique(votes, axis=0, return_counts=True)
    m = Q.estimate(patterns, counts_.astype(float))
    assert abs(m["prior"] - good.mean()) < 0.02
    assert np.abs(m["hit"] - 0.5).max() < 0.08 and np.abs(m["false"] - 0.01).max() < 0.01


def test_junk_is_dropped_and_prose_kept(documents):
    r = random.Random(2)
    prose = lambda: " ".join(r.choice("alder birch cedar doum elder fir ginkgo hazel iroko jarrah".split()) + str(r.randint(0, 99) or "") + r.choice(["", "", "", ",", "."]) for _ in range(150))
    rows = [(i, prose()) for i in range(200)] + [(1000 + i, " ".join(w.upper() + "!!" for w in prose().split())) for i in range(12)] + [(2000 + i, prose().replace(" ", "### ")) for i in range(12)]
    kept = {r.doc_id: r.kept for r in Q.quality(documents(rows)).collect()}
    assert all(kept[i] for i in range(200)) and not any(v for k, v in kept.items() if k >= 1000)
