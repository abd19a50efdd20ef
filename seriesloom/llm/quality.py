"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Spark counts the vote
patterns (at most 3 ** number of rules rows, whatever the corpus size), expectation-maximisation
on those counts estimates how often each rule is right for good and for bad documents, and the
posterior probability of good is computed per document from the estimates as a Column expression.

Defined results: a null or empty text has no words, fails the base rule and every count is 0;
repeated rows are judged row by row; an empty table gives an empty result and the starting
estimates; only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
RULES = ("length", "word_length", "symbols", "lines", "repeats", "capitals", "variety", "shouting", "sentences", "junk_words")
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"v_{r} int" for r in RULES)
_symbol = re.compile(r"[#*$%&|<>]")
_space = re.compile(r"[\x20\x09-\x0D]")


def _vote(bad: bool, good: bool) -> int:
    return -1 if bad else 1 if good else 0


def measure(text: str) -> tuple[int, ...]:
    """The five counts, then the vote of each rule, of one whole text."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(_space.sub("", text))
    symbols = len(text) - len(_symbol.sub("", text))
    lines = [x for x in text.split("\n") if x and x.encode("utf-8", "surrogatepass").split()]
    dup_lines = len(lines) - len(set(lines))
    grams = list(zip(words, words[1:], words[2:]))
    repeats = 0
    if len(set(grams)) < len(grams):
        twice = {g for g, c in Counter(grams).items() if c > 1}
        end = 0
        for i, g in enumerate(grams):
            if g in twice:
                repeats += i + 3 - max(i, end)
                end = i + 3
    return n, chars, symbols, dup_lines, repeats, *votes(text, words, n, chars, symbols, len(lines), dup_lines, repeats)


def votes(text: str, words: list[bytes], n: int, chars: int, symbols: int, lines: int, dup_lines: int, repeats: int) -> tuple[int, ...]:
    if not n:
        return (-1,) + (0,) * (len(RULES) - 1)
    mean = chars / n
    capitals = sum(1 for w in words if len(w) > 1 and w.isupper())
    distinct = len(set(words))
    shouts = text.count("!")
    ends = sum(1 for w in words if w[-1] in b".,;:?!")
    marked = sum(1 for w in words if w[-1] in b"#*$%&|<>")
    return (
        _vote(n < MIN_WORDS, n >= 2 * MIN_WORDS),
        _vote(mean < 2 or mean > 15, 3 <= mean <= 10),
        _vote(10 * symbols > n, 100 * symbols <= 2 * n),
        _vote(10 * dup_lines > 3 * lines, not dup_lines),
        _vote(10 * repeats > 3 * n, 10 * repeats <= n),
        _vote(10 * capitals > 3 * n, 20 * capitals <= n),
        _vote(n >= MIN_WORDS and 10 * distinct < 2 * n, 10 * distinct >= 4 * n),
        _vote(10 * shouts > n, 100 * shouts <= 2 * n),
        _vote(n >= MIN_WORDS and 100 * ends < n, 20 * ends >= n),
        _vote(10 * marked > n, not marked),
    )


def measured(docs: DataFrame) -> DataFrame:
    """One row per document: counts and votes, from whole texts."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    schema = pa.schema([(k, pa.int64() if not k.startswith("v_") else pa.int32()) for k in names])

    def run(batches):
        for b in batches:
            rows = [measure(t or "") for t in b.column("text").to_pylist()]
            columns = list(zip(*rows)) or [[] for _ in names[1:]]
            yield base.batch(schema, doc_id=b.column("doc_id"), **dict(zip(names[1:], columns)))

    return base.arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> dict:
    """EM over vote patterns (rows of -1, 0, 1) with their counts.

    Returns the prior of good and, per rule, the probability of a bad vote (given a vote) for
    bad and for good documents. Starts from rules that are mostly silent about good documents;
    Beta pseudo-counts keep the estimates inside (0, 1) on small or empty tables.
    """
    m = len(RULES)
    prior, hit, false = 0.8, np.full(m, 0.4), np.full(m, 0.02)
    if not len(patterns):
        return {"prior": prior, "hit": hit, "false": false}
    bad, good = (patterns == -1).astype(float), (patterns == 1).astype(float)
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + bad @ np.log(false / hit) + good @ np.log((1 - false) / (1 - hit))
        p = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        w1, w0 = counts * p, counts * (1 - p)
        new = ((w1.sum() + 8) / (counts.sum() + 10), (w0 @ bad + 4) / (w0 @ (bad + good) + 10), (w1 @ bad + 0.2) / (w1 @ (bad + good) + 10))
        # a rule's bad vote must stay evidence of badness, else the two classes could swap
        new = (new[0], np.maximum(new[1], 1.5 * new[2]).clip(1e-4, 0.999), new[2].clip(1e-5, 0.6))
        moved = abs(new[0] - prior) + np.abs(new[1] - hit).sum() + np.abs(new[2] - false).sum()
        prior, hit, false = new
        if moved < tolerance:
            break
    return {"prior": prior, "hit": hit, "false": false}


def quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the counts, the votes, base_failed, quality (posterior of good) and kept."""
    facts = base.stored(measured(docs), "quality")
    names = [f"v_{r}" for r in RULES]
    seen = sorted((tuple(r[c] for c in names), r["count"]) for r in facts.groupBy(*names).count().collect())
    model = estimate(np.array([p for p, _ in seen], dtype=int).reshape(len(seen), len(names)), np.array([c for _, c in seen], dtype=float))
    odds = F.lit(float(np.log(model["prior"] / (1 - model["prior"]))))
    for c, h, f in zip(names, model["hit"], model["false"]):
        odds = odds + F.when(F.col(c) == -1, float(np.log(f / h))).when(F.col(c) == 1, float(np.log((1 - f) / (1 - h)))).otherwise(0.0)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        facts.withColumn("quality", F.round(1 / (1 + F.exp(-odds)), 9))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
    )


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(base.documents(spark, sf_dir)).select("doc_id", *STATS, "base_failed", "kept", "quality")
