"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are of documents. A bounded sample of labelled rows (MAX_FIT toxic and twice as many clean
ones at most, lowest md5 of doc_id first) is all that is fitted on. Token labels come from
it: a token of a toxic document is toxic if its word or a word beginning occurs in toxic documents
far more often than chance (likelihood ratio) and hardly in clean ones. The field has two states,
features of the token itself (word, beginnings, ending, shape) hashed into a fixed table, and
transitions inside a sentence; it is trained by gradient on forward-backward marginals. A
document's score is a logistic function of the marginals of all its tokens, so that it is the
probability that the document's label is toxic.

Whole texts are scored. A chain ends after . ! ? and after CHAIN tokens, where a new one starts; no
token is left out. Defined results: a null or empty text has no tokens and the lowest evidence;
null and repeated doc_ids are scored row by row; a doc_id with several labels counts as toxic if
one says so; without a toxic and a clean training row every score is 0; an empty table gives an
empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

MAX_FIT = 1000
CHAIN = 64
TABLE = 1 << 18
KINDS = 7
EVIDENCE = 8.0
SPANS = "array<struct<start:int,end:int,probability:double>>"
_edge = re.compile(r"^[\W_]+|[\W_]+$")
_token = re.compile(r"[^\x20\x09-\x0D]+")


def features(word: str) -> tuple[str, ...]:
    """Names of the features of one token: word, four beginnings, ending, shape."""
    key = _edge.sub("", word)
    low = key.lower()
    shape = "X" if key.isupper() and len(key) > 1 else "x" if key.islower() else "Xx" if key[:1].isupper() else "0"
    return f"w:{low}", f"4:{low[:4]}", f"5:{low[:5]}", f"6:{low[:6]}", f"7:{low[:7]}", f"e:{low[-3:]}", f"s:{shape}"


def hashed(word: str) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) for f in features(word)]


def chains(ends: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the chains of a batch, longest first; offsets: first token of each text."""
    n = len(ends)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[1:] = ends
    first[offsets] = True
    first = first[:n]
    index = np.arange(n)
    since = index - np.maximum.accumulate(np.where(first, index, 0))
    starts = np.flatnonzero(first | (since % CHAIN == 0))
    lengths = np.diff(np.append(starts, n))
    order = np.argsort(-lengths, kind="stable")
    return starts[order], lengths[order]


def forward_backward(energy: np.ndarray, starts: np.ndarray, lengths: np.ndarray, start: float, trans: np.ndarray, pairs: bool = False):
    """Marginal probability of the toxic state of each token; with pairs, the expected transitions too.

    All chains advance together, one position at a time. Ratios of the two states' messages are
    enough: they never underflow.
    """
    n = len(energy)
    e = np.exp(np.clip(energy, -30, 30))
    t = np.exp(trans)
    ahead, behind = np.empty(n), np.ones(n)
    steps = int(lengths[0]) if len(lengths) else 0
    alive = [int(np.searchsorted(-lengths, -k, side="left")) for k in range(steps + 1)]  # chains longer than k
    if steps:
        ahead[starts] = e[starts] * math.exp(start)
    for k in range(1, steps):
        at = starts[: alive[k]] + k
        r = ahead[at - 1]
        ahead[at] = e[at] * (t[0, 1] + t[1, 1] * r) / (t[0, 0] + t[1, 0] * r)
    for k in range(steps - 1, 0, -1):
        at = starts[: alive[k]] + k
        m = e[at] * behind[at]
        behind[at - 1] = (t[1, 0] + t[1, 1] * m) / (t[0, 0] + t[0, 1] * m)
    odds = ahead * behind
    p = odds / (1 + odds)
    if not pairs:
        return p
    inner = np.ones(n, bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    r, m = ahead[at - 1], e[at] * behind[at]
    joint = np.stack([np.full(len(at), t[0, 0]), t[0, 1] * m, r * t[1, 0], r * t[1, 1] * m])
    joint /= joint.sum(0)
    return p, joint.sum(1).reshape(2, 2)


def marked(hashes: np.ndarray, sized: np.ndarray, codes: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Which of the words mark toxic documents, from the documents' labels alone.

    hashes: of the features of each word; sized: is the word long enough to be judged; codes: the
    words of each document. Near copies of one document share most of three minima over its words, and
    support a feature once.
    """
    names = hashes[:, : KINDS - 2]
    none = np.zeros(0, np.uint64)
    seen, many, clean, pairs = none, np.zeros(0), [], []

    def counted():
        """Merge what the clean documents met lately add to the counts."""
        nonlocal seen, many
        own, n = np.unique(np.concatenate([*clean, none]), return_counts=True)
        seen, at = np.unique(np.concatenate([seen, own]), return_inverse=True)
        many = np.bincount(at, np.concatenate([many, n]), minlength=len(seen))
        clean.clear()

    for own, y in zip(codes, toxic):
        own = np.unique(own)
        kinds = np.unique(names[own[sized[own]]])
        if not y:
            clean.append(kinds)
            if len(clean) == 200:
                counted()
            continue
        first = hashes[own, 0]
        same = [int((first * np.uint64(k) & np.uint64(0xFFFFFFFF)).min(initial=0xFFFFFFFF)) for k in (2654435761, 2246822519, 3266489917)]
        pairs.append((kinds, same))
    counted()
    support: np.ndarray | None = None
    for i in range(3):
        both = np.unique(np.concatenate([*(k << np.uint64(32) | np.uint64(s[i]) for k, s in pairs), none]))
        found, count = np.unique(both >> np.uint64(32), return_counts=True)
        support = count if support is None else np.minimum(support, count)
    b = np.zeros(len(found))
    if len(seen):
        at = np.minimum(np.searchsorted(seen, found), len(seen) - 1)
        b = np.where(seen[at] == found, many[at], 0).astype(float)
    a, n1, n0 = support.astype(float), max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    share = n1 / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = a * np.log(a / ((a + b) * share)) + np.where(b > 0, b * np.log(b / ((a + b) * (1 - share))), 0.0)
    marks = found[(a / n1 >= 10 * b / n0) & (ratio >= EVIDENCE)]
    return sized & np.isin(names, marks).any(1)


def _ends(words: list[str]) -> np.ndarray:
    return np.array([w[-1] in ".!?" for w in words], bool)


def train(texts: list[str], toxic: np.ndarray, toxic_share: float, epochs: int = 8, rate: float = 0.5) -> dict | None:
    """The field's weights and the score's logistic function, from whole labelled texts."""
    if not toxic.any() or toxic.all():
        return None
    flat, words, bounds = base.split_words(pa.array(texts, pa.large_string()))
    flat = flat.astype(np.int32)
    base.trim()
    tokens = [flat[i:j] for i, j in zip(bounds[:-1], bounds[1:])]
    hashes = np.fromiter((h for w in words for h in hashed(w)), np.uint64, len(words) * KINDS).reshape(len(words), KINDS)
    sized = np.array([len(_edge.sub("", w)) > 2 for w in words], bool)
    marks = marked(hashes, sized, tokens, toxic)
    table = (hashes % np.uint64(TABLE)).astype(np.int32)
    ending = _ends(words)
    del hashes, words, flat
    base.trim()
    weight, moved = np.zeros(TABLE), np.full(TABLE, 1e-2)
    bias, start, trans = -4.0, 0.0, np.zeros((2, 2))
    small = np.full(6, 1e-2)
    order = np.random.default_rng(7).permutation(len(tokens))
    groups = [order[i : i + 100] for i in range(0, len(order), 100)]
    ready = []
    for g in groups:
        codes = np.concatenate([tokens[i] for i in g])
        y = np.concatenate([marks[tokens[i]] & toxic[i] for i in g])
        offsets = np.cumsum([0] + [len(tokens[i]) for i in g])
        own, local = np.unique(codes, return_inverse=True)
        ready.append((local.astype(np.int32), y, *chains(ending[codes], offsets), table[own], offsets))
    for _ in range(epochs):
        for codes, y, starts, lengths, own, _ in ready:
            if not len(codes):
                continue
            y, energy = y.astype(float), bias + weight[own].sum(1)[codes]
            p, expected = forward_backward(energy, starts, lengths, start, trans, pairs=True)
            inner = np.ones(len(y), bool)
            inner[starts] = False
            at = np.flatnonzero(inner)
            observed = np.bincount((2 * y[at - 1] + y[at]).astype(int), minlength=4).reshape(2, 2)
            miss = (y - p) / len(starts)
            by_word = np.bincount(codes, miss, minlength=len(own))
            at_, back = np.unique(own.ravel(), return_inverse=True)
            g = np.bincount(back, np.repeat(by_word, KINDS), minlength=len(at_)) * len(starts) / 100 - 1e-4 * weight[at_]
            moved[at_] += g * g
            weight[at_] += rate * g / np.sqrt(moved[at_])
            gs = np.array([miss.sum() * len(starts) / 100, ((y - p)[starts]).sum() / 100, *((observed - expected).ravel() / 100)]) - 1e-3 * np.array([0, start, *trans.ravel()])
            small += gs * gs
            step = 0.2 * gs / np.sqrt(small)
            bias, start = bias + step[0], start + step[1]
            trans = trans + step[2:].reshape(2, 2)
    model = {"weight": weight.astype(np.float32), "bias": float(bias), "start": float(start), "trans": trans}
    evidence = np.concatenate([summed(marginals(model, own[codes], starts, lengths), offsets) for codes, _, starts, lengths, own, offsets in ready])
    sampled = toxic.mean()
    importance = np.where(toxic[order], toxic_share / sampled, (1 - toxic_share) / (1 - sampled))
    model["score"] = logistic(evidence, toxic[order].astype(float), importance)
    return model


def marginals(model: dict, rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Probability of the toxic state of tokens, given the features of each."""
    return forward_backward(model["bias"] + model["weight"][rows].sum(1), starts, lengths, model["start"], model["trans"])


def summed(p: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    p = np.where(p < 0.02, 0.0, p)  # what every ordinary word has, else length alone would be evidence
    none = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-9)))])
    count = np.concatenate([[0.0], np.cumsum(p)])
    any_ = -np.expm1(none[offsets[1:]] - none[offsets[:-1]])
    any_ = np.clip(any_, 1e-3, 1 - 1e-3)
    return np.stack([np.log(any_ / (1 - any_)), np.log1p(np.maximum(0.0, count[offsets[1:]] - count[offsets[:-1]]))], 1)


def logistic(x: np.ndarray, y: np.ndarray, importance: np.ndarray, rounds: int = 30) -> list[float]:
    """Weights (bias first) by Newton steps, with a small ridge."""
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (importance * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (importance * (y - p)) - 0.1 * w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return [float(v) for v in w]


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> dict | None:
    """Train on at most max_fit toxic and 2 * max_fit clean labelled rows that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = dict(known.groupBy("toxic").count().collect())
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    if not n1 or not n0:
        return None
    picked = [r for toxic, most in ((1, max_fit), (0, 2 * max_fit)) for r in known.where(F.col("toxic") == toxic).orderBy(F.md5(F.col("doc_id").cast("string"))).limit(most).collect()]
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r["doc_id"], int(r["toxic"])) for r in picked], "doc_id long, toxic int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), base.text_of(docs).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()  # one of the rows that repeat an id
    rows.sort(key=lambda r: r["doc_id"])
    model = train([r["text"] for r in rows], np.array([r["toxic"] == 1 for r in rows], bool), n1 / (n1 + n0))
    del rows
    base.trim()
    return model


class Judge:
    """Scores batches of whole texts; keeps the energies of words it has met, up to a bound."""

    def __init__(self, model: dict | None):
        self.model, self.seen, self.table = model, {}, []

    def __call__(self, texts: pa.Array, spans: bool) -> tuple[np.ndarray, np.ndarray, list]:
        """Score, number of toxic tokens and, with spans, their offsets, of each text."""
        n, model = len(texts), self.model
        if model is None:
            return np.zeros(n), np.zeros(n, np.int64), [[]] * n
        codes, words, offsets = base.split_words(texts)
        if len(self.seen) > 250_000:
            self.seen.clear()
            self.table.clear()
        seen, table, weight = self.seen, self.table, model["weight"]
        at = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            k = seen.get(w)
            if k is None:
                k = seen[w] = len(table)
                table.append(model["bias"] + sum(float(weight[f % TABLE]) for f in hashed(w)))
            at[i] = k
        energy = np.array(table)[at][codes] if len(words) else np.zeros(0)
        starts, lengths = chains(_ends(words)[codes] if len(words) else np.zeros(0, bool), offsets)
        p = forward_backward(energy, starts, lengths, model["start"], model["trans"])
        bias, by_any, by_count = model["score"]
        scores = 1 / (1 + np.exp(-np.clip(bias + summed(p, offsets) @ np.array([by_any, by_count]), -30, 30)))
        hit = np.concatenate([[0], np.cumsum(p >= 0.5)])
        hits = hit[offsets[1:]] - hit[offsets[:-1]]
        found: list = [[]] * n
        if spans:
            for i in np.flatnonzero(hits):
                own = p[offsets[i] : offsets[i + 1]]
                found[i] = [{"start": m.start(), "end": m.end(), "probability": float(q)} for m, q in zip(_token.finditer(texts[int(i)].as_py()), own) if q >= 0.5]
        return scores, hits, found


def score(docs: DataFrame, model: dict | None, spans: bool = True) -> DataFrame:
    """doc_id, score, n_toxic and, with spans, the character offsets of toxic tokens of every whole text."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_toxic", pa.int64()), ("spans", kind)])

    def run(batches):
        judge = Judge(model)
        for whole in batches:
            for b in base.slices(whole, "text"):
                scores, hits, found = judge(b.column("text"), spans)
                yield base.batch(schema, doc_id=b.column("doc_id"), score=scores, n_toxic=hits, spans=found)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.arrow_map(rows, run, f"doc_id long, score double, n_toxic long, spans {SPANS}")


def without_toxic(docs: DataFrame, model: dict | None, threshold: float = 0.7) -> DataFrame:
    """docs without the rows that score the threshold or more; all columns as they are, no shuffle."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches):
        judge = Judge(model)
        for whole in batches:
            for b in base.slices(whole, "text", 2 << 20):
                keep = pa.array(judge(b.column("text"), False)[0] < threshold)
                yield pa.RecordBatch.from_arrays([b.column("row").filter(keep)], names=["row"])

    kept = base.arrow_map(rows, run, f"row {rows.schema['row'].dataType.simpleString()}")
    return kept.select(*[F.col("row")[c].alias(c) for c in names])


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = base.documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_toxic")
