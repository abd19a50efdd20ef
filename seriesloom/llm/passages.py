"""Fuzzy passages shared by documents: seeds, collinear chains with gap costs, alignment.

1. Seeds are runs of K words picked by winnowing: any MATCH = K + W - 1 words in a row that two texts
   share give both a common seed. Every occurrence of a seed is matched with its first one (smallest doc_id,
   then place), so a seed gives as many matches as occurrences, however common a passage is. Of a phrase
   said over and over, one seed in W words stays.
2. Matches of a text with another one are merged along diagonals into segments, and
   segments chained: later ones must start later in both, words between them cost GAP each. The best
   predecessor is a prefix maximum, kept in a Fenwick tree over places in the other document; where that one is
   more than FAR words behind, it is looked for among the ends at most FAR words behind.
3. Chains are aligned on the words of both documents: segments along their diagonal, gaps by
   their longest common subsequence, ends outwards along the diagonal, REACH words at most, and
   for TAIL words further by longest common subsequence. A passage is the longest range of columns with
   MIN_WORDS words of which IDENTITY are equal; the columns to its left and right may hold further ones.
   It begins and ends with K equal words; where there is none, with one.
4. Where the first holders of neighbouring seeds differ, two later texts may share a passage that no first one
   has. There all runs of MIN_WORDS words are matched with their first occurrence in the same way, and overlapping
   ones of a pair are one passage. So a run of MIN_WORDS words that an earlier document has is found, whatever its seeds
   are matched with; only where all its seeds lie on one diagonal of one first holder is it left to that holder's alignment.
5. Seeds that no passage found so far covers are matched again, with every earlier holder that has like words around it, and
   chained and aligned in the same way: a passage with edits is found though each of its seeds has another first holder.

A seed that a task meets in many texts is tied to the first of them there, and only that goes on to the other
tasks, so no key gathers what a common phrase has; the others then take over what their first one is matched
with. Equal texts are one text, that of the smallest doc_id; the others are whole passages of that one. Nothing depends
on how the rows are dealt out. Rows go by (doc_id, 64-bit hash of the text).

Defined results: the document with the smallest doc_id keeps a passage, null ids count as smallest;
texts of fewer than MIN_WORDS words, nulls and empty ones have none; repeats inside one document
are not passages; rows that repeat a doc_id with the same text are one document in matching, and lose the
same words; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .rolling import MAX, Sums, mix, winnow, words_of

K = 6
W = 8
MIN_WORDS = 50
IDENTITY = 0.8
UNEQUAL = 4  # what a column of unlike words costs, so that IDENTITY breaks even: IDENTITY / (1 - IDENTITY)
GAP = 0.1
FAR = 25
REACH = 64
TAIL = 16
FLUSH = 600_000
ALIKE = 24  # pairs of neighbouring words that the places of a passage share, at least: 29 of any 50 columns that reach IDENTITY
DIRECT = 256
BLOCK = 4096
SPREAD = 16  # occurrences of a seed in one flush that all go to the seed's key
_seed = pa.schema([(c, pa.int64()) for c in ("h", "d", "t", "pos", "rd", "rt", "rpos")])
_match = pa.schema([("kind", pa.int32())] + [(c, pa.int64()) for c in ("d", "t", "pos", "rd", "rt", "rpos")])
_link = pa.schema([(c, pa.int64()) for c in ("d", "t", "pos", "rd", "rt", "rpos")])
MATCH, HEAD, TIED = 0, 1, 2


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.binary(): "binary", pa.int32(): "int", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {kinds.get(f.type, 'long')}" for f in schema)


def thin(at: np.ndarray, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which picks stay: of equal ones at one distance from each other enough to leave none further than W apart."""
    keep = np.ones(len(at), bool)
    if len(at) < 3:
        return keep
    step = np.diff(at)
    tie = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) & (step < W)
    goes_on = np.zeros(len(tie), bool)
    goes_on[:-1] = tie[:-1] & tie[1:] & (step[1:] == step[:-1])
    begins = np.concatenate([[True], ~goes_on[:-1]])
    index = np.arange(len(tie)) - np.maximum.accumulate(np.where(begins, np.arange(len(tie)), 0))
    keep[1:] = ~goes_on | ((index + 1) % np.maximum(W // step, 1) == 0)
    return keep


def seeds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and first word of every seed of a batch, and each text's number of words."""
    data, offsets = base.bytes_of(texts)
    starts, ends, first = words_of(data, offsets)
    none, sizes = np.zeros(0, np.int64), np.diff(first)
    if len(starts) < K:
        return none, none, none, sizes
    h = Sums(data, Sums(data).of(starts, ends)).windows(K)
    gap = np.zeros(len(starts) + 1, np.int32)
    np.add.at(gap, np.where(sizes >= MIN_WORDS, np.maximum(first[1:] - K + 1, first[:-1]), first[:-1]), 1)
    np.add.at(gap, first[1:], -1)
    h[np.cumsum(gap[:-1])[: len(h)] > 0] = MAX
    at = winnow(h, W)
    doc = np.searchsorted(first, at, side="right") - 1
    keep = thin(at, h[at], doc)
    at, doc = at[keep], doc[keep]
    return h[at].view(np.int64), doc, at - first[doc], sizes


def occurrences(rows: DataFrame, find=seeds, columns: tuple[str, ...] = (), whole: bool = True) -> DataFrame:
    """h, d, t, pos of the seeds of texts. One that is in a flush more than SPREAD times goes on once, with rpos -1;
    its others get the flush's first as rd, rt, rpos, and an h of their own, so that they go anywhere.

    find gives hash, row and place of the seeds of texts (and of further columns), and sizes in words. Equal texts of a flush are
    one, with the smallest d. With whole, a text of MIN_WORDS words is itself a seed of its row, at pos -(number of words).
    """

    def run(batches):
        held: list[tuple] = []
        known: dict[int, int] = {}
        ids: list[int] = []
        copies: list[tuple[int, int, int]] = []
        size = 0

        def flush():
            h, own, pos = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64),) * 3
            d, t = np.array(ids, np.int64)[own], np.fromiter(known, np.int64, len(known))[own]
            if copies:
                cd, ct, n = np.array(copies, np.int64).T
                h = np.concatenate([h, mix(ct.view(np.uint64) ^ np.uint64(MIN_WORDS)).view(np.int64)])
                d, t, pos = np.concatenate([d, cd]), np.concatenate([t, ct]), np.concatenate([pos, -n])
            order = np.argsort(h)
            new = np.ones(len(h), bool)
            new[1:] = h[order][1:] != h[order][:-1]
            count = np.diff(np.append(np.flatnonzero(new), len(h)))
            common = np.zeros(len(h), bool)
            common[order] = np.repeat(count > SPREAD, count)
            for e in _chunks(np.flatnonzero(~common)):
                nulls = pa.nulls(len(e), pa.int64())
                yield base.batch(_seed, h=h[e], d=d[e], t=t[e], pos=pos[e], rd=nulls, rt=nulls, rpos=nulls)
            e = np.flatnonzero(common)
            if not len(e):
                return
            h, d, t, pos = h[e], d[e], t[e], pos[e]
            order = np.lexsort((pos, t, d, h))
            h, d, t, pos = h[order], d[order], t[order], pos[order]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            k = np.flatnonzero(new)
            nulls = pa.nulls(len(k), pa.int64())
            yield base.batch(_seed, h=h[k], d=d[k], t=t[k], pos=pos[k], rd=nulls, rt=nulls, rpos=np.full(len(k), -1))
            first = k[np.cumsum(new) - 1]
            for x in _chunks(np.flatnonzero(~new)):
                r = first[x]
                spread = mix((h[x] ^ t[x]).view(np.uint64) + pos[x].view(np.uint64)).view(np.int64)
                yield base.batch(_seed, h=spread, d=d[x], t=t[x], pos=pos[x], rd=d[r], rt=t[r], rpos=pos[r])

        for batch in batches:
            for b in base.slices(batch, "text", 1 << 20):
                fresh, own = [], []
                row_of = []
                for i, (d, t) in enumerate(zip(b.column("d").to_pylist(), b.column("t").to_pylist())):
                    k = known.get(t)
                    if k is None:
                        k = known[t] = len(ids)
                        ids.append(d)
                        fresh.append(i)
                        own.append(k)
                    elif d < ids[k]:
                        ids[k] = d
                    row_of.append((d, t, k))
                new = b.take(pa.array(fresh, pa.int64())) if len(fresh) < b.num_rows else b
                h, doc, pos, sizes = find(new.column("text"), *(new.column(c) for c in columns))
                if len(h):
                    held.append((h, np.array(own, np.int64)[doc], pos))
                    size += len(h)
                if whole:
                    words.update(zip(own, sizes.tolist()))
                    copies.extend((d, t, words[k]) for d, t, k in row_of if words[k] >= MIN_WORDS)
                if size >= FLUSH or len(ids) >= FLUSH or len(copies) >= FLUSH:
                    yield from flush()
                    held, known, ids, copies, size = [], {}, [], [], 0
                    words.clear()
        if held or copies:
            yield from flush()

    words: dict[int, int] = {}
    return base.arrow_map(rows.select("d", "t", "text", *columns), run, _ddl(_seed))


def _chunks(x: np.ndarray, n: int = 100_000):
    for i in range(0, len(x), n):
        yield x[i : i + n]


def matches(found: DataFrame, name: str) -> DataFrame:
    """d, t, pos of every occurrence of a seed that has several, and rd, rt, rpos of its first one of all.

    Rows of one seed pass by in order, the first one held: a seed of any size needs no more memory.
    """

    def run(batches):
        names = ("h", "d", "t", "pos", "more", "done")
        carry: dict[str, np.ndarray] | None = None
        for b in batches:
            loose = pc.is_null(b.column("rd")).to_numpy(zero_copy_only=False)
            if not loose.all():
                x = b.filter(pa.array(~loose))
                yield base.batch(_match, kind=np.full(x.num_rows, TIED, np.int32), **{c: x.column(c) for c in _match.names[1:]})
                b = b.filter(pa.array(loose))
            if not b.num_rows:
                continue
            x = {c: b.column(c).to_numpy() for c in names[:4]}
            x["more"] = b.column("rpos").is_valid().to_numpy(zero_copy_only=False)
            x["done"] = np.zeros(b.num_rows, bool)
            if carry is not None:
                x = {c: np.concatenate([carry[c], x[c]]) for c in names}
            n = len(x["h"])
            k = np.flatnonzero(np.concatenate([[True], x["h"][1:] != x["h"][:-1]]))
            count = np.diff(np.append(k, n))
            first = np.repeat(k, count)
            # equal texts are one, but for the seed that is a whole text
            other = (x["t"] != x["t"][first]) | (x["pos"] != x["pos"][first]) | ((x["pos"] < 0) & (x["d"] != x["d"][first])) | x["more"]
            shared = np.logical_or.reduceat(other, k)
            other[k] = shared
            out = np.flatnonzero(other & ~x["done"])
            if len(out):
                r = first[out]
                yield base.batch(_match, kind=x["more"][out].astype(np.int32), **{c: x[c][out] for c in ("d", "t", "pos")}, rd=x["d"][r], rt=x["t"][r], rpos=x["pos"][r])
            carry = {c: v[k[-1] : k[-1] + 1].copy() for c, v in x.items()}
            carry["done"][:] |= shared[-1]

    ordered = found.repartition(base.partitions(found.sparkSession), "h").sortWithinPartitions("h", "d", "t", "pos")
    made = base.stored(base.arrow_map(ordered, run, _ddl(_match)), name)
    # rows that repeat a key are one first
    heads = made.where(f"kind = {HEAD}").select(F.col("d").alias("hd"), F.col("t").alias("ht"), F.col("pos").alias("hpos"), F.struct("rd", "rt", "rpos").alias("r")).dropDuplicates(["hd", "ht", "hpos"])
    tied = made.where(f"kind = {TIED}").join(heads, (F.col("rd") == F.col("hd")) & (F.col("rt") == F.col("ht")) & (F.col("rpos") == F.col("hpos")))
    return made.where(f"kind <> {TIED}").drop("kind").unionByName(tied.select("d", "t", "pos", "r.*"))


def suspects(shared: DataFrame) -> DataFrame:
    """d, t, spans: first and last starts (int32 pairs) of runs of MIN_WORDS words that may recur though no chain says so.

    All seeds in such a run are shared ones. Runs inside a stretch of seeds with one first document and one
    diagonal are left out: that document's alignment has them.
    """
    schema = pa.schema([("d", pa.int64()), ("t", pa.int64()), ("spans", pa.binary())])

    def run(batches):
        for table in _pairs(batches, ("t",)):
            d, t, pos, rd, rt, rpos = (table.column(c).to_numpy() for c in ("d", "t", "pos", "rd", "rt", "rpos"))
            cuts = base.bounds(table, ("t",))
            new = np.zeros(len(pos), bool)
            new[cuts[:-1]] = True
            new[1:] |= pos[1:] - pos[:-1] > W
            turn = new.copy()
            turn[1:] |= (rd[1:] != rd[:-1]) | (rt[1:] != rt[:-1]) | ((rpos - pos)[1:] != (rpos - pos)[:-1])
            k, s = np.flatnonzero(new), np.flatnonzero(turn)
            # the words around the outermost seeds that may be shared without a seed of their own
            lo = np.maximum(pos[k] - (W - 1), 0)
            hi = pos[np.append(k[1:], len(pos)) - 1] + K + W - 1 - MIN_WORDS
            begin, end = pos[s], pos[np.append(s[1:], len(pos)) - 1] + K - MIN_WORDS
            held = end >= begin
            owner = np.cumsum(new)[s[held]] - 1
            runs = np.arange(len(k))
            first, last = np.concatenate([lo, end[held] + 1]), np.concatenate([begin[held] - 1, hi])
            first = first[np.argsort(np.concatenate([runs, owner]), kind="stable")]
            order = np.argsort(np.concatenate([owner, runs]), kind="stable")
            last, at = last[order], k[np.concatenate([owner, runs])[order]]
            full = last >= first
            first, last, at = first[full], last[full], at[full]
            if not len(at):
                continue
            text = np.searchsorted(cuts, at, side="right") - 1
            head = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            spans = np.stack([first, last], 1).astype(np.int32)
            own = np.minimum.reduceat(d, cuts[:-1])[text[head]]
            yield base.batch(schema, d=own, t=t[at[head]], spans=[x.tobytes() for x in np.split(spans, head[1:])])

    ordered = shared.repartition(base.partitions(shared.sparkSession), "t").sortWithinPartitions("t", "pos")
    return base.arrow_map(ordered, run, "d long, t long, spans binary")


def runs_of(texts: pa.Array, spans: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and first word of the runs of MIN_WORDS words that begin in the spans of each text."""
    data, offsets = base.bytes_of(texts)
    starts, ends, first = words_of(data, offsets)
    none, sizes = np.zeros(0, np.int64), np.diff(first)
    if len(starts) < MIN_WORDS:
        return none, none, none, sizes
    h = Sums(data, Sums(data).of(starts, ends)).windows(MIN_WORDS)
    wanted = np.zeros(len(starts) + 1, np.int32)
    for i, blob in enumerate(spans.to_pylist()):
        pairs = np.frombuffer(blob, np.int32).reshape(-1, 2)
        stop = max(0, int(first[i + 1] - first[i]) - MIN_WORDS + 1)
        np.add.at(wanted, first[i] + np.minimum(pairs[:, 0], stop), 1)
        np.add.at(wanted, first[i] + np.minimum(pairs[:, 1] + 1, stop), -1)
    at = np.flatnonzero(np.cumsum(wanted[:-1])[: len(h)] > 0)
    doc = np.searchsorted(first, at, side="right") - 1
    return h[at].view(np.int64), doc, at - first[doc], sizes


def whole_runs(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """Passages of equal words that runs of MIN_WORDS words show; overlapping ones of a pair are one."""
    found = matches(occurrences(texts.join(suspects(shared), ["d", "t"]), runs_of, ("spans",), whole=False), "runs")
    keys = ("t", "rd", "rt")

    def run(batches):
        for table in _pairs(batches, keys):
            d, t, rd, rt, pos, rpos = (table.column(c).to_numpy() for c in ("d", "t", "rd", "rt", "pos", "rpos"))
            cuts = base.bounds(table, keys)
            new = np.zeros(len(pos), bool)
            new[cuts[:-1]] = True
            new[1:] |= pos[1:] > pos[:-1] + MIN_WORDS
            k = np.flatnonzero(new)
            last = np.append(k[1:], len(pos)) - 1
            own = np.minimum.reduceat(d, cuts[:-1])[np.searchsorted(cuts, k, side="right") - 1]
            end = pos[last] + MIN_WORDS
            yield base.batch(_passages, d=own, t=t[k], start=pos[k], end=end, rd=rd[k], rt=rt[k], rstart=np.minimum.reduceat(rpos, k), rend=np.maximum.reduceat(rpos, k) + MIN_WORDS, equal=end - pos[k], columns=end - pos[k])

    ordered = found.where("t <> rt").repartition(base.partitions(found.sparkSession), *keys).sortWithinPartitions(*keys, "pos")
    return base.arrow_map(ordered, run, _ddl(_passages))


class Fenwick:
    """Prefix maxima of (value, label) by position."""

    def __init__(self, n: int):
        self.n, self.value, self.label = n, [float("-inf")] * (n + 1), [-1] * (n + 1)

    def put(self, at: int, value: float, label: int) -> None:
        at += 1
        while at <= self.n:
            if value > self.value[at]:
                self.value[at], self.label[at] = value, label
            at += at & -at

    def best(self, below: int) -> tuple[float, int]:
        """Maximum over positions < below."""
        value, label = float("-inf"), -1
        while below > 0:
            if self.value[below] > value:
                value, label = self.value[below], self.label[below]
            below -= below & -below
        return value, label


def chain(x0: np.ndarray, x1: np.ndarray, y0: np.ndarray) -> list[list[int]]:
    """Chains of segments (x0 .. x1 in one document, from y0 in the other), each a list of segments in order."""
    n = len(x0)
    if n == 1:
        return [[0]]
    y1 = y0 + x1 - x0
    # a segment may be followed by those that start behind its last seed's start
    ys = np.unique(np.concatenate([y0, y1 - K]))
    begin, end = np.searchsorted(ys, y0).tolist(), np.searchsorted(ys, y1 - K).tolist()
    tree = Fenwick(len(ys))
    score, before = (x1 - x0).astype(float).tolist(), [-1] * n
    weight = list(score)
    events = sorted([(int(x), 0, i) for i, x in enumerate(x0)] + [(int(x) - K, 1, i) for i, x in enumerate(x1)])
    xs0, xs1, ys0, ys1 = x0.tolist(), x1.tolist(), y0.tolist(), y1.tolist()
    ended: dict[int, list[int]] = {}  # by end in the other document, in order of ends in this one

    def near(i: int) -> int:
        """The best predecessor at most FAR words behind: at most one segment ends at each pair of places."""
        value, label = float("-inf"), -1
        for y in range(ys0[i] - FAR, ys0[i] + K):
            for j in reversed(ended.get(y, ())):
                if xs0[i] - xs1[j] > FAR:
                    break
                if score[j] + GAP * (xs1[j] + ys1[j]) > value:
                    value, label = score[j] + GAP * (xs1[j] + ys1[j]), j
        return label

    for x, kind, i in events:
        if kind == 0:
            _, j = tree.best(begin[i])
            if j >= 0 and max(xs0[i] - xs1[j], ys0[i] - ys1[j]) > FAR:
                j = near(i)
            if j >= 0:
                gap_x, gap_y = xs0[i] - xs1[j], ys0[i] - ys1[j]
                joined = weight[i] + min(0, gap_x, gap_y) + score[j] - GAP * (max(0, gap_x) + max(0, gap_y))
                if joined > score[i]:
                    score[i], before[i] = joined, j
        else:
            ended.setdefault(ys1[i], []).append(i)
            tree.put(end[i], score[i] + GAP * (xs1[i] + ys1[i]), i)
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda k: (-score[k], k)):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = before[i]
        if path:
            out.append(path[::-1])
    return out


_chains = pa.schema([(c, pa.int64()) for c in ("d", "t", "rd", "rt", "lo", "hi", "rlo", "rhi")] + [("path", pa.binary())])


def chains(links: DataFrame) -> DataFrame:
    """d, t, rd, rt, the word ranges a chain spans in both, and its path: int32 triples (x0, x1, y0)."""
    keys = ("t", "rd", "rt")

    def run(batches):
        for table in _pairs(batches, keys):
            d, t, rd, rt, pos, rpos = (table.column(c).to_numpy() for c in ("d", *keys, "pos", "rpos"))
            cuts = base.bounds(table, keys)
            own = np.minimum.reduceat(d, cuts[:-1])
            pair = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            order = np.lexsort((pos, pos - rpos, pair))
            p, x, y = pair[order], pos[order], rpos[order]
            new = np.ones(len(p), bool)
            new[1:] = (p[1:] != p[:-1]) | ((x - y)[1:] != (x - y)[:-1]) | (x[1:] - x[:-1] > K + W)
            k = np.flatnonzero(new)
            last = np.append(k[1:], len(p)) - 1
            x0, x1, y0, owner = x[k], x[last] + K, y[k], p[k]
            out: dict[str, list] = {f.name: [] for f in _chains}
            group = np.append(np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])), len(owner))
            alone = np.diff(group) == 1
            one = group[:-1][alone]
            if len(one):
                r = cuts[owner[one]]
                triples = np.stack([x0[one], x1[one], y0[one]], 1).astype(np.int32)
                blobs = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(np.arange(0, 12 * len(one) + 1, 12, dtype=np.int32)), pa.py_buffer(triples.tobytes())])
                yield base.batch(_chains, d=own[owner[one]], t=t[r], rd=rd[r], rt=rt[r], lo=x0[one], hi=x1[one], rlo=y0[one], rhi=y0[one] + x1[one] - x0[one], path=blobs)
            for a, z in zip(group[:-1][~alone].tolist(), group[1:][~alone].tolist()):
                for path in chain(x0[a:z], x1[a:z], y0[a:z]):
                    s = np.array(path) + a
                    lo, hi = int(x0[s].min()), int(x1[s].max())
                    r = cuts[owner[a]]
                    rlo, rhi = int(y0[s].min()), int((y0[s] + x1[s] - x0[s]).max())
                    triples = np.stack([x0[s], x1[s], y0[s]], 1).astype(np.int32).tobytes()
                    for column, v in zip(out.values(), (own[owner[a]], t[r], rd[r], rt[r], lo, hi, rlo, rhi, triples)):
                        column.append(v)
            if out["d"]:
                yield base.batch(_chains, **out)

    ordered = links.repartition(base.partitions(links.sparkSession), *keys).sortWithinPartitions(*keys)
    return base.arrow_map(ordered, run, _ddl(_chains))


def _pairs(batches, keys: tuple[str, ...]):
    """Tables of whole groups, some 100,000 rows at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) < 100_000:
            continue
        table = pa.Table.from_batches(held)
        cut = int(base.bounds(table, keys)[-2])
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


_window = pa.schema([(c, pa.int64()) for c in ("d", "t", "lo", "hi", "origin")] + [("words", pa.binary())])


def windows(texts: DataFrame, found: DataFrame, few: bool = False) -> DataFrame:
    """d, t, lo, hi of every range of words that a chain spans, with 32-bit codes of the words from origin = lo - REACH to hi + REACH.

    With few, the ranges are stored first: the planner then sees their size, and need not shuffle the texts.
    """
    own = found.select("d", "t", F.struct("lo", "hi").alias("range"))
    other = found.select(F.col("rd").alias("d"), F.col("rt").alias("t"), F.struct(F.col("rlo").alias("lo"), F.col("rhi").alias("hi")).alias("range"))
    # at most one for each two words of a text, however many chains it is in
    needs = own.unionByName(other).groupBy("d", "t").agg(F.collect_set("range").alias("ranges"))
    if few:
        needs = base.stored(needs, "ranges")

    def run(batches):
        last = None
        for whole in batches:
            for b in base.slices(whole, "text", 1 << 20):
                data, offsets = base.bytes_of(b.column("text"))
                starts, ends, first = words_of(data, offsets)
                codes = (Sums(data).of(starts, ends) >> np.uint64(32)).astype(np.uint32)
                out: dict[str, list] = {f.name: [] for f in _window}
                for r, (d, t, ranges) in enumerate(zip(*(b.column(c).to_pylist() for c in ("d", "t", "ranges")))):
                    if (d, t) == last:
                        continue  # rows that repeat a key follow each other
                    last, own = (d, t), codes[first[r] : first[r + 1]]
                    for x in ranges:
                        a = max(0, x["lo"] - REACH)
                        for column, v in zip(out.values(), (d, t, x["lo"], x["hi"], a, own[a : x["hi"] + REACH].tobytes())):
                            column.append(v)
                if out["d"]:
                    yield base.batch(_window, **out)

    return base.arrow_map(texts.join(needs, ["d", "t"]).select("d", "t", "text", "ranges"), run, _ddl(_window))


def gap_columns(a: np.ndarray, b: np.ndarray, shifts: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Alignment of two short runs of words: columns of places (-1 for none) in both, and which are equal.

    Runs of one length are laid side by side, unless shifts are looked for in them too.
    """
    n, m = len(a), len(b)
    if (n == m and not shifts) or not n or not m:
        k = max(n, m)
        x = np.where(np.arange(k) < n, np.arange(k), -1)
        y = np.where(np.arange(k) < m, np.arange(k), -1)
        same = a == b if n == m else np.zeros(k, bool)
        return x, y, same
    best = np.zeros((n + 1, m + 1), np.int32)
    equal = a[:, None] == b[None, :]
    for i in range(n - 1, -1, -1):
        # a row at once: what starts here or in the row below, carried leftwards as a running maximum
        row = np.maximum(best[i + 1, :m], np.where(equal[i], best[i + 1, 1:] + 1, 0))
        best[i, :m] = np.maximum.accumulate(row[::-1])[::-1]
    x, y, same, i, j = [], [], [], 0, 0
    while i < n or j < m:
        if i < n and j < m and equal[i, j]:
            column = (i, j, True)
        elif i < n and j < m and best[i + 1, j + 1] == best[i, j]:
            column = (i, j, False)
        elif i < n and (j == m or best[i + 1, j] >= best[i, j + 1]):
            column = (i, -1, False)
        else:
            column = (-1, j, False)
        x.append(column[0])
        y.append(column[1])
        same.append(column[2])
        i, j = i + (column[0] >= 0), j + (column[1] >= 0)
    return np.array(x), np.array(y), np.array(same, bool)


def end_columns(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns outwards from the end of a chain: the diagonal as far as it pays, then TAIL words that may shift."""
    n = min(len(a), len(b), REACH)
    same = a[:n] == b[:n]
    total = np.cumsum(np.where(same, 1, -3))
    best = int(np.argmax(total)) + 1 if n and total.max() > 0 else 0
    x, y, tail = gap_columns(a[best : best + TAIL], b[best : best + TAIL], shifts=True)
    k = np.arange(best)
    return np.concatenate([k, np.where(x >= 0, x + best, -1)]), np.concatenate([k, np.where(y >= 0, y + best, -1)]), np.concatenate([same[:best], tail])


def longest(same: np.ndarray, word: np.ndarray) -> tuple[int, int] | None:
    """The columns of a passage, if there is one: MIN_WORDS words, and equal ones reach IDENTITY.

    Equal columns score 1, others as much as makes IDENTITY break even, so a range may stay if its sum is not negative.
    The longest one that begins and ends with K equal columns, and further while that pays; else the best that begins and
    ends with an equal column.
    """
    n = len(same)
    if word.sum() < MIN_WORDS:
        return None
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -UNEQUAL))])
    words = np.concatenate([[0], np.cumsum(word)])
    runs = np.concatenate([[0], np.cumsum(same)])
    if n >= K:
        solid = np.flatnonzero(runs[K:] - runs[:-K] == K)
        if len(solid):
            low = np.minimum.accumulate(total[solid])
            ends = solid + K
            first = solid[np.minimum(np.searchsorted(-low, -total[ends]), len(solid) - 1)]
            fits = (total[ends] >= total[first]) & (words[ends] - words[first] >= MIN_WORDS)
            if fits.any():
                k = int(np.argmax(np.where(fits, ends - first, -1)))
                begin, end = int(first[k]), int(ends[k])
                return int(np.argmin(total[: begin + 1])), end + int(np.argmax(total[end:]))
    starts, ends = np.flatnonzero(same), np.flatnonzero(same) + 1
    last = np.searchsorted(words[starts], words[ends] - MIN_WORDS, side="right") - 1  # the last start with words enough
    ends, last = ends[last >= 0], last[last >= 0]
    if not len(ends):
        return None
    low = np.minimum.accumulate(total[starts])
    k = int(np.argmax(total[ends] - low[last]))
    if total[ends[k]] < low[last[k]]:
        return None
    return int(starts[np.argmax(total[starts] == low[last[k]])]), int(ends[k])


def align(a: np.ndarray, a0: int, b: np.ndarray, b0: int, path: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """Passages (start, end, other start, other end, equal words, columns) of a chain, in words of the documents.

    a, b: words of both from a0 and b0 on; path: the chain's segments.
    """
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    (i, _, j) = (int(v) for v in path[0])
    gx, gy, same = end_columns(a[: i - a0][::-1], b[: j - b0][::-1])
    parts.append((np.where(gx >= 0, i - 1 - gx, -1)[::-1], np.where(gy >= 0, j - 1 - gy, -1)[::-1], same[::-1]))
    for x0, x1, y0 in path.tolist():
        y1 = y0 + x1 - x0
        skip = max(0, i - x0, j - y0)
        x0, y0 = x0 + skip, y0 + skip
        if x0 >= x1:
            continue
        gx, gy, same = gap_columns(a[i - a0 : x0 - a0], b[j - b0 : y0 - b0])
        parts.append((np.where(gx >= 0, gx + i, -1), np.where(gy >= 0, gy + j, -1), same))
        k = np.arange(x1 - x0)
        parts.append((k + x0, k + y0, a[x0 - a0 : x1 - a0] == b[y0 - b0 : y1 - b0]))
        i, j = x1, y1
    gx, gy, same = end_columns(a[i - a0 :], b[j - b0 :])
    parts.append((np.where(gx >= 0, gx + i, -1), np.where(gy >= 0, gy + j, -1), same))
    xs, ys, same = (np.concatenate(v) for v in zip(*parts))
    out, todo = [], [(0, len(same))]
    while todo:
        s, e = todo.pop()
        found = longest(same[s:e], xs[s:e] >= 0)
        if not found:
            continue
        begin, end = s + found[0], s + found[1]
        cx, cy, cs = xs[begin:end], ys[begin:end], same[begin:end]
        cx, cy = cx[cx >= 0], cy[cy >= 0]
        out.append((int(cx[0]), int(cx[-1]) + 1, int(cy[0]), int(cy[-1]) + 1, int(cs.sum()), len(cs)))
        todo += [(s, begin), (end, e)]
    return sorted(out)


def hopeful(batch: pa.RecordBatch) -> np.ndarray:
    """Which chains may give a passage: of those of one segment, where its ends go far enough for MIN_WORDS words.

    The same measure as in end_columns(), for all chains at once.
    """
    lo, hi, rlo, rhi, a0, b0 = (batch.column(c).to_numpy() for c in ("lo", "hi", "rlo", "rhi", "a0", "b0"))
    single = pc.equal(pc.binary_length(batch.column("path")), 12).to_numpy(zero_copy_only=False) & (hi - lo < MIN_WORDS)
    out = ~single
    rows = np.flatnonzero(single)
    if not len(rows):
        return out
    sides = []
    for name, origin in (("a", a0), ("b", b0)):
        column = batch.column(name)
        offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
        sides.append((np.frombuffer(column.buffers()[2], np.uint8), offsets[:-1][rows], (np.diff(offsets) // 4)[rows], origin[rows]))
    far = np.zeros(len(rows), np.int64)
    j = np.arange(REACH)
    for starts, way in (((lo[rows] - 1, rlo[rows] - 1), -1), ((hi[rows], rhi[rows]), 1)):
        words, inside = [], np.ones((len(rows), REACH), bool)
        for (data, begin, n, origin), start in zip(sides, starts):
            at = (start - origin)[:, None] + way * j
            inside &= (at >= 0) & (at < n[:, None])
            at = begin[:, None] + 4 * np.clip(at, 0, np.maximum(n - 1, 0)[:, None])
            words.append(np.stack([data[at + i] for i in range(4)]) if data.size else np.zeros((4, *at.shape), np.uint8))
        total = np.cumsum(np.where(inside, np.where((words[0] == words[1]).all(0), 1, -3), 0), 1)
        far += np.where(total.max(1) > 0, total.argmax(1) + 1, 0)
    out[rows] = far + (hi - lo)[rows] + 2 * TAIL >= MIN_WORDS
    return out


_passages = pa.schema([(c, pa.int64()) for c in ("d", "t", "start", "end", "rd", "rt", "rstart", "rend", "equal", "columns")])


def aligned(texts: DataFrame, links: DataFrame, few: bool = False) -> DataFrame:
    """Passages of the pairs of texts that links tie: chains of links, aligned on the words around them."""
    found = base.stored(chains(links.where("t <> rt")), "chains")
    spans = windows(texts, found, few)
    own = spans.withColumnsRenamed({"origin": "a0", "words": "a"})
    other = spans.toDF("rd", "rt", "rlo", "rhi", "b0", "b")
    # a place that many chains lead to is met first, the places of their own texts spread them again
    both = found.join(other, ["rd", "rt", "rlo", "rhi"]).join(own, ["d", "t", "lo", "hi"])

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _passages}
            for r in batch.filter(pa.array(hopeful(batch))).to_pylist():
                for x0, x1, y0, y1, equal, columns in align(np.frombuffer(r["a"], np.uint32), r["a0"], np.frombuffer(r["b"], np.uint32), r["b0"], np.frombuffer(r["path"], np.int32).reshape(-1, 3)):
                    for column, v in zip(out.values(), (r["d"], r["t"], x0, x1, r["rd"], r["rt"], y0, y1, equal, columns)):
                        column.append(v)
            if out["d"]:
                yield base.batch(_passages, **out)

    return base.arrow_map(both, run, _ddl(_passages))


_near = pa.schema([("h", pa.int64()), ("i", pa.int32()), ("j", pa.int32())] + [(c, pa.int64()) for c in ("d", "t", "pos")] + [("open", pa.bool_()), ("side", pa.int32()), ("ctx", pa.binary())])


def earlier_like(ctx: np.ndarray, d: np.ndarray, t: np.ndarray, wanted: np.ndarray, side: np.ndarray):
    """For each wanted row, the rows of earlier texts (of another side, if sides differ) with ALIKE pairs of words of its ctx.

    Rows are ordered by d and t. ctx holds codes of pairs of neighbouring words, each once a row, 0 for none. In a large group a row is
    looked for by all its codes but those ALIKE - 1 that most rows have: rows with ALIKE common ones share one of the others.
    """
    n = len(ctx)
    begin = np.searchsorted(np.arange(n), np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])])))
    before = begin[np.searchsorted(begin, np.arange(n), side="right") - 1]  # the first row of the same text
    crossed = side.min() != side.max()
    if n <= DIRECT:
        row, column = np.nonzero(ctx)
        _, code, count = np.unique(ctx[row, column], return_inverse=True, return_counts=True)
        often = count > 1
        kept = often[code]
        has = np.zeros((n, int(often.sum())), np.float32)
        has[row[kept], (np.cumsum(often) - 1)[code[kept]]] = 1
        like = (has @ has.T >= ALIKE) & (np.arange(n) < before[:, None]) & wanted[:, None]
        if crossed:
            like &= side[:, None] != side
        for b in np.flatnonzero(like.any(1)):
            yield b, np.flatnonzero(like[b])
        return
    mark = np.zeros(1 << 16, bool)
    count = np.bincount(ctx.ravel(), minlength=1 << 16)
    count[0] = -1
    rank = np.empty(1 << 16, np.int64)
    rank[np.lexsort((np.arange(1 << 16), count))] = np.arange(1 << 16)
    by = np.take_along_axis(ctx, np.argsort(-rank[ctx], axis=1), 1)[:, ALIKE - 1 :]
    row, _ = np.nonzero(by)
    code = by[by != 0]
    order = np.argsort(code, kind="stable")
    row, at = row[order], np.searchsorted(code[order], np.arange((1 << 16) + 1))
    for b in np.flatnonzero(wanted & (before > 0)):
        lists = [row[at[c] : at[c + 1]] for c in by[b][by[b] != 0].tolist()]
        if not lists:
            continue
        a = np.unique(np.concatenate(lists))
        a = a[a < before[b]]
        if crossed:
            a = a[side[a] != side[b]]
        own = ctx[b][ctx[b] != 0]
        mark[own] = True
        for x in _chunks(a, 50_000):
            x = x[mark[ctx[x]].sum(1) >= ALIKE]
            if len(x):
                yield b, x
        mark[own] = False


def pair_codes(codes: np.ndarray) -> np.ndarray:
    """16-bit codes, not 0, of words with their next."""
    return np.maximum(mix(codes[:-1].astype(np.uint64) << np.uint64(32) | codes[1:]) >> np.uint64(48), 1).astype(np.uint16)


def once(ctx: np.ndarray) -> np.ndarray:
    """Each code once a row, the others 0."""
    ctx = np.sort(ctx, axis=1)
    ctx[:, 1:][ctx[:, 1:] == ctx[:, :-1]] = 0
    return ctx


def others(texts: DataFrame, shared: DataFrame, found: DataFrame) -> DataFrame:
    """Links (as shared) of seeds that no passage found so far covers to every earlier holder with like words around it.

    A seed's first holder need not be the text that shares a passage: the seed's place goes to all holders before it. Two texts
    with a passage of 50 columns, 40 of them equal, in at most 11 runs, have 29 pairs of neighbouring words in common;
    places with fewer than ALIKE in REACH words around the seed are no link. A seed of very many texts is compared in blocks of BLOCK.
    """
    place = ["rd", "rt", "rpos"]
    # small tables are stored, so that the planner sees their size
    spans = found.select("t", "start", "end").distinct().groupBy("t").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = base.stored(spans, "covered")
    held = F.exists("spans", lambda z: (z["start"] <= F.col("pos")) & (z["end"] >= F.col("pos") + K))
    occ = shared.join(spans, "t", "left").select("d", "t", "pos", *place, (~F.coalesce(held, F.lit(False)) & (F.col("t") != F.col("rt"))).alias("open"))
    occ = base.stored(occ, "places")
    hot = base.stored(occ.groupBy(*place).agg(F.count("*").alias("n"), F.max("open").alias("any")).where("any and n > 2").select(*place, "n"), "seeds-again")
    at = F.struct("pos", F.xxhash64(*place).alias("h"), "open", "n")
    # equal texts are one, that of the smallest doc_id; as many texts are needed as not, so none is broadcast
    needs = occ.join(hot, place).groupBy("t").agg(F.min("d").alias("d"), F.collect_set(at).alias("at")).hint("merge")

    def around(batches):
        last = None
        for whole in batches:
            for b in base.slices(whole, "text", 1 << 20):
                data, offsets = base.bytes_of(b.column("text"))
                starts, ends, first = words_of(data, offsets)
                pairs = pair_codes((Sums(data).of(starts, ends) >> np.uint64(32)).astype(np.uint32))
                out: dict[str, list] = {f.name: [] for f in _near}
                for r, (d, t, at) in enumerate(zip(*(b.column(c).to_pylist() for c in ("d", "t", "at")))):
                    if (d, t) == last:
                        continue  # rows that repeat a key follow each other
                    last, own = (d, t), pairs[first[r] : max(first[r], first[r + 1] - 1)]
                    for x in at:
                        ctx = own[max(0, x["pos"] - REACH) : x["pos"] + K + REACH - 1].tobytes()
                        blocks = -(-x["n"] // BLOCK)
                        mine = (t >> 8) % blocks
                        for other in range(blocks):
                            for column, v in zip(out.values(), (x["h"], min(mine, other), max(mine, other), d, t, x["pos"], x["open"], int(mine > other), ctx)):
                                column.append(v)
                        if len(out["d"]) > 20_000:
                            yield base.batch(_near, **out)
                            out = {f.name: [] for f in _near}
                if out["d"]:
                    yield base.batch(_near, **out)

    places = base.arrow_map(texts.join(needs, ["d", "t"]).select("d", "t", "text", "at"), around, _ddl(_near))
    keys = ("h", "i", "j")

    def run(batches):
        for table in base.groups(batches, keys, "ctx"):
            table = table.combine_chunks()
            cuts = base.bounds(table, keys)
            d, t, pos, side, wanted, i, j = (table.column(c).to_numpy() for c in ("d", "t", "pos", "side", "open", "i", "j"))
            out: list[tuple] = []
            size = 0
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if z - a < 2 or not wanted[a:z].any():
                    continue
                blobs = table.column("ctx").slice(a, z - a)
                ctx = np.zeros((z - a, 2 * REACH + K - 1), np.uint16)
                ctx[np.arange(ctx.shape[1]) < pc.binary_length(blobs).to_numpy()[:, None] // 2] = np.frombuffer(b"".join(blobs.to_pylist()), np.uint16)
                sides = side[a:z] if i[a] != j[a] else np.zeros(z - a, np.int32)
                if i[a] != j[a] and sides.min() == sides.max():
                    continue
                for b, x in earlier_like(once(ctx), d[a:z], t[a:z], wanted[a:z], sides):
                    out.append((np.full(len(x), a + b), a + x))
                    size += len(x)
                    if size > 100_000:
                        yield links(d, t, pos, out)
                        out, size = [], 0
            if out:
                yield links(d, t, pos, out)

    def links(d, t, pos, out):
        b, a = (np.concatenate(x) for x in zip(*out))
        return base.batch(_link, d=d[b], t=t[b], pos=pos[b], rd=d[a], rt=t[a], rpos=pos[a])

    ordered = places.repartition(base.partitions(texts.sparkSession), *keys).sortWithinPartitions(*keys, "d", "t", "pos")
    return base.arrow_map(ordered, run, _ddl(_link))


def passages(docs: DataFrame) -> DataFrame:
    """d, t, start, end (words) of every passage, with the earlier document's rd, rt, rstart, rend, and how equal it is."""
    texts = base.keyed(docs).select("d", "t", "text")
    met = base.stored(matches(occurrences(texts), "matches"), "shared-seeds")
    shared = met.where("pos >= 0")
    copies = met.where("pos < 0 and d <> rd").select("d", "t", F.lit(0).cast("long").alias("start"), (-F.col("pos")).alias("end"), "rd", "rt", F.lit(0).cast("long").alias("rstart"), (-F.col("pos")).alias("rend"), (-F.col("pos")).alias("equal"), (-F.col("pos")).alias("columns"))
    # plans of a part of the size: the driver holds one at a time
    plain = base.stored(whole_runs(texts, shared), "equal-passages")
    first = base.stored(aligned(texts, shared), "first-passages").unionByName(plain)
    again = base.stored(others(texts, shared, first), "other-links")
    # with the links these pairs had before
    pairs = again.select("t", "rd", "rt").distinct()
    more = again.unionByName(shared.join(pairs, ["t", "rd", "rt"], "left_semi").select(*again.columns)).distinct()
    # rows that repeat a key are found more than once
    return first.unionByName(aligned(texts, more, few=True)).unionByName(copies).distinct()


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = passages(base.documents(spark, sf_dir))
    real = lambda c: F.when(F.col(c) != base.NO_ID, F.col(c))
    return found.select(
        real("d").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), real("rd").alias("ref_doc_id"), F.col("rstart").alias("ref_start_word"), F.col("rend").alias("ref_end_word"),
        F.round(F.col("equal") / F.col("columns"), 6).alias("identity"),
    )


def without_passages(docs: DataFrame) -> DataFrame:
    """docs with the words of passages cut out of all documents but the first that has them; columns as they are.

    What is cut is the passage's bytes from its first word up to the next word that stays; n_chars, if there,
    follows the text. A document of which nothing is left stays, with an empty text.
    """
    names = docs.columns
    cuts = passages(docs.select("doc_id", "text")).groupBy("d", "t").agg(F.collect_set(F.struct("start", "end")).alias("cuts"))
    cuts = base.stored(cuts, "passages")
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(base.NO_ID)).alias("d"), F.xxhash64(base.text_of(docs)).alias("t"))
    joined = inner.join(cuts, ["d", "t"], "left").select("row", F.col("row.text").cast("string").alias("text"), "cuts")
    schema = joined.schema["row"].dataType

    def run(batches):
        for whole in batches:
            for b in base.slices(whole, "text"):
                texts = [cut(x, c) if c else x for x, c in zip(b.column("text").to_pylist(), b.column("cuts").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string()), pa.array([bool(c) for c in b.column("cuts").to_pylist()])], names=["row", "new_text", "was_cut"])

    done = base.arrow_map(joined, run, f"row {schema.simpleString()}, new_text string, was_cut boolean")
    picked = []
    for c in names:
        kept = F.col("row")[c]
        if c == "text":
            kept = F.col("new_text")
        elif c == "n_chars":
            kept = F.when(F.col("was_cut"), F.length("new_text").cast(docs.schema[c].dataType)).otherwise(kept)
        picked.append(kept.alias(c))
    return done.select(*picked)


def cut(text: str, cuts: list[dict]) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    starts, _, _ = words_of(data, np.array([0, len(data)]))
    edges = np.append(starts, len(raw))
    x, y = base.merge(np.array([c["start"] for c in cuts], np.int64), np.array([c["end"] for c in cuts], np.int64))
    x, y = np.minimum(x, len(starts)), np.minimum(y, len(starts))
    return b"".join(raw[i:j] for i, j in zip([0, *edges[y].tolist()], [*edges[x].tolist(), len(raw)])).decode("utf-8", "surrogatepass")
