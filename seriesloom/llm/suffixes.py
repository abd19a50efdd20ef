"""Exact removal of repeated byte strings: depth-limited radix sort of suffixes.

Suffixes are ordered by their first DEPTH bytes only, most significant digit first; suffixes
still together after the last digit are exactly the repeated windows, and every byte in one goes.
A digit is a run of bytes named by its 64-bit hash, so that order among digits is that of the
names: which suffixes are equal does not depend on it.

The first digits are dealt out by Spark. Windows are put into buckets by an anchor inside them, a run
of ANCHOR bytes picked by winnowing: which run a window holds depends on its bytes alone, so equal
windows share a bucket, and one record per anchor stands for all the windows around it. A record
carries the hash of all bytes these windows reach. Buckets of one record drop out; records with equal
reach are repeated with all their windows; only records of a bucket with different reach are sorted
further: by the next digit, the bytes next to the anchor on either side, and then, with the
bytes themselves, by digits of DIGIT bytes to the end.

Copies met by one task are merged before the shuffle, so a bucket gets at most one record per task and
reach, however often a passage occurs. Rows may repeat a doc_id: results go by (doc_id, text hash).

Defined results: null text is empty; texts shorter than DEPTH bytes keep all; repeated rows remove
each other; null doc_ids are kept apart by their text; an empty table gives an empty result. Only
doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .rolling import MAX, Sums, mix, winnow

DEPTH = 200
ANCHOR = 100
DIGIT = 40
FLUSH = 1_000_000
SLICE = 1 << 18
SIDES = 8192
_records = pa.schema([(c, pa.int64()) for c in ("h", "c", "d", "t", "lo", "hi", "at", "many")])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'long'}" for f in schema)


def records(texts: pa.Array, depth: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of each anchor: its hash, the hash of its reach, its text's number, and reach and anchor as byte places in it."""
    data, offsets = base.bytes_of(texts)
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if not len(data):
        return none
    sums = Sums(data)
    hashes = sums.windows(anchor)
    if not len(hashes):
        return none
    sizes = np.diff(offsets)
    # an anchor lies inside one text
    gap = np.zeros(len(data) + 1, np.int32)
    ends, longs = offsets[1:], sizes >= depth
    np.add.at(gap, np.where(longs, np.maximum(ends - anchor + 1, offsets[:-1]), offsets[:-1]), 1)
    np.add.at(gap, ends, -1)
    hashes[np.cumsum(gap[:-1])[: len(hashes)] > 0] = MAX
    at = winnow(hashes, depth - anchor + 1)
    doc = np.searchsorted(offsets, at, side="right") - 1
    lo = np.maximum(offsets[doc], at - (depth - anchor))
    hi = np.minimum(offsets[doc + 1], at + depth)
    reach = mix(sums.of(lo, hi) ^ (at - lo).astype(np.uint64))
    begin = offsets[doc]
    return hashes[at].view(np.int64), reach.view(np.int64), doc, lo - begin, hi - begin, at - begin


def found(docs: DataFrame, depth: int, anchor: int) -> DataFrame:
    """Records of all texts, merged by (h, c) within a task; many > 0: repeated, and its reach goes.

    Rows with h null are the merged copies' own: their reach goes as well.
    """

    def run(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            h, c, d, t, lo, hi, at = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((c, h))
            h, c, d, t, lo, hi, at = (x[order] for x in (h, c, d, t, lo, hi, at))
            first = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
            run_of = np.cumsum(first) - 1
            many = np.bincount(run_of)[run_of] > 1
            k = np.flatnonzero(first)
            yield base.batch(_records, h=h[k], c=c[k], d=d[k], t=t[k], lo=lo[k], hi=hi[k], at=at[k], many=many[k].astype(np.int64))
            gone = np.flatnonzero(many & ~first)
            for i in range(0, len(gone), FLUSH):
                g = gone[i : i + FLUSH]
                yield base.batch(_records, h=pa.nulls(len(g), pa.int64()), c=np.zeros(len(g), np.int64), d=d[g], t=t[g], lo=lo[g], hi=hi[g], at=at[g], many=np.ones(len(g), np.int64))

        for whole in batches:
            for b in base.slices(whole, "text", SLICE):
                h, c, doc, lo, hi, at = records(b.column("text"), depth, anchor)
                if len(h):
                    held.append((h, c, b.column("d").to_numpy()[doc], b.column("t").to_numpy()[doc], lo, hi, at))
                    size += len(h)
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return base.arrow_map(docs.select("d", "t", "text"), run, _ddl(_records))


_after = pa.schema([(c, pa.int64()) for c in ("d", "t", "lo", "hi", "at", "h")])


def sorted_buckets(recs: DataFrame) -> DataFrame:
    """d, t, lo, hi, and at, h: reaches to remove (h null), and records to sort further (h set).

    Records come in order of (h, c); a bucket of any size passes by without being gathered.
    """

    def settle(x: dict[str, np.ndarray], mixed: np.ndarray, again: np.ndarray):
        gone = np.flatnonzero(again)
        first = np.concatenate([[True], (x["h"][1:] != x["h"][:-1]) | (x["c"][1:] != x["c"][:-1])]) if len(x["h"]) else np.zeros(0, bool)
        todo = np.flatnonzero(mixed & first)
        for rows, h in ((gone, pa.nulls(len(gone), pa.int64())), (todo, x["h"][todo])):
            if len(rows):
                yield base.batch(_after, d=x["d"][rows], t=x["t"][rows], lo=x["lo"][rows], hi=x["hi"][rows], at=x["at"][rows], h=h)

    def run(batches):
        names = ("h", "c", "d", "t", "lo", "hi", "at", "many")
        carry: dict[str, np.ndarray] | None = None
        carry_mixed = False

        def done(x: dict[str, np.ndarray], last: bool):
            """Settle all rows but the last run of equal (h, c), which may go on."""
            nonlocal carry, carry_mixed
            h, c = x["h"], x["c"]
            n = len(h)
            same_h = h[1:] == h[:-1]
            same = same_h & (c[1:] == c[:-1])
            again = np.zeros(n, bool)
            again[1:] |= same
            again[:-1] |= same
            again |= x["many"] > 0
            first_h = np.concatenate([[True], ~same_h])
            group = np.cumsum(first_h) - 1
            change = np.concatenate([[False], same_h & ~same])
            mixed = np.bincount(group, change)[group] > 0
            if carry_mixed:
                mixed |= group == 0
            if last:
                yield from settle(x, mixed, again)
                return
            run_start = n - 1
            breaks = np.flatnonzero(~same)
            run_start = int(breaks[-1]) + 1 if len(breaks) else 0
            # the last run is held back; whether its bucket is mixed already is kept beside it
            open_mixed = bool(mixed[-1])
            if run_start:
                # rows of the open bucket before the last run differ from it, so that they are mixed
                yield from settle({k: v[:run_start] for k, v in x.items()}, mixed[:run_start], again[:run_start])
            carry = {k: v[run_start:] for k, v in x.items()}
            if len(carry["h"]) > 3:  # of equal records two will do to show that they are, the others are settled
                out = {k: v[2:] for k, v in carry.items()}
                yield base.batch(_after, d=out["d"], t=out["t"], lo=out["lo"], hi=out["hi"], at=out["at"], h=pa.nulls(len(out["h"]), pa.int64()))
                carry = {k: v[:2] for k, v in carry.items()}
            carry_mixed = open_mixed

        for b in batches:
            x = {k: b.column(k).to_numpy() for k in names}
            if not len(x["h"]):
                continue
            if carry is not None:
                x = {k: np.concatenate([carry[k], x[k]]) for k in names}
            yield from done(x, False)
        if carry is not None:
            yield from done(carry, True)

    ordered = recs.repartition(base.partitions(recs.sparkSession), "h").sortWithinPartitions("h", "c")
    return base.arrow_map(ordered, run, _ddl(_after))


_sides = pa.schema([("key", pa.int64()), ("d", pa.int64()), ("t", pa.int64()), ("lo", pa.int64()), ("at", pa.int64()), ("left", pa.int64()), ("body", pa.binary())])


def cut(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """The bytes of each range as a binary array."""
    ends = np.cumsum(hi - lo)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    place = np.arange(offsets[-1]) + np.repeat(lo - offsets[:-1], hi - lo)
    return pa.BinaryArray.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[place]))])


def sides(rows: DataFrame, depth: int, anchor: int) -> DataFrame:
    """For each record two rows with bytes: windows that reach far to the left of the anchor, and the rest.

    key: the next digit, the anchor with the bytes next to it on that side.
    """
    spare = depth - anchor
    half = (spare + 1) // 2

    def reaches(at: np.ndarray, left: int) -> tuple[np.ndarray, ...]:
        """Begin and end of the bytes, and of the key, on one side."""
        if left:
            return at - spare, at + depth - half, at - half, at + anchor
        return at - half + 1, at + depth, at, at + anchor + spare - half + 1

    def run(batches):
        for whole in batches:
            for b in base.slices(whole, "text"):
                marks = b.column("marks")
                doc = np.repeat(np.arange(b.num_rows), pc.list_value_length(marks).to_numpy())
                data, offsets = base.bytes_of(b.column("text"))
                begin, end = offsets[:-1][doc], offsets[1:][doc]
                at = marks.flatten().field("at").to_numpy() + begin
                sums = Sums(data)
                d, t = b.column("d").to_numpy(zero_copy_only=False)[doc], b.column("t").to_numpy(zero_copy_only=False)[doc]
                for left in (1, 0):
                    lo, hi, k0, k1 = reaches(at, left)
                    lo, hi = np.maximum(begin, lo), np.minimum(end, hi)
                    whole_side = np.flatnonzero((k0 >= begin) & (k1 <= end) & (hi - lo >= depth))
                    for i in range(0, len(whole_side), SIDES):
                        r = whole_side[i : i + SIDES]
                        key = mix(sums.of(k0[r], k1[r]) ^ np.uint64(left)).view(np.int64)
                        yield base.batch(_sides, key=key, d=d[r], t=t[r], lo=(lo - begin)[r], at=(at - begin)[r], left=np.full(len(r), left, np.int64), body=cut(data, lo[r], hi[r]))

    return base.arrow_map(rows, run, _ddl(_sides))


def radix(key: np.ndarray, at: np.ndarray, bodies: list[bytes], left: np.ndarray, lo: np.ndarray, depth: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and start of the windows that are equal to another of their bucket: passes over digits, most significant first."""
    spare = depth - anchor
    half = (spare + 1) // 2
    sizes = np.array([len(x) for x in bodies], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    sums = Sums(np.frombuffer(b"".join(bodies), np.uint8))
    inner = at - lo
    first = np.maximum(0, np.where(left > 0, inner - spare, inner - half + 1))
    last = np.minimum(sizes - depth, np.where(left > 0, inner - half, inner))
    n = np.maximum(0, last - first + 1)
    row = np.repeat(np.arange(len(n)), n)
    ends = np.cumsum(n)
    start = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n) + first[row]
    # a window is known by how far it reaches to the left of the anchor: equal windows agree in that
    _, group = np.unique(key, return_inverse=True)
    group = group[row].astype(np.int64) * (depth + 1) + (inner[row] - start)
    place = begin[row] + start
    for digit in range(0, depth, DIGIT):
        if not len(group):
            break
        name = sums.of(place + digit, place + min(depth, digit + DIGIT))
        # in order of a hash of both, equal ones are neighbours; which are equal is told by group and name
        order = np.argsort(mix(name ^ mix(group.astype(np.uint64))))
        g, v = group[order], name[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])])
        named = np.cumsum(new) - 1
        stay = np.bincount(named)[named] > 1
        order = order[stay]
        group, row, start, place = named[stay], row[order], start[order], place[order]
    return row, start


_spans = pa.schema([(c, pa.int64()) for c in ("d", "t", "lo", "hi")])


def compared(rows: DataFrame, depth: int, anchor: int) -> DataFrame:
    """d, t, lo, hi: windows repeated in another record of their bucket."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table):
            x = {c: table.column(c).to_numpy() for c in ("key", "d", "t", "lo", "at", "left")}
            row, start = radix(x["key"], x["at"], table.column("body").to_pylist(), x["left"], x["lo"], depth, anchor)
            if not len(row):
                return
            order = np.lexsort((start, row))
            row, start = row[order], start[order]
            first = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > start[:-1] + depth)])
            last = np.concatenate([first[1:], [True]])
            r = row[first]
            yield base.batch(_spans, d=x["d"][r], t=x["t"][r], lo=start[first] + x["lo"][r], hi=start[last] + depth + x["lo"][r])

        for b in batches:
            for part in base.slices(b, "body", 2 << 20):
                held.append(part)
                if sum(h.num_rows for h in held) < 8192:
                    continue
                table = pa.Table.from_batches(held)
                key = table.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1], side="left"))
                if cut:
                    yield from flush(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held))

    ordered = rows.repartition(base.partitions(rows.sparkSession), "key").sortWithinPartitions("key")
    return base.arrow_map(ordered, run, _ddl(_spans))


def repeated(keyed: DataFrame, depth: int = DEPTH, anchor: int = ANCHOR) -> DataFrame:
    """d, t, spans: sorted intervals of bytes (not yet merged) that a repeated window covers."""
    recs = found(keyed, depth, anchor)
    after = base.stored(sorted_buckets(recs.where("h is not null")).unionByName(recs.where("h is null").select("d", "t", "lo", "hi", "at", "h")), "suffix-buckets")
    marks = after.where("h is not null").groupBy("d", "t").agg(F.collect_list(F.struct("at")).alias("marks"))
    further = keyed.join(marks, ["d", "t"]).select("d", "t", "text", "marks")
    spans = after.where("h is null").select("d", "t", "lo", "hi").where(F.col("hi") - F.col("lo") >= depth).unionByName(compared(sides(further, depth, anchor), depth, anchor))
    return spans.groupBy("d", "t").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def remove(docs: DataFrame, depth: int = DEPTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_bytes, spans (start, end of maximal removed runs) and kept (the remaining bytes) of every row."""
    keyed = base.keyed(docs)
    rows = keyed.join(repeated(keyed, depth, anchor), ["d", "t"], "left").select("doc_id", "text", "spans")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", kind), ("kept", pa.binary())])

    def run(batches):
        for whole in batches:
            for b in base.slices(whole, "text"):
                n_bytes, spans, kept = [], [], []
                for text, own in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                    raw = text.encode("utf-8", "surrogatepass")
                    x, y = base.merge(np.array([s["lo"] for s in own or ()], np.int64), np.array([s["hi"] for s in own or ()], np.int64))
                    n_bytes.append(len(raw))
                    spans.append([{"start": int(i), "end": int(j)} for i, j in zip(x, y)])
                    kept.append(b"".join(raw[i:j] for i, j in zip([0, *y.tolist()], [*x.tolist(), len(raw)])))
                yield base.batch(schema, doc_id=b.column("doc_id"), n_bytes=n_bytes, spans=spans, kept=kept)

    return base.arrow_map(rows, run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove(base.documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT rid, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400)),
f AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1),
g AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM f)),
s AS (SELECT rid, run, min(i) AS a, max(i) + 200 AS z FROM g GROUP BY rid, run),
c AS (SELECT rid, run, a, z, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS p FROM s),
k AS (SELECT c.rid, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS kept, max(z) AS last
  FROM c JOIN d ON c.rid = d.rid GROUP BY c.rid)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN k.rid IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN k ON d.rid = k.rid
"""


def brute(texts: list[str | None], depth: int = DEPTH) -> list[list[tuple[int, int]]]:
    """Removed runs by a table of all windows; for tests."""
    raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    seen: dict[bytes, int] = {}
    for r in raw:
        for i in range(len(r) - depth + 1):
            w = hashlib.blake2b(r[i : i + depth], digest_size=16).digest()
            seen[w] = seen.get(w, 0) + 1
    out = []
    for r in raw:
        at = np.array([i for i in range(len(r) - depth + 1) if seen[hashlib.blake2b(r[i : i + depth], digest_size=16).digest()] > 1], np.int64)
        x, y = base.merge(at, at + depth)
        out.append(list(zip(x.tolist(), y.tolist())))
    return out
