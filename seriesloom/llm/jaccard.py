"""Documents whose five-word shingle sets have a Jaccard similarity of 0.8 or more, by Bayesian pruning.

1. Documents are reduced to their sets of distinct shingles; equal sets are one node (sid, a 64-bit
   hash of the set), however many documents have it.
2. Each node's MinHash values are cut into bands (at similarity 0.8 two nodes share none of the
   32 with a probability of 5e-8). Nodes that share a band are tied to the band's smallest node, so
   a band gives as many edges as members, not pairs; the edges' connected components bound where
   links can be.
3. Inside a component nodes are compared in blocks: the sizes must allow the similarity, then MinHash
   values are compared STEP at a time, and a pair is dropped as soon as the posterior probability
   that its similarity reaches the threshold (uniform prior) is below TOLERANCE. Pairs that are left
   after all values are verified on their whole shingle sets.
4. Blocks give each node the number of linked documents, and a spanning forest of the links, whose
   components are the classes. No pair leaves its block.

Copies met by one task are merged before the shuffle, so a band's or set's key gets at most one row per
task. Results go by (doc_id, text hash); rows may repeat a doc_id.

Defined results: a text of fewer than five words has one shingle, of all of them; null, empty and
white texts have none, link with nothing and are classes of their own; repeated rows link with each
other; the class id is the smallest doc_id of the class (null if none has one); an empty table
gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base
from .components import components
from .rolling import mix, shingles

K = 5
THRESHOLD = (4, 5)
HASHES = 128
ROWS = 4
STEP = 16
TOLERANCE = 1e-6
BLOCK = 500_000
FLUSH = 400_000
_seeds = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)
_found = pa.schema([("kind", pa.int32())] + [(c, pa.int64()) for c in ("d", "t", "sid", "n", "band")])


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values (uint32, a row per set) of non-empty sets that lie end to end."""
    out = np.empty((len(first), HASHES), np.uint32)
    for j, seed in enumerate(_seeds):
        out[:, j] = np.minimum.reduceat(h * seed, first) >> np.uint64(32)
    return out


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After n values compared, the fewest equal ones with which a pair may still be similar enough."""
    grid = (np.arange(20000) + 0.5) / 20000
    above = grid >= threshold
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            density = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(density - density.max())
            if density[above].sum() / density.sum() >= tolerance:
                out[n] = m
                break
    return out


def set_ids(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set: of the sums of its hashes and of their squares, and its size."""
    a = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])
    b = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * (h ^ (h >> np.uint64(29))), dtype=np.uint64)])
    return mix((a[last] - a[first]) ^ mix((b[last] - b[first]) + (last - first).astype(np.uint64))).view(np.int64)


def described(keyed: DataFrame) -> DataFrame:
    """kind 0: d, t, sid, n of each text; kind 1: sid, band; kind 2: an edge sid - n between nodes of one band."""

    def run(batches):
        sids_seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            band, sid = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((sid, band))
            band, sid = band[order], sid[order]
            new = np.concatenate([[True], band[1:] != band[:-1]])
            low = sid[new][np.cumsum(new) - 1]
            k, e = np.flatnonzero(new), np.flatnonzero(low != sid)
            yield _rows(1, sid=sid[k], band=band[k])
            if len(e):
                pairs = np.unique(np.stack([sid[e], low[e]], 1), axis=0)
                yield _rows(2, sid=pairs[:, 0], n=pairs[:, 1])

        for whole in batches:
            for b in base.slices(whole, "text", 1 << 20):
                data, offsets = base.bytes_of(b.column("text"))
                h, at = shingles(data, offsets, K)
                sid = set_ids(h, at[:-1], at[1:])
                n = np.diff(at)
                sid[n == 0] = 0
                yield _rows(0, d=b.column("d"), t=b.column("t"), sid=sid, n=n)
                new = [i for i in np.unique(sid, return_index=True)[1] if n[i] and int(sid[i]) not in sids_seen]
                if len(sids_seen) < FLUSH:
                    sids_seen.update(int(sid[i]) for i in new)
                if not new:
                    continue
                new = np.array(new)
                take = np.concatenate([np.arange(at[i], at[i + 1]) for i in new])
                first = np.concatenate([[0], np.cumsum(n[new])])[:-1]
                sig = signatures(h[take], first).astype(np.uint64)
                bands = np.zeros((len(new), HASHES // ROWS), np.uint64)
                for r in range(ROWS):
                    bands = mix(bands + sig[:, r::ROWS] + np.uint64(1))
                bands = mix(bands + np.arange(HASHES // ROWS, dtype=np.uint64)[None, :])
                held.append((bands.ravel().view(np.int64), np.repeat(sid[new], HASHES // ROWS)))
                size += bands.size
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return base.arrow_map(keyed.select("d", "t", "text"), run, "kind int, d long, t long, sid long, n long, band long")


def _rows(kind: int, **columns) -> pa.RecordBatch:
    k = len(columns["sid"])
    return base.batch(_found, kind=np.full(k, kind, np.int32), **{f.name: columns.get(f.name, pa.nulls(k, pa.int64())) for f in list(_found)[1:]})


_nodes = pa.schema([(c, pa.int64()) for c in ("comp", "i", "j", "block", "sid", "n", "many")] + [("sig", pa.binary()), ("set", pa.binary())])


def sets(rows: DataFrame) -> DataFrame:
    """Nodes with MinHash values and whole shingle sets, from the text of one of their documents."""

    def run(batches):
        for whole in batches:
            for b in base.slices(whole, "text", 1 << 20):
                data, offsets = base.bytes_of(b.column("text"))
                h, at = shingles(data, offsets, K)
                sig = signatures(h, at[:-1])
                own = {c: b.column(c) for c in ("comp", "block", "sid", "n", "many")}
                out: dict[str, list] = {f.name: [] for f in _nodes}
                for r, partners in enumerate(b.column("partners").to_pylist()):
                    one = {c: v[r].as_py() for c, v in own.items()}
                    for p in partners:
                        for c, v in (one | {"i": min(p, one["block"]), "j": max(p, one["block"]), "sig": sig[r].tobytes(), "set": h[at[r] : at[r + 1]].tobytes()}).items():
                            out[c].append(v)
                yield base.batch(_nodes, **out)

    return base.arrow_map(rows, run, ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'long'}" for f in _nodes))


def links_in(blocks: np.ndarray, n: np.ndarray, sig: np.ndarray, members: list[np.ndarray], own: bool, need: dict[int, int], up: int, down: int):
    """(x, ys) for every node x of a block pair: the later nodes ys whose similarity is up / down or more.

    own: the pair is of a block with itself; otherwise only nodes of different blocks are compared.
    """
    for x in range(len(n)):
        ys = np.arange(x + 1, len(n))
        if not own:
            ys = ys[blocks[ys] != blocks[x]]
        ys = ys[(n[ys] * down >= n[x] * up) & (n[x] * down >= n[ys] * up)]
        equal = np.zeros(len(ys), np.int64)
        for k in range(STEP, HASHES + 1, STEP):
            if not len(ys):
                break
            equal += (sig[ys, k - STEP : k] == sig[x, k - STEP : k]).sum(1)
            stay = equal >= need[k]
            ys, equal = ys[stay], equal[stay]
        if not len(ys):
            continue
        sizes = n[ys]
        flat = np.concatenate([members[y] for y in ys])
        at = np.minimum(np.searchsorted(members[x], flat), len(members[x]) - 1)
        common = np.add.reduceat((members[x][at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
        ys = ys[common * (up + down) >= up * (sizes + n[x])]
        if len(ys):
            yield x, ys


_linked = pa.schema([(c, pa.int64()) for c in ("sid", "links", "root")])


def verified(nodes: DataFrame, up: int, down: int) -> DataFrame:
    """sid, links (documents of other nodes linked in this block pair), root (smallest node it is tied to there)."""
    need = least_matches(up / down)
    keys = ("comp", "i", "j")

    def run(batches):
        for table in base.groups(batches, keys, "set"):
            table = table.take(base.bounds(table, (*keys, "block", "sid"))[:-1])  # a row that repeats a key doubles no node
            cuts = base.bounds(table, keys)
            sid, n, many, block, i, j = (table.column(c).to_numpy() for c in ("sid", "n", "many", "block", "i", "j"))
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
            members = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
            links, root = np.zeros(len(sid), np.int64), np.arange(len(sid))

            def find(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for a, z in zip(cuts[:-1], cuts[1:]):
                for x, ys in links_in(block[a:z], n[a:z], sig[a:z], members[a:z], i[a] == j[a], need, up, down):
                    links[a + x] += many[a + ys].sum()
                    links[a + ys] += many[a + x]
                    for y in ys:
                        p, q = find(a + x), find(a + y)
                        if p != q:
                            root[max(p, q)] = min(p, q)
            top = np.array([find(x) for x in range(len(sid))], np.int64)
            low = sid.copy()
            np.minimum.at(low, top, sid)
            tied = np.flatnonzero(links > 0)
            yield base.batch(_linked, sid=sid[tied], links=links[tied], root=low[top][tied])

    ordered = nodes.repartition(base.partitions(nodes.sparkSession), *keys).sortWithinPartitions(*keys, "block", "sid")
    return base.arrow_map(ordered, run, ", ".join(f"{f.name} long" for f in _linked))


def join(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """d, t, class_id, n_links for every row of base.keyed(docs) (rows with one key repeated)."""
    up, down = threshold
    keyed = base.keyed(docs)
    found = base.stored(described(keyed), "shingle-sets")
    per_text = found.where("kind = 0").select("d", "t", "sid", "n")
    across = found.where("kind = 1").select("band", "sid")
    low = F.min("sid").over(Window.partitionBy("band").orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    edges = across.select("sid", low.alias("low")).where("sid <> low").select(F.col("sid").alias("a"), F.col("low").alias("b"))
    edges = edges.unionByName(found.where("kind = 2").select(F.col("sid").alias("a"), F.col("n").alias("b")))
    comps = components(edges, "bands").withColumnRenamed("v", "sid")
    one = per_text.where("n > 0").groupBy("sid").agg(F.min(F.struct("d", "t")).alias("one"), F.min("n").alias("n"), F.count("*").alias("many"))
    inside = one.join(comps, "sid")
    filled = F.sum("n").over(Window.partitionBy("comp").orderBy("n", "sid").rowsBetween(Window.unboundedPreceding, -1))
    blocked = base.stored(inside.withColumn("block", F.coalesce((filled / BLOCK).cast("long"), F.lit(0).cast("long"))), "blocks")
    spans = blocked.groupBy("comp", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    other = spans.select("comp", F.col("block").alias("other"), F.col("least").alias("o_least"), F.col("most").alias("o_most"))
    # blocks are in order of size, so that those too different in size do not meet
    meet = spans.join(other, "comp").where((F.col("most") * down >= F.col("o_least") * up) & (F.col("o_most") * down >= F.col("least") * up))
    meet = meet.groupBy("comp", "block").agg(F.collect_list("other").alias("partners"))
    chosen = blocked.join(meet, ["comp", "block"]).select(F.col("one.d").alias("d"), F.col("one.t").alias("t"), "comp", "block", "sid", "n", "many", "partners")
    texts = keyed.select("d", "t", "text").join(chosen, ["d", "t"])
    linked = base.stored(verified(sets(texts.select("text", "comp", "block", "sid", "n", "many", "partners")), up, down), "links")
    classes = components(linked.select(F.col("sid").alias("a"), F.col("root").alias("b")), "classes").select(F.col("v").alias("sid"), F.col("comp").alias("class"))
    counts = linked.groupBy("sid").agg(F.sum("links").alias("links"))
    nodes = one.select("sid", "many", "one").join(counts, "sid", "left").join(classes, "sid", "left")
    nodes = nodes.withColumn("class", F.coalesce("class", "sid"))
    ids = per_text.where("n > 0").groupBy("sid").agg(F.min(F.when(F.col("d") != base.NO_ID, F.col("d"))).alias("low_id"))
    names = nodes.join(ids, "sid").groupBy("class").agg(F.min("low_id").alias("class_id"))
    nodes = nodes.join(names, "class").select("sid", "class_id", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.col("class"))
    # texts without words are no nodes: however many there are, they meet in no join
    bare = per_text.where("n = 0").select("d", "t", F.when(F.col("d") != base.NO_ID, F.col("d")).alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("class"))
    return per_text.where("n > 0").join(nodes, "sid").select("d", "t", "class_id", F.col("n_links").cast("long").alias("n_links"), "class").unionByName(bare)


def op9_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    joined = join(base.documents(spark, sf_dir))
    return joined.select(F.when(F.col("d") != base.NO_ID, F.col("d")).alias("doc_id"), "class_id", "n_links")


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, sh FROM (SELECT rid, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS sh FROM d)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.rid <> b.rid GROUP BY a.rid, b.rid),
l AS (SELECT x, y FROM p JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 9 * c >= 4 * (a.n + b.n)),
r AS (SELECT rid AS v, rid AS c FROM d UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.v),
m AS (SELECT r.v, min(d.doc_id) AS class_id FROM r JOIN d ON r.c = d.rid GROUP BY r.v),
k AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT d.doc_id, m.class_id, CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links FROM d JOIN m ON m.v = d.rid LEFT JOIN k ON k.x = d.rid
"""


def representatives(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """docs with one row of each class: the smallest doc_id, and of rows that repeat it the first by text hash.

    All columns are kept as they are, whatever their names; rows without words are kept all.
    """
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id"), F.col("text"))
    classes = join(docs.select("doc_id", "text"), threshold)
    keep = classes.where("class is not null").groupBy("class").agg(F.min(F.struct(F.col("d") == base.NO_ID, "d", "t")).alias("best")).select("best.d", "best.t").withColumn("whole", F.lit(False))
    empty = classes.where("class is null").select("d", "t").distinct().withColumn("whole", F.lit(True))
    kept = base.stored(keep.unionByName(empty), "kept-classes")
    rows = inner.withColumn("d", F.coalesce(F.col("doc_id").cast("long"), F.lit(base.NO_ID))).withColumn("t", F.xxhash64(base.text_of(inner)))
    rows = rows.join(kept, ["d", "t"])
    once = rows.where("not whole").dropDuplicates(["d", "t"]).select("row").unionByName(rows.where("whole").select("row"))
    return once.select(*[F.col("row")[c].alias(c) for c in names])
