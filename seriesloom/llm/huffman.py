"""Token ids on disk in a canonical, length-limited Huffman code, decoded in independent blocks.

Code lengths (16 bits at most) come from the counts of all ids of the corpus by package-merge; a
canonical code is its lengths, so the file's first table is one byte per id. Documents stand in
ascending doc_id order. A block holds whole documents: their ids and counts, the coded bits and
the bit offset of every STRIDE-th id. Blocks are read alone; inside one, all strides are decoded
together by a 2 ** 16 entry table, one id of each stride at a time.

Defined results: null text is empty, so a document of its end id alone; null doc_ids come first;
repeated doc_ids keep all their rows, in order of text; an empty corpus gives no blocks; a
document longer than BLOCK ids has a block of its own. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base
from .tokens import SIZE, token_table

BITS = 16
BLOCK = 1 << 19
STRIDE = 512
MOST_PARTS = 500_000  # rows of two numbers that may be broadcast
END = 2
BLOCKS = "part int, first long, doc_ids array<long>, lengths array<long>, offsets binary, bits binary"


def code_lengths(counts: np.ndarray, limit: int = BITS) -> np.ndarray:
    """Optimal lengths of at most `limit` bits, 0 for ids that do not occur; package-merge."""
    ids = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(ids)
    if n <= 1:
        out[ids] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids need more than {limit} bits")
    order = ids[np.lexsort((ids, counts[ids]))]
    leaves = counts[order].astype(np.int64)
    rows, packed = [], np.zeros(0, np.int64)
    for _ in range(limit):
        weight = np.concatenate([leaves, packed])
        by = np.argsort(weight, kind="stable")
        rows.append(by < n)
        weight = weight[by]
        packed = weight[: len(weight) // 2 * 2].reshape(-1, 2).sum(1)
    take, lengths = 2 * (n - 1), np.zeros(n, np.int64)
    for leaf in reversed(rows):
        used = int(leaf[:take].sum())
        lengths[:used] += 1
        take = 2 * (take - used)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    own = lengths[ids].astype(np.int64)
    # each code starts where those before it end in the unit interval, in steps of 2 ** -BITS
    ends = np.cumsum(1 << (BITS - own))
    codes[ids] = ((ends - (1 << (BITS - own))) >> (BITS - own)).astype(np.uint32)
    return codes


def table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit window the id it begins with, and the length of that id's code."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    spans = 1 << (BITS - lengths[ids].astype(np.int64))
    symbol, size = np.zeros(1 << BITS, np.uint16), np.ones(1 << BITS, np.uint8)
    total = int(spans.sum())
    symbol[:total] = np.repeat(ids, spans)
    size[:total] = np.repeat(lengths[ids], spans)
    return symbol, size


def encode(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """Bit offsets of every STRIDE-th id (uint32 bytes), and the bits, most significant first."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    total = int(ends[-1]) if len(ends) else 0
    out = np.zeros((total + 7) // 8 + 4, np.float64)
    shifted = codes[ids].astype(np.int64) << (24 - n - (starts & 7))
    at = starts >> 3
    for k in range(3):
        out[k : k + len(out) - 4] += np.bincount(at, (shifted >> (16 - 8 * k)) & 255, minlength=len(out) - 4)
    return starts[::STRIDE].astype(np.uint32).tobytes(), out.astype(np.uint8)[: (total + 7) // 8].tobytes()


def decode(blocks: list[tuple[int, bytes, bytes]], symbol: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Ids of blocks (number of ids, offsets, bits); strides of all blocks given advance together."""
    bodies, at, counts, base_bit = [], [], [], 0
    for n, offsets, bits in blocks:
        o = np.frombuffer(offsets, np.uint32).astype(np.int64)
        at.append(o + base_bit)
        c = np.full(len(o), STRIDE, np.int64)
        if len(o):
            c[-1] = n - STRIDE * (len(o) - 1)
        counts.append(c)
        bodies.append(bits)
        base_bit += 8 * len(bits)
    data = np.frombuffer(b"".join(bodies) + b"\0\0\0\0", np.uint8).astype(np.uint32)
    window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    position = np.concatenate(at) if at else np.zeros(0, np.int64)
    count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    order = np.argsort(-count, kind="stable")
    position, sorted_count = position[order], count[order]
    out = np.zeros((STRIDE, len(count)), np.uint16)
    for k in range(STRIDE):
        alive = int(np.searchsorted(-sorted_count, -k, side="left"))
        if not alive:
            break
        p = position[:alive]
        bits = (window[p >> 3] >> (16 - (p & 7)).astype(np.uint32)) & 0xFFFF
        out[k, :alive] = symbol[bits]
        p += size[bits]
    lanes = np.empty_like(out)
    lanes[:, order] = out
    lanes = lanes.T.reshape(-1)
    result, lane = [], 0
    for n, offsets, _ in blocks:
        result.append(lanes[lane * STRIDE : lane * STRIDE + n])
        lane += len(offsets) // 4
    return result


def write(docs: DataFrame, end_id: int = END) -> tuple[DataFrame, DataFrame]:
    """The two tables of the format, written and read back: code (lengths of all ids), blocks."""
    spark = docs.sparkSession
    ordered = docs.select("doc_id", "text").repartitionByRange(base.partitions(spark), F.col("doc_id").cast("long").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").cast("long").asc_nulls_first(), "text")
    tokens = base.stored(token_table(ordered, end_id, counts=True), "tokens")

    def totals(batches):
        sums = np.zeros(SIZE, np.int64)
        for b in batches:
            for x in b.column("counts").to_pylist():
                sums += np.frombuffer(x, np.int64)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["id", "n"])

    counts = np.zeros(SIZE, np.int64)  # one number for each id of the vocabulary, however large the corpus
    for r in base.arrow_map(tokens.where("counts is not null").select("counts"), totals, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    code = base.stored(spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary"), "huffman-code")
    codes = canonical(lengths)
    schema = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("offsets", pa.binary()), ("bits", pa.binary())])

    def run(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            ids = np.frombuffer(b"".join(h[-1] for h in held), np.uint16)
            offsets, bits = encode(ids, codes, lengths)
            return base.batch(schema, part=[held[0][0]], first=[held[0][2]], doc_ids=[[h[3] for h in held]], lengths=[[h[4] for h in held]], offsets=[offsets], bits=[bits])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in names)):
                # a block is any run of documents that follow each other: a part's rows may be read by several tasks
                if held and (row[:2] != (held[-1][0], held[-1][1] + 1) or size + row[4] > BLOCK):
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += row[4]
        if held:
            yield flush()

    names = ("part", "row", "at", "doc_id", "n", "ids")
    return code, base.stored(base.arrow_map(tokens.where("ids is not null").select(*names), run, BLOCKS), "huffman-blocks", codec="uncompressed")


def read(code: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, start, ids (little-endian uint32) of every document, decoded from the two tables."""
    lengths = np.frombuffer(bytes(code.first()["lengths"]), np.uint8)
    symbol, size = table(lengths)
    sums = blocks.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("own"))
    before = base.stored(sums.withColumn("before", F.coalesce(F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("own"), "huffman-parts")
    if before.count() <= MOST_PARTS:
        before = F.broadcast(before)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 4):
                rows = b.slice(i, 4).to_pylist()
                for r, ids in zip(rows, decode([(sum(r["lengths"]), r["offsets"], r["bits"]) for r in rows], symbol, size)):
                    ends = np.cumsum(np.array(r["lengths"], np.int64))
                    starts = ends - np.array(r["lengths"], np.int64)
                    raw = ids.astype("<u4").tobytes()
                    blob = pa.array([raw[4 * x : 4 * y] for x, y in zip(starts, ends)], pa.binary())
                    yield base.batch(schema, doc_id=r["doc_ids"], start=starts + r["first"] + r["before"], n_tokens=r["lengths"], ids=blob)

    return base.arrow_map(blocks.join(before, "part"), run, "doc_id long, start long, n_tokens long, ids binary")


def op8_huffman(spark, sf_dir: str) -> DataFrame:
    code, blocks = write(base.documents(spark, sf_dir))
    return read(code, blocks).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
