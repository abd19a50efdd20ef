"""What the operators of this package share: scratch tables, text helpers, Arrow plumbing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_shipped: dict[str, object] = {}
_written: list[tuple[object, str]] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where that is unset, on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="seriesloom-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return _own["dir"]


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    The table stays until the session ends, as plans that read it may run at any time.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/seriesloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _drop_written() -> None:
    for spark, path in _written:
        try:
            jvm = spark._jvm
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            return


atexit.register(_drop_written)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, whatever their Python path has: they unpickle functions by module name."""
    if _shipped.get("to") is spark.sparkContext:
        return
    import zipfile
    from pathlib import Path

    top = Path(__file__).resolve().parents[2]
    to = Path(tempfile.mkdtemp(prefix="seriesloom-zip-"))
    atexit.register(shutil.rmtree, str(to), ignore_errors=True)
    with zipfile.ZipFile(to / "seriesloom_package.zip", "w") as z:
        for p in sorted((top / "seriesloom").rglob("*.py")):
            z.write(p, p.relative_to(top))
    spark.sparkContext.addPyFile(str(to / "seriesloom_package.zip"))
    _shipped["to"] = spark.sparkContext


#: Of a worker process: what empties the caches that outlive a task, and whose they are.
_caches: dict[str, object] = {}


def caching(owner: str, clear) -> None:
    """Register a cache that only tasks of `owner` use."""
    _caches[owner] = clear


def _tidy(owner: str | None) -> None:
    """Empty the caches of other operators' tasks, and give freed memory back to the system."""
    for name, clear in list(_caches.items()):
        if name != owner:
            clear()
            del _caches[name]
    trim()


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        import ctypes

        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it keeps what it likes


def arrow_map(df: DataFrame, function, schema: str, owner: str | None = None) -> DataFrame:
    """mapInArrow with this package at hand on the executors.

    Worker processes are used again by later stages, of other operators too: each task begins and ends
    by giving back what is not its own.
    """
    ship(df.sparkSession)

    def run(batches):
        _tidy(owner)
        try:
            yield from function(batches)
        finally:
            _tidy(owner)

    return df.mapInArrow(run, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(df: DataFrame, column: str = "text"):
    """The text column, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a, f.type) for f, a in ((f, columns[f.name]) for f in schema)], schema=schema)


def coded_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """ASCII white-space words of a batch of texts, as indices into the distinct words.

    Returns (codes of all words, distinct words, word offsets of each text: one more than texts).
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, offsets


def strings(words: pa.Array) -> list[str]:
    """Words without line feeds as Python strings: one string is far cheaper to hand over than its words."""
    if not len(words):
        return []
    whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string()))
    return pc.binary_join(whole, "\n")[0].as_py().split("\n")


def split_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """coded_words() with the distinct words as Python strings."""
    codes, words, offsets = coded_words(texts)
    return codes, strings(words), offsets


def slices(record: pa.RecordBatch, column: str, most: int = 8 << 20):
    """Cut a batch so that each part holds at most about `most` bytes of the column; long texts stand alone."""
    sizes = pc.fill_null(pc.binary_length(record.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield record.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield record.slice(start)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a batch of texts end to end, and where each begins: one more than texts."""
    whole = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1, whole.offset * 8) if len(whole) else np.zeros(1, np.int64)
    data = whole.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, ordered intervals with the same union; touching ones become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, far = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], starts[1:] > far[:-1]])
    last = np.concatenate([first[1:], [True]])
    return starts[first], far[last]


NO_ID = -(1 << 63)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the key (d, t) of a row: its id (NO_ID for null) and its text's hash.

    Rows with one key are copies of each other, so results by key hold for each of them.
    """
    text = text_of(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("t")
    )


def groups(batches, keys: tuple[str, ...], body: str, most: int = 4 << 20):
    """Tables of whole groups of rows that follow each other with equal keys, several groups at a time.

    Only groups' own rows are held: about `most` bytes of the body column, or one group if that is larger.
    """
    held: list[pa.RecordBatch] = []
    size = 0

    def last_start(table: pa.Table) -> int:
        n = table.num_rows
        changed = np.zeros(n - 1, bool)
        for k in keys:
            x = table.column(k).to_numpy()
            changed |= x[1:] != x[:-1]
        at = np.flatnonzero(changed)
        return int(at[-1]) + 1 if len(at) else 0

    for whole in batches:
        for b in slices(whole, body, most):
            held.append(b)
            size += pc.sum(pc.binary_length(b.column(body))).as_py() or 0
            if size < most:
                continue
            table = pa.Table.from_batches(held)
            cut = last_start(table)
            if cut:
                yield table.slice(0, cut)
                held, size = table.slice(cut).to_batches(), 0
            else:
                size = 0  # one group so far: look again when as much has come anew
    if held:
        yield pa.Table.from_batches(held)


def bounds(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """Where groups of equal keys begin in a table, and its length."""
    n = table.num_rows
    first = np.zeros(n, bool)
    if n:
        first[0] = True
    for k in keys:
        x = table.column(k).to_numpy()
        first[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(first), n)
