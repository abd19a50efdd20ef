"""Media columns: documents as interleaved sequences of text and media references.

HTML is parsed into an ordered array of structs (position, kind, text, digest, caption). A media
store is a table of (digest, media), digest being the SHA-256 of the stored bytes; references are
resolved by a join on the digest, after which positions and captions are still those of the HTML.

The stored form here is PNG, 8-bit RGB rows of 64 pixels, 192 bytes a row: lossless, and checked
on reading (signature, chunk CRCs, size). encode() and decode() are one inverse of the other for
every payload whose length is a positive multiple of 192.

Defined results: null or empty text is a payload of 192 spaces; equal texts have equal media, kept
in the store once per writing task at least and joined once; an unknown digest resolves to nulls,
its place in the sequence stays; repeated rows give repeated results; an empty table gives an
empty result. Only the columns named are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .extraction import boilerplate
from .html_tree import BLOCK, parse

ROW = 192
WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
MEDIA_TAGS = {"img": "image", "video": "video", "audio": "audio", "source": "", "embed": "embed", "object": "object"}
ITEMS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of the text, with bytes 32 up to a positive multiple of 192; the length before them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % ROW if raw else ROW), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(samples: bytes) -> bytes:
    """PNG of 8-bit RGB samples, 64 pixels a row, no row filter."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode(png: bytes) -> bytes:
    """The samples of such a PNG; ValueError where a chunk is damaged."""
    if png[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, height, data = 8, 0, []
    while at < len(png):
        (size,) = struct.unpack_from(">I", png, at)
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", png, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            width, height, bits, colour = struct.unpack_from(">IIBB", body)
            if (width, bits, colour) != (WIDTH, 8, 2):
                raise ValueError("not 8-bit RGB of 64 pixels a row")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, ROW + 1)
    if lines[:, 0].any():
        raise ValueError("row filters are not written by encode()")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, deviation and a 16-bin histogram (permille) of the samples, and a hash of its shape over the rows."""
    a = np.frombuffer(samples, np.uint8)
    counts = np.bincount(a, minlength=256)
    n = a.size
    mean = float((counts * np.arange(256)).sum()) / n
    square = float((counts * np.arange(256) ** 2).sum()) / n
    bins = (counts.reshape(16, 16).sum(1) * 1000 + n // 2) // n
    rows = a.reshape(-1, ROW)
    parts = [float(x.mean()) for x in np.array_split(rows, min(17, len(rows)))]
    shape = "".join("1" if y > x else "0" for x, y in zip(parts, parts[1:]))
    return f"mean={mean:.4f};std={max(0.0, square - mean * mean) ** 0.5:.4f};hist={','.join(map(str, bins))};rows={shape}"


def interleave(html: str | None) -> list[dict]:
    """Ordered texts and media references of a page; a figure's caption belongs to the media in it."""
    items: list[dict] = []
    line: list[str] = []

    def add(kind, text=None, digest=None, caption=None):
        items.append({"position": len(items), "kind": kind, "text": text, "digest": digest, "caption": caption})

    def end():
        if text := " ".join("".join(line).split()):
            add("text", text=text)
        line.clear()

    def words(node) -> str:
        return " ".join("".join(c if isinstance(c, str) else " " + words(c) + " " for c in node[2]).split())

    def captions(node) -> str | None:
        for c in node[2]:
            if not isinstance(c, str):
                if c[0] == "figcaption":
                    return words(c)
                if found := captions(c):
                    return found
        return None

    def walk(node, caption):
        for c in node[2]:
            if isinstance(c, str):
                line.append(c)
            elif c[0] in MEDIA_TAGS and (c[1].get("src") or c[1].get("data")):
                end()
                source = c[1].get("src") or c[1].get("data")
                add(MEDIA_TAGS[c[0]] or (c[1].get("type", "").split("/")[0] or "media"), digest=source.removeprefix("sha256:") if source.startswith("sha256:") else source, caption=caption if caption is not None else c[1].get("alt"))
                walk(c, caption)
            elif c[0] == "figure":
                end()
                walk(c, captions(c))
                end()
            elif c[0] == "figcaption" and caption is not None:
                continue
            elif c[0] not in ("video", "audio", "object", "picture") and boilerplate(c, True):
                continue
            elif c[0] == "br":
                line.append(" ")
            elif c[0] in BLOCK:
                end()
                walk(c, caption)
                end()
            else:
                walk(c, caption)

    walk(parse(html or ""), None)
    end()
    return items


def sequences(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key and items: the interleaved sequence of every page."""
    schema = pa.schema([("key", pa.int64()), ("items", pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])))])

    def run(batches):
        for b in batches:
            yield base.batch(schema, key=b.column("key"), items=[interleave(x) for x in b.column("html").to_pylist()])

    out = base.arrow_map(pages.select(F.col(key).cast("long").alias("key"), F.col(html).cast("string").alias("html")), run, f"key long, items {ITEMS}")
    return out.withColumnRenamed("key", key)


def resolve(sequenced: DataFrame, key: str, store: DataFrame) -> DataFrame:
    """A row for each media reference: key, position, caption and the store's columns, null for an unknown digest.

    `store` has one row per digest. Only what it carries crosses the join: pass what was computed
    from the media beside the bytes, not the bytes, and payloads need not be moved.
    """
    refs = sequenced.select(key, F.explode("items").alias("item")).where(F.col("item.digest").isNotNull())
    refs = refs.select(key, F.col("item.position").alias("position"), F.col("item.kind").alias("kind"), F.col("item.caption").alias("caption"), F.col("item.digest").alias("digest"))
    return refs.join(store, "digest", "left")


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, html (a page that refers to the medium of the text), digest, media (null where this task stored it before)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("html", pa.string()), ("digest", pa.string()), ("media", pa.binary())])

    def run(batches):
        kept: set[bytes] = set()
        for whole in batches:
            for b in base.slices(whole, "text"):
                out: dict[str, list] = {f.name: [] for f in schema}
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    raw, n = payload(text)
                    png = encode(raw)
                    digest = hashlib.sha256(png)
                    new = digest.digest() not in kept
                    if len(kept) < 1_000_000:
                        kept.add(digest.digest())
                    page = f'<article><p>Text of {n} bytes.</p><figure><img src="sha256:{digest.hexdigest()}"><figcaption>payload of {len(raw)} bytes</figcaption></figure></article>'
                    for column, v in zip(out.values(), (doc, n, page, digest.hexdigest(), png if new else None)):
                        column.append(v)
                yield base.batch(schema, **out)

    return base.arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_bytes long, html string, digest string, media binary")


def facts(store: DataFrame) -> DataFrame:
    """digest -> what the stored bytes say, read back and decoded."""
    names = ("digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    schema = pa.schema([(c, pa.int64() if c in ("payload_bytes", "tail_crc32", "media_bytes") else pa.string()) for c in names])

    def run(batches):
        for whole in batches:
            for b in base.slices(whole, "media"):
                rows = []
                for digest, media in zip(b.column("digest").to_pylist(), b.column("media").to_pylist()):
                    raw = decode(media)
                    rows.append((digest, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(raw)))
                yield base.batch(schema, **dict(zip(names, zip(*rows))))

    ddl = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in schema)
    return base.arrow_map(store.select("digest", "media"), run, ddl).dropDuplicates(["digest"])


def op6_media(spark, sf_dir: str) -> DataFrame:
    written = base.stored(store_texts(base.documents(spark, sf_dir)), "media", codec="uncompressed")
    # the key of a row is its document and its page's bytes: repeated doc_ids stay apart
    rows = written.select("doc_id", "n_bytes", "html").withColumn("row", F.monotonically_increasing_id())
    rows = base.stored(rows, "media-rows")
    found = resolve(sequences(rows, "row"), "row", facts(written.where("media is not null")))
    return found.join(rows.select("row", "doc_id", "n_bytes"), "row").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption"
    )
