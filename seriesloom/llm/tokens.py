"""Token ids of whole texts by a public tokenizer, fast where words recur.

The tokenizer's rules never look across ASCII white space (it normalises to NFC, turns white space
into one space, lower-cases character by character and splits into runs of letters, digits and
signs), so the ids of a text are those of its white-space words in order. Arrow splits and codes the
words of a batch, and brings words of plain Latin-1 letters, with at most one full stop or comma behind, to
lower-case cores; each distinct core is tokenised once per worker, by the library's BPE model alone, each other
word by its whole encode(). numpy lays out the ids. encode_texts() equals Tokenizer.encode() text
by text (tested).

Defined results: a null text is empty and has no ids but the end id appended.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

VOCABULARY = "word_bpe_49k.json"
SIZE = 49408
MOST_BYTES = 96 << 20  # a worker's memory, not the corpus's: words are forgotten beyond it and tokenised again
PLAIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[.,]?$"
TABLE = "part int, row long, at long, doc_id long, n long, ids binary, counts binary"


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letters for which a byte-level vocabulary writes each byte: printable Latin-1 as itself, the rest from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        letters = _byte_letters()
        self.letters = {chr(c): "".join(letters[b] for b in chr(c).encode()) for c in range(128, 256)}
        self.translate = str.maketrans(self.letters)
        self.signs = {c: self._full(c)[0] for c in ".,"}
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.pieces = array("H")
        self.lengths = array("I")  # a text without white space is one word, however long
        self.starts = array("Q")
        self.held = 0

    def _full(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _places(self, words: pa.Array, tokenise) -> np.ndarray:
        """Where each of the words stands in the table; new ones are tokenised."""
        words = base.strings(words)
        index, at = self.index, np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            k = index.get(w)
            if k is None:
                k = index[w] = len(self.lengths)
                ids = tokenise(w)
                self.starts.append(len(self.pieces))
                self.pieces.extend(ids)
                self.lengths.append(len(ids))
                self.held += 160 + 2 * len(w) + 2 * len(ids)
            at[i] = k
        return at

    def _core(self, core: str) -> list[int]:
        return [t.id for t in self.model.tokenize(core if core.isascii() else core.translate(self.translate))]

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the offset of each text's first: one more than texts."""
        codes, words, offsets = base.coded_words(texts)
        if self.held > MOST_BYTES:
            self.clear()
        plain = pc.match_substring_regex(words, PLAIN)
        is_plain = plain.to_numpy(zero_copy_only=False)
        at, sign = np.empty(len(words), np.int64), np.zeros(len(words), np.uint16)
        # no plain core is a word of the other kind, so that both can share the table
        at[~is_plain] = self._places(words.filter(pc.invert(plain)), self._full)
        own = words.filter(plain)
        cores = pc.utf8_rtrim(pc.utf8_lower(own), characters=".,").dictionary_encode()
        at[is_plain] = self._places(cores.dictionary, self._core)[cores.indices.to_numpy(zero_copy_only=False)]
        for c, i in self.signs.items():
            sign[is_plain] += np.where(pc.ends_with(own, c).to_numpy(zero_copy_only=False), i, 0).astype(np.uint16)
        lengths, starts, pieces = (np.array(x) for x in (self.lengths, self.starts, self.pieces))
        bare = lengths[at].astype(np.int64)
        n = (bare + (sign > 0))[codes]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        source = np.repeat(starts[at].astype(np.int64)[codes] - (ends - n), n)
        source += np.arange(total)
        signed = sign[codes]
        tail = np.flatnonzero(signed)
        source[ends[tail] - 1] = 0
        out = pieces[source] if total else np.zeros(0, np.uint16)
        out[ends[tail] - 1] = signed[tail]
        return out, np.concatenate([[0], ends])[offsets]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One to a worker process, so that later tasks find the words of earlier ones."""
    base.caching("tokens", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_table(docs: DataFrame, end_id: int, path: str | None = None, counts: bool = False) -> DataFrame:
    """part, row, at, doc_id, n, ids: the ids of every whole text with end_id behind, as little-endian uint16.

    part and row say where the document stood in docs, at how many ids of its part stand before. With counts, a last row of each part has
    the part's count of each id (int64) and nothing else.
    """
    path = path or tokenizer_path()
    schema = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("at", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        enc, part, row, before, seen = encoder(path), TaskContext.get().partitionId(), 0, 0, np.zeros(SIZE, np.int64)
        for whole in batches:
            for b in base.slices(whole, "text", 4 << 20):
                ids, offsets = enc.encode_texts(b.column("text"))
                k = b.num_rows
                out = np.full(len(ids) + k, end_id, np.uint16)
                keep = np.ones(len(out), bool)
                keep[offsets[1:] + np.arange(k)] = False
                out[keep] = ids
                if counts:
                    seen += np.bincount(out, minlength=SIZE)
                bounds = offsets + np.arange(k + 1)
                blob = pa.Array.from_buffers(pa.large_binary(), k, [None, pa.py_buffer((bounds * 2).astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())
                yield base.batch(schema, part=np.full(k, part, np.int32), row=np.arange(row, row + k), at=before + bounds[:-1], doc_id=b.column("doc_id"), n=np.diff(bounds), ids=blob, counts=pa.nulls(k, pa.binary()))
                row += k
                before += len(out)
        if counts:
            yield base.batch(schema, part=[part], row=[-1], at=[before], doc_id=[None], n=[0], ids=[None], counts=[seen.tobytes()])

    return base.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, TABLE, owner="tokens")
