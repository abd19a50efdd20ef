import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from seriesloom.llm import huffman as H
from seriesloom.llm import packing as P
from seriesloom.llm import tokens


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


def texts():
    r = random.Random(3)
    alpha = "abcABC  \t\n.,'s!?éÉßÿ1٣—İ́Σς漢\x85\xa0\x1c가"
    out = ["".join(r.choice(alpha) for _ in range(r.randint(0, 60))) for _ in range(300)]
    words = ["The", "quick,", "brown", "fox.", "JUMPS", "over12", "Étagère", "naïve."]
    return out + ["<|endoftext|> a", "x<|startoftext|>y don't 'll", None, ""] + [" ".join(r.choice(words) for _ in range(n)) for n in (1, 700, 3000, 9000)]


def test_words_give_the_ids_of_whole_texts(tokenizer):
    e = tokens.Encoder(tokens.tokenizer_path())
    xs = texts()
    for _ in range(2):  # new words, then known ones
        ids, at = e.encode_texts(pa.array(xs))
        for i, x in enumerate(xs):
            assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode(x or "", add_special_tokens=False).ids, x
    assert len(e.encode_texts(pa.array([], pa.string()))[0]) == 0


def test_a_word_may_have_more_ids_than_16_bits_count(tokenizer):
    long = "漢字仮名" * 12000
    want = tokenizer.encode(long, add_special_tokens=False).ids
    assert len(want) > 65535
    ids, at = tokens.Encoder(tokens.tokenizer_path()).encode_texts(pa.array(["a", long, f"b {long}"]))
    assert ids[at[1] : at[2]].tolist() == want and len(ids) == at[3]


def test_codes_are_optimal_limited_and_prefix_free():
    import heapq

    r = np.random.default_rng(1)
    w = r.integers(1, 1000, 300)
    heap = w.tolist()
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    lengths = H.code_lengths(w)
    assert (lengths * w).sum() == cost
    steep = H.code_lengths(np.array([1 << i for i in range(40)]))
    assert steep.max() == 16 and (2.0 ** -steep.astype(float)).sum() <= 1
    codes = [format(c, f"0{n}b") for c, n in zip(H.canonical(steep), steep)]
    assert not any(a != b and b.startswith(a) for a in codes for b in codes)
    assert H.code_lengths(np.zeros(5, int)).tolist() == [0] * 5 and H.code_lengths(np.array([0, 9, 0])).tolist() == [0, 1, 0]


def test_blocks_decode_alone():
    r = np.random.default_rng(2)
    ids = np.minimum(r.zipf(1.2, 20000), 49407).astype(np.uint16)
    lengths = H.code_lengths(np.bincount(ids, minlength=tokens.SIZE))
    codes, table = H.canonical(lengths), H.table(lengths)
    parts = [ids[:1], ids[1:513], ids[513:1025], ids[1025:], ids[:0]]
    blocks = [(len(x), *H.encode(x, codes, lengths)) for x in parts]
    for x, y in zip(parts, H.decode(blocks, *table)):
        assert (x == y).all()
    assert (H.decode(blocks[3:4], *table)[0] == parts[3]).all()


def rows():
    xs = [(i * 7 % 311, x) for i, x in enumerate(texts())]
    return xs + [(4, "again"), (4, "again"), (None, "no id")]


def test_huffman_files(documents, tokenizer):
    code, blocks = H.write(documents(rows()))
    got = sorted((r.start, r.doc_id, r.n_tokens, bytes(r.ids)) for r in H.read(code, blocks).collect())
    at, seen = 0, []
    for start, doc, n, ids in got:
        assert start == at and len(ids) == 4 * n
        at += n
        seen.append((doc, ids))
    assert [d for d, _ in seen] == sorted((d for d, _ in rows()), key=lambda d: (d is not None, d or 0))
    want = sorted((str(d), np.array(tokenizer.encode(x or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for d, x in rows())
    assert sorted((str(d), ids) for d, ids in seen) == want
    code, blocks = H.write(documents(rows()).where("doc_id < -1"))
    assert H.read(code, blocks).count() == 0


def test_packing(documents, tokenizer):
    data = rows()
    got = P.pack(documents(data)).collect()
    by_sequence, by_doc = {}, {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, bytes(r.ids)))
        assert len(r.ids) == 4 * r.length > 0
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    want = {}
    for d, x in data:
        ids = np.array(tokenizer.encode(x or "", add_special_tokens=False).ids + [1], "<u4")
        want.setdefault((d, len(ids)), []).append(ids.tobytes())
    assert {k: sum(map(len, v)) for k, v in want.items()} == {k: sum(len(i) for _, i in v) for k, v in by_doc.items()}
    for k, v in want.items():
        if len(v) == 1:
            assert b"".join(i for _, i in sorted(by_doc[k])) == v[0]
    assert P.pack(documents(data).where("doc_id < -1")).count() == 0


def test_nnls_and_recipes():
    r = np.random.default_rng(4)
    columns = P.combinations(16)
    assert (columns.sum(1) == 16).all() and len({tuple(c) for c in columns}) == len(columns)
    target = r.integers(0, 50, 16).astype(float)
    x = P.nnls(columns, target)
    a = np.zeros((16, len(columns)))
    for j, c in enumerate(columns):
        for v in c[c > 0]:
            a[v - 1, j] += 1
    slope = a.T @ (target - a @ x)
    assert (x >= 0).all() and slope.max() < 1e-5 and np.abs(slope[x > 0]).max() < 1e-5
    for k in (1, 40, 5000):
        h = np.bincount(np.minimum(255, r.lognormal(4.2, 0.9, k).astype(int)), minlength=256)
        used = np.zeros(256, int)
        for parts, times in P.recipes(h):
            assert sum(parts) == 256 and times > 0
            for b in parts:
                used[b - 1] += times
        assert (used <= h).all()
    assert P.recipes(np.zeros(256, int)) == []
