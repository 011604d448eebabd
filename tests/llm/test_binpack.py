import itertools
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tablejury.llm import binpack
from tablejury.llm.common import text_buffer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(binpack.tokenizer_path())


@pytest.mark.parametrize("text", ["", " ", "Don't we'll 12 3,4", "a\tb\n\nc\x0bd", "É é ÀB ΑΣ ΣΑΣ Σ", "x y　z w", "é ́ a",
                                  "naïve café 東京 🗼tower", "a <|endoftext|> b<|startoftext|>c", "\x1c \x00 \x85", "İI ıi ß", "Word, (word) .'s it's. 'S.'t a.b,c!? é.É ,é", "<|ENDOFTEXT|> X", "a.<|endoftext|>.B", "e.\u0301 E\u0301, .\u0301", "–.a a.– a,–", "한국 각 각"])
def test_ids_equal_the_library(library, text):
    import pyarrow as pa

    ids, n = binpack.encoder(binpack.tokenizer_path()).batch(*text_buffer(pa.array(["first", text, None, "last one"])), 1)
    want = [library.encode(t, add_special_tokens=False).ids + [1] for t in ("first", text, "", "last one")]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_ids_after_the_cache_starts_over(library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(binpack, "CACHE", 5)
    words = binpack.Words(binpack.tokenizer_path())
    for text in ("some words here", "some other words of a longer text", "some words here again"):
        ids, _ = words.batch(*text_buffer(pa.array([text])), 1)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids + [1]


def fewest(sizes, capacity):
    """The least number of sequences, by trying all."""
    best = [len(sizes)]
    sizes = sorted(sizes, reverse=True)

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= sizes[i]}):
            rest = list(rooms)
            rest.remove(room)
            go(i + 1, [*rest, room - sizes[i]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best[0]


def filled(p, sizes, capacity):
    """Every piece has one slot; slots are gapless in each sequence and within the capacity."""
    got = {}
    for size, first, per, start, offset in p.rows:
        n = next((f for s, f, *_ in sorted(p.rows) if s == size and f > first), int(p.taken[size])) - first
        for i in range(n):
            got.setdefault(start + i // per, []).append((offset + i % per * size, size))
    assert sorted(s for b in got.values() for _, s in b) == sorted(sizes)
    for b in got.values():
        at = 0
        for offset, size in sorted(b):
            assert offset == at
            at += size
        assert at <= capacity
    return len(got)


def test_dominance_keeps_the_fewest_sequences():
    rng, reduced = np.random.default_rng(5), 0
    for k in range(300):
        capacity = int(rng.integers(8, 40))
        low = capacity // 4 if k % 2 else 1
        sizes = rng.integers(low, capacity + 1, int(rng.integers(1, 11))).tolist()
        counts = np.bincount(sizes, minlength=capacity + 1)
        p = binpack.Plan(counts, capacity).reduce_dominated()
        left = np.repeat(np.arange(capacity + 1), p.left).tolist()
        reduced += len(left) < len(sizes)
        best = fewest(sizes, capacity)
        assert p.sequences + (fewest(left, capacity) if left else 0) == best
        assert best <= filled(p.best_fit(), sizes, capacity) == p.sequences <= best + 1
    assert reduced > 200


def test_best_fit_equals_one_piece_at_a_time():
    rng = np.random.default_rng(6)
    for _ in range(50):
        sizes = sorted(rng.choice([3, 5, 8, 13, 21, 34], 200).tolist(), reverse=True)
        rooms = []
        for s in sizes:
            fit = [r for r in rooms if r >= s]
            room = min(fit, default=50)
            if fit:
                rooms.remove(room)
            rooms.append(room - s)
        p = binpack.Plan(np.bincount(sizes, minlength=51), 50).best_fit()
        assert filled(p, sizes, 50) == len(rooms)


def check(rows, texts, library, capacity):
    want = sorted((i is None, i or 0, piece, piece * capacity, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()))
                  for i, t in texts for ids in [library.encode(t or "", add_special_tokens=False).ids + [1]]
                  for piece, cut in enumerate(itertools.batched(ids, capacity)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in sequences.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    bound = -(-sum(r.length for r in rows) // capacity)
    assert len(sequences) <= bound * 1.02 + 1


@pytest.mark.parametrize("capacity", [4096, 64])
def test_documents(spark, library, capacity):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    rows = binpack.pack_digest(binpack.pack(docs, capacity=capacity)).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], library, capacity)


def test_awkward_rows(awkward, empty, library):
    pieces = binpack.pack(awkward)
    check(pieces.collect(), [(r.doc_id, r.text) for r in awkward.collect()], library, 4096)
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in pieces.collect())
    assert binpack.pack(empty).count() == 0
