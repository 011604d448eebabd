import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablejury.llm import lm_scoring


def tokens(text):
    """Pieces of a text, one character class at a time."""
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    out = []
    for m in re.finditer(rb"([\x00-\x20]?)([a-z\x80-\xff]+|[0-9]+|[^a-z0-9\x80-\xff\x00-\x20]+)", data):
        run = (b" " if m[1] else b"") + m[2]
        out += [run[i:i + 4] for i in range(0, len(run), 4)]
    return out


def brute(texts, target_ids):
    """Dictionaries of bigrams, one token at a time."""
    seqs = [(i, tokens(t)) for i, t in texts]
    vocabulary = {w for _, s in seqs for w in s}

    def model(chosen):
        single, follow = Counter(), defaultdict(Counter)
        for s in chosen:
            for v, w in zip([b""] + s, s):
                single[w] += 1
                follow[v][w] += 1
        total = sum(single.values())

        def p(v, w):
            rest = 1 / len(vocabulary)
            if total:
                rest = (single[w] + len(single) * rest) / (total + len(single))
            c = follow.get(v)
            return (c[w] + len(c) * rest) / (sum(c.values()) + len(c)) if c else rest
        return p

    models = model([s for i, s in seqs if i in target_ids]), model([s for _, s in seqs])
    out = []
    for i, s in seqs:
        loss = [sum(-math.log2(p(v, w)) for v, w in zip([b""] + s, s)) / max(len(s), 1) for p in models]
        out.append((i, len(s), loss[0], loss[1], loss[0] - loss[1]))
    return out


TEXTS = [(1, "The cat sat on the mat."), (2, "ZZZZ!! qqq 999 12345"), (3, ""), (4, None), (5, "the cat é sat"),
         (6, "dogs run"), (7, " \n\t "), (8, "Кошка сидела на ковре"), (9, "abc123\n\n--x  y"), (10, "the cat sat" * 40)]


@pytest.mark.parametrize("step,size,places,ranks", [(8_000_000, 64_000_000, 1 << 16, 1 << 16), (30, 60, 3, 5), (30, 10_000, 100, 7)])
def test_against_dictionaries(spark, monkeypatch, step, size, places, ranks):
    """With the slices of the operator, and with slices and rows small enough that every bound is met."""
    for name, value in (("STEP", step), ("SLICE", size), ("MOST_PLACES", places), ("RANKS", ranks)):
        monkeypatch.setattr(lm_scoring, name, value)
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([(1,), (5,), (5,), (None,), (99,)], "doc_id long")
    got = sorted(tuple(r) for r in lm_scoring.cross_entropy_difference(docs, target).collect())
    want = brute(TEXTS, {1, 5})
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2:] for g in got], [w[2:] for w in want], atol=1e-5)
    assert got[0][4] < got[1][4]


def test_pieces_over_document_borders():
    texts = [b"", b"abcde", b" x", b"", b"12 a"]
    offsets = np.cumsum([0, *map(len, texts)])
    code, bounds = lm_scoring.pieces(np.frombuffer(b"".join(texts), np.uint8), offsets)
    got = [[int(c).to_bytes(4).rstrip(b"\0") for c in code[bounds[i]:bounds[i + 1]]] for i in range(len(texts))]
    assert got == [[], [b"abcd", b"e"], [b" x"], [], [b"12", b" a"]] == [tokens(t.decode()) for t in texts]


def test_probabilities_sum_to_one(spark):
    """Over the vocabulary, for a context whose followers are all known and for both models."""
    words = [(b << 32 | w, n, t) for b, w, n, t in [(0, 1, 3, 0), (1, 1, 2, 1), (1, 2, 5, 0), (2, 1, 1, 1), (2, 2, 1, 0)]]
    rows = lm_scoring.loss_table(spark.createDataFrame(words, "key long, n long, n_target long")).collect()
    for name in ("target_loss", "background_loss"):
        for before in (1, 2):
            assert abs(sum(2.0 ** (-r[name] / lm_scoring.UNIT) for r in rows if r.key >> 32 == before) - 1) < 1e-6


def test_scripts_and_digits_are_told_apart(spark):
    """A model of Cyrillic text prefers Cyrillic, one of even digits prefers even digits."""
    rng = np.random.default_rng(5)

    def text(signs):
        return " ".join("".join(rng.choice(list(signs), 5)) for _ in range(60))

    kinds = {"latin": "abcdefgh", "cyrillic": "абвгдежз", "even": "02468", "odd": "13579"}
    rows = [(i, list(kinds)[i % 4], text(list(kinds.values())[i % 4])) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, kind string, text string").cache()
    for kind in kinds:
        target = docs.where(f"kind = '{kind}' AND doc_id < 60").select("doc_id")
        got = {r.doc_id: r.score for r in lm_scoring.cross_entropy_difference(docs, target).collect()}
        inside = [got[i] for i, k, _ in rows if i >= 60 and k == kind]
        assert max(inside) < min(got[i] for i, k, _ in rows if i >= 60 and k != kind)


def test_tables_grow_with_the_corpus(spark):
    docs = spark.createDataFrame([(i, f"w{i * 7919 % 100003} common {i}") for i in range(2000)], "doc_id long, text string")
    sizes = [lm_scoring.folded(docs.where(f"doc_id < {n}").selectExpr("*", "false AS target")).where("key IS NOT NULL")
             .select("key").distinct().count() for n in (200, 2000)]
    assert sizes[1] > 4 * sizes[0]


def test_awkward_rows(spark, awkward, empty):
    ids = spark.createDataFrame([(1,)], "doc_id long")
    rows = lm_scoring.cross_entropy_difference(awkward, ids).collect()
    assert len(rows) == awkward.count() and all(math.isfinite(r.score) for r in rows)
    assert {r.score for r in rows if r.n_tokens == 0} == {0.0}
    assert lm_scoring.cross_entropy_difference(empty, ids).count() == 0
    assert lm_scoring.cross_entropy_difference(awkward, ids.where("false")).count() == awkward.count()
