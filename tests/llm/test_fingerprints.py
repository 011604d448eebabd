import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tablejury.llm import fingerprints
from tablejury.llm.common import text_buffer

SF = "/root/testdata/sf0.001"


def check(rows, texts):
    """texts in descending order of id."""
    rows = sorted(rows, key=lambda r: -r.doc_id)
    assert [r.doc_id for r in rows] == [i for i, _ in texts]
    same = {}
    for n, (r, (_, t)) in enumerate(zip(rows, texts, strict=True)):
        t, after = t or "", texts[(n + 1) % len(texts)][1] or ""
        cut = len(t) // 3
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256((t[:len(t) - cut] + after[:cut]).encode()).hexdigest()
        assert same.setdefault(t, r.fingerprint) == r.fingerprint
        assert r.near_next == sum(a == b for a, b in pieces(r, rows[(n + 1) % len(rows)])) / max(1, len(pieces(r, rows[(n + 1) % len(rows)]))) \
            or not pieces(r, rows[(n + 1) % len(rows)])
        assert 0 <= r.near_edited <= 1


ALL = 2 ** 64 - 1


def scramble(x):
    x ^= x >> 31
    x = x * 0xBF58476D1CE4E5B9 & ALL
    x ^= x >> 29
    x = x * 0x94D049BB133111EB & ALL
    return x ^ x >> 32


def tossed(symbols):
    out = []
    for i, x in enumerate(symbols):
        differ = x ^ symbols[i - 1] if i else 1
        bit = (differ & -differ).bit_length() - 1
        out.append(2 * bit + (x >> bit & 1))
    return out


def parsed(text):
    """The minima of a text, one symbol after the other."""
    symbols, level, bins = [b + 1 for b in text.encode()], 0, {}
    weights = [scramble(i + 1) | 1 for i in range(200)]
    while symbols:
        x = [scramble(v + sum(1 for _ in run) * 0x9E3779B97F4A7C15 & ALL) for v, run in groupby(symbols)]
        c = x
        for _ in range(4):
            c = tossed(c)
        found = []
        for i, v in enumerate(x):
            if i == 0 or (i < len(x) - 1 and c[i] > c[i - 1] and c[i] >= c[i + 1]):
                found.append([])
            found[-1].append(v)
        names = [scramble(sum(v * w for v, w in zip(phrase, weights)) & ALL) for phrase in found]
        level += 1
        if level >= fingerprints.LEVEL or len(names) == 1:
            for name in names:
                h = scramble(name + (level if level >= fingerprints.LEVEL else 0) & ALL)
                bins[h >> 58] = min(bins.get(h >> 58, ALL), h >> 40 & 0xFFFF)
        symbols = names if len(names) > 1 else []
    return bins


def shown(bins):
    return "".join(f"{bins[i]:04x}" if i in bins else "----" for i in range(fingerprints.BINS))


def alike(a, b):
    used = set(a) | set(b)
    return sum(a.get(i) == b.get(i) for i in used) / len(used) if used else 1.0


def test_against_a_plain_parse(spark):
    """Every fingerprint and likeness of all documents, their edited texts and some awkward ones."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = [(-1, ""), (-2, None), (-3, "a"), (-4, "aaaa" * 99), (-5, "ab" * 300), (-6, "é😀 " * 50), (-7, "\x00\x01"), (-8, "x")]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).repartition(5)
    texts = [r.text or "" for r in docs.orderBy(F.desc("doc_id")).collect()]
    rows = fingerprints.fingerprints(docs).orderBy(F.desc("doc_id")).collect()
    plain = [parsed(t) for t in texts]
    for n, (r, t) in enumerate(zip(rows, texts, strict=True)):
        after = (n + 1) % len(texts)
        cut = len(t) // 3
        changed = parsed(t[:len(t) - cut] + texts[after][:cut])
        assert (r.fingerprint, r.edited_fingerprint) == (shown(plain[n]), shown(changed))
        assert (r.near_edited, r.near_next) == (alike(plain[n], changed), alike(plain[n], plain[after]))


def pieces(r, s):
    a, b = ([x.fingerprint[i:i + 4] for i in range(0, 4 * fingerprints.BINS, 4)] for x in (r, s))
    return [(x, y) for x, y in zip(a, b, strict=True) if x != "----" or y != "----"]


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    rows = fingerprints.fingerprints(docs.repartition(7)).collect()
    check(rows, texts)
    long = [r for r in rows if r.n_chars >= 1000]
    assert 0.4 < np.mean([r.near_edited for r in long]) < 0.6 and np.mean([r.near_next for r in long]) < 0.02


def test_equal_substrings_share_their_phrases_at_any_offset():
    rng = np.random.default_rng(1)
    body = "".join(rng.choice(list("abcdefghij  .,\n"), 6000))
    for lead in range(0, 40, 3):
        a, b = fingerprints.sketches(*text_buffer(pa.array([body, "x" * lead + "yz"[lead % 2:] + body + "tail" * lead])))
        assert fingerprints.likeness(a[None], b[None])[0] > 0.85


def test_a_text_does_not_depend_on_its_neighbours():
    texts = ["aaaa", "", "abababab" * 50, "é" * 33, "some words here", "a", "ab", "\x00\x00"]
    together = fingerprints.sketches(*text_buffer(pa.array(texts)))
    for i, t in enumerate(texts):
        assert (fingerprints.sketches(*text_buffer(pa.array([t])))[0] == together[i]).all()


def test_phrases_are_short_and_cover_the_text():
    rng = np.random.default_rng(2)
    for x in (rng.integers(1, 200, 5000).astype(np.uint64), np.arange(1, 5000, dtype=np.uint64), np.repeat(np.uint64(7), 900)):
        names, doc = fingerprints.phrases(x, np.zeros(len(x), np.int64))
        assert 1 <= len(names) <= max(1, len(x) // 2)
        if len(set(x.tolist())) > 1:
            assert len(names) >= len(x) // 16


def test_awkward_rows(spark, awkward, empty):
    assert fingerprints.fingerprints(empty).count() == 0
    rows = fingerprints.fingerprints(awkward).collect()
    assert len(rows) == awkward.count() and sum(r.doc_id is None for r in rows) == 2
    one = spark.createDataFrame([(1, "abc" * 50)], "doc_id long, text string")
    r = fingerprints.fingerprints(one).first()
    assert r.near_next == 1.0
    two = fingerprints.fingerprints(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert {x.near_next for x in two} == {1.0} and {x.n_chars for x in two} == {0}
