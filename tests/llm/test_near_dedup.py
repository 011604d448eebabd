import math
import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablejury.llm import near_dedup

SF = "/root/testdata/sf0.001"


def shingles(text):
    table = {i: i + 32 for i in range(65, 91)}
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < 4 else [tuple(words[i:i + 4]) for i in range(len(words) - 3)])


def brute(rows):
    """All pairs of distinct sets; components over rows."""
    sets = defaultdict(list)
    for i, t in rows:
        sets[shingles(t)].append(i)
    keys = [s for s in sets if s]
    root = {s: s for s in keys}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for a in range(len(keys)):
        for b in range(a):
            x, y = keys[a], keys[b]
            if 100 * len(x & y) >= 80 * len(x | y):
                root[find(x)] = find(y)
    members = defaultdict(list)
    for s in keys:
        members[find(s)] += [i for i in sets[s] if i is not None]
    out = []
    for i, t in rows:
        s = shingles(t)
        least = min(members[find(s)], default=None) if s else i
        out.append((i, len(s), least, i == least))
    return sorted(out, key=str)


def run(df):
    return sorted([tuple(r) for r in near_dedup.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()], key=str)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert run(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("near", [64, 6])
def test_a_crowd_of_near_copies_around_a_shared_passage(spark, monkeypatch, near):
    """More near copies than the window, chains of links, and clean texts with a common passage."""
    monkeypatch.setattr(near_dedup, "NEAR", near)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    base = rng.choices(words, k=120)
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    passage = rng.choices(words, k=60)
    rows += [(1000 + i, " ".join(passage + rng.choices(words, k=rng.randint(40, 90)))) for i in range(100)]
    chain = rng.choices(words, k=200)
    for i in range(10):
        chain = chain[4:] + rng.choices(words, k=4)
        rows.append((2000 + i, " ".join(chain).upper()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, want = run(docs), brute(rows)
    assert sum(a != b for a, b in zip(got, want, strict=True)) == 0


def test_sets_that_the_forest_did_not_search_are_compared_exactly(spark, monkeypatch):
    """Distinct texts around one passage, alike but below the bound, hide a few links; every set is left as crowded."""
    def crowd(sets, near, best):
        return sets.selectExpr("set_id AS a", "set_id AS b").where("false"), sets.select("set_id")

    monkeypatch.setattr(near_dedup, "candidates", crowd)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(4000)]
    passage, rows = rng.choices(words, k=85), [(500, "one"), (501, "two words"), (502, "")]
    for i in range(60):
        own = rng.choices(words, k=15)
        rows.append((i, " ".join(passage + own)))
        if i % 6 == 0:
            rows.append((1000 + i, " ".join(passage + own[:7] + rng.choices(words, k=i % 9))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, want = run(docs), brute(rows)
    assert sum(not r[3] for r in want) >= 10 and got == want


def test_a_region_that_a_cut_splits_is_crowded(spark, monkeypatch):
    """Regions a little longer than the window, some over a partition cut: the ends are too far apart to be compared."""
    monkeypatch.setattr(near_dedup, "TREES", 1)
    rng, rows = random.Random(3), []
    for region in range(230):
        for i in range(70):
            key = (region * 7919).to_bytes(4) + i.to_bytes(28)
            rows.append((key, 10, rng.randbytes(32), key, key, 1))
    sets = spark.createDataFrame(rows, "set_id binary, n_shingles long, sketch binary, signature binary, root binary, weight long")
    _, crowded = near_dedup.candidates(sets, near=64, best=2)
    left = {bytes(r.set_id) for r in crowded.collect()}
    assert not [r[0] for r in rows if int.from_bytes(r[0][4:]) in (0, 1, 2, 3, 4, 5, 64, 65, 66, 67, 68, 69) and r[0] not in left]


def test_awkward_rows(awkward, empty):
    assert run(awkward) == brute([(r.doc_id, r.text) for r in awkward.collect()])
    assert run(empty) == []
    kept = near_dedup.deduplicated(awkward)
    assert kept.columns == awkward.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {3, 4, 5, 6, 7, None} <= ids and 2 not in ids


def test_components_of_a_long_path(spark):
    n = 300
    links = spark.createDataFrame([(i.to_bytes(2), (i + 1).to_bytes(2)) for i in range(n)], "a binary, b binary")
    rows = near_dedup.components(links).collect()
    assert len(rows) == n and {bytes(r.root) for r in rows} == {(0).to_bytes(2)}


def test_a_document_without_id_links_others(spark):
    """Two documents that are not alike but both alike to a third one, whose doc_id is NULL."""
    words = [f"w{i}" for i in range(200)]
    middle, left, right = words, ["x"] * 20 + words[20:], words[:-20] + ["y"] * 20
    rows = [(1, " ".join(left)), (2, " ".join(right)), (None, " ".join(middle))]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [{tuple(w[i:i + 4]) for i in range(len(w) - 3)} for w in (left, right, middle)]
    like = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    assert like(sets[0], sets[2]) and like(sets[1], sets[2]) and not like(sets[0], sets[1])
    assert got == {1: 1, 2: 1, None: 1}


def test_commonness_reaches_the_driver_as_columns(spark):
    """A full table of buckets takes a few bytes a bucket in the driver, also where Arrow is off by default."""
    bits, n = 17, 1 << 17
    full = spark.range(64).select(F.expr(f"id * {n // 64} AS low")).mapInArrow(_sets_of_buckets(bits, n // 64), "shingles binary")
    before = spark.conf.get("spark.sql.execution.arrow.pyspark.enabled")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    tracemalloc.start()
    try:
        got, peak = near_dedup._commonness(full, bits), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", before)
    assert got.dtype == np.uint32 and (got == 1 + (np.arange(n) % 2 == 0)).all()
    assert peak < 40 * n


def _sets_of_buckets(bits, size):
    """Two sets a row: one shingle in every bucket of a stretch, and one in every second."""
    def make(batches):
        for batch in batches:
            for low in batch.column(0).to_pylist():
                stretch = (low + np.arange(size, dtype=np.uint64)) << np.uint64(64 - bits)
                yield pa.RecordBatch.from_arrays([pa.array([stretch.tobytes(), stretch[::2].tobytes()], pa.binary())], names=["shingles"])
    return make


def test_texts_around_one_passage_are_no_candidates(spark):
    """Alike by six tenths: the sketches of two bits let many of these pairs through."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(80)]
    rows = [(i, " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(25)])) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = near_dedup.signatures(docs).selectExpr("set_id", "n_shingles", "signature", "sketch", "set_id AS root", "1L AS weight")
    pairs, _ = near_dedup.candidates(sets)
    assert pairs.isEmpty()
    assert [r[2] for r in run(docs)] == [r[2] for r in brute(rows)]


@pytest.mark.parametrize("size", [1, 5, 60, 129, 700, 5000])
def test_parities_leave_every_link_open(size):
    rng = np.random.default_rng(size)
    closed = 0
    for share in [*np.linspace(0.3, 1, 60), 0.8]:
        both, only = int(size * share), size - int(size * share)
        x, y = (np.unique(rng.integers(0, 2**64, both + only, np.uint64)) for _ in range(2))
        y = np.unique(np.concatenate([x[:both], y[:rng.integers(0, only + 1)]]))
        links = near_dedup._overlap(x.tobytes(), y.tobytes())
        may = near_dedup._may_link(*(near_dedup._sized_parity(s) for s in (x, y)))
        assert may or not links
        assert links == (100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y)))
        closed += not may
    assert closed > 20 or size < 5


def test_the_marks_that_a_set_may_have():
    """Two sets at the bound meet in so few trees by a chance below 1e-7; with few trees any mark counts."""
    chance = lambda k: sum(math.comb(16, i) * 0.8 ** i * 0.2 ** (16 - i) for i in range(k + 1))
    assert near_dedup.spare(16) == 2 and chance(2) < 1e-7 <= chance(3)
    assert near_dedup.spare(1) == near_dedup.spare(4) == 0


@pytest.mark.parametrize("marked", [0, 1, 2, 3, 16])
def test_a_set_is_crowded_once_long_regions_hide_it_in_more_than_two_trees(spark, marked):
    rng, rows, rest = random.Random(13), [], near_dedup.CHUNK - 4
    for i in range(70):
        own = [(t < marked) and b"same" or rng.randbytes(4) for t in range(near_dedup.TREES)]
        key = i.to_bytes(16)
        rows.append((key, 10, rng.randbytes(64), b"".join(first + i.to_bytes(rest) for first in own), key, 1))
    sets = spark.createDataFrame(rows, "set_id binary, n_shingles long, sketch binary, signature binary, root binary, weight long")
    pairs, crowded = near_dedup.candidates(sets, near=64, best=2)
    left = sorted(int.from_bytes(r.set_id) for r in crowded.collect())
    assert pairs.isEmpty() and left == ([*range(6), *range(64, 70)] if marked > 2 else [])


def test_a_round_that_links_next_to_nothing_is_the_last(spark, monkeypatch):
    """One link among hundreds of crowded sets: the exact comparison finds the others at once."""
    calls = []

    def crowd(sets, near, best):
        calls.append(near)
        rows = sets.select("set_id", "doc_id")
        two = rows.where("doc_id IN (0, 1000)").agg(F.min("set_id").alias("a"), F.max("set_id").alias("b"))
        return two, rows.select("set_id")

    monkeypatch.setattr(near_dedup, "candidates", crowd)
    rng = random.Random(17)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))) for i in range(300)]
    rows += [(1000 + i, text + " more") for i, text in rows[::30]]
    got = run(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows) and sum(not r[3] for r in got) == 10
    assert calls == [near_dedup.NEAR]
