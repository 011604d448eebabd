import zlib

import numpy as np
import pyarrow as pa
import pytest

from tablejury.llm import quality
from tablejury.llm.common import text_buffer

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy(tables):
    docs, labels = tables
    rows = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
               for i, r in rows.items())
    held = [(r.quality, rows[r.doc_id].predicted) for r in labels.collect() if rows[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) >= 0.96
    assert np.mean([b == 0 for a, b in held if a == 0]) >= 0.9 and np.mean([b == 1 for a, b in held if a == 1]) >= 0.96


def test_held_out_labels_have_no_influence(tables):
    docs, labels = tables
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(), 1 - quality.F.col("quality"))
                                .otherwise(quality.F.col("quality")).cast("int"))
    docs = docs.limit(120)
    one, two = ({r.doc_id: r.score for r in quality.score(docs, x).collect()} for x in (labels, flipped))
    assert one == two


def test_word_vectors_equal_a_loop(spark):
    texts = ["a b a c! a", "", None, "b b  x\n12 a", "é*** é"]
    got = quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string"), buckets=64, width=8)
    index, want = quality.index_vectors(64, 8).astype(np.int64), np.zeros((64, 8))
    for t in texts:
        ids, _ = quality.tokens(*text_buffer(pa.array([t], pa.string())), 64)
        for i in range(len(ids)):
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                if i != j:
                    want[ids[i]] += index[ids[j]]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1)
    assert np.allclose(got, want)


def test_folding_equals_the_plain_network():
    rng = np.random.default_rng(0)
    vectors, texts = rng.normal(size=(50, 6)), pa.array(["a b c", "d d d e", "", "f 1 2 ##"])
    x = quality.pooled(texts, vectors)
    y = np.array([0.0, 1.0] * 20)
    net = quality.Network(np.vstack([rng.normal(size=6) + 2 * v for v in y]), y)
    table, bias = net.folded(vectors)
    plain = 1 / (1 + np.exp(-net._logits((x - net.mean) / net.scale) / net.temperature))
    assert np.allclose(net.scores(quality.pooled(texts, table), bias), plain, atol=1e-5)


def test_awkward_rows(spark, awkward, empty, no_labels):
    some = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, None), (None, 1, 0), (7, 0, 0), (7, 1, 0), (6, 5, 0), (8, 1, 1), (9, 0, 0),
                                  (10, 0, 0), (11, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (some, no_labels):
        rows = quality.score(awkward, labels).collect()
        assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.score(awkward, no_labels).collect()} == {0.5}
    kept = quality.accepted(awkward, no_labels)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()
    assert quality.score(empty, some).count() == 0 and quality.accepted(empty, no_labels).count() == 0
