import math

import numpy as np
import pytest

from tablejury.llm import topk


def brute(rows, k=20):
    vectors = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(64 * float(x)) for x in v]
        vectors[i] = min(vectors.get(i, q), q)
    out = set()
    for i, q in vectors.items():
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in vectors.items() if j != i)
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])}
    return out


def run(spark, rows, **sizes):
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    return {tuple(r) for r in topk.top_k(v, v.where("vec_id % 20 = 0"), **sizes).select("query_id", "rank", "vec_id", "score").collect()}


@pytest.mark.parametrize("sizes", [{}, {"block": 16, "query_block": 3}])
def test_random_vectors_of_uneven_length(spark, sizes):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.1 + i % 7, 12)], 0) for i in range(300)]
    assert run(spark, rows, **sizes) == brute([r[:2] for r in rows])


def test_ties_repeats_and_bad_rows(spark):
    rows = [(i, [0.5, 0.25], 0) for i in range(100)] + [(0, [0.5, 0.25], 1), (20, [0.25, 0.75], None)]
    rows += [(200, None, 0), (201, [None, 1.0], 0), (202, [float("nan"), 1.0], 0), (203, [float("inf"), 0.0], 0),
             (None, [1.0, 1.0], 0), (204, [], 0), (205, [1.0], 0), (220, [-1.0, -1.0, 3.0], 0)]
    assert run(spark, rows, block=16, query_block=2) == brute([r[:2] for r in rows])


def test_few_and_none(spark):
    assert run(spark, [(0, [1.0], 0), (1, [2.0], 0)]) == {(0, 1, 1, 64 * 128)}
    assert run(spark, []) == set()
    assert run(spark, [(0, [1.0], 0)]) == set()


def _found(q, v, bound, width, k=20):
    """Rows of one pair of blocks, searched in this process."""
    import pyarrow as pa

    order = np.argsort(-(v.astype(np.float64) ** 2).sum(1), kind="stable")
    ids, v = np.arange(len(v))[order], v[order]
    cell = [np.arange(0, 20 * len(q), 20), q, np.full(len(q), bound), ids, v]
    batch = pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x, np.int64).tobytes()], pa.binary()) for x in cell], names=list("abcde"))
    out = [r for b in topk._search(width, k, np.eye(width))([batch]) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    best = {(20 * i, j, -s) for i, x in enumerate(q) for s, j in sorted((-int(x.astype(object) @ y.astype(object)), int(j)) for j, y in zip(ids, v, strict=True) if j != 20 * i)[:k]}
    return set(out), best


def test_open_pairs_are_scored_by_matrix_products(monkeypatch):
    """Where most pairs are open, none is gathered and scored on its own."""
    rng = np.random.default_rng(5)
    q, v = rng.integers(-3, 4, (30, 8)), rng.integers(-3, 4, (900, 8))  # small numbers, many ties
    monkeypatch.setattr(topk.np, "einsum", lambda *_: pytest.fail("pairs scored one by one"))
    found, best = _found(q, v, np.iinfo(np.int64).min, 8)
    assert found == best


def test_numbers_beyond_doubles_are_scored_as_integers():
    rng = np.random.default_rng(6)
    q, v = rng.integers(2 ** 29, 2 ** 30, (4, 2)), rng.integers(2 ** 29, 2 ** 30, (700, 2))
    found, best = _found(q, v, np.iinfo(np.int64).min, 2)
    assert found == best
