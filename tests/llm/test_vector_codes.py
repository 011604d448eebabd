import hashlib
import math

import numpy as np
import pytest

from tablejury.llm import vector_codes


def brute(rows, parts=16, entries=64, rounds=2, scale=256):
    """Codes by plain whole-number loops: (id, code, error, label error, checksum) of each row."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    cut = [[(v + [0] * (parts * width - len(v)))[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, rows_key(kept[r][1])))[:entries]
    books = [[list(cut[r][p]) for r in order] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(near(c[p], books[p])[1], []).append(c[p])
            for e, members in groups.items():
                books[p][e] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    fit = [e if e < 1 << 63 else None for e in errors]
    total = {k: v if v < 1 << 63 else None for k, v in by_label.items()}
    return [(i, "".join(f"{e:02x}" for _, e in f), e_, total[label], digest) for (i, _, label), f, e_ in zip(kept, found, fit, strict=True)]


def rows_key(v):
    return tuple(v)


def ours(spark, rows, kind="float", **sizes):
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], f"vec_id long, embedding array<{kind}>, label int, id string, codes int")
    return sorted((tuple(r) for r in vector_codes.compress(df.repartition(3), **sizes).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 4, 8, 32])
def test_transform_keeps_distances_and_orders_by_sign_changes(n):
    rng = np.random.default_rng(n)
    a, b = rng.integers(-99, 99, (2, 5, n))
    h = vector_codes.walsh(np.eye(n, dtype=np.int64))
    assert (np.abs(h) == 1).all() and (h @ h.T == n * np.eye(n)).all()
    assert ((h[1:] != h[:-1]).sum(axis=0) == np.arange(n)).all()
    assert (((vector_codes.walsh(a) - vector_codes.walsh(b)) ** 2).sum(1) == n * ((a - b) ** 2).sum(1)).all()


@pytest.mark.parametrize("width, most", [(1, 3), (3, 4), (4, 200), (7, 2 ** 35), (4, 2 ** 61)])
def test_nearest_entry(width, most):
    rng = np.random.default_rng(width)
    x, c = rng.integers(-most, most, (300, width)), rng.integers(-most, most, (40, width))
    c[7] = c[3]
    index, distance = vector_codes.nearest(x, c)
    for row, i, d in zip(x.tolist(), index.tolist(), distance.tolist(), strict=True):
        assert (d, i) == min((sum((a - b) ** 2 for a, b in zip(row, e, strict=True)), k) for k, e in enumerate(c.tolist()))


@pytest.mark.parametrize("width, sizes", [(64, {}), (30, {"entries": 5, "rounds": 3}), (5, {"parts": 2, "entries": 4})])
def test_codes_equal_brute_force(spark, width, sizes):
    rng = np.random.default_rng(width)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, width)], int(i) % 3 or None) for i in rng.permutation(200)]
    assert ours(spark, rows, **sizes) == sorted(brute(rows, **sizes), key=str)


def test_awkward_rows(spark):
    v = [0.25, -0.5, 0.001, -0.001, 1.0] * 4
    rows = [(1, v, 1), (1, v, 1), (2, v[::-1], None), (3, None, 1), (4, [*v[:-1], None], 1), (5, [*v[:-1], math.nan], 2), (6, [math.inf, *v[1:]], 2),
            (None, [0.5] * 20, 7), (None, None, None), (8, [], 7), (9, v[:7], None), (10, [1e6] * 20, 9), (11, [-3e8] * 20, 10), (12, v, 2)]
    assert ours(spark, rows, "double") == sorted(brute(rows), key=str)
    assert ours(spark, rows, "double", entries=2) == sorted(brute(rows, entries=2), key=str)
    beyond = ours(spark, [*rows, (13, [1e300] * 20, 3)], "double")
    assert [r for r in beyond if r[0] == 13] == [(13, None, None, None, beyond[0][4])]
    assert [r for r in beyond if r[0] != 13] == sorted(brute(rows), key=str)
    assert ours(spark, []) == [] and ours(spark, [(1, None, 1)]) == []


def test_errors_beyond_a_long(spark):
    rows = [(1, [1e8] * 16, 1), (2, [-1e8] * 16, 1), (3, [0.0] * 16, 2)]
    got = ours(spark, rows, entries=1, rounds=0)
    assert got == sorted(brute(rows, entries=1, rounds=0), key=str)
    assert [r[2] for r in got] == [0, None, 16 * int(256e8) ** 2 if 16 * int(256e8) ** 2 < 1 << 63 else None]


def test_decoding_gives_the_entries(spark):
    rng = np.random.default_rng(4)
    rows = vector_codes.prepared(spark.createDataFrame([(i, rng.normal(size=12).tolist(), 0) for i in range(50)], "vec_id long, embedding array<double>, label int"))
    books = vector_codes.fit(rows, parts=3, entries=50, rounds=0)
    back = {r.id: r.v for r in vector_codes.decode(vector_codes.encode(rows, books), books).collect()}
    assert all(back[r.id] == [math.floor(256 * x) / 256 for x in r.v] for r in rows.collect()) and len(back) == 50
