import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablejury.operators import neighbours, privacy as P
from tablejury.operators.neighbours import build_cells, nearest_distances, search


def vectors(spark, x):
    return spark.createDataFrame(pd.DataFrame({"vec": list(x)}), "vec array<double>")


def brute(q, p):
    return np.sqrt(((q[:, None, :] - p[None, :, :]) ** 2).sum(axis=2)).min(axis=1)


@pytest.mark.parametrize("width,kind,cell_rows", [(1, "even", 100), (2, "even", None), (3, "tied", 300), (6, "tailed", 200), (9, "grid", 250)])
def test_equals_brute_force_over_many_leaves(spark, width, kind, cell_rows):
    rng = np.random.default_rng(width)
    p, q = rng.normal(size=(1500, width)), rng.normal(size=(900, width)) * 1.5
    if kind == "tied":  # a third of all points share one value in two columns
        p[:500, :2], q[:300, :2] = 0.0, 0.0
        p, q = np.round(p, 1), np.round(q, 1)
    if kind == "tailed":
        p[:, 0], q[:, 0] = np.exp(9 * p[:, 0]), np.exp(9 * q[:, 0])
    if kind == "grid":
        p, q = np.unique(np.round(p), axis=0), np.unique(np.round(q), axis=0)
    got = nearest_distances(vectors(spark, q), vectors(spark, p), leaf_rows=40, cell_rows=cell_rows).toPandas()
    want = {tuple(v): d for v, d in zip(q, brute(q, p))}
    assert len(got) == len(want)
    assert np.allclose([want[tuple(v)] for v in got["vec"]], got["distance"], atol=1e-12)


def test_copies_and_a_crowded_leaf(spark):
    p = np.vstack([np.zeros((2000, 2)), np.arange(400).reshape(-1, 2)])
    q = np.vstack([np.zeros((3000, 2)), np.random.default_rng(1).normal(size=(2500, 2)) * 0.01])
    got = nearest_distances(vectors(spark, q), vectors(spark, p), leaf_rows=20, cell_rows=50).toPandas()
    want = {tuple(v): d for v, d in zip(q, brute(q, np.unique(p, axis=0)))}
    assert np.allclose([want[tuple(v)] for v in got["vec"]], got["distance"])


def test_cells_hold_every_point_within_the_limit(spark):
    rng = np.random.default_rng(3)
    x = np.unique(np.vstack([np.exp(12 * rng.normal(size=(2000, 3))), rng.normal(size=(2000, 3)) * 1e-9, [[0, 0, k * 5e-324] for k in range(50)]]), axis=0)
    cells = build_cells(vectors(spark, x), 60)
    node = cells.locate(x)
    for end, (n, low, high) in cells.ends.items():
        mine = x[node == end]
        assert 0 < len(mine) == n <= 60
        assert (mine.min(axis=0) == low).all() and (mine.max(axis=0) == high).all()
    assert sum(n for n, _, _ in cells.ends.values()) == len(x)


def test_many_columns_leave_most_leaves_out(spark):
    """14 columns that three measures lie behind, as in a table of people: bounds tighten from leaf to leaf."""
    rng = np.random.default_rng(14)
    p, q = (rng.normal(size=(6000, 3)) @ rng.normal(size=(3, 14)) + rng.normal(size=(6000, 14)) * 0.05 for _ in range(2))
    q = p[:2000] + rng.normal(size=(2000, 14)) * 0.05
    got = search(vectors(spark, q), vectors(spark, p), leaf_rows=32, cell_rows=500).toPandas()
    want = {tuple(v): d for v, d in zip(q, brute(q, p))}
    assert np.allclose([want[tuple(v)] for v in got["vec"]], got["distance"], atol=1e-12)
    assert got["leaves"].mean() < 0.15 * 6000 / 16


def micro(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    real = pd.DataFrame({"source": "real", "row_id": range(n), "x": rng.normal(size=n), "y": rng.normal(size=n) * 50, "c": 4.0})
    same = real.assign(source="same")
    far = real.assign(source="far", x=real["x"] + 3)
    return spark.createDataFrame(pd.concat([real, same, far]))


def test_linkage_of_identical_tables_is_zero(spark):
    out = {r["source"]: r for r in P.record_linkage(micro(spark), ["x", "y", "c"]).collect()}
    assert out["same"]["max_distance"] == 0.0 and out["same"]["linkage_success_rate"] == 0.0
    assert out["far"]["mean_distance"] > 0.3


def test_mahalanobis_falls_back_when_singular(spark):
    """A constant column makes the covariance singular, so the Euclidean distance is used."""
    a = P.record_linkage(micro(spark), ["x", "c"], "mahalanobis").toPandas().set_index("source")["mean_distance"]
    b = P.record_linkage(micro(spark), ["x", "c"]).toPandas().set_index("source")["mean_distance"]
    assert np.allclose(a.sort_index(), b.sort_index())


def newton_logistic(x, y, c=1.0):
    x1, w = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    ridge = np.diag([0.0] + [1.0 / c] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x1 @ w))
        w -= np.linalg.solve(x1.T @ (x1 * (p * (1 - p))[:, None]) + ridge, x1.T @ (p - y) + ridge @ w)
    return w


def test_attack_matches_an_independent_fit(spark):
    tables = micro(spark)
    sample = P.attack_sample(tables, ["x", "y"], ["row_id"]).toPandas()
    out = P.membership_inference(tables, ["x", "y"], ["row_id"]).toPandas().set_index("method")
    for method, part in sample.groupby("method"):
        train, test = part[part["is_train"]], part[~part["is_train"]]
        assert len(train) == int(0.7 * len(part))
        mean, sd = train[["x", "y"]].mean(), train[["x", "y"]].std(ddof=0)
        w = newton_logistic(((train[["x", "y"]] - mean) / sd).to_numpy(), train["label"].to_numpy())
        score = np.c_[np.ones(len(test)), ((test[["x", "y"]] - mean) / sd).to_numpy()] @ w
        right = (score > 0).astype(int) == test["label"].to_numpy()
        ranks = pd.Series(score).rank().to_numpy()
        y = test["label"].to_numpy()
        auc = (ranks[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
        assert out.loc[method, "overall_accuracy"] == pytest.approx(right.mean(), abs=0.02)
        assert out.loc[method, "auc"] == pytest.approx(auc, abs=0.01)
    assert out.loc["far", "auc"] > 0.95


def test_attack_on_two_halves_of_one_table_is_a_coin_flip(spark):
    rng = np.random.default_rng(5)
    both = pd.DataFrame({"source": np.where(np.arange(8000) % 2 == 0, "real", "half"), "row_id": np.arange(8000),
                         "x": rng.normal(size=8000), "y": rng.normal(size=8000)})
    row = P.membership_inference(spark.createDataFrame(both), ["x", "y"], ["row_id"], cap=None).first()
    assert abs(row["mia_discrimination"] - 0.5) < 0.05 and abs(row["auc"] - 0.5) < 0.05
    assert row["n_train"] + row["n_test"] == 8000


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)], "score double, label int")
    assert P.exact_auc(df, "score", "label", []).first()["auc"] == pytest.approx(0.875)


def test_imputation_uses_the_real_means(spark):
    df = spark.createDataFrame([("real", 1.0), ("real", 3.0), ("real", None), ("s", None)], "source string, x double")
    scale = P.real_scale(df, ["x"])
    assert scale["x"][0] == 2.0 and scale["x"][1] == pytest.approx(np.std([1, 3, 2]))
    assert [r["x"] for r in P.standardise(df, ["x"], scale).filter(F.col("source") == "s").collect()] == [0.0]


def test_pairs_are_not_written_and_finished_queries_leave(spark, monkeypatch):
    """Only queries with cells still to visit go into a further round; pairs of query and cell are never stored."""
    written, store = [], neighbours.shared_table

    def shared_table(df, purpose):
        out = store(df, purpose)
        written.append((purpose, out.count()))
        return out

    monkeypatch.setattr(neighbours, "shared_table", shared_table)
    rng = np.random.default_rng(21)
    p = rng.normal(size=(3000, 3))
    q = np.vstack([p[:1500], rng.normal(size=(100, 3)) * 1.5])  # most are points themselves: nothing is nearer
    got = nearest_distances(vectors(spark, q), vectors(spark, p), leaf_rows=40, cell_rows=200).toPandas()
    want = {tuple(v): d for v, d in zip(q, brute(q, p))}
    assert len(got) == len(want) and np.allclose([want[tuple(v)] for v in got["vec"]], got["distance"], atol=1e-12)
    bounds = [n for purpose, n in written if purpose == "bounds"]
    assert bounds[0] == len(q) and len(bounds) > 2 and bounds[2] < len(q) / 2
    most = sum(n for purpose, n in written if purpose not in ("points", "leaves", "queries", "bounds"))
    assert most < len(q)
