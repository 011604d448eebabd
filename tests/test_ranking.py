import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablejury.functions import ranking as R
from tablejury.functions.digests import digest, unit


@pytest.fixture(scope="module")
def rows(spark):
    """Three keys, one of which holds a third of all rows under one value."""
    df = spark.range(6000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "warm")
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("key"),
        F.when(F.col("id") % 3 == 0, 1.5).otherwise(F.round(unit(digest("v", "id")) * 100, 1)).alias("value"))
    return df.withColumn("_digest", digest(1, "id")).cache()


def ordered(rows):
    return rows.toPandas().sort_values(["key", "_digest"])


def test_bottom_n_takes_exactly_the_smallest_digests(rows):
    quota = rows.groupBy("key").agg((F.count("*") / 2).cast("int").alias("n_take"))
    for digits in (1, 2, 3):
        got = set(R.bottom_n(rows, ["key"], quota, tie=["id"], hex_digits=digits).toPandas()["id"])
        want = set()
        for key, part in ordered(rows).groupby("key"):
            want |= set(part["id"].head(len(part) // 2))
        assert got == want


def test_bottom_n_beyond_the_group_keeps_all_and_zero_keeps_none(spark, rows):
    keys = [r["key"] for r in rows.select("key").distinct().collect()]
    quota = spark.createDataFrame([(k, 10 ** 9 if k == "hot" else 0) for k in keys], "key string, n_take bigint")
    got = R.bottom_n(rows, ["key"], quota, tie=["id"])
    assert {r["key"] for r in got.select("key").distinct().collect()} == {"hot"}
    assert got.count() == rows.filter("key = 'hot'").count()


def test_flag_bottom_n_keeps_every_row(spark, rows):
    quota = spark.createDataFrame([(4200,)], "n_take bigint")
    flagged = R.flag_bottom_n(rows, [], quota, "kept", tie=["id"])
    assert flagged.count() == 6000 and flagged.filter("kept").count() == 4200


def test_digest_rank_matches_a_sort(rows):
    got = R.digest_rank(rows, ["key"], tie=["id"]).toPandas().set_index("id")["rank"]
    frame = ordered(rows)
    want = (frame.groupby("key").cumcount() + 1).set_axis(frame["id"])
    assert (got.sort_index() == want.sort_index()).all()


def test_prefix_sums_and_average_ranks(rows):
    got = R.average_ranks(rows, ["key"], "value").toPandas()
    frame = rows.toPandas()
    frame["rank"] = frame.groupby("key")["value"].rank()
    want = frame.groupby(["key", "value"])["rank"].first()
    merged = got.set_index(["key", "value"])["avg_rank"]
    assert np.allclose(merged.sort_index(), want.sort_index())


def test_quantiles_of_hot_keys(rows):
    probs, names = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0), ["a", "b", "c", "d", "e", "f"]
    got = R.quantiles(rows, ["key"], "value", probs, names).toPandas().set_index("key")
    want = rows.toPandas().groupby("key")["value"].quantile(list(probs)).unstack()
    assert np.allclose(got.sort_index()[names].to_numpy(), want.sort_index().to_numpy())


def test_quantiles_of_heavy_tails_and_weights(spark):
    values = pd.DataFrame({"v": np.r_[np.exp(np.linspace(-20, 20, 3000)), [0.0] * 1500]})
    df = spark.createDataFrame(values)
    got = R.quantiles(df, [], "v", [0.25, 0.5, 0.75], ["a", "b", "c"]).first()
    want = values["v"].quantile([0.25, 0.5, 0.75]).to_numpy()
    assert np.allclose([got["a"], got["b"], got["c"]], want, rtol=1e-9)
    weighted = spark.createDataFrame([(1.0, 3), (2.0, 1), (10.0, 2)], "v double, w int")
    assert R.quantiles(weighted, [], "v", [0.5], ["m"], weight="w").first()["m"] == np.median([1, 1, 1, 2, 10, 10])


def test_quantiles_of_all_magnitudes(spark):
    """Signs, zeros, the smallest and largest doubles, infinities, one full bin, NULL and NaN, NULL keys."""
    rng = np.random.default_rng(4)
    wide = rng.choice([-1.0, 1.0], 2000) * np.exp(rng.uniform(-744, 709, 2000))
    groups = {"wide": np.r_[wide, 0.0, -0.0, 5e-324, -5e-324, 1.7e308], "bin": 1.0 + np.arange(3000) * 1e-9,
              None: np.r_[np.full(7, 2.0), 3.0], "ends": np.array([-np.inf, -1.0, 0.0, 1.0, np.inf]), "one": np.array([4.0])}
    data = [(k, float(v)) for k, values in groups.items() for v in values] + [("wide", None), ("bin", float("nan")), ("none", None)]
    probs, names = (0.0, 0.01, 0.25, 0.5, 0.75, 1.0), ["a", "b", "c", "d", "e", "f"]
    got = {r["k"]: r for r in R.quantiles(spark.createDataFrame(data, "k string, v double").repartition(5), ["k"], "v", probs, names).collect()}
    assert set(got) == set(groups)
    for key, values in groups.items():
        assert got[key]["n"] == len(values)
        shown = probs if key != "ends" else (0.0, 0.25, 0.5, 0.75, 1.0)
        want = np.quantile(values, shown) if key != "ends" else values  # whole ranks; numpy interpolates infinities to NaN
        np.testing.assert_allclose([got[key][names[probs.index(p)]] for p in shown], want, rtol=1e-9)
    assert R.quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", probs, names).count() == 0


def test_draw_counts_equals_explicit_draws(rows):
    quota = rows.groupBy("key").agg((F.count("*") / 3).cast("int").alias("n_take"))
    tagged = rows.withColumn("even", F.col("id") % 2 == 0)
    got = R.draw_counts(tagged, ["key"], F.sequence(F.lit(1), F.lit(4)), lambda s: digest(s, "id"), quota, ["even"],
                        tie=["id"]).toPandas()
    frame = tagged.toPandas()
    import hashlib
    for seed in (1, 4):
        frame["d"] = [hashlib.md5(f"{seed}|{i}".encode()).hexdigest() for i in frame["id"]]
        for key, part in frame.groupby("key"):
            head = part.sort_values("d").head(len(part) // 3)
            mine = got[(got["draw"] == seed) & (got["key"] == key)].set_index("even")["n"]
            assert mine.to_dict() == head["even"].value_counts().to_dict()
