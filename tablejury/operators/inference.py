"""Matched samples, seed sweeps, permutation and binomial tests."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tablejury.functions import scalar as S
from tablejury.functions.digests import digest, unit
from tablejury.functions.ranking import bottom_n, draw_counts
from tablejury.functions.stats import binomial_tail_udf
from tablejury.operators import metrics as M
from tablejury.schema import FAIR_MIN_N, REAL, SYNTHETIC
from tablejury.session import spread

KEYS = ["dataset", "method", "condition"]
GROUP = ["dataset", "provider_label", "method"]


def trial_key(trials):
    """What names a trial: its file and line where the log has them, then its number, which starts again in every file."""
    return [c for c in ("source_path", "line_no") if c in trials.columns] + ["trial_id"]


def _row_digest(seed, *more, key):
    """Seeded by the cell and the model as well: trial numbers start again in every run."""
    return digest(seed, *more, *KEYS, "provider_label", *key)


def match_sizes(trials, n_models=2):
    """Per cell: the smaller trial count of the compared models, where all of them have trials."""
    counts = trials.groupBy(*KEYS, "provider_label").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*KEYS).agg(F.min("n").alias("n_match"), F.count(F.lit(1)).alias("_models")) \
        .filter(F.col("_models") == n_models).drop("_models")


def fair_quota(trials, min_n=FAIR_MIN_N):
    return match_sizes(trials).filter(F.col("n_match") >= min_n).withColumnRenamed("n_match", "n_take")


def matched_sample(trials, seed, min_n=FAIR_MIN_N, key=None):
    """Equal N per model in every fair cell: the rows with the smallest keyed digests.

    ``key`` names a row within its cell, by default ``trial_key``.
    """
    key = key or trial_key(trials)
    keyed = trials.withColumn("_digest", _row_digest(seed, key=key))
    return bottom_n(keyed, M.CELL, fair_quota(trials, min_n), tie=list(key)).drop("_digest")


def matched_check(matched):
    """N per model per cell of a matched sample, whether they agree, and the pooled metrics of the cell."""
    wide = M.cell_metrics(matched).groupBy(*KEYS).agg(
        F.min("n").alias("n_low"), F.max("n").alias("n_high"), F.count(F.lit(1)).alias("n_models"))
    return wide.withColumn("matched_equal_n", F.col("n_low") == F.col("n_high"))


def _class_drs(counts, by, suffix=""):
    """DRS from category counts (true_label, correct, n)."""
    def share(label):
        mine = F.when(F.col("true_label") == label, F.col("n"))
        right = F.when((F.col("true_label") == label) & F.col("correct"), F.col("n"))
        return F.lit(100.0) * F.coalesce(F.sum(right), F.lit(0)) / F.nullif(F.sum(mine), F.lit(0))

    real, syn = share(REAL), share(SYNTHETIC)
    return counts.groupBy(*by).agg(
        F.when(real.isNotNull() & syn.isNotNull(), F.least(real, syn)).alias(f"drs{suffix}"))


def seed_sweep(trials, first_seed=1000, n_seeds=50, min_n=FAIR_MIN_N, key=None):
    """DRS of every cell over many matched samples: mean and central 95 % range.

    The quantiles run over one value per seed, so their input is bounded by n_seeds.
    """
    key = key or trial_key(trials)
    counts = draw_counts(
        trials, M.CELL, F.sequence(F.lit(first_seed), F.lit(first_seed + n_seeds - 1)),
        lambda s: _row_digest(s, key=key), fair_quota(trials, min_n), ["true_label", "correct"],
        tie=list(key), draw="seed")
    per_seed = _class_drs(counts, [*M.CELL, "seed"])
    q = F.percentile("drs", F.array(F.lit(0.025), F.lit(0.975)))
    return per_seed.groupBy(*M.CELL).agg(
        F.count("drs").alias("n_seeds"), F.avg("drs").alias("drs_mean"), q[0].alias("q025"), q[1].alias("q975"))


def binomial_table(trials, *by):
    """Accuracy per group against chance by the one-sided exact binomial test; p on result rows only."""
    out = trials.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(S.hit()).alias("n_correct"))
    out = out.withColumn("accuracy", F.col("n_correct") / F.col("n")) \
        .withColumn("p_value", binomial_tail_udf(F.col("n_correct"), F.col("n")))
    return out.withColumn("sig", S.significance(F.col("p_value")))


def export_summary(llm, human):
    """Source x condition x label: N, correct, accuracy (4 places), p (4 places) and its mark."""
    keep = ["condition", "true_label", "correct"]
    table = binomial_table(M.tag_sources(llm.select(*keep), human.select(*keep)), "source", "condition", "true_label")
    return table.select("source", "condition", "true_label", "n", "n_correct",
                        F.bround("accuracy", 4).alias("accuracy"), F.bround("p_value", 4).alias("p_value"), "sig")


# ---- permutation test ------------------------------------------------------------

_DRAW_FIELDS = ["real_correct", "real_wrong", "syn_correct", "syn_wrong"]
_DRAW = StructType([StructField(f, LongType()) for f in _DRAW_FIELDS])


def _inverse(good, bad, n, u):
    """Hypergeometric draws at the uniform numbers ``u`` by the inverse distribution, for a population of any size.

    Values further than 12 sd from the mode weigh less than a double can hold beside 1.
    """
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    mode = (n + 1) * (good + 1) // (total + 2)
    sd = np.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(total - 1, 1)))
    first, last = max(low, mode - int(12 * sd) - 2), min(high, mode + int(12 * sd) + 2)
    k = np.arange(first, last, dtype=float)
    steps = np.log((good - k) / (k + 1)) + np.log((n - k) / (bad - n + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    share = np.cumsum(np.exp(logs - logs.max()))
    return first + np.searchsorted(share, np.asarray(u) * share[-1], "right")


def _draws(good, bad, n, u):
    """One draw per row; rows with the same parameters share one distribution."""
    out = np.where(bad == 0, n, 0)
    open_ = np.flatnonzero((good > 0) & (bad > 0) & (n > 0))
    keys, which = np.unique(np.stack([good, bad, n], axis=1)[open_], axis=0, return_inverse=True)
    order = np.argsort(which.ravel(), kind="stable")
    for key, rows in zip(keys, np.split(open_[order], np.cumsum(np.bincount(which.ravel(), minlength=len(keys)))[:-1])):
        out[rows] = _inverse(*(int(v) for v in key), u[rows])
    return out


@F.pandas_udf(_DRAW)
def _shuffled_c1(rc: pd.Series, rw: pd.Series, sc: pd.Series, sw: pd.Series, n_c1: pd.Series,
                 u1: pd.Series, u2: pd.Series, u3: pd.Series) -> pd.DataFrame:
    """Category counts that land in C1 when the condition labels of a group are shuffled; u1 to u3 are uniform."""
    counts = np.stack([rc, rw, sc, sw], axis=1).astype(np.int64).reshape(-1, 4)
    out, n = np.zeros_like(counts), n_c1.to_numpy(np.int64).copy()
    rest = counts.sum(axis=1)
    for j, u in enumerate((u1, u2, u3)):
        rest = rest - counts[:, j]
        out[:, j] = _draws(counts[:, j], rest, n, u.to_numpy(float))
        n = n - out[:, j]
    out[:, 3] = n
    return pd.DataFrame(out, columns=_DRAW_FIELDS)


# Declared non-deterministic so that no filter is pushed through it and makes it run twice.
_shuffled_c1 = _shuffled_c1.asNondeterministic()


def _count(label, correct, condition=None):
    test = (F.col("true_label") == label) & (F.col("correct") == F.lit(correct))
    if condition:
        test = test & (F.col("condition") == condition)
    return F.count_if(test)


def _drs_of(rc, rw, sc, sw):
    real = F.lit(100.0) * rc / F.nullif(rc + rw, F.lit(0))
    syn = F.lit(100.0) * sc / F.nullif(sc + sw, F.lit(0))
    return F.when(real.isNotNull() & syn.isNotNull(), F.least(real, syn))


_PARTS = (("rc", REAL, True), ("rw", REAL, False), ("sc", SYNTHETIC, True), ("sw", SYNTHETIC, False))


def group_counts(trials, group=GROUP):
    """The four label x outcome counts per group, in total and in C1, and both observed DRS."""
    both = trials.filter(F.col("condition").isin("C1", "C2"))
    out = both.groupBy(*group).agg(
        F.count_if(F.col("condition") == "C1").alias("n_c1"), F.count_if(F.col("condition") == "C2").alias("n_c2"),
        *[_count(label, ok).alias(name) for name, label, ok in _PARTS],
        *[_count(label, ok, "C1").alias(f"{name}_1") for name, label, ok in _PARTS])
    first = [F.col(f"{name}_1") for name, _, _ in _PARTS]
    second = [F.col(name) - F.col(f"{name}_1") for name, _, _ in _PARTS]
    return out.filter((F.col("n_c1") > 0) & (F.col("n_c2") > 0)) \
        .withColumn("drs_c1", _drs_of(*first)).withColumn("drs_c2", _drs_of(*second)) \
        .withColumn("delta", F.col("drs_c2") - F.col("drs_c1"))


def permutation_test(trials, n_perm=3000, seed=20260531, group=GROUP, engine="counts", key=None):
    """Is the C2 - C1 change in DRS larger than under shuffled conditions?

    ``counts`` draws the shuffled C1 counts directly from each group's four
    counts, at a cost independent of the number of trials. ``digest`` shuffles
    the trials themselves by keyed digest, which SQL can repeat. Shuffles that
    leave a class empty give no difference and are not counted.
    """
    observed, key = group_counts(trials, group), key or trial_key(trials)
    names = [name for name, _, _ in _PARTS]
    if engine == "counts":
        perms = observed.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
        perms = spread(perms, *group, "perm") \
            .withColumn("_d", _shuffled_c1(*names, "n_c1", *[unit(digest(seed, F.lit(f"u{i}"), *group, "perm")) for i in (1, 2, 3)]))
        first = [F.col(f"_d.{f}") for f in _DRAW_FIELDS]
    else:
        drawn = draw_counts(
            trials.filter(F.col("condition").isin("C1", "C2")), group,
            F.sequence(F.lit(0), F.lit(n_perm - 1)), lambda p: _row_digest(seed, p, key=key),
            observed.select(*group, F.col("n_c1").alias("n_take")), ["true_label", "correct"],
            tie=["condition", *key], draw="perm")
        wide = drawn.groupBy(*group, "perm").agg(*[
            F.coalesce(F.sum(F.when((F.col("true_label") == label) & (F.col("correct") == F.lit(ok)), F.col("n"))),
                       F.lit(0)).alias(f"_p_{name}") for name, label, ok in _PARTS])
        perms = wide.join(observed, group)
        first = [F.col(f"_p_{name}") for name in names]
    second = [F.col(name) - f for name, f in zip(names, first)]
    shuffled = perms.withColumn("_diff", _drs_of(*second) - _drs_of(*first)).filter(F.col("_diff").isNotNull())
    q = F.percentile("_diff", F.array(F.lit(0.025), F.lit(0.975)))  # one value per shuffle: bounded by n_perm
    eps = F.lit(1e-9)  # equal differences must stay equal whatever the order of the float operations

    def p_of(test):
        return F.when(F.col("delta").isNotNull(), (F.count_if(test) + 1) / (F.count("_diff") + 1))

    fields = [*group, "n_c1", "n_c2", "drs_c1", "drs_c2", "delta"]
    out = shuffled.groupBy(*fields).agg(
        F.count("_diff").alias("perm_effective_n"), q[0].alias("perm_null_q025"), q[1].alias("perm_null_q975"),
        p_of(F.col("_diff") >= F.col("delta") - eps).alias("p_one_sided_ge"),
        p_of(F.abs("_diff") >= F.abs("delta") - eps).alias("p_two_sided"))
    return out.withColumn("significant", F.col("p_two_sided") < 0.05)
