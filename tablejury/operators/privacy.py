"""Formal privacy risk: record linkage and membership inference."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tablejury.functions import scalar as S
from tablejury.functions.digests import digest
from tablejury.functions.ranking import bottom_n, flag_bottom_n, prefix_sums, quantiles
from tablejury.operators.neighbours import nearest_distances
from tablejury.session import shared_table

REAL_SOURCE = "real"


def real_scale(tables, features, by="source", real=REAL_SOURCE):
    """Mean and population sd of the real table's features after mean imputation: one row to the driver."""
    row = S.nan_to_null(tables.filter(F.col(by) == real)).agg(*[e for c in features for e in (
        F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}"), F.count(c).alias(f"k_{c}")
    )], F.count(F.lit(1)).alias("n")).first()
    scale = {}
    for c in features:
        sd = float(np.sqrt((row[f"v_{c}"] or 0.0) * row[f"k_{c}"] / max(row["n"], 1)))
        scale[c] = (row[f"m_{c}"] or 0.0, sd if sd > 0 else 1.0)  # a constant column is only centred
    return scale


def standardise(tables, features, scale):
    """Impute with the real means and scale by the real spread, as literals in one projection."""
    return S.nan_to_null(tables).select(*[
        ((F.coalesce(F.col(c).cast("double"), F.lit(scale[c][0])) - F.lit(scale[c][0])) / F.lit(scale[c][1])).alias(c)
        if c in features else F.col(c) for c in tables.columns])


def whitening(real_scaled, features):
    """Lower factor L of the inverse covariance (L L' = inverse), or None when it is singular."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    row = real_scaled.agg(*[F.covar_samp(features[i], features[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((len(features), len(features)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    try:
        return np.linalg.cholesky(np.linalg.inv(cov))
    except np.linalg.LinAlgError:
        return None


def _vector(features, factor=None):
    if factor is None:
        return F.array(*[F.col(c) for c in features])
    return F.array(*[sum((F.col(c) * F.lit(float(factor[j, k])) for j, c in enumerate(features)), F.lit(0.0))
                     for k in range(len(features))])


def linkage_distances(tables, features, metric="euclidean", by="source", real=REAL_SOURCE, keep=()):
    """(by, vec, n, distance) per distinct synthetic point, or one row per record when ``keep`` names its id."""
    scaled = standardise(tables.select(by, *keep, *features), features, real_scale(tables, features, by, real))
    reals = scaled.filter(F.col(by) == real)
    factor = whitening(reals, features) if metric == "mahalanobis" else None
    vectors = scaled.select(by, *keep, _vector(features, factor).alias("vec"))
    synthetic = vectors.filter(F.col(by) != real)
    nearest = shared_table(nearest_distances(synthetic, vectors.filter(F.col(by) == real)), "nearest")
    if keep:
        return synthetic.join(nearest, "vec").select(by, *keep, "distance")
    return synthetic.groupBy(by, "vec").agg(F.count(F.lit(1)).alias("n")).join(nearest, "vec")


def linkage_summary(distances, by="source"):
    """Mean, sd, range, median, threshold (mean + sd) and the share strictly below it, from (by, n, distance)."""
    table = shared_table(distances.select(by, "n", "distance"), "distances")
    first = table.groupBy(by).agg(F.sum("n").alias("n_records"), (F.sum(F.col("n") * F.col("distance")) / F.sum("n")).alias("mean_distance"),
                                  F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance"))
    first = shared_table(first, "means")
    gap = F.col("distance") - F.col("mean_distance")
    spread = table.join(first, by).groupBy(by).agg(
        F.sqrt(F.sum(F.col("n") * gap * gap) / F.sum("n")).alias("std_distance"))
    second = shared_table(first.join(spread, by)
                          .withColumn("threshold", F.col("mean_distance") + F.col("std_distance")), "thresholds")
    below = table.join(second, by).groupBy(by).agg(
        (F.sum(F.when(F.col("distance") < F.col("threshold"), F.col("n")).otherwise(0)) / F.sum("n"))
        .alias("linkage_success_rate"))
    median = quantiles(table, [by], "distance", [0.5], ["median_distance"], weight="n").drop("n")
    return second.join(below, by).join(median, by)


def record_linkage(tables, features, metric="euclidean", by="source", real=REAL_SOURCE):
    return linkage_summary(linkage_distances(tables, features, metric, by, real), by) \
        .withColumn("metric", F.lit(metric))


# ---- membership inference ------------------------------------------------------------

def labelled_union(tables, features, by="source", real=REAL_SOURCE, methods=None):
    """Real rows (label 1) beside each method's rows (label 0), one copy of the real rows per method.

    The names of the methods are a table of their own that real rows are joined with.
    """
    is_real = F.col(by) == real
    names = tables.filter(~is_real).select(F.col(by).alias("method")).distinct()
    if methods:
        names = names.filter(F.col("method").isin(*methods))
    names = shared_table(names.withColumn(by, F.lit(real)), "methods")
    copies = tables.filter(is_real).join(names, by).withColumn("label", F.lit(1))
    made = tables.filter(~is_real).withColumn("method", F.col(by)).withColumn("label", F.lit(0))
    return copies.unionByName(made)


def attack_sample(tables, features, row_id, seed=42, cap=5000, by="source", real=REAL_SOURCE, methods=None):
    """Equal numbers of real and synthetic rows per method, flagged for training (70 %) by digest order.

    ``cap=None`` uses every row the smaller class has.
    """
    scale = real_scale(tables, features, by, real)
    filled = tables.select(by, *row_id, *[F.coalesce(F.col(c).cast("double"), F.lit(scale[c][0])).alias(c)
                                          for c in features])
    union = labelled_union(filled, features, by, real, methods) \
        .withColumn("_digest", digest(seed, "label", *row_id))
    sizes = union.groupBy("method", "label").agg(F.count(F.lit(1)).alias("n"))
    limit = F.min("n") if cap is None else F.least(F.min("n"), F.lit(cap))
    quota = shared_table(sizes.groupBy("method").agg(limit.alias("n_take")), "quota")
    drawn = bottom_n(union, ["method", "label"], quota, tie=row_id)
    drawn = shared_table(drawn.withColumn("_digest", digest(seed + 1, "label", *row_id)), "attack")
    train = quota.select("method", F.floor(F.col("n_take") * 2 * 0.7).alias("n_take"))
    return flag_bottom_n(drawn, ["method"], train, "is_train", tie=["label", *row_id]).drop("_digest")


def exact_auc(scores, score, label, by):
    """Area under the ROC curve from running counts over distinct scores, ties counted half."""
    by = list(by)
    folded = scores.groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("pos"),
                                            F.count_if(F.col(label) == 0).alias("neg"))
    running = prefix_sums(folded, by, [score], ["neg"])
    pairs = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2.0))
    out = running.groupBy(*by) if by else running
    return out.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
                   (pairs / F.nullif(F.sum("pos").cast("double") * F.sum("neg"), F.lit(0.0))).alias("auc"))


def _dot(w, x, size):
    return sum((F.element_at(w, i + 1) * F.element_at(x, i + 1) for i in range(1, size)), F.element_at(w, 1) * F.element_at(x, 1))


def fit_logistic(rows, by, size, c=1.0, steps=60, tolerance=1e-9):
    """(by, w): ridge logistic weights of every group at once, from rows (by, label, x) with x[0] = 1 for the intercept.

    A Newton step is one aggregation over all rows: loss, gradient and Hessian of every group,
    which a small Python function solves group by group. Where a step raised a group's loss, the
    group goes back half of it. The driver learns only the largest step. The intercept has no ridge.
    """
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    ridge = np.diag([0.0] + [1.0 / c] * (size - 1))
    x, y, z = [F.element_at("x", i + 1) for i in range(size)], F.col("label"), F.col("z")
    p = 1.0 / (1.0 + F.exp(-z))

    @F.pandas_udf("w array<double>, before array<double>, loss double, change double")
    def step(w: pd.Series, before: pd.Series, last: pd.Series, loss: pd.Series, g: pd.Series, h: pd.Series) -> pd.DataFrame:
        out = []
        for now, old, was, is_, slope, curve in zip(w, before, last, loss, g, h, strict=True):
            now, old = np.array(now), np.array(old)
            value = is_ + 0.5 * now @ ridge @ now
            if value > was + 1e-9 * abs(was):
                new, old, value = (now + old) / 2, old, was
            else:
                hessian = np.zeros((size, size))
                for (i, j), v in zip(pairs, curve, strict=True):
                    hessian[i, j] = hessian[j, i] = v
                new, old = now - np.linalg.pinv(hessian + ridge) @ (np.array(slope) + ridge @ now), now
            out.append((new.tolist(), old.tolist(), float(value), float(np.abs(new - now).max())))
        return pd.DataFrame(out, columns=["w", "before", "loss", "change"])

    zero = F.array(*[F.lit(0.0)] * size)
    state = rows.select(by).distinct().select(by, zero.alias("w"), zero.alias("before"), F.lit(float("inf")).alias("last"))
    for _ in range(steps):
        state = shared_table(state, "weights")
        sums = rows.join(state.select(by, "w"), by).withColumn("z", _dot("w", "x", size)).groupBy(by).agg(
            F.sum(F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y * z).alias("loss"),
            F.array(*[F.sum((p - y) * v) for v in x]).alias("g"), F.array(*[F.sum(p * (1.0 - p) * x[i] * x[j]) for i, j in pairs]).alias("h"))
        moved = shared_table(state.join(sums, by).select(by, step("w", "before", "last", "loss", "g", "h").alias("s")), "steps")
        state = moved.select(by, "s.w", "s.before", F.col("s.loss").alias("last"))
        if (moved.agg(F.max("s.change")).first()[0] or 0.0) < tolerance:
            break
    return shared_table(state.select(by, "w"), "weights")


def membership_inference(tables, features, row_id, seed=42, cap=5000, c=1.0, by="source", real=REAL_SOURCE,
                         methods=None):
    """Accuracy, AUC and per-class accuracy of a logistic attack that tells real rows from synthetic ones."""
    sample = shared_table(attack_sample(tables, features, row_id, seed, cap, by, real, methods), "sample")
    stats = shared_table(sample.filter("is_train").groupBy("method").agg(*[e for i, f in enumerate(features) for e in (
        F.avg(f).alias(f"_m{i}"), F.stddev_pop(f).alias(f"_s{i}"))]), "attack-scale")
    spread_ = [F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(1.0) for i in range(len(features))]
    scaled = shared_table(sample.join(stats, "method").select("method", "label", "is_train", F.array(
        F.lit(1.0), *[(F.col(f) - F.col(f"_m{i}")) / spread_[i] for i, f in enumerate(features)]).alias("x")), "scaled")
    weights = fit_logistic(scaled.filter("is_train").drop("is_train"), "method", len(features) + 1, c)
    z = F.col("z")
    scored = shared_table(scaled.filter("NOT is_train").join(weights, "method").withColumn("z", _dot("w", "x", len(features) + 1))
                          .select("method", "label", (z > 0).cast("int").alias("prediction"), z.alias("score")), "scored")
    right = (F.col("prediction") == F.col("label")).cast("int")

    def on(label):
        return F.coalesce(F.avg(F.when(F.col("label") == label, right)), F.lit(0.0))

    rates = scored.groupBy("method").agg(
        F.avg(right).alias("overall_accuracy"), on(1).alias("accuracy_on_real"), on(0).alias("accuracy_on_synthetic"),
        ((on(1) + on(0)) / 2).alias("mia_discrimination"), F.count(F.lit(1)).alias("n_test"))
    train = sample.groupBy("method").agg(F.count_if("is_train").alias("n_train"))
    return rates.join(train, "method").join(exact_auc(scored, "score", "label", ["method"])
                                            .select("method", "auc"), "method")
