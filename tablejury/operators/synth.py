"""Producers of synthetic tables: rule-based generator, fraction samples, independent margins, Gaussian copula."""

import warnings
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tablejury.functions.digests import digest, unit
from tablejury.functions.ranking import prefix_sums
from tablejury.functions.scalar import nan_to_null
from tablejury.operators.sampling import fraction_samples, number_off
from tablejury.schema import categorical_columns, numeric_columns
from tablejury.session import shared_table

# --- fixed values: names and weights of the sample generator's columns -------------
NORMALS = {"age": (38.6, 13.6, 17, 90), "fnlwgt": (189778.0, 106146.0, None, None),
           "hours_per_week": (40.4, 12.4, 1, 100)}
UNIFORM_INTS = {"education_num": (1, 16)}
ZERO_INFLATED = {"capital_gain": (0.96, 30000.0), "capital_loss": (0.98, 2000.0)}
CATEGORIES = {
    "workclass": (["Private", "Self-emp-not-inc", "Self-emp-inc", "Federal-gov", "Local-gov", "State-gov",
                   "Without-pay", "Never-worked"], [0.73, 0.05, 0.02, 0.01, 0.02, 0.01, 0.00, 0.00]),
    "education": (["Preschool", "1st-4th", "5th-6th", "7th-8th", "9th", "10th", "11th", "12th", "HS-grad",
                   "Some-college", "Assoc-voc", "Assoc-acdm", "Bachelors", "Masters", "Prof-school", "Doctorate"],
                  [0.00, 0.00, 0.00, 0.00, 0.00, 0.00, 0.00, 0.00, 0.33, 0.21, 0.07, 0.07, 0.13, 0.05, 0.01, 0.01]),
    "marital_status": (["Married-civ-spouse", "Married-spouse-absent", "Married-AF-spouse", "Never-married",
                        "Divorced", "Separated", "Widowed"], [0.46, 0.01, 0.00, 0.32, 0.13, 0.04, 0.04]),
    "occupation": (["Tech-support", "Craft-repair", "Other-service", "Sales", "Exec-managerial", "Prof-specialty",
                    "Protective-serv", "Machine-op-inspct", "Transport-moving", "Handlers-cleaners",
                    "Farming-fishing", "Armed-Forces"],
                   [0.08, 0.12, 0.14, 0.11, 0.13, 0.13, 0.02, 0.04, 0.05, 0.04, 0.01, 0.00]),
    "relationship": (["Wife", "Own-child", "Husband", "Not-in-family", "Other-relative", "Unmarried"],
                     [0.01, 0.20, 0.40, 0.27, 0.03, 0.08]),
    "race": (["White", "Asian-Pac-Islander", "Amer-Indian-Eskimo", "Other", "Black"], [0.85, 0.04, 0.01, 0.01, 0.09]),
    "sex": (["Male", "Female"], [0.67, 0.33]),
    "native_country": (["United-States", "Mexico", "Puerto-Rico", "Cuba", "Jamaica", "India", "China", "Taiwan",
                        "Hong", "Iran", "Philippines", "Vietnam", "Japan", "Cambodia", "Thailand", "Laos", "Canada",
                        "England", "France", "Germany", "Greece", "Ireland", "Italy", "Poland", "Portugal",
                        "Scotland", "Trinadad&Tobago", "Columbia", "Dominican-Republic", "Ecuador", "El-Salvador",
                        "Guatemala", "Haiti", "Honduras", "Nicaragua", "Peru", "Yugoslavia", "Hungary",
                        "Outlying-US(Guam-USVI-etc)", "South", "Holand-Netherlands"], [0.90] + [0.10 / 40] * 40),
    "income": (["<=50K", ">50K"], [0.76, 0.24]),
}
COLUMN_ORDER = ["age", "workclass", "fnlwgt", "education", "education_num", "marital_status", "occupation",
                "relationship", "race", "sex", "capital_gain", "capital_loss", "hours_per_week", "native_country",
                "income"]
# -------------------------------------------------------------------------------------


def cumulative(weights):
    """Upper bounds of the weights after normalising them to sum to one."""
    return np.cumsum(np.array(weights) / np.sum(weights)).tolist()


def _weighted(u, names, bounds):
    out = F.when(u < bounds[0], names[0])
    for name, bound in list(zip(names, bounds))[1:-1]:
        out = out.when(u < bound, name)
    return out.otherwise(names[max(i for i, b in enumerate(bounds) if i == 0 or b > bounds[i - 1])])


def generate_rows(ids, seed=42, row_id="row_id"):
    """Census-like rows, one per id: clipped normals, weighted names, zero-inflated exponentials, uniform integers.

    Every value is a built-in expression of a keyed digest, so rows are made
    where their ids live and come out the same on every run.
    """
    def u(tag):
        return unit(digest(seed, F.lit(tag), row_id))

    made = {}
    for c, (mean, sd, low, high) in NORMALS.items():
        z = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u(c))) * F.cos(F.lit(2 * np.pi) * u(c + "#2"))
        value = (F.lit(mean) + F.lit(sd) * z).cast("bigint")
        made[c] = value if low is None else F.greatest(F.lit(low), F.least(F.lit(high), value)).cast("bigint")
    for c, (low, high) in UNIFORM_INTS.items():
        made[c] = (F.lit(low) + F.floor(u(c) * (high - low + 1))).cast("bigint")
    for c, (zero, scale) in ZERO_INFLATED.items():
        made[c] = F.when(u(c) < zero, F.lit(0).cast("bigint")) \
            .otherwise((-F.lit(scale) * F.log(F.lit(1.0) - u(c + "#2"))).cast("bigint"))
    for c, (names, weights) in CATEGORIES.items():
        made[c] = _weighted(u(c), names, cumulative(weights))
    return ids.select(row_id, *[made[c].alias(c) for c in COLUMN_ORDER])


# ---- learned producers -----------------------------------------------------------------

def _margin(real, column):
    """(value, next, low, high): the distinct numbers in order, each with the ranks [low, high) it holds.

    Running counts come from range partitions, so a column with very many values is never gathered.
    """
    counts = real.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")) \
        .agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    placed = shared_table(prefix_sums(counts, [], ["value"], ["n", "one"]), "margin")
    after = placed.select((F.col("cum_one") - 1).alias("cum_one"), F.col("value").alias("next"))
    return shared_table(placed.join(after, "cum_one", "left").select(
        "value", "next", (F.col("cum_n") - F.col("n")).alias("low"), F.col("cum_n").alias("high")), "margin")


def _category_scores(real, column):
    """Value bounds of a categorical column on [0,1], most frequent first, and its normal scores.

    Running shares come from distributed totals, so a column with very many
    values is never gathered; the lookup joins on the value.
    """
    counts = real.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    return prefix_sums(counts.withColumn("_neg", -F.col("n")), [], ["_neg", "value"], ["n"]).select(
        "value", ((F.col("cum_n") - F.col("n")) / F.lit(total)).alias("low"), (F.col("cum_n") / F.lit(total)).alias("high"))


_Z = np.linspace(-8.0, 8.0, 20_001)
_P = np.array([NormalDist().cdf(z) for z in _Z])


def _normal_score(p):
    return np.interp(p, _P, _Z)


def _normal_share(z):
    return np.interp(z, _Z, _P)


def fit_margins(real, columns=None):
    """Exact margins and shares of NULLs of the real table.

    Values stay in tables of any size; a column without values has no margin and is generated as NULL.
    """
    numeric = [c for c in numeric_columns(real) if columns is None or c in columns]
    categories = [c for c in categorical_columns(real) if columns is None or c in columns]
    real = nan_to_null(real)
    row = real.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in numeric + categories]).first()
    filled = {c: row[c] for c in numeric + categories}
    empty = [c for c in filled if not filled[c]]
    nulls = {c: 1.0 - filled[c] / row["n"] for c in filled if filled[c]}
    numeric, categories = [c for c in numeric if c not in empty], [c for c in categories if c not in empty]
    margins = {c: _margin(real, c) for c in numeric}
    tables = {c: shared_table(_category_scores(real, c), "category") for c in categories}
    types = dict(real.dtypes)
    return {"columns": numeric + categories, "empty": empty, "nulls": nulls, "filled": filled, "margins": margins,
            "tables": tables, "types": {c: types[c] for c in numeric + categories + empty}}


def fit_copula(real, columns=None):
    """Margins and normal-score correlation of a Gaussian copula over the real table.

    Scores are those of the middle rank of a value; they are joined by value.
    """
    model = fit_margins(real, columns)
    used, margins, tables, filled = model["columns"], model["margins"], model["tables"], model["filled"]
    real = nan_to_null(real)
    placed = real.select(*used)
    for c, table in tables.items():  # sized by its file: broadcast or shuffled by the planner
        middle = table.select(F.col("value").alias(c), ((F.col("low") + F.col("high")) / 2).alias(f"_p_{c}"))
        placed = placed.join(middle, c, "left")
    for c, table in margins.items():
        middle = table.select(F.col("value").alias(f"_v_{c}"), ((F.col("low") + F.col("high")) / 2.0 / filled[c]).alias(f"_p_{c}"))
        placed = placed.join(middle, F.col(c).cast("double") == F.col(f"_v_{c}"), "left").drop(f"_v_{c}")

    @F.pandas_udf(ArrayType(DoubleType()))
    def scores_of(rows: pd.DataFrame) -> pd.Series:
        out = np.zeros((len(rows), len(used)))
        for k, c in enumerate(used):
            share = rows[c].to_numpy(dtype=float)
            rank = np.where(np.isnan(share), 0.5, np.clip(share, 1e-6, 1 - 1e-6))
            out[:, k] = _normal_score(rank)
        return pd.Series(list(out))

    corr = np.eye(len(used))
    pairs = [(i, j) for i in range(len(used)) for j in range(i + 1, len(used))]
    if pairs:
        fields = [F.col(f"_p_{c}").alias(c) for c in used]
        z = placed.select(scores_of(F.struct(*fields)).alias("z")).select(*[F.col("z")[k].alias(f"z{k}") for k in range(len(used))])
        row = z.agg(*[(F.covar_samp(f"z{i}", f"z{j}") / F.nullif(F.stddev_samp(f"z{i}") * F.stddev_samp(f"z{j}"), F.lit(0.0)))
                      .alias(f"r{i}_{j}") for i, j in pairs]).first()
        for i, j in pairs:
            corr[i, j] = corr[j, i] = row[f"r{i}_{j}"] or 0.0
    values, vectors = np.linalg.eigh(corr)
    root = vectors * np.sqrt(np.clip(values, 0.0, None))  # root @ root.T = nearest positive part
    return {**model, "root": root}


BUCKETS_AT_ONCE = 4_096  # of a range, spelled out in two steps, so that no array grows with the table


def _spread_ranges(table, first, last):
    """Each range once per bucket ``_b`` it touches, from ``first`` to ``last``."""
    return (table.withColumn("_last", last).withColumn("_b", F.explode(F.sequence(first, F.col("_last"), F.lit(BUCKETS_AT_ONCE).cast("bigint"))))
            .withColumn("_b", F.explode(F.sequence(F.col("_b"), F.least(F.col("_b") + (BUCKETS_AT_ONCE - 1), F.col("_last"))))).drop("_last"))


def _values_at(drawn, column, table):
    """Replace the share in ``column`` by the value whose range holds it.

    Ranges meet shares in equal buckets, as many as there are values, so a bucket
    holds two ranges on average, and a frequent value spans many buckets.
    """
    n = max(1, table.count())
    last = F.lit(n - 1).cast("bigint")

    def bucket(x):
        return F.least(F.floor(x * n), last)

    ranges = _spread_ranges(table, bucket(F.col("low")), bucket(F.col("high")))
    inside = (F.col(column) >= F.col("low")) & ((F.col(column) < F.col("high")) | (F.col("high") >= 1.0 - 1e-15))
    return drawn.withColumn("_b", bucket(F.col(column))).join(ranges, "_b").where(inside) \
        .withColumn(column, F.col("value")).drop("_b", "low", "high", "value")


def _numbers_at(drawn, column, table, total):
    """Replace the share u in ``column`` by the exact quantile: rank u (total - 1), linear between neighbouring values."""
    n = max(1, table.count())
    last = F.lit(n - 1).cast("bigint")

    def bucket(rank):
        return F.least(F.floor(rank / F.lit(float(total)) * n), last)

    ranges = _spread_ranges(table, bucket(F.col("low")), bucket(F.col("high")))
    over = F.col("_h") - (F.col("high") - 1)
    number = F.when(over > 0, F.col("value") + over * (F.col("next") - F.col("value"))).otherwise(F.col("value"))
    return (drawn.withColumn("_h", F.col(column) * F.lit(float(total - 1))).withColumn("_b", bucket(F.col("_h"))).join(ranges, "_b")
            .where((F.col("_h") >= F.col("low")) & (F.col("_h") < F.col("high")))
            .withColumn(column, number).drop("_b", "_h", "low", "high", "value", "next"))


def _from_shares(model, made, seed, row_id):
    """Turn shares into values by exact lookup in the margins, then NULLs by their share."""
    used, types = model["columns"], model["types"]
    for c, table in model["margins"].items():
        made = _numbers_at(made, c, table, model["filled"][c])
        if types[c] != "double":
            whole = types[c] in ("tinyint", "smallint", "int", "bigint")
            made = made.withColumn(c, (F.rint(c) if whole else F.col(c)).cast(types[c]))
    for c, table in model["tables"].items():
        made = _values_at(made, c, table)
    filled = [F.when(unit(digest(seed, F.lit(f"n{k}"), row_id)) >= model["nulls"][c], F.col(c)).alias(c) if model["nulls"][c] > 0
              else F.col(c) for k, c in enumerate(used)]
    return made.select(row_id, *filled, *[F.lit(None).cast(types[c]).alias(c) for c in model["empty"]])


def sample_copula(model, ids, seed=42, row_id="row_id"):
    """One row per id from a fitted copula; normals come from the id's digest."""
    used, root = model["columns"], model["root"]
    if not used:
        return _from_shares(model, ids.select(row_id), seed, row_id)
    normals = F.array(*[F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - unit(digest(seed, F.lit(f"z{k}"), row_id))))
                        * F.cos(F.lit(2 * np.pi) * unit(digest(seed, F.lit(f"w{k}"), row_id))) for k in range(len(used))])

    def draw(batches):
        for batch in batches:
            z = np.stack(batch["_z"].to_numpy()) @ root.T if len(batch) else np.zeros((0, len(used)))
            u = np.minimum(_normal_share(z), np.nextafter(1.0, 0.0))
            yield pd.DataFrame({row_id: batch[row_id], **{c: u[:, k] for k, c in enumerate(used)}})

    schema = ", ".join([f"`{row_id}` {dict(ids.dtypes)[row_id]}"] + [f"`{c}` double" for c in used])
    return _from_shares(model, ids.select(row_id, normals.alias("_z")).mapInPandas(draw, schema), seed, row_id)


def independent_margins(real, ids, seed=42, row_id="row_id", columns=None):
    """Every column drawn from its own margin, without dependence; the shares are the ids' digests."""
    model = fit_margins(real, columns)
    shares = [unit(digest(seed, F.lit(f"u{k}"), row_id)).alias(c) for k, c in enumerate(model["columns"])]
    return _from_shares(model, ids.select(row_id, *shares), seed, row_id)


def gaussian_copula(real, ids, seed=42, row_id="row_id", columns=None):
    return sample_copula(fit_copula(real, columns), ids, seed, row_id)


ALIASES = {"copula": "gaussian_copula", "gaussiancopula": "gaussian_copula"}


def generate_all(real, methods=("gaussian_copula", "fraction_sample", "independent_margins"), n_samples=None,
                 seed=42, row_id="row_id", columns=None):
    """All named methods in one long table; unknown names and failing methods are reported and left out."""
    columns = columns or [c for c in real.columns if c != row_id]
    ids = real.select(row_id)
    if n_samples is not None:
        ids = number_off(real.sparkSession.createDataFrame([(1,)], "one int"), F.lit(n_samples), row_id).select(row_id)
    makers = {
        "gaussian_copula": lambda: gaussian_copula(real, ids, seed, row_id, columns),
        "independent_margins": lambda: independent_margins(real, ids, seed, row_id, columns),
        "fraction_sample": lambda: fraction_samples(real, ["fraction_sample"], 0.9, seed, [row_id]).drop("method"),
    }
    out = None
    for method in methods:
        name = ALIASES.get(method.lower(), method.lower())
        if name not in makers:
            warnings.warn(f"unknown method {method}")
            continue
        try:
            table = makers[name]().withColumn("method", F.lit(name)).select("method", row_id, *columns)
        except Exception as exc:  # noqa: BLE001 - one failing method must not stop the others
            warnings.warn(f"method {method} failed: {exc}")
            continue
        out = table if out is None else out.unionByName(table)
    return out


