"""Column profiles and real-versus-synthetic distribution tables, as long tables.

Columns are turned into (column, value) rows before grouping, so any number of
columns is one aggregation, and a hot value is folded on the map side.
"""

from itertools import combinations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tablejury.functions import scalar as S
from tablejury.functions import stats
from tablejury.functions.digests import digest
from tablejury.functions.ranking import HEX_DIGITS, quantiles, top_k
from tablejury.functions.stats import shapiro_wilk
from tablejury.schema import categorical_columns, numeric_columns
from tablejury.session import literal_table, shared_table

QUARTILES = (0.25, 0.5, 0.75)
PAIRS_PER_PASS = 60


def column_types(df, exclude=()):
    """(column, dtype, kind, position) from the schema, with what the values are: n_values and ``content``.

    content is ``null`` without values, else the narrowest of ``integral``, ``decimal``, ``time``
    and ``text`` that holds for every value. Each column folds to four counts in one pass over all rows.
    """
    kinds = {**{c: "numeric" for c in numeric_columns(df)}, **{c: "categorical" for c in categorical_columns(df)}}
    rows = [(c, t, kinds.get(c, "other"), i) for i, (c, t) in enumerate(df.dtypes) if c not in exclude]
    data = S.nan_to_null(df)

    def counts(c, kind):
        value, text = F.col(c), F.trim(F.col(c).cast("string"))
        if kind in ("date", "timestamp", "timestamp_ntz"):
            whole, number, time = F.lit(False), F.lit(False), F.lit(True)
        elif kind == "string":
            whole, number, time = text.rlike(r"^[+-]?[0-9]+$"), text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.try_to_timestamp(text).isNotNull()
        elif kinds.get(c) == "numeric":
            whole, number, time = value == F.floor(value), F.lit(True), F.lit(False)
        else:
            whole, number, time = F.lit(False), F.lit(False), F.lit(False)
        return F.struct(F.count(value).alias("n"), *[F.count_if(value.isNotNull() & test).alias(name) for name, test in (("whole", whole), ("number", number), ("time", time))])

    folded = data.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.lit(k).alias("kind"), F.lit(i).alias("position"), counts(c, t).alias("of"))
                                for c, t, k, i in rows]).alias("columns"))
    n = F.col("of.n")
    content = (F.when(n == 0, "null").when(F.col("of.whole") == n, "integral").when(F.col("of.number") == n, "decimal")
               .when(F.col("of.time") == n, "time").otherwise("text"))
    return folded.select(F.explode("columns").alias("c")).select("c.*").select("column", "dtype", "kind", "position", n.alias("n_values"), content.alias("content"))


def _none(df, by, **fields):
    """No rows, with the given columns: what a table without suitable columns gives."""
    return df.filter(F.lit(False)).select(*by, *[F.lit(None).cast(t).alias(c) for c, t in fields.items()])


def _long(df, by, columns, cast, keep=()):
    if not columns:
        return _none(df, [*by, *keep], column="string", value=cast)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(cast).alias("value")) for c in columns])
    return df.select(*by, *keep, F.explode(cells).alias("_c")).select(*by, *keep, "_c.column", "_c.value")


def numeric_long(df, by=(), columns=None, keep=()):
    """(by, column, value double); NaN becomes NULL."""
    columns = columns or numeric_columns(df, {*by, *keep})
    return _long(df, by, columns, "double", keep).withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def value_counts(df, by=(), columns=None):
    """(by, column, value, n) for every distinct non-null value."""
    columns = columns or [c for c, _ in df.dtypes if c not in by]
    return _long(df, by, columns, "string").filter(F.col("value").isNotNull()) \
        .groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n"))


COLUMNS_PER_PASS = 24


def _per_column(df, by, columns, measures):
    """(by, column, measures...) from wide aggregates of a fixed number of columns per pass."""
    out = None
    for start in range(0, len(columns), COLUMNS_PER_PASS):
        part = columns[start:start + COLUMNS_PER_PASS]
        named = [(c, measures(c)) for c in part]
        exprs = [e.alias(f"{m}_{i}") for i, (_, ms) in enumerate(named) for m, e in ms.items()]
        wide = (df.groupBy(*by) if by else df).agg(*exprs)
        cells = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{m}_{i}").alias(m) for m in ms])
                          for i, (c, ms) in enumerate(named)])
        rows = wide.select(*by, F.explode(cells).alias("_c")).select(*by, "_c.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def missing(df, by=(), columns=None):
    columns = columns or [c for c, _ in df.dtypes if c not in by]
    df = S.nan_to_null(df)
    counts = _per_column(df, by, columns, lambda c: {"n_rows": F.count(F.lit(1)),
                                                     "n_missing": F.count_if(F.col(c).isNull())})
    return counts.withColumn("missing_pct", F.bround(100.0 * F.col("n_missing") / F.col("n_rows"), 2))


def columns_with_missing(df, by=()):
    return missing(df, by).filter(F.col("n_missing") > 0).select(*by, "column", "missing_pct")


FLOATING = ("double", "float", "int", "smallint", "tinyint")


def distinct_counts(df, by=(), columns=None, approximate=False):
    """Exact counts from distinct values; the approximate form needs no shuffle of values.

    Types that fit a double are compared as doubles, all others as text.
    """
    columns = columns or [c for c, _ in df.dtypes if c not in by]
    kinds = dict(df.dtypes)
    parts = [_long(df, by, names, cast) for names, cast in (
        ([c for c in columns if kinds[c] in FLOATING], "double"),
        ([c for c in columns if kinds[c] not in FLOATING], "string")) if names]
    out = None
    for part in parts:
        if approximate:
            counted = part.groupBy(*by, "column").agg(F.approx_count_distinct("value").alias("n_unique"))
        else:
            counted = part.filter(F.col("value").isNotNull()).groupBy(*by, "column", "value").agg(
                F.lit(1).alias("_one")).groupBy(*by, "column").agg(F.count(F.lit(1)).alias("n_unique"))
        out = counted if out is None else out.unionByName(counted)
    return out


def _numbers(df, by, columns):
    """The columns as doubles with NaN turned into NULL."""
    return df.select(*by, *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])


def _moments(c):
    return {"mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(c), "max": F.max(c),
            "skewness": stats.skewness_adjusted(c), "kurtosis": stats.kurtosis_adjusted(c)}


def numeric_moments(df, by=(), columns=None):
    columns = columns or numeric_columns(df, by)
    if not columns:
        return _none(df, by, column="string", **{m: "double" for m in _moments("x")})
    return _per_column(_numbers(df, by, columns), by, columns, _moments)


def numeric_quantiles(df, by=(), columns=None):
    return quantiles(numeric_long(df, by, columns), [*by, "column"], "value", QUARTILES, ["p25", "median", "p75"])


def numeric_profile(df, by=(), columns=None, places=4):
    """Mean, sd, range, quartiles and shape per numeric column, rounded for display."""
    joined = numeric_moments(df, by, columns).join(numeric_quantiles(df, by, columns).drop("n"), [*by, "column"])
    shown = ["mean", "std", "min", "p25", "median", "p75", "max", "skewness", "kurtosis"]
    return joined.select(*by, "column", *[F.bround(c, places).alias(c) for c in shown])


def _with_totals(df, by, columns):
    """Value counts with the number of non-null values of their column.

    Totals come from a plain count, are one row per column and written, so the
    counts of a column with very many values are not gathered to divide them.
    """
    if not columns:
        return _none(df, by, column="string", value="string", n="bigint", total="bigint")
    totals = shared_table(_per_column(df, by, columns, lambda c: {"total": F.count(c)}), "totals")
    return value_counts(df, by, columns).join(totals, [*by, "column"])


def category_shares(df, by=(), columns=None):
    """Every value of each categorical column with its count and share."""
    counts = _with_totals(df, by, columns or categorical_columns(df, by))
    return counts.select(*by, "column", "value", "n", (F.col("n") / F.col("total")).alias("share"))


def top_values(df, by=(), columns=None, k=10):
    """The k most frequent values of each categorical column; ties go to the smaller value."""
    counts = _with_totals(df, by, columns or categorical_columns(df, by))
    best = top_k(counts, [*by, "column"], k, F.desc("n"), "value", rank_column="rank")
    return best.select(*by, "column", "value", "rank", "n", F.bround(F.col("n") / F.col("total"), 4).alias("share"))


def entropies(df, by=(), columns=None):
    """Entropy of each categorical column from the shares of its values."""
    shares = category_shares(df, by, columns)
    return shares.groupBy(*by, "column").agg(F.bround(stats.entropy(F.col("share")), 4).alias("entropy"))


def correlations(df, by=(), columns=None, places=4):
    """Pearson r of every column pair, pairwise complete; a fixed number of pairs per pass."""
    columns = columns or numeric_columns(df, by)
    df = S.nan_to_null(df)
    pairs = list(combinations(columns, 2))
    if not pairs:
        return _none(df, by, c1="string", c2="string", r="double")
    out = None
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        part = pairs[start:start + PAIRS_PER_PASS]
        exprs = [stats.pearson(a, b).alias(f"r{i}") for i, (a, b) in enumerate(part)]
        wide = (df.groupBy(*by) if by else df).agg(*exprs)
        cells = F.array(*[F.struct(F.lit(a).alias("c1"), F.lit(b).alias("c2"), F.col(f"r{i}").alias("r"))
                          for i, (a, b) in enumerate(part)])
        rows = wide.select(*by, F.explode(cells).alias("_p")).select(*by, "_p.c1", "_p.c2",
                                                                     F.bround("_p.r", places).alias("r"))
        out = rows if out is None else out.unionByName(rows)
    return out


def top_correlations(df, by=(), columns=None, k=15):
    table = correlations(df, by, columns)
    order = [F.abs("r").desc_nulls_last(), "c1", "c2"]
    return top_k(table, by, k, *order) if by else table.orderBy(*order).limit(k)


def _first_buckets(values, keys, n, digest_column):
    """The rows of each key's first digest buckets, as many buckets as hold its n smallest digests (all, if fewer).

    Counts of buckets, combined on the map side, find them, so that no other row is sorted or shuffled.
    """
    keyed = values.withColumn("_key", F.struct(*keys)).withColumn("_bucket", F.substring(digest_column, 1, HEX_DIGITS))  # a struct is never NULL
    upto = F.sum("_c").over(W.partitionBy("_key").orderBy("_bucket"))
    counts = keyed.groupBy("_key", "_bucket").agg(F.count(F.lit(1)).alias("_c")).withColumn("_upto", upto)
    last = shared_table(counts.groupBy("_key").agg(F.min(F.when(F.col("_upto") >= n, F.col("_bucket"))).alias("_last")), "buckets")  # one row per key
    return keyed.join(last, "_key").filter(F.col("_last").isNull() | (F.col("_bucket") <= F.col("_last"))).select(*values.columns)


def shapiro(df, row_id, by=(), columns=None, seed=42, sample=500):
    """Shapiro-Wilk p of up to ``sample`` values per column (groups are bounded by ``sample``)."""
    keys = [*by, "column"]
    values = numeric_long(df.withColumn("_d", digest(seed, *row_id)), by, columns or numeric_columns(df, {*by, *row_id}), keep=[*row_id, "_d"]) \
        .filter(F.col("value").isNotNull())
    drawn = top_k(_first_buckets(values, keys, sample, "_d"), keys, sample, "_d", *row_id).select(*keys, "value")

    def test(key, rows):
        n = len(rows)
        w, p = shapiro_wilk(rows["value"]) if n > 8 else (None, None)
        return pd.DataFrame([[*key, n, w, p]])

    schema = ", ".join([f"`{k}` {dict(df.dtypes).get(k, 'string')}" for k in keys] + ["n int", "w double", "shapiro_p double"])
    return drawn.groupBy(*keys).applyInPandas(test, schema).withColumn(
        "verdict", F.when(F.col("shapiro_p") > 0.05, "normal").when(F.col("shapiro_p").isNotNull(), "non-normal"))


def table_profile(df, by=(), exclude=()):
    """One row per column: type, missing share, distinct count, and for numbers moments and quartiles.

    Missing counts and moments of all columns come from the same pass.
    """
    data = df.drop(*exclude)
    columns = [c for c, _ in data.dtypes if c not in by]
    numeric = set(numeric_columns(data, by))
    nothing = F.lit(None).cast("double")
    absent = {m: nothing for m in ("mean", "std", "min", "max", "skewness", "kurtosis")}
    ready = data.select(*by, *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c)
                               if c in numeric else F.col(c) for c in columns])
    scalars = _per_column(ready, by, columns, lambda c: {
        "n_rows": F.count(F.lit(1)), "n_missing": F.count_if(F.col(c).isNull()),
        **(_moments(c) if c in numeric else absent)})
    shown = scalars.select(*by, "column", "n_rows", "n_missing",
                           F.bround(100.0 * F.col("n_missing") / F.col("n_rows"), 2).alias("missing_pct"),
                           *[F.bround(m, 4).alias(m) for m in absent])
    types = column_types(data, by).select("column", "dtype", "kind", "position")
    quartiles = numeric_quantiles(data, by).select(*by, "column", *[F.bround(q, 4).alias(q) for q in ("p25", "median", "p75")])
    return (shown.join(distinct_counts(data, by), [*by, "column"], "left").na.fill(0, ["n_unique"])
            .join(F.broadcast(types), "column")  # one row per schema column
            .join(quartiles, [*by, "column"], "left")
            .join(entropies(data, by), [*by, "column"], "left"))


# ---- distribution comparison ------------------------------------------------------

def compare_distributions(df, by="source", first=3, exclude=()):
    columns = numeric_columns(df, {by, *exclude})[:first]
    return numeric_long(df, [by], columns).groupBy(by, "column").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def histogram(long, keys, bins):
    """Equal-width counts per key, empty bins included; the last bin is closed on both sides."""
    keys = list(keys)
    values = long.filter(F.col("value").isNotNull())
    flat = F.min("value") == F.max("value")
    span = shared_table(values.groupBy(*keys).agg(
        (F.min("value") - F.when(flat, 0.5).otherwise(0.0)).alias("low"),
        (F.max("value") + F.when(flat, 0.5).otherwise(0.0)).alias("high")), "spans")
    width = (F.col("high") - F.col("low")) / F.lit(float(bins))
    place = F.least(F.floor((F.col("value") - F.col("low")) / width), F.lit(bins - 1)).cast("int")
    counts = values.join(span, keys).groupBy(*keys, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counts, [*keys, "bin"], "left").na.fill(0, ["n"]).select(
        *keys, "bin", (F.col("low") + F.col("bin") * width).alias("left_edge"), "n")


def numeric_histograms(df, by="source", bins=50, exclude=()):
    return histogram(numeric_long(df, [by], numeric_columns(df, {by, *exclude})), [by, "column"], bins)


def box_plot(df, by, value):
    """Quartiles, whiskers at the last data inside 1.5 IQR, and the number of outliers."""
    rows = df.select(by, F.col(value).cast("double").alias("value")).filter(F.col("value").isNotNull())
    boxes = shared_table(quantiles(rows, [by], "value", QUARTILES, ["q1", "median", "q3"]), "boxes")
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    inside = (F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach)
    return rows.join(boxes, by).groupBy(by, "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"), F.count_if(~inside).alias("n_outliers"))


def joint_density(df, x, y, by="source", bins=20):
    """Counts over a bins x bins grid of two columns, each scaled to its range within the group."""
    rows = df.select(by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) \
        .filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    span = shared_table(rows.groupBy(by).agg(*[f(v).alias(f"{v}_{n}") for v in ("x", "y")
                                               for n, f in (("low", F.min), ("high", F.max))]), "spans")

    def place(v):
        width = F.nullif(F.col(f"{v}_high") - F.col(f"{v}_low"), F.lit(0.0)) / F.lit(float(bins))
        return F.coalesce(F.least(F.floor((F.col(v) - F.col(f"{v}_low")) / width), F.lit(bins - 1)), F.lit(0)).cast("int")

    return rows.join(span, by).groupBy(by, place("x").alias("bin_x"), place("y").alias("bin_y")) \
        .agg(F.count(F.lit(1)).alias("n"))
