"""Exact order statistics that never gather a whole group in one task.

* ``bottom_n``       the n rows with the smallest digest per key, n from a table
* ``digest_rank``    the exact position of every row in digest order per key
* ``prefix_sums``    running totals over a sorted order, per key
* ``average_ranks``  tie-averaged ranks of distinct values
* ``quantiles``      linearly interpolated exact quantiles

Digests are uniform, so their leading hex digits cut any group, however hot,
into even buckets: counts per bucket (combined map-side) locate a rank, and only
the rows of one bucket are ever sorted together.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from tablejury.session import shared_table, spread

HEX_DIGITS = 3


def _bucket(digest_column, hex_digits):
    return F.substring(digest_column, 1, hex_digits)


def _keyed(df, keys):
    """The frame and its keys; an unkeyed call gets one constant key, so every join stays an equi-join."""
    return (df, list(keys)) if keys else (df.withColumn("_all", F.lit(1)), ["_all"])


def bottom_n(df: DataFrame, keys, quota, digest_column="_digest", tie=(), hex_digits=HEX_DIGITS,
             n_column="n_take"):
    """Rows whose digest is among the smallest ``n_column`` of their key.

    ``quota`` has one row per key. The big side is filtered against one cut
    bucket per key; only rows of that bucket are shuffled and ranked.
    """
    below, edge, _ = _around_cut(df, keys, quota, digest_column, tie, hex_digits, n_column)
    return below.select(*df.columns).unionByName(edge.filter("_kept").select(*df.columns))


def flag_bottom_n(df: DataFrame, keys, quota, flag, digest_column="_digest", tie=(), hex_digits=HEX_DIGITS,
                  n_column="n_take"):
    """Every row, with a flag telling the n smallest of its key from the rest."""
    below, edge, above = _around_cut(df, keys, quota, digest_column, tie, hex_digits, n_column)
    return (below.select(*df.columns, F.lit(True).alias(flag))
            .unionByName(edge.select(*df.columns, F.col("_kept").alias(flag)))
            .unionByName(above.select(*df.columns, F.lit(False).alias(flag))))


def _around_cut(df, keys, quota, digest_column, tie, hex_digits, n_column):
    quota, _ = _keyed(quota, keys)
    df, keys = _keyed(df, keys)
    bucketed = df.withColumn("_bucket", _bucket(F.col(digest_column), hex_digits))
    counts = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    cuts = shared_table(_cuts(counts, keys, quota, n_column), "cuts")
    tagged = bucketed.join(cuts, keys)
    edge = (tagged.filter(F.col("_bucket") == F.col("_cut"))
            .withColumn("_kept", F.row_number().over(W.partitionBy(*keys).orderBy(digest_column, *tie)) <= F.col("_rest")))
    return tagged.filter(F.col("_bucket") < F.col("_cut")), edge, tagged.filter(F.col("_bucket") > F.col("_cut"))


def _cuts(counts, keys, quota, n_column):
    """Per key: the bucket holding the n-th smallest digest and how many rows to take from it."""
    running = counts.withColumn("_upto", F.sum("_c").over(W.partitionBy(*keys).orderBy("_bucket"))) \
        .withColumn("_total", F.sum("_c").over(W.partitionBy(*keys)))
    joined = running.join(quota, [k for k in keys if k in quota.columns])
    wanted = F.least(F.col(n_column).cast("bigint"), F.col("_total"))
    return (joined.filter((F.col("_upto") - F.col("_c") < wanted) & (wanted <= F.col("_upto")))
            .select(*keys, F.col("_bucket").alias("_cut"), (wanted - F.col("_upto") + F.col("_c")).alias("_rest")))


def digest_rank(df: DataFrame, keys, digest_column="_digest", tie=(), rank_column="rank",
                hex_digits=HEX_DIGITS):
    """Exact 1-based rank in digest order within each key, one shuffle by (key, bucket)."""
    columns = df.columns
    df, keys = _keyed(df, keys)
    bucketed = df.withColumn("_bucket", _bucket(F.col(digest_column), hex_digits))
    counts = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    offsets = shared_table(counts.select(
        *keys, "_bucket",
        (F.sum("_c").over(W.partitionBy(*keys).orderBy("_bucket")) - F.col("_c")).alias("_before")), "offsets")
    within = W.partitionBy(*keys, "_bucket").orderBy(digest_column, *tie)
    return (bucketed.join(offsets, [*keys, "_bucket"])
            .select(*columns, (F.col("_before") + F.row_number().over(within)).alias(rank_column)))


def top_k(df: DataFrame, keys, k, *order, rank_column=None):
    """First k rows per key for a constant k; Spark prunes to k per task before the shuffle."""
    name = rank_column or "_rn"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))) \
        .filter(F.col(name) <= k)
    return out if rank_column else out.drop(name)


def prefix_sums(df: DataFrame, keys, order, values):
    """Inclusive running totals of ``values`` in ``order`` per key, over distinct order values.

    Rows are range-partitioned, so a key with a third of the rows spans many
    partitions; per-partition totals (a small table) supply the offsets.
    """
    columns, order, values = df.columns, list(order), list(values)
    df, keys = _keyed(df, keys)
    parts = shared_table(
        df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = parts.groupBy(*keys, "_part").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    across = W.partitionBy(*keys).orderBy("_part")
    offsets = totals.select(*keys, "_part", *[
        (F.sum(f"_sum_{v}").over(across) - F.col(f"_sum_{v}")).alias(f"_before_{v}") for v in values])
    inside = W.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (parts.join(offsets, [*keys, "_part"])
            .select(*columns, *[(F.col(f"_before_{v}") + F.sum(v).over(inside)).alias(f"cum_{v}")
                                for v in values]))


def average_ranks(df: DataFrame, keys, value):
    """(keys, value, n, avg_rank): one row per distinct value, ties share the mean rank."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return prefix_sums(counted, keys, [value], ["n"]).select(
        *keys, value, "n", (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0).alias("avg_rank"))


STEPS = 512       # bins per factor e of magnitude
FARTHEST = 800    # beyond the logarithm of any double, the smallest included


def _magnitude(value):
    """A whole number that never falls when the value rises: sign and logarithm, 0.2 % wide; zero has its own."""
    size = F.floor(F.least(F.ln(F.abs(value)), F.lit(float(FARTHEST))) * STEPS) + STEPS * FARTHEST
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0).cast("bigint"))


def quantiles(df: DataFrame, keys, value, probs, names, weight=None):
    """Exact linearly interpolated quantiles per key, one row per key plus ``n``.

    ``weight`` is a column of row multiplicities. NULL and NaN have no rank; a NULL
    key is a key like any other; a key without values gives no row.

    The same two passes serve every size. The first counts values by magnitude, on
    the map side, and finds the bins that hold the wanted ranks of all keys at once.
    The second counts the distinct values of those bins; running totals over range
    partitions place them, so that no bin, however full, is sorted in one task.
    """
    shown = list(keys)
    times = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    rows = df.select(F.struct(*[F.col(k) for k in shown], F.lit(1).alias("_all")).alias("_key"),  # a struct is never NULL
                     F.col(value).cast("double").alias("_v"), times.alias("_m")) \
        .filter(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.col("_m") > 0)).withColumn("_bin", _magnitude(F.col("_v")))
    ordered = W.partitionBy("_key").orderBy("_bin")  # one row per magnitude: bounded by the number format
    bins = (rows.groupBy("_key", "_bin").agg(F.sum("_m").alias("_c"))
            .withColumn("n", F.sum("_c").over(W.partitionBy("_key"))).withColumn("_from", F.sum("_c").over(ordered) - F.col("_c")))
    places = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(side).alias("_side"), at(k).cast("bigint").alias("_rank"))
                      for i, k in enumerate(places) for side, at in enumerate((F.floor, F.ceil))])
    here = F.filter(ranks, lambda r: (r["_rank"] >= F.col("_from")) & (r["_rank"] < F.col("_from") + F.col("_c")))
    wanted = shared_table(bins.select("_key", "_bin", "n", "_from", F.explode(here).alias("_r")).select("_key", "_bin", "n", "_from", "_r.*"), "ranks")
    inside = rows.join(wanted.select("_key", "_bin").distinct(), ["_key", "_bin"]).groupBy("_key", "_bin", "_v").agg(F.sum("_m").alias("_c"))
    found = (wanted.join(prefix_sums(inside, ["_key", "_bin"], ["_v"], ["_c"]), ["_key", "_bin"])
             .filter(F.col("_rank") - F.col("_from") < F.col("cum__c")).filter(F.col("_rank") - F.col("_from") >= F.col("cum__c") - F.col("_c")))
    wide = found.groupBy("_key").agg(F.first("n").alias("n"), *[
        F.max(F.when((F.col("_i") == i) & (F.col("_side") == side), F.col("_v"))).alias(f"_{end}{i}")
        for i in range(len(places)) for side, end in enumerate("ab")])

    def between(i, k):
        low, high = F.col(f"_a{i}"), F.col(f"_b{i}")
        return F.when(low == high, low).otherwise(low + (high - low) * (k - F.floor(k)))

    return wide.select(*[F.col("_key")[k].alias(k) for k in shown], "n", *[between(i, k).alias(name) for i, (k, name) in enumerate(zip(places, names, strict=True))])


def digits_for(n_rows, rows_per_bucket=2048):
    """Leading hex digits for the largest group: as many buckets as keep each near ``rows_per_bucket`` rows."""
    digits = 1
    while n_rows > rows_per_bucket * 16 ** digits:
        digits += 1
    return digits


def draw_counts(rows: DataFrame, keys, seeds, digest_of, quota, categories, tie=(), draw="draw",
                hex_digits=None, n_column="n_take"):
    """Category counts among the n smallest digests per (key, draw), for many draws at once.

    Rows are never shuffled once per draw: each draw is counted per digest
    bucket on the map side, and only rows of the cut buckets are ranked.
    ``seeds`` is an array column, ``digest_of(draw_column)`` gives the digest of
    a row from the draw and the ``tie`` columns. The rows are narrowed, spread by
    ``tie`` and written once, since every draw reads them.
    """
    keys, categories = list(keys), list(categories)
    rows = shared_table(spread(rows.select(*dict.fromkeys([*keys, *categories, *tie])), *tie), "rows")
    if hex_digits is None:
        largest = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).agg(F.max("_c")).first()[0]
        hex_digits = digits_for(largest or 0)
    every = (rows.withColumn(draw, F.explode(seeds))
             .withColumn("_digest", digest_of(F.col(draw)))
             .withColumn("_bucket", _bucket(F.col("_digest"), hex_digits)))
    counts = shared_table(
        every.groupBy(*keys, draw, "_bucket", *categories).agg(F.count(F.lit(1)).alias("_c")), "draws")
    per_bucket = counts.groupBy(*keys, draw, "_bucket").agg(F.sum("_c").alias("_c"))
    cuts = shared_table(_cuts(per_bucket, [*keys, draw], quota, n_column), "cuts")
    below = (counts.join(cuts, [*keys, draw]).filter(F.col("_bucket") < F.col("_cut"))
             .select(*keys, draw, *categories, "_c"))
    edge = (every.join(cuts, [*keys, draw]).filter(F.col("_bucket") == F.col("_cut"))
            .withColumn("_rn", F.row_number().over(W.partitionBy(*keys, draw).orderBy("_digest", *tie)))
            .filter(F.col("_rn") <= F.col("_rest"))
            .select(*keys, draw, *categories, F.lit(1).cast("bigint").alias("_c")))
    return below.unionByName(edge).groupBy(*keys, draw, *categories).agg(F.sum("_c").alias("n"))
