"""Helpers shared by the operators: stored tables, running numbers, joins with hot groups, word hashes."""

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tablejury.session import shared_folder

BROADCAST_ROWS = 1_000_000  # a table is broadcast only if it was counted and has no more rows than this
BUCKETS = 1 << 18  # of keys by hash: at most so many whole numbers are broadcast


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write once to the shared folder (compressed) and read back: no lineage, fixed values, known size."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table whose counted rows are below the bound; otherwise leave the join to the planner."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def likely(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """The rows whose key shares a hash bucket with one in `names`: few others are shuffled to the join that follows.

    A bounded filter: with so many names that they fill the buckets, it leaves all rows.
    """
    def bucket():
        return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket")

    buckets = F.broadcast(names.select(bucket()).distinct())
    return rows.withColumn("bucket", bucket()).join(buckets, "bucket", "left_semi").drop("bucket")


def parts(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def partition_starts(totals: DataFrame, by: list) -> DataFrame:
    """Second pass of a two-pass prefix sum: `total` of each `part` becomes `base`, the sum of earlier parts.

    One row per written partition (and group), never per input row, so the
    window stays small: a hundred terabytes in splits of 128 MB give under a million.
    """
    w = W.partitionBy(*by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return totals.withColumn("base", F.coalesce(F.sum("total").over(w), F.lit(0)).cast("long")).drop("total")


def numbered(df: DataFrame, by: str, name: str, purpose: str) -> DataFrame:
    """Add `name`: a gapless number from 0 within each value of the integer column `by`.

    First pass: each partition numbers its rows on its own and is written.
    Second pass: counts per partition become starting points.
    """
    schema = T.StructType(df.schema.fields + [T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType())])

    def number(batches):
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(by)).to_numpy(zero_copy_only=False)
            order = np.argsort(keys, kind="stable")
            values, first, counts = np.unique(keys[order], return_index=True, return_counts=True)
            local = np.empty(len(keys), np.int64)
            local[order] = np.arange(len(keys)) - np.repeat(first, counts)
            starts = np.array([seen.get(v, 0) for v in values.tolist()], np.int64)
            local[order] += np.repeat(starts, counts)
            for v, n in zip(values.tolist(), counts.tolist(), strict=True):
                seen[v] = seen.get(v, 0) + n
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(keys), part, np.int32)), pa.array(local)],
                names=[*batch.schema.names, "part", "local"])

    rows = stored(df.mapInArrow(number, schema), purpose)
    totals = rows.groupBy("part", by).agg(F.count("*").alias("total"))
    starts = stored(partition_starts(totals, [by]), purpose + "-starts")
    return (rows.join(small(starts, starts.count()), ["part", by])
            .withColumn(name, F.col("base") + F.col("local")).drop("part", "local", "base"))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str) -> DataFrame:
    """Join every row with its group's record; a group may own a third of all rows.

    Groups above 1/(4 * partitions) of the rows are fewer than 4 * partitions,
    so they are broadcast; the remaining rows meet their groups in a shuffle
    where no key is large. Both tables must be stored ones (they are read twice).
    """
    n = parts(rows)
    limit = max(1, math.ceil((groups.agg(F.sum(count)).first()[0] or 0) / (4 * n)))
    hot = groups.where(F.col(count) > limit)
    keys = [r[0] for r in hot.select(key).collect()]  # fewer than 4 * partitions
    if not keys:
        return rows.join(groups, key)
    is_hot = F.col(key).isin(keys)
    return (rows.where(is_hot).join(F.broadcast(hot), key)
            .unionByName(rows.where(~is_hot).join(groups.where(F.col(count) <= limit), key)))


# ---- words of UTF-8 text, hashed without a Python loop ----

_ODD = np.uint64(0x9E3779B97F4A7C15)
_P = 0x100000001B3 | (1 << 40) | 0x51
_POWERS = {}


def mix(x):
    """A bijective scramble of 64-bit numbers, so that close values end far apart."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def _powers(n):
    """Powers of an odd multiplier and of its inverse modulo 2**64."""
    have = _POWERS.get("p")
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            out = []
            for base in (_P, pow(_P, -1, 1 << 64)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                out.append(np.multiply.accumulate(steps))
        _POWERS["p"] = have = tuple(out)
    return have


def text_buffer(column):
    """(bytes, offsets) of an Arrow string column; NULL counts as empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    return raw[lo:hi], offsets - lo


def slices(offsets, target=1_500_000):
    """Cut documents into runs of about `target` bytes (whole documents), to bound memory."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + target, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def run_hashes(data, kinds, offsets):
    """Hash maximal runs of equal, non-zero `kinds`; runs never cross documents.

    Returns (hash, start byte, bounds), where runs bounds[d]:bounds[d+1] lie in document d.
    Equal byte strings have equal hashes wherever they stand.
    """
    n = len(data)
    docs = len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(docs + 1, np.int64)
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=change[1:])
    inner = offsets[:-1]
    change[inner[inner < n]] = True
    edges = np.flatnonzero(change)
    ends = np.append(edges[1:], n)
    keep = kinds[edges] != 0
    starts, ends = edges[keep], ends[keep]
    return span_hashes(data, starts, ends), starts, np.searchsorted(starts, offsets)


def span_hashes(data, starts, ends):
    """Hashes of the byte strings data[start:end]; equal strings have equal hashes wherever they stand."""
    n = len(data)
    power, inverse = _powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _ODD)
