"""Vector code compression: product codes whose nearest entries are found by an integer Walsh-Hadamard transform.

Vectors become integers and are cut into equal parts. For a part x and an entry c,
both padded with zeros to a power of two n, the transform H keeps distances up to a
known factor: |Hx - Hc|^2 = n |x - c|^2. Scaled squared differences are added up
coefficient by coefficient, in sequency order (slowly changing patterns first, which
hold most of a smooth part), and an entry goes as soon as its sum exceeds the whole
distance of the entry that looked best at first. All of it is integer arithmetic, so
distances and ties are exact.

Codebooks (`parts` x `entries` of a part's width) are the only thing the driver
sees: each task adds up its parts per entry, Spark adds up the tasks' sums.
"""

import hashlib
import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablejury.llm.common import join_groups, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LARGEST = 2.0 ** 62  # components at or beyond this, once scaled, have no code
NUMBERS = 4_000_000  # components that a task holds at a time


def walsh(x):
    """Walsh-Hadamard transform of the last axis (a power of two), coefficients in sequency order."""
    n = x.shape[-1]

    def butterflies(y):
        h = 1
        while h < n:
            pairs = y.reshape(-1, n // (2 * h), 2, h)
            y = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(y.shape)
            h *= 2
        return y

    signs = butterflies(np.eye(n, dtype=np.int64))
    return butterflies(x)[..., np.argsort((signs[:, 1:] != signs[:, :-1]).sum(axis=1))]


def nearest(x, entries):
    """(index, squared distance) of the nearest entry of every row of x, ties to the lower index.

    Numbers too large for 64-bit sums are worked on as whole numbers of any size.
    """
    n = 1 << (x.shape[1] - 1).bit_length()
    large = max(_most(x), _most(entries)) > (1 << 30) // n
    kind = object if large else np.int64
    pad = ((0, 0), (0, n - x.shape[1]))
    a, c = walsh(np.pad(x, pad).astype(kind)), walsh(np.pad(entries, pad).astype(kind))
    part = (a[:, :1] - c[:, 0]) ** 2
    bound = ((a - c[part.argmin(axis=1)]) ** 2).sum(axis=1)
    row, entry = np.nonzero(part <= bound[:, None])
    part = part[row, entry]
    for s in range(1, n):
        part = part + (a[row, s] - c[entry, s]) ** 2
        open_ = np.flatnonzero(part <= bound[row])
        row, entry, part = row[open_], entry[open_], part[open_]
    first = np.searchsorted(row, np.arange(len(a)))
    least = np.minimum.reduceat(part, first) if len(a) else part
    hit = np.flatnonzero(part == least[row])
    return entry[hit[np.searchsorted(row[hit], np.arange(len(a)))]], least // n


def _most(x):
    return max(int(x.max()), -int(x.min())) if x.size else 0


class Codebooks:
    """Entries by part, index and position, as whole numbers of `scale` times the components."""

    def __init__(self, entries, scale):
        self.entries, self.scale = entries, scale
        self.parts, self.count, self.width = entries.shape

    def sha256(self):
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def matrices(self, batch, at):
        """Row ranges of a batch and their integer parts (rows, parts, width)."""
        lists, size = batch.column(at), self.parts * self.width
        for lo in range(0, batch.num_rows, step := max(1, NUMBERS // size)):
            part = lists.slice(lo, step)
            lengths = part.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = np.floor(part.flatten().to_numpy(zero_copy_only=False) * self.scale)
            out = np.zeros((len(part), size), np.int64)
            row = np.repeat(np.arange(len(part)), lengths)
            out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat.astype(np.int64)
            yield lo, out.reshape(len(part), self.parts, self.width)

    def nearest(self, x):
        """(indexes, squared distances) of all parts, each (rows, parts); rows with large numbers apart from the rest."""
        index, distance = np.empty(x.shape[:2], np.int64), np.empty(x.shape[:2], object)
        large = np.abs(x).max(axis=(1, 2)) > (1 << 30) // (2 * self.width)
        for rows in (np.flatnonzero(~large), np.flatnonzero(large)):
            for p in range(self.parts if len(rows) else 0):
                index[rows, p], distance[rows, p] = nearest(x[rows, p], self.entries[p])
        return index, distance


def prepared(vectors: DataFrame, id_column="vec_id", vector_column="embedding", label_column="label") -> DataFrame:
    """(id, v, label, fits) of the vectors whose components are all finite; `fits` is false where one is too large."""
    v = F.col("v")
    return (vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v"), F.col(label_column).alias("label"))
            .where(v.isNotNull()).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
            .withColumn("fits", F.forall("v", lambda x: F.abs(x) * SCALE < LARGEST)))


def fit(rows: DataFrame, parts=PARTS, entries=ENTRIES, rounds=ROUNDS, scale=SCALE) -> Codebooks | None:
    """Codebooks after `rounds` of assigning all parts and replacing each entry by floor(sum / count); None without rows."""
    rows = rows.where("fits").select("id", "v")
    size = rows.agg(F.max(F.size("v"))).first()[0]
    if size is None:
        return None
    width = max(1, math.ceil(size / parts))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()  # `entries` vectors
    books = Codebooks(np.zeros((parts, len(first), width), np.int64), scale)
    for k, r in enumerate(first):
        whole = [math.floor(scale * x) for x in r.v] + [0] * (parts * width - len(r.v))
        books.entries[:, k] = np.array(whole, np.int64).reshape(parts, width)
    for _ in range(rounds):
        books = Codebooks(books.entries.copy(), scale)
        for r in _sums(rows, books).collect():  # at most parts * entries rows of a part's width
            books.entries[r.part, r.entry] = [int(t) // r.n for t in r.totals]
    return books


def _sums(rows, books):
    """(part, entry, totals, n): the parts nearest to each entry added up, by task and then by Spark."""
    def add(batches):
        total = np.zeros(books.entries.shape, object)
        count = np.zeros(books.entries.shape[:2], np.int64)
        for batch in batches:
            for _, x in books.matrices(batch, 0):
                index, _ = books.nearest(x)
                kind = object if _most(x) * len(x) >= 1 << 62 else np.int64
                for p in range(books.parts):
                    some = np.zeros(books.entries.shape[1:], kind)
                    np.add.at(some, index[:, p], x[:, p].astype(kind))
                    total[p] += some
                    count[p] += np.bincount(index[:, p], minlength=books.count)
        part, entry = np.nonzero(count)
        sums = [[Decimal(int(t)) for t in total[p, e]] for p, e in zip(part, entry, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(sums, pa.list_(pa.decimal128(38, 0))),
             pa.array(count[part, entry])], names=["part", "entry", "totals", "n"])

    added = rows.select("v").mapInArrow(add, "part int, entry int, totals array<decimal(38,0)>, n long")
    each = added.select("part", "entry", "n", F.posexplode("totals").alias("position", "t"))
    return (each.groupBy("part", "entry", "position").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
            .groupBy("part", "entry").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("position", "t"))).alias("s"))
            .select("part", "entry", "n", F.col("s.t").alias("totals")))


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(id, codes, error, label): the index of each part's nearest entry and the squared distances, summed.

    `codes` is NULL where a component is too large; `error` also where the sum exceeds a long.
    """
    kinds = dict(rows.dtypes)

    def assign(batches):
        for batch in batches:
            for lo, x in books.matrices(batch, 0):
                index, distance = books.nearest(x)
                error = [e if e < 1 << 63 else None for e in distance.sum(axis=1).tolist()]
                codes = pa.ListArray.from_arrays(np.arange(0, index.size + 1, books.parts, dtype=np.int32), pa.array(index.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(lo, len(x)), codes, pa.array(error, pa.int64()), batch.column(2).slice(lo, len(x))],
                    names=["id", "codes", "error", "label"])

    schema = f"id {kinds['id']}, codes array<int>, error long, label {kinds['label']}"
    coded = rows.where("fits").select("v", "id", "label").mapInArrow(assign, schema)
    return coded.unionByName(rows.where("not fits").select("id", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error"), "label"))


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """(id, v): the entries that the codes name, one after the other, as components."""
    def restore(batches):
        for batch in batches:
            index = np.array(batch.column(1).to_pylist(), np.int64).reshape(-1, books.parts)
            v = (books.entries[np.arange(books.parts), index] / books.scale).reshape(len(index), -1)
            lists = pa.ListArray.from_arrays(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32), pa.array(v.ravel().astype(np.float64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "v"])

    return coded.where("codes IS NOT NULL").select("id", "codes").mapInArrow(restore, f"id {dict(coded.dtypes)['id']}, v array<double>")


def compress(vectors: DataFrame, parts=PARTS, entries=ENTRIES, rounds=ROUNDS, scale=SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every vector whose components are all finite.

    NULL vectors and vectors with a NULL, NaN or infinite component are dropped. Repeated
    rows and ids, and NULL ids, are coded each on their own; the first entries are those of
    the smallest ids (NULL last, ties by components), fewer if there are fewer vectors.
    Vectors of other lengths than the longest, or not divisible by `parts`, are filled with
    zeros. A component of 2**62 or more once scaled leaves its vector without code and out
    of the codebooks; `error` and `label_error` are NULL where they exceed a long. An empty
    table gives no rows. Columns other than vec_id, embedding and label are ignored.
    """
    assert entries <= 256, "a code is two hex digits"
    rows = prepared(vectors)
    books = fit(rows, parts, entries, rounds, scale) or Codebooks(np.zeros((parts, 0, 1), np.int64), scale)
    group = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    code = F.array_join(F.transform("codes", lambda i: F.lower(F.lpad(F.hex(i), 2, "0"))), "")
    coded = stored(encode(rows, books).select("id", code.alias("code"), "error", group.alias("group")), "vector-codes")
    whole = F.count("error") == F.count("*")
    labels = stored(coded.groupBy("group").agg(
        F.when(whole, F.sum(F.col("error").cast("decimal(38,0)"))).alias("total"), F.count("*").alias("members")), "vector-labels")
    return (join_groups(coded, labels, "group", "members")
            .select(F.col("id").alias("vec_id"), "code", "error", F.expr("try_cast(total AS long)").alias("label_error"),
                    F.lit(books.sha256()).alias("codebooks_sha256")))
