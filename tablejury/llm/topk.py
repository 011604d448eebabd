"""Exact top-k by inner product: norm-sorted blocks, rotated partial sums, Cauchy-Schwarz pruning.

Vectors are sorted by descending length and cut into blocks. Coordinates are
rotated by the right singular vectors of the whole table (from its Gram matrix),
so that the first few carry most of every inner product. A pair of a query and a
vector can beat the query's k-th best score only if

    head of q . head of v + |rest of q| * |rest of v|  >=  that score,

and a block only if |q| * (its largest length) does. Queries first meet the
block of the longest vectors, which gives each a lower bound for its k-th score;
then every query block meets the vector blocks its bound leaves open. Survivors
are scored in 64-bit integers, so scores and ties are exact.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tablejury.llm.common import small, stored

K, BLOCK, QUERY_BLOCK, SUB = 20, 4096, 512, 512
EXACT, DENSE, PAIRS = 2.0 ** 52, 64, 20_000  # whole numbers of doubles, with room for rounded lengths; a matrix product costs less from one open pair in DENSE; pairs scored at once


def quantised(vectors: DataFrame, id_column="vec_id", vector_column="embedding", scale=64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, for vectors whose components are all finite.

    Rows with a NULL id or vector, or with a NULL, NaN or infinite component, take
    no part. Repeated rows fold into one; if an id has several vectors, the
    smallest in array order counts.
    """
    x = F.col(vector_column)
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    ints = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("long"))
    return (vectors.where(F.col(id_column).isNotNull() & x.isNotNull()).where(fine)
            .select(F.col(id_column).cast("long").alias("vec_id"), ints.alias("v"))
            .groupBy("vec_id").agg(F.min("v").alias("v")))


def _matrix(column, width):
    """Dense int64 rows of an Arrow list column, shorter vectors filled with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    column_of = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, column_of] = flat
    return out


def rotation(table: DataFrame, width):
    """Right singular vectors of all rows, strongest first, from one Gram matrix per partition (width squared)."""
    def gram(batches):
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column(0), width).astype(np.float64)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(width), width)),
                                          pa.array(np.tile(np.arange(width), width)), pa.array(total.ravel())],
                                         names=["i", "j", "x"])

    cells = table.select("v").mapInArrow(gram, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))
    g = np.zeros((width, width))
    for r in cells.collect():  # width squared numbers
        g[r["i"], r["j"]] = r["x"]
    values, vectors = np.linalg.eigh(g)
    return vectors[:, np.argsort(-values)]


def blocks(table: DataFrame, width, rows, sort) -> DataFrame:
    """Rows packed into binary blocks in the given order: (block, ids, data, longest, bounds, least bound)."""
    def pack(batches):
        part, number, held = TaskContext.get().partitionId(), 0, []

        def emit(take):
            nonlocal number
            ids, m, t = (np.concatenate([h[i] for h in held]) for i in range(3))
            held[:] = [(ids[take:], m[take:], t[take:])] if len(ids) > take else []
            ids, m, t = ids[:take], m[:take], t[:take]
            longest = float(np.sqrt((m.astype(np.float64) ** 2).sum(1)).max())
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + number - 1]), pa.array([ids.tobytes()], pa.binary()),
                 pa.array([m.tobytes()], pa.binary()), pa.array([longest]), pa.array([t.tobytes()], pa.binary()),
                 pa.array([int(t.min())])],
                names=["block", "ids", "data", "longest", "bounds", "least"])

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), _matrix(batch.column(1), width),
                             batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)))
            while sum(len(h[0]) for h in held) >= rows:
                yield emit(rows)
        while held and sum(len(h[0]) for h in held):
            yield emit(rows)

    n = max(1, -(-table.count() // (rows * 4)))
    ordered = table.repartitionByRange(n, *sort).sortWithinPartitions(*sort)
    return ordered.select("vec_id", "v", "bound").mapInArrow(
        pack, "block long, ids binary, data binary, longest double, bounds binary, least long")


def _scored(qf, vf, q_ids, v_ids, bound, live, lo, open_pairs, k):
    """(query, vector, score) of open pairs, by one matrix product: of each query those among its k best here, with all ties."""
    rows, columns = np.flatnonzero(open_pairs.any(1)), np.flatnonzero(open_pairs.any(0))
    a, b = live[rows], columns + lo
    score = qf[a] @ vf[b].T
    score[~open_pairs[np.ix_(rows, columns)] | (q_ids[a][:, None] == v_ids[b][None, :])] = -np.inf
    least = bound[a].astype(np.float64)  # a bound beyond EXACT is none: the smallest number of 64 bits
    if len(b) > k:
        least = np.maximum(least, np.partition(score, len(b) - k, axis=1)[:, len(b) - k])
    i, j = np.nonzero((score >= least[:, None]) & (score > -np.inf))
    return a[i], b[j], score[i, j].astype(np.int64)


def _search(width, k, basis):
    """Pairs of blocks to the up to k best (query_id, vec_id, score) of each query that reach its bound."""
    head = max(1, width // 4)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                cell = [np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in range(5)]
                q_ids, bound, v_ids = cell[0], cell[2].copy(), cell[3]  # 64-bit ids, bounds and components
                q, v = cell[1].reshape(-1, width), cell[4].reshape(-1, width)
                qf, vf = q.astype(np.float64), v.astype(np.float64)
                qr, vr = qf @ basis, vf @ basis
                q_len, v_len = np.sqrt((qf ** 2).sum(1)), np.sqrt((vf ** 2).sum(1))
                q_rest = np.sqrt(np.maximum((qr[:, head:] ** 2).sum(1), 0))
                v_rest = np.sqrt(np.maximum((vr[:, head:] ** 2).sum(1), 0))
                slack = 1e-9 * (1 + q_len * v_len.max(initial=0.0))
                exact = q_len.max(initial=0.0) * v_len.max(initial=0.0) < EXACT  # every partial sum is then a whole number that a double holds
                found_q, found_v, found_s = (np.zeros(0, np.int64) for _ in range(3))
                for lo in range(0, len(v), SUB):
                    hi = min(lo + SUB, len(v))
                    live = np.flatnonzero(q_len * v_len[lo:hi].max() + slack >= bound)
                    if not len(live):
                        break  # lengths only fall from here on
                    upper = qr[live, :head] @ vr[lo:hi, :head].T + np.outer(q_rest[live], v_rest[lo:hi])
                    open_pairs = upper + slack[live, None] >= bound[live, None]
                    if exact and open_pairs.sum() * DENSE > open_pairs.size:
                        a, b, score = _scored(qf, vf, q_ids, v_ids, bound, live, lo, open_pairs, k)
                    else:
                        a, b = np.nonzero(open_pairs)
                        a, b = live[a], b + lo
                        score = np.concatenate([np.einsum("ij,ij->i", q[a[s:s + PAIRS]], v[b[s:s + PAIRS]]) for s in range(0, max(1, len(a)), PAIRS)])
                    take = (score >= bound[a]) & (q_ids[a] != v_ids[b])
                    found_q = np.concatenate([found_q, a[take]])
                    found_v = np.concatenate([found_v, v_ids[b[take]]])
                    found_s = np.concatenate([found_s, score[take]])
                    order = np.lexsort((found_v, -found_s, found_q))
                    found_q, found_v, found_s = found_q[order], found_v[order], found_s[order]
                    rank = np.arange(len(found_q)) - np.searchsorted(found_q, found_q)
                    best = rank < k
                    found_q, found_v, found_s, rank = found_q[best], found_v[best], found_s[best], rank[best]
                    full = rank == k - 1
                    bound[found_q[full]] = np.maximum(bound[found_q[full]], found_s[full])
                if len(found_q):
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[found_q]), pa.array(found_v), pa.array(found_s)],
                                                     names=["query_id", "vec_id", "score"])
    return run


def top_k(table: DataFrame, queries: DataFrame, k=K, block=BLOCK, query_block=QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products with rows of other ids.

    `table` and `queries` are (vec_id long, v array<long>), one row per id. Ties
    go to the smaller vec_id; fewer than k candidates give them all. Vectors of
    unequal lengths are compared as if filled with zeros. Scores must fit in 64
    bits. Empty tables give no rows; many equal vectors are split over blocks.
    """
    spark = table.sparkSession
    table = stored(table, "topk-vectors")
    width = table.agg(F.max(F.size("v"))).first()[0] or 1
    norm = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    order = [F.desc("norm"), F.asc("vec_id")]
    least = np.iinfo(np.int64).min
    held = stored(blocks(table.withColumn("bound", F.lit(0).cast("long")).withColumn("norm", norm), width, block, order),
                  "topk-blocks")
    lengths = sorted((r["block"], r["longest"]) for r in held.select("block", "longest").collect())  # one row per block
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    search = _search(width, k, rotation(table, width))
    longest = np.array([x for _, x in lengths])

    @F.pandas_udf("int")
    def open_blocks(length: pd.Series, bound: pd.Series) -> pd.Series:
        """How many blocks, from the longest on, may hold a score of at least the bound."""
        need = bound.to_numpy(np.float64) * (1 - 1e-9) - 1
        reach = length.to_numpy()[:, None] * longest[None, :]
        return pd.Series((reach >= need[:, None]).sum(1))

    def packed(frame, name):
        """Query blocks, written with the block they meet first."""
        out = blocks(frame.withColumn("norm", norm), width, query_block, order)
        return stored(out.select(F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("bounds").alias("q_bounds"),
                                 F.col("longest").alias("q_longest"), F.col("least").alias("q_least"),
                                 F.lit(lengths[0][0]).cast("long").alias("block")), name)

    def meet(pairs):
        return (pairs.join(held, "block").select("q_ids", "q_data", "q_bounds", "ids", "data")
                .mapInArrow(search, "query_id long, vec_id long, score long"))

    queries = stored(queries.select("vec_id", "v"), "topk-queries")
    start = packed(queries.withColumn("bound", F.lit(least)), "topk-seed-queries")
    seed = stored(meet(start), "topk-seed")
    kth = (seed.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("bound"))
           .where(F.col("n") == k).select(F.col("query_id").alias("vec_id"), "bound"))
    again = packed(queries.join(kth, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(least))), "topk-bounded")
    names = stored(spark.createDataFrame([(i, b) for i, (b, _) in enumerate(lengths)], "at int, block long"), "topk-names")
    pairs = (again.drop("block").withColumn("open", open_blocks("q_longest", "q_least")).where("open > 1")
             .withColumn("at", F.explode(F.expr("sequence(1, open - 1)"))).join(small(names, len(lengths)), "at"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (seed.unionByName(meet(pairs)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
