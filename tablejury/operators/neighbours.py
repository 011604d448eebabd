"""Exact nearest-neighbour distances between two point sets, without a cross join.

Space is cut twice, each time by counts of all points. Cells come first: every pass
counts the oversized cells' points in bins along their widest side and cuts them
between bins, so a few passes leave no cell above `cell_rows`, which grows with the
square root of the points. A task then cuts one cell into leaves at exact medians.

Queries go through cells best first, in rounds: a query visits the unvisited cells
nearest to it whose boxes are nearer than the distance it has, one cell in the first
round and twice as many in each further one. Within a cell it goes from leaf to leaf in
the same manner, and every leaf may tighten its bound. Visits are joins of (cell, salt)
groups: a cell crowded with queries is split over salts, identical points are folded
beforehand, and one minimum per query and cell leaves a task.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tablejury.session import shared_table, spread

LEAF_ROWS = 512
CELL_ROWS = 32_768
BINS = 64
BATCH = 256


def _matrix(column):
    """Rows of equal length from an Arrow list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _lists(matrix):
    n, width = matrix.shape
    return pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32), pa.array(np.ascontiguousarray(matrix).ravel()))


class Cells:
    """A binary tree of cuts whose ends are cells with their counts and tight boxes."""

    def __init__(self, count, low, high):
        self.dim, self.cut, self.child = [0], [np.inf], [(0, 0)]
        self.ends = {0: (count, np.array(low), np.array(high))}

    def locate(self, x):
        dim, cut, child = np.array(self.dim), np.array(self.cut), np.array(self.child)
        node = np.zeros(len(x), np.int64)
        while len(inner := np.flatnonzero(child[node, 0] > 0)):
            at = node[inner]
            node[inner] = child[at, (x[inner, dim[at]] > cut[at]).astype(int)]
        return node

    def edges(self, node):
        """The widest side of a cell and the upper ends of its bins, all but the last below the side's end."""
        _, low, high = self.ends[node]
        dim = int(np.argmax(high - low))
        ends = low[dim] + (high[dim] - low[dim]) * (np.arange(1, BINS + 1) / BINS)
        ends = np.where(ends < high[dim], ends, low[dim])  # a side too narrow for so many bins keeps its lowest value apart
        return dim, np.append(np.sort(ends[:-1]), high[dim])

    def split(self, node, dim, ends, bins, limit):
        """Cut a cell between its bins [(bin, count, low, high)] in order until parts are small or widest elsewhere."""
        count = sum(b[1] for b in bins)
        low, high = np.min([b[2] for b in bins], axis=0), np.max([b[3] for b in bins], axis=0)
        self.ends[node] = (count, low, high)
        if count <= limit or len(bins) < 2 or int(np.argmax(high - low)) != dim:
            return
        below = np.cumsum([b[1] for b in bins])[:-1]
        k = int(np.argmin(np.abs(below - count / 2))) + 1
        del self.ends[node]
        self.dim[node], self.cut[node] = dim, ends[bins[k - 1][0]]
        self.child[node] = (len(self.dim), len(self.dim) + 1)
        self.dim += [0, 0]
        self.cut += [np.inf, np.inf]
        self.child += [(0, 0), (0, 0)]
        left, right = self.child[node]
        self.split(left, dim, ends, bins[:k], limit)
        self.split(right, dim, ends, bins[k:], limit)


def _count_bins(points, cells, large):
    """(node, bin, n, low, high) of the oversized cells' points, added up within tasks and then by Spark."""
    sides = {node: cells.edges(node) for node in large}
    width = len(next(iter(cells.ends.values()))[1])

    def run(batches):
        total = {}
        for batch in batches:
            x = _matrix(batch.column(0))
            node = cells.locate(x) if len(x) else np.zeros(0, np.int64)
            for n in np.intersect1d(np.unique(node), large).tolist():
                dim, ends = sides[n]
                mine = x[node == n]
                where = np.minimum(np.searchsorted(ends, mine[:, dim], side="left"), BINS - 1)
                for b in np.unique(where).tolist():
                    some = mine[where == b]
                    k, low, high = total.get((n, b), (0, np.inf, -np.inf))
                    total[n, b] = (k + len(some), np.minimum(low, some.min(axis=0)), np.maximum(high, some.max(axis=0)))
        keys = list(total)
        yield pa.RecordBatch.from_arrays([
            pa.array([n for n, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int32()), pa.array([total[k][0] for k in keys], pa.int64()),
            pa.array([total[k][1].tolist() for k in keys], pa.list_(pa.float64())), pa.array([total[k][2].tolist() for k in keys], pa.list_(pa.float64()))],
            names=["node", "bin", "n", "low", "high"])

    def each(f, column):
        return F.array(*[f(F.element_at(column, k + 1)) for k in range(width)]).alias(column)

    return (points.select("vec").mapInArrow(run, "node long, bin int, n long, low array<double>, high array<double>")
            .groupBy("node", "bin").agg(F.sum("n").alias("n"), each(F.min, "low"), each(F.max, "high")))


def build_cells(points, limit):
    """Cells of at most `limit` distinct points. The driver holds their boxes; there are about 2 n / limit."""
    width = points.select(F.size("vec")).first()[0]
    row = points.agg(F.count(F.lit(1)).alias("n"), *[f(F.element_at("vec", k + 1)).alias(f"{s}{k}") for k in range(width) for s, f in (("lo", F.min), ("hi", F.max))]).first()
    cells = Cells(row["n"], [row[f"lo{k}"] for k in range(width)], [row[f"hi{k}"] for k in range(width)])
    while large := [n for n, end in cells.ends.items() if end[0] > limit]:
        found = {}
        for r in _count_bins(points, cells, np.array(large)).collect():  # at most BINS rows for each oversized cell
            found.setdefault(r["node"], []).append((r["bin"], r["n"], np.array(r["low"]), np.array(r["high"])))
        for node, bins in found.items():
            cells.split(node, *cells.edges(node), sorted(bins, key=lambda b: b[0]), limit)
    return cells


def _leaf_rows(x, rows):
    """Row numbers of a cell's leaves: cut at the median of the widest side until `rows` or fewer are left."""
    todo, leaves = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= rows:
            leaves.append(at)
            continue
        part = x[at]
        dim = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        values = part[:, dim]
        cut = np.median(values)
        if cut == values.max():  # keep both sides non-empty when the top value repeats
            cut = values[values < cut].max()
        todo += [at[values <= cut], at[values > cut]]
    return leaves


def build_leaves(points, cells, leaf_rows):
    """(cell, points, low, high): one row per leaf, its points one after the other."""
    def place(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(cells.locate(_matrix(batch.column(0)))), batch.column(0)], names=["cell", "vec"])

    def cut(table):
        x = _matrix(table.column("vec"))
        leaves = _leaf_rows(x, leaf_rows)
        return pa.table({"cell": pa.array([table.column("cell")[0].as_py()] * len(leaves), pa.int64()),
                         "points": pa.array([x[at].ravel() for at in leaves], pa.list_(pa.float64())),
                         "low": _lists(np.stack([x[at].min(axis=0) for at in leaves])), "high": _lists(np.stack([x[at].max(axis=0) for at in leaves]))})

    return (points.select("vec").mapInArrow(place, "cell long, vec array<double>").groupBy("cell")
            .applyInArrow(cut, "cell long, points array<double>, low array<double>, high array<double>"))


def _gaps(x, low, high):
    """Squared distance of every row of x to every box."""
    total = np.zeros((len(x), len(low)))
    for k in range(x.shape[1]):
        gap = np.maximum(np.maximum(low[:, k] - x[:, k, None], x[:, k, None] - high[:, k]), 0.0)
        total += gap * gap
    return total


def _block_min(a, b):
    """Smallest squared distance from each row of a to the rows of b, by direct differences."""
    total = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        diff = a[:, k, None] - b[None, :, k]
        total += diff * diff
    return total.min(axis=1)


def _search_cell(x, best, leaves, low, high):
    """(squared distances, leaves compared) of queries x with bounds `best` in one cell's leaves.

    Queries are taken in batches of neighbours. Each first visits its nearest leaf, then the
    batch goes through the other leaves, nearest first, with the queries whose bounds they undercut.
    """
    found, compared = best.copy(), np.zeros(len(x), np.int64)
    first = np.concatenate([_gaps(x[i:i + BATCH], low, high).argmin(axis=1) for i in range(0, len(x), BATCH)])
    order = np.argsort(first, kind="stable")
    for i in range(0, len(x), BATCH):
        at = order[i:i + BATCH]
        mine, gaps, bound = x[at], _gaps(x[at], low, high), found[at]
        near = first[at]

        def visit(rows, leaf):
            bound[rows] = np.minimum(bound[rows], _block_min(mine[rows], leaves[leaf]))
            compared[at[rows]] += 1

        for leaf in np.unique(near).tolist():
            visit(np.flatnonzero(near == leaf), leaf)
        gaps[np.arange(len(at)), near] = np.inf
        least = gaps.min(axis=0)
        for leaf in np.argsort(least).tolist():
            if least[leaf] >= bound.max():
                break
            rows = np.flatnonzero(gaps[:, leaf] < bound)
            if len(rows):
                visit(rows, leaf)
        found[at] = bound
    return found, compared


def _visit(asked, salts, leaves):
    """(id, d2, leaves) for every (query, cell) pair asked for; `salts` has the salts of each cell."""
    salted = asked.join(salts, "cell").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("n_salts")).cast("int")).drop("n_salts")
    offered = leaves.join(salts, "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1))).drop("n_salts")

    def compare(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "d2": pa.array([], pa.float64()), "leaves": pa.array([], pa.int64())})
        x, best = _matrix(left.column("vec")), left.column("best").to_numpy()
        points = [np.asarray(p.values).reshape(-1, x.shape[1]) for p in right.column("points")]
        d2, compared = _search_cell(x, best, points, _matrix(right.column("low")), _matrix(right.column("high")))
        return pa.table({"id": left.column("id"), "d2": pa.array(d2), "leaves": pa.array(compared)})

    return salted.groupBy("cell", "salt").cogroup(offered.groupBy("cell", "salt")).applyInArrow(compare, "id long, d2 double, leaves long")


def search(queries, points, leaf_rows=LEAF_ROWS, cell_rows=None):
    """(vec, distance, leaves) for every distinct query vector: Euclidean distance to its nearest point, leaves compared.

    Both inputs have one column ``vec`` of doubles without NULL.
    """
    points = shared_table(spread(points.select("vec").distinct(), "vec"), "points")
    n = points.count()
    if n == 0:
        raise ValueError("no points to search")
    limit = cell_rows or max(CELL_ROWS, math.isqrt(n * leaf_rows))
    cells = build_cells(points, limit)
    leaves = shared_table(build_leaves(points, cells, leaf_rows), "leaves")
    nodes = np.array(sorted(cells.ends))
    low, high = (np.stack([cells.ends[n][k] for n in nodes.tolist()]) for k in (1, 2))
    least, tasks = max(2048, limit // 8), 4 * points.sparkSession.sparkContext.defaultParallelism

    def agenda(seen, take, count=False):
        """The next `take` cells of every query in order of their distance, as far as they are nearer than its bound; or how often a task asks for each cell."""
        def run(batches):
            total = np.zeros(len(nodes), np.int64)
            for batch in batches:
                x, best = _matrix(batch.column(1)), batch.column(2).to_numpy()
                for i in range(0, len(x), step := max(1, 4_000_000 // len(nodes))):
                    gaps = _gaps(x[i:i + step], low, high)
                    order = np.argsort(gaps, axis=1, kind="stable")[:, seen:seen + take]
                    row, rank = np.nonzero(np.take_along_axis(gaps, order, axis=1) < best[i:i + step, None])
                    if count:
                        total += np.bincount(order[row, rank], minlength=len(nodes))
                        continue
                    where = pa.array(row + i)
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).take(where) for c in range(3)], pa.array(nodes[order[row, rank]])], names=["id", "vec", "best", "cell"])
            if count:
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[used]), pa.array(total[used])], names=["cell", "n"])
        return run

    state = shared_table(spread(queries.select("vec").distinct(), "vec").withColumn("id", F.monotonically_increasing_id())
                         .select("id", "vec", F.lit(math.inf).alias("best"), F.lit(0).cast("long").alias("leaves")), "queries")
    seen, take, done = 0, 1, []
    while seen < len(nodes):
        bounds = state.select("id", "vec", "best")  # pairs of query and cell are many: counted first, made again for the shuffle instead of written
        counts = shared_table(bounds.mapInArrow(agenda(seen, take, count=True), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "counts")
        total = counts.agg(F.sum("n")).first()[0]
        if not total:
            break
        block = max(least, min(limit, total // tasks))  # every salt takes a copy of its cell: no more of them than keep all cores busy
        salts = counts.select("cell", F.ceil(F.col("n") / block).cast("int").alias("n_salts"))
        asked = bounds.mapInArrow(agenda(seen, take), "id long, vec array<double>, best double, cell long")
        got = _visit(asked, salts, leaves).groupBy("id").agg(F.min("d2").alias("d2"), F.sum("leaves").alias("more"))
        state = shared_table(state.join(got, "id", "left").select(
            "id", "vec", F.least("best", "d2").alias("best"), (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"),
            F.col("d2").isNotNull().alias("open")), "bounds")
        done.append(state.where("NOT open").drop("open"))  # cells come in order of their distance: who asked for none asks for none later
        state = state.where("open").drop("open")
        seen, take = seen + take, 2 * take
    for part in done:
        state = state.unionByName(part)
    return state.select("vec", F.sqrt("best").alias("distance"), "leaves")


def nearest_distances(queries, points, leaf_rows=LEAF_ROWS, cell_rows=None):
    """(vec, distance) for every distinct query vector: Euclidean distance to its nearest point."""
    return search(queries, points, leaf_rows, cell_rows).drop("leaves")
