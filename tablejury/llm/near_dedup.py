"""Near-duplicate documents by an LSH forest: sorted signature orders, longest-common-prefix neighbours.

Every distinct shingle set gets `TREES` chunks of `DEPTH` minimum hashes. In each
tree the sets are sorted by their chunk, so that sets with the longest common
prefixes stand side by side. A set's candidates stand within `NEAR` places and
share a prefix at all: in a thin region that is everyone with one common minimum,
in a crowded one those that agree deeper, so the depth adapts to the region. A
sketch of two bits per minimum screens them (five standard deviations below what
a link would show), and so does the parity of the set's size in each of `PARITY` hash
buckets: two sets differ in no fewer shingles than parities, so no link is screened out.
In each tree the `BEST` on either side go on to be confirmed
on full sets. A set for which that was not all in a tree (candidates left out, a region longer
than the window) is marked there. Of two sets that meet in a tree, either both are compared or
both are marked; sets marked in more than `spare` trees are crowded. They
go through another round with a wider window and more of the best, where only
candidates of different components count, until a round links next to nothing: what a
crowd hides from one round, the next finds once the crowd has become one component.
Sets that are crowded even then are compared by an exact prefix-filter join on their
rarest shingles, which leaves out no pair of different components. So a link is missed
only if its sets meet in `spare` trees or fewer: at the bound by a chance below `MISS`.

The sorted order is range-partitioned by the whole chunk, so that a region shared
by a third of all rows is cut like any other; the first and last rows of each
partition are compared across the cut in a second, small step.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tablejury.llm.common import join_groups, likely, mix, parts, run_hashes, slices, stored, text_buffer

TREES, DEPTH, NEAR, WIDER, BEST = 16, 8, 64, 4, 2
CHUNK = 4 + 2 * (DEPTH - 1)  # bytes of a tree's chunk: its first minimum whole, of the others, which only order a region, the lower half
SHINGLE, SIMILARITY = 4, 80  # words, per cent
PARITY = 256  # bits
MOST_BITS, BLOCK = 20, 1000  # of the exact join: buckets of shingles by commonness, sets a block of a shingle
MISS = 1e-7
LITTLE = 100  # a round that links fewer than one in so many of the sets still crowded is the last


def spare(trees):
    """The most trees that a set may be marked in without being crowded: of `trees` two sets at the bound meet in no more by a chance below MISS."""
    p = SIMILARITY / 100
    chances = np.cumsum([math.comb(trees, k) * p ** k * (1 - p) ** (trees - k) for k in range(trees + 1)])
    return max(0, int((chances < MISS).sum()) - 1)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, np.uint8)
_WORD[[9, 10, 11, 12, 13, 32]] = 0
_COEFFICIENTS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_A = mix(np.arange(1001, 1001 + TREES * DEPTH, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(5001, 5001 + TREES * DEPTH, dtype=np.uint64))


def shingle_sets(data, offsets, size=SHINGLE):
    """The sorted distinct shingle hashes of each document; a text of fewer words is one shingle of all of them."""
    low = _LOWER[data]
    h, _, bounds = run_hashes(low, _WORD[low], offsets)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(h) - size + 1), np.uint64)
        for i in range(size):
            rolled += h[i:len(h) - size + 1 + i] * _COEFFICIENTS[i]
        rolled = mix(rolled)
        for d in range(len(offsets) - 1):
            lo, hi = bounds[d], bounds[d + 1]
            if hi - lo >= size:
                yield np.unique(rolled[lo:hi - size + 1])
            elif hi > lo:
                whole = (h[lo:hi] * _COEFFICIENTS[size + np.arange(hi - lo)]).sum(dtype=np.uint64)
                yield mix(np.array([whole + np.uint64(hi - lo)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def digest(shingles):
    """16 bytes that identify a set."""
    with np.errstate(over="ignore"):
        one = mix(shingles).sum(dtype=np.uint64)
        two = mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return np.array([one, two], np.uint64).tobytes()


def minima(shingles):
    """The upper half of each of the smallest linear hashes."""
    out = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(shingles), 4096):
            part = shingles[lo:lo + 4096]
            np.minimum(out, (_A[:, None] * part[None, :] + _B[:, None]).min(1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _chunks(minimum):
    """The chunks of all trees one after the other."""
    by_tree = minimum.reshape(TREES, DEPTH)
    first, others = by_tree[:, :1].astype(">u4"), (by_tree[:, 1:] & 0xFFFF).astype(">u2")
    return np.hstack([first.view(np.uint8), others.view(np.uint8)]).tobytes()


def _sketch(minimum):
    """Two bits of every minimum, packed."""
    two = (minimum & 3).astype(np.uint8).reshape(-1, 4)
    return (two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6).tobytes()


def _parity(shingles, bits=PARITY):
    """Whether each of `bits` buckets, a power of two, holds an odd number of the shingles, packed."""
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def _sized_parity(shingles):
    """The size of a set, then parities of at least twice as many buckets: a sixteenth to a thirty-second of the set."""
    n = len(shingles)
    return np.uint64(n).tobytes() + _parity(shingles, max(PARITY, 1 << (2 * n - 1).bit_length()))


def _may_link(x, y):
    """Whether the parities of two sets leave it open that they overlap enough."""
    n, m = (int.from_bytes(s[:8], "little") for s in (x, y))
    x, y = (np.frombuffer(s, np.uint64, offset=8) for s in (x, y))
    while len(x) != len(y):  # buckets of half as many: those of the second half join the first
        if len(x) > len(y):
            x = x[:len(x) // 2] ^ x[len(x) // 2:]
        else:
            y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return _reachable(np.bitwise_count(x ^ y).sum(dtype=np.int64), n + m)


def _reachable(apart, both):
    """Whether sets of `both` shingles together, of which `apart` or more are in one only, can overlap enough."""
    return apart * (100 + SIMILARITY) <= both * (100 - SIMILARITY)


_AGREE = SIMILARITY / 100 + (1 - SIMILARITY / 100) / 4
_WORDS = len(_sketch(np.zeros(TREES * DEPTH, np.uint32))) // 8  # of 64 bits, before the parities
_MOST_DIFFERENT = int(TREES * DEPTH * (1 - _AGREE) + 5 * np.sqrt(TREES * DEPTH * _AGREE * (1 - _AGREE)))


def signatures(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_id, signature, sketch) of every row, stored; empty sets have NULLs. The parities follow the sketch."""
    kind = dict(documents.dtypes)["doc_id"]

    def sign(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in slices(offsets):
                rows, last = [], {}
                for s in shingle_sets(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]):
                    if not len(s):
                        rows.append((0, None, None, None))
                        continue
                    name = digest(s)
                    if name not in last:
                        m = minima(s)
                        last[name] = (len(s), name, _chunks(m), _sketch(m) + _parity(s))
                    rows.append(last[name])
                n, name, signature, sketch = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(name, pa.binary()),
                     pa.array(signature, pa.binary()), pa.array(sketch, pa.binary())],
                    names=["doc_id", "n_shingles", "set_id", "signature", "sketch"])

    return stored(documents.select("doc_id", "text").mapInArrow(
        sign, f"doc_id {kind}, n_shingles long, set_id binary, signature binary, sketch binary"), "dedup-signatures")


def _near(frame, near, best, across=None):
    """Pairs at most `near` apart in the order that share a prefix, differ in root and pass size and sketch.

    A sketch may have no parities behind it. Of these, the `best` on either side in the view of the row whose component is not the larger one. Also the numbers
    of the rows for which that was not all: candidates left out, or a region longer than the window. `across` marks the rows before the cut, when only pairs over it count.
    """
    first = np.frombuffer(b"".join(c[:4] for c in frame["chunk"]), ">u4")
    sketch = np.frombuffer(b"".join(frame["sketch"]), "<u8").reshape(len(frame), -1)
    sketch, parity = sketch[:, :_WORDS], sketch[:, _WORDS:]
    tree, n, names = frame["tree"].to_numpy(), frame["n_shingles"].to_numpy(), frame["set_id"].to_numpy()
    root, weight = pd.factorize(frame["root"])[0], frame["weight"].to_numpy()
    found, live, crowded = [], np.arange(len(frame)), []
    for d in range(1, near + 1):
        live = live[live + d < len(frame)]  # in a sorted order, those that share a prefix at d shared it at d - 1
        live = live[(tree[live] == tree[live + d]) & (first[live] == first[live + d])]
        if not len(live):
            break
        if d == near:  # the region goes on beyond the window
            crowded += [live, live + d]
        i = live[root[live] != root[live + d]]
        if across is not None:
            i = i[across[i] & ~across[i + d]]
        i = i[np.minimum(n[i], n[i + d]) * 100 >= np.maximum(n[i], n[i + d]) * SIMILARITY]
        x = sketch[i] ^ sketch[i + d]
        different = np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(1)
        take = different <= _MOST_DIFFERENT
        i, different = i[take], different[take]
        take = _reachable(np.bitwise_count(parity[i] ^ parity[i + d]).sum(1, dtype=np.int64), n[i] + n[i + d])
        found.append((i[take], i[take] + d, different[take]))
    pairs = set()
    if found:
        i, j, different = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = (_rank(i, different) < best) & (weight[i] <= weight[j]) | (_rank(j, different) < best) & (weight[j] <= weight[i])
        crowded += [i[~keep], j[~keep]]
        pairs.update((min(x, y), max(x, y)) for x, y in zip(names[i[keep]], names[j[keep]], strict=True))
    return pairs, np.unique(np.concatenate(crowded)) if crowded else np.zeros(0, np.int64)


def _rank(group, value):
    """The place of each row among those of its group, smallest value first."""
    order = np.lexsort((value, group))
    ordered = group[order]
    out = np.empty(len(group), np.int64)
    out[order] = np.arange(len(group)) - np.searchsorted(ordered, ordered)
    return out


def candidates(sets: DataFrame, near=NEAR, best=BEST):
    """Distinct pairs (a, b), a < b, of set ids with different roots that are neighbours in some tree, and set ids marked in more than `spare` trees."""
    rows = sets.selectExpr("set_id", "n_shingles", "sketch", "root", "weight", f"""inline(transform(sequence(0, {TREES - 1}), t ->
        struct(t AS tree, substring(signature, t * {CHUNK} + 1, {CHUNK}) AS chunk)))""")
    cuts = max(1, min(parts(sets), sets.count() * TREES // max(2000, 4 * near)))
    ordered = rows.repartitionByRange(cuts, "tree", "chunk", "set_id").sortWithinPartitions("tree", "chunk", "set_id")
    fields = {"tree": "int", "chunk": "binary", "n_shingles": "long", "sketch": "binary", "set_id": "binary", "root": "binary", "weight": "long"}
    names = list(fields)

    def scan(batches):
        part, held, first, total = TaskContext.get().partitionId(), None, None, 0

        def made(n, **columns):
            return pd.DataFrame({k: columns.get(k, [None] * n) for k in ["a", "b", "part", "side", "whole", *names]})

        for frame in batches:
            if not len(frame):
                continue
            total += len(frame)
            if first is None or len(first) < near:
                first = pd.concat([first, frame]).head(near) if first is not None else frame.head(near)
            frame = pd.concat([held, frame], ignore_index=True) if held is not None else frame
            pairs, marked = _near(frame, near, best)
            marked = frame.iloc[marked]
            held = frame.tail(near).reset_index(drop=True)
            if pairs:
                a, b = zip(*pairs, strict=True)
                yield made(len(a), a=list(a), b=list(b))
            if len(marked):
                yield made(len(marked), side=[2] * len(marked), tree=marked["tree"].tolist(), set_id=marked["set_id"].tolist())
        if held is not None:  # of the edges, only the region that touches the cut can meet the other side
            for side, edge, end in ((1, first, 0), (0, held, -1)):
                mine = (edge["tree"] == edge["tree"].iloc[end]) & (edge["chunk"].str[:4] == edge["chunk"].iloc[end][:4])
                edge = edge[mine]
                yield made(len(edge), part=[part] * len(edge), side=[side] * len(edge), whole=[len(edge) == total] * len(edge), **{c: edge[c].tolist() for c in names})

    found = stored(ordered.select(*names).mapInPandas(
        scan, "a binary, b binary, part int, side int, whole boolean, " + ", ".join(f"{k} {v}" for k, v in fields.items())), "dedup-candidates")
    edges = found.where(F.col("side") < 2)
    ranks = edges.select("part").distinct().withColumn("rank", F.row_number().over(W.orderBy("part")))  # one row per partition
    cut = edges.join(ranks, "part").withColumn("cut", F.col("rank") - F.col("side"))

    def over(frame):
        frame = frame.sort_values("side", kind="stable", ignore_index=True)
        frame = pd.concat([part.sort_values(["tree", "chunk", "set_id"]) for _, part in frame.groupby("side")], ignore_index=True)
        left = frame["side"].to_numpy() == 0
        pairs, marked = _near(frame, near, best, across=left)
        region = list(zip(frame["tree"], frame["chunk"].str[:4], strict=True))
        over_cut = 0 < left.sum() < len(frame) and region[0] == region[-1]  # one region on both sides
        if over_cut and (len(frame) > near or frame["whole"].any()):  # it goes on beyond the window, or may beyond a short partition
            marked = np.arange(len(frame))
        marked = frame.iloc[marked]
        return pd.DataFrame([(a, b, None, None) for a, b in sorted(pairs)] + [(None, None, t, c) for t, c in zip(marked["tree"], marked["set_id"], strict=True)],
                            columns=["a", "b", "tree", "set_id"])

    joined = stored(cut.select("cut", "side", "whole", *names).groupBy("cut").applyInPandas(over, "a binary, b binary, tree int, set_id binary"),
                    "dedup-cuts")  # 2 * near rows a group
    pairs = found.where(F.col("side").isNull()).select("a", "b").unionByName(joined.where("a IS NOT NULL").select("a", "b")).distinct()
    marked = found.where(F.col("side") == 2).select("set_id", "tree").unionByName(joined.where("set_id IS NOT NULL").select("set_id", "tree"))
    trees = marked.groupBy("set_id").agg(F.bit_count(F.bit_or(F.expr("shiftleft(1L, tree)"))).alias("trees"))
    return pairs, trees.where(F.col("trees") > spare(TREES)).select("set_id")


def full_sets(documents: DataFrame, sets: DataFrame, names: DataFrame, form=np.ndarray.tobytes) -> DataFrame:
    """(set_id, shingles) of the distinct set ids in `names`, with its other columns, stored: the sorted shingle hashes as bytes, or their `form`."""
    wanted = stored(sets.select("set_id", "doc_id").join(names, "set_id"), "dedup-wanted")

    def fetch(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for lo, hi in slices(offsets):
                found = list(shingle_sets(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]))
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in found], pa.binary()),
                                                  pa.array([form(s) for s in found], pa.binary())], names=["set_id", "shingles"])

    ids = wanted.select("doc_id").distinct()
    texts = documents.select("doc_id", "text").join(ids, "doc_id", "left_semi").select("text")
    if not wanted.where("doc_id IS NULL").isEmpty():  # sets of which no row has a doc_id
        texts = texts.unionByName(documents.where("doc_id IS NULL").select("text"))
    full = texts.mapInArrow(fetch, "set_id binary, shingles binary")
    if names.columns == ["set_id"]:
        full = stored(full, "dedup-sets")
        if full.count() == wanted.count():  # every set wanted is there, so none comes twice and no other does
            return full
    return stored(full.join(wanted.drop("doc_id"), "set_id").dropDuplicates(["set_id"]), "dedup-sets")


def _kept(pairs: DataFrame, full: DataFrame, keep) -> DataFrame:
    """The pairs (a, b) for whose bytes in `full` keep(x, y) holds."""
    def run(batches):
        for batch in batches:
            found = [keep(*(batch.column(c)[i].as_buffer() for c in (2, 3))) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(found, pa.bool_()))

    one = full.select(F.col("set_id").alias("a"), F.col("shingles").alias("x"))
    two = full.select(F.col("set_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _overlap(x, y):
    """Whether two full sets overlap enough."""
    x, y = (np.frombuffer(s, np.uint64) for s in (x, y))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= SIMILARITY * (len(x) + len(y) - both)


def _names(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()


def confirmed(documents: DataFrame, sets: DataFrame, pairs: DataFrame, full: DataFrame = None) -> DataFrame:
    """The pairs whose full sets overlap enough; only those that parities leave open meet as full sets."""
    pairs = stored(pairs, "dedup-pairs")
    if full is None:
        parities = full_sets(documents, sets, _names(pairs), _sized_parity)
    else:
        parities = full.select("set_id", "shingles").mapInArrow(_parities, "set_id binary, shingles binary")
    pairs = stored(_kept(pairs, parities, _may_link), "dedup-open")
    if pairs.isEmpty():
        return pairs
    full = full_sets(documents, sets, _names(pairs)) if full is None else full.join(_names(pairs), "set_id", "left_semi")
    return stored(_kept(pairs, full, _overlap), "dedup-links")


def _parities(batches):
    for batch in batches:
        sized = [_sized_parity(np.frombuffer(x.as_buffer(), np.uint64)) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sized, pa.binary())], names=["set_id", "shingles"])


def _commonness(full: DataFrame, bits: int) -> np.ndarray:
    """In how many sets a shingle of each hash bucket stands."""
    shift = np.uint64(64 - bits)

    def count(batches):
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(total, (np.frombuffer(x.as_buffer(), np.uint64) >> shift).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    rows = full.select("shingles").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    rows = rows.select(F.col("bucket").cast("int"), F.least("n", F.lit(np.iinfo(np.int32).max)).cast("int").alias("n")).toArrow()
    out = np.zeros(1 << bits, np.uint32)  # at most 2 ** MOST_BITS buckets, gathered as columns: as rows they took hundreds of MB
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def exact_candidates(sets: DataFrame, full: DataFrame) -> DataFrame:
    """All pairs (a, b), a < b, of different roots in `full` that can reach SIMILARITY; none that does is left out.

    Sets of n and m shingles that are similar share `SIMILARITY (n + m) / (100 + SIMILARITY)` at
    least. In any order of all shingles, the first shared one then has that many
    places from itself to the end on both sides. The order is by commonness, so
    the places that count hold the rarest shingles. A shingle all of whose sets
    are one component needs no comparison; the sets of a common one are dealt
    over blocks.
    """
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    bits = min(MOST_BITS, max(16, int(total).bit_length() - 1))
    common, shift = _commonness(full, bits), np.uint64(64 - bits)

    def prefixes(batches):
        for batch in batches:
            keys, places, lengths, rows = [], [], [], []
            for i, x in enumerate(batch.column(1)):
                s = np.frombuffer(x.as_buffer(), np.uint64)
                at = common[(s >> shift).astype(np.int64)]
                most = len(s) - -(-SIMILARITY * len(s) // 100) + 1
                near = np.flatnonzero(at <= np.partition(at, most - 1)[most - 1])
                first = near[np.lexsort((s[near], at[near]))[:most]]
                alone = at[first] == 1  # in no other set
                place = np.flatnonzero(~alone)
                keys.append(s[first[place]].view(np.int64))
                places.append(place)
                lengths.append(np.full(len(place), len(s)))
                rows.append(np.full(len(place), i))
            if keys:
                rows = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(places).astype(np.int64)),
                                                  pa.array(np.concatenate(lengths).astype(np.int64)), batch.column(0).take(rows),
                                                  batch.column(2).take(rows)], names=["shingle", "place", "n", "set_id", "root"])

    shared = f"ceil({SIMILARITY} * (%s) / {100 + SIMILARITY})"
    entries = stored(full.select("set_id", "shingles", "root").mapInArrow(
        prefixes, "shingle long, place long, n long, set_id binary, root binary")
        .withColumn("short", F.expr(f"place <= n - {shared % '2 * n'}")), "dedup-prefixes")
    root = F.xxhash64("root")
    keys = stored(entries.groupBy("shingle").agg(F.min(root).alias("one"), F.max(root).alias("other"), F.count_if("short").alias("shorts"))
                  .where((F.col("one") != F.col("other")) & (F.col("shorts") > 0))
                  .select("shingle", F.ceil(F.col("shorts") / BLOCK).cast("int").alias("blocks")), "dedup-keys")
    entries = stored(likely(entries, keys, "shingle").join(keys, "shingle"), "dedup-shared")
    x = entries.where("short").select("shingle", F.expr("pmod(hash(set_id), blocks)").alias("block"), "place", "n", "set_id", "root")
    y = entries.select("shingle", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("place").alias("place_y"),
                       F.col("n").alias("m"), F.col("set_id").alias("set_y"), F.col("root").alias("root_y"))
    return x.join(y, ["shingle", "block"]).where(f"""root != root_y AND (n < m OR n = m AND set_id < set_y) AND 100 * n >= {SIMILARITY} * m
        AND place <= n - {shared % 'n + m'} AND place_y <= m - {shared % 'n + m'}""").select(
        F.least("set_id", "set_y").alias("a"), F.greatest("set_id", "set_y").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node: alternate large and small stars until the edges are stars.

    Each step sends every neighbour of a node to the node's smallest neighbour;
    minima combine before the shuffle, and each step is written, so a lost
    executor repeats one step at most.
    """
    def star(edges, large):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = both.join(least, "u")
        if large:
            out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                least.select("u", F.col("m").alias("v")))
        out = out.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        return stored(out.distinct(), "dedup-star")

    def unsettled(edges):
        """Nodes with two smaller neighbours, or with a smaller and a larger one; stars have none."""
        ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
        return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 AND up > 0").count()

    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    while True:
        edges = star(star(edges, True), False)
        if not unsettled(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Rows without words (NULL, empty, white space) have no shingles and are linked
    with nothing: component_id is their own doc_id. Equal sets are one class from
    the start, however many copies there are; repeated rows of one doc_id are all
    kept or all dropped. component_id is the smallest doc_id of the component; a
    NULL doc_id never is, unless the component has no other. Other columns are
    ignored. An empty table gives no rows. Texts count whole.
    """
    rows = signatures(documents)
    full = rows.where(F.col("set_id").isNotNull())
    sets = stored(full.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"),
                                             F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"),
                                             F.first("sketch").alias("sketch")), "dedup-distinct")
    active, near, best, roots = sets.withColumns({"root": F.col("set_id"), "weight": F.lit(1).cast("long")}), NEAR, BEST, None
    exact = False
    while True:
        if exact:
            whole = full_sets(documents, sets, active.select("set_id", "root"))
            links = confirmed(documents, sets, exact_candidates(active, whole), whole)
        else:
            pairs, crowded = candidates(active, near, best)
            links = confirmed(documents, sets, pairs)
        new = links.count()
        if roots is None or new:
            edges = links if roots is None else links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
            roots = components(edges)
        if exact:
            break
        crowded = stored(crowded, "dedup-crowded")
        left = crowded.count()
        near, best, exact = near * WIDER, best * WIDER, new * LITTLE < left
        if not left:
            break
        weights = roots.groupBy("root").agg((F.count("*") + 1).alias("weight"))
        active = (likely(sets, crowded, "set_id").join(crowded, "set_id", "left_semi")
                  .join(roots.select(F.col("node").alias("set_id"), "root"), "set_id", "left")
                  .withColumn("root", F.coalesce("root", "set_id")).join(weights, "root", "left")
                  .withColumn("weight", F.coalesce("weight", F.lit(1)).cast("long")))
    placed = sets.select("set_id", "doc_id", "rows").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    linked = placed.where(F.col("root").isNotNull())
    heads = placed.join(roots.select(F.col("root").alias("set_id")).distinct(), "set_id", "left_semi")
    least = (linked.select("root", "doc_id").unionByName(heads.select(F.col("set_id").alias("root"), "doc_id"))
             .groupBy("root").agg(F.min("doc_id").alias("component_id")))
    placed = placed.withColumn("root", F.coalesce("root", "set_id")).join(least, "root", "left")
    placed = stored(placed.select("set_id", "rows", F.coalesce("component_id", "doc_id").alias("component_id")), "dedup-placed")
    done = join_groups(full.select("doc_id", "n_shingles", "set_id"), placed, "set_id", "rows")
    out = done.select("doc_id", "n_shingles", "component_id").unionByName(
        rows.where(F.col("set_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(documents: DataFrame) -> DataFrame:
    """The rows of `documents`, all columns, without the doc_ids of which no row was kept."""
    seen = stored(near_duplicates(documents).groupBy("doc_id").agg(F.max("kept").alias("kept")), "dedup-kept")
    dropped = seen.where(~F.col("kept")).select("doc_id")
    return documents.join(dropped, "doc_id", "left_anti").select(*documents.columns)
