"""Byte-balanced shards by Karmarkar-Karp differencing of indivisible groups of equal texts.

Differencing keeps partial partitions: tuples of part sizes, largest first. The
two with the largest spread are combined in opposite order (largest part onto
smallest) until one is left; walking the combinations back assigns every item.

One heap cannot hold all groups of a large corpus. While there are more than
`last_level` items, cells of a bounded number of them are differenced in parallel
into `ways` bundles each, which become the items of the next level; the last
level yields the shards. Groups larger than 1/(shards * ways) of all bytes are fewer
than shards * ways; they skip the cells and enter the last level on their own, so
that everything else can be arranged around them.
"""

import heapq
from operator import add

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablejury.llm.common import join_groups, numbered, small, stored

SHARDS, WAYS, GROUPS_PER_CELL, LAST_LEVEL = 8, 64, 50_000, 20_000


def difference(sizes, ways):
    """The part (0 to ways - 1) of each item, by differencing; ties go to the earlier item."""
    n = len(sizes)
    if not n:
        return []
    items = [((s,) + (0,) * (ways - 1), None) for s in sizes]
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = list(map(add, items[a][0], reversed(items[b][0])))
        order = sorted(range(ways), key=both.__getitem__, reverse=True)
        parts_ = tuple(both[i] for i in order)
        items[a], items[b] = (None, items[a][1]), (None, items[b][1])
        items.append((parts_, (a, b, order)))
        heapq.heappush(heap, (parts_[-1] - parts_[0], len(items) - 1))
    out, todo = [0] * n, [(len(items) - 1, list(range(ways)))]
    while todo:
        node, labels = todo.pop()
        if node < n:
            out[node] = labels[0]
            continue
        a, b, order = items[node][1]
        left, right = [0] * ways, [0] * ways
        for position, i in enumerate(order):
            left[i] = labels[position]
            right[ways - 1 - i] = labels[position]
        todo += [(a, left), (b, right)]
    return out


def _bundled(items: DataFrame, ways, per_cell) -> DataFrame:
    """One level: (item, bytes) to (item, bytes, bundle), cells of about `per_cell` items each."""
    cells = max(1, -(-items.count() // per_cell))

    def cell(frame):
        frame = frame.sort_values(["bytes", "item"], ascending=[False, True], ignore_index=True)
        label = difference(frame["bytes"].tolist(), ways)
        return pd.DataFrame({"item": frame["item"], "bytes": frame["bytes"], "bundle": frame["cell"] * ways + label})

    kind = dict(items.dtypes)["item"]
    return stored(items.withColumn("cell", F.pmod(F.xxhash64("item"), F.lit(cells)))
                  .groupBy("cell").applyInPandas(cell, f"item {kind}, bytes long, bundle long"), "sharding-level")


def shard_groups(groups: DataFrame, shards=SHARDS, ways=WAYS, per_cell=GROUPS_PER_CELL, last_level=LAST_LEVEL):
    """(group_key, rows, shard) for a stored table (group_key, rows, bytes)."""
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    limit = total // (shards * ways)
    heavy = [(bytes(r[0]), r[1]) for r in groups.where(F.col("bytes") > limit).select("group_key", "bytes")
             .orderBy(F.desc("bytes"), "group_key").collect()]  # fewer than shards * ways
    light = groups.where(F.col("bytes") <= limit)
    levels, items = [], light.select(F.col("group_key").alias("item"), "bytes")
    while items.count() > last_level:
        levels.append(_bundled(items, ways, per_cell))
        items = levels[-1].groupBy(F.col("bundle").alias("item")).agg(F.sum("bytes").alias("bytes"))
    last = sorted((-r["bytes"], r["item"]) for r in items.collect())  # at most last_level
    label = difference([b for _, b in heavy] + [-b for b, _ in last], shards)
    spark = groups.sparkSession
    kind = dict(items.dtypes)["item"]
    found = stored(spark.createDataFrame([(item, s) for (_, item), s in zip(last, label[len(heavy):], strict=True)],
                                         f"item {kind}, shard int"), "sharding-last")
    for level in reversed(levels):
        up = found.withColumnRenamed("item", "bundle")
        found = level.select("item", "bundle").join(small(up, up.count()), "bundle").select("item", "shard")
    found = found.withColumnRenamed("item", "group_key")
    if heavy:
        found = found.unionByName(spark.createDataFrame(
            [(bytearray(k), s) for (k, _), s in zip(heavy, label, strict=False)], "group_key binary, shard int"))
    return groups.select("group_key", "rows").join(found, "group_key")


def shard_documents(documents: DataFrame, shards=SHARDS, ways=WAYS, per_cell=GROUPS_PER_CELL, last_level=LAST_LEVEL) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (NULL) for every row.

    Equal texts share a shard; a NULL text counts as empty. Shard sizes in bytes
    are near equal unless one group alone exceeds a shard's share, which then
    stays whole. Repeated rows and doc_ids are placed as often as they occur, a
    NULL doc_id is carried along, other columns are ignored, an empty table gives
    no rows. `slot` counts from 0 within a shard, in storage order.
    """
    text = F.coalesce("text", F.lit(""))
    rows = stored(documents.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("group_key")), "sharding-rows")
    groups = stored(rows.groupBy("group_key").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")),
                    "sharding-groups")
    placed = stored(shard_groups(groups, shards, ways, per_cell, last_level), "sharding-placed")
    out = join_groups(rows, placed, "group_key", "rows").select("doc_id", "size", "text_crc32", "shard")
    return numbered(out, "shard", "slot", "sharding-slots").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
