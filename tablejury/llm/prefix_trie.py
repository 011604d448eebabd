"""Prefix trie of conversations by ROLLUP over positional turn-id columns.

A conversation is cut into blocks of WIDTH turns. A block is one row: conversation,
block number, key of the node it starts at, and one turn-id column per position. The
key is the sum of 32-bit pieces of all earlier blocks' hashes, so a two-pass prefix
sum gives the keys of all blocks at once and no block waits for the one before.
GROUP BY block, key, ROLLUP(t0, t1, ..) then aggregates all prefixes of all blocks
together; grouping_id tells how many positions a group covers. The last group of a
full block and the first group of the block that continues it are one node: they have
the same depth and smallest member, which name a node.

Sums over subtrees need no walk over levels. Each node belongs to its smallest member,
and the nodes of one member form a chain down to its own end. What a chain adds up to
goes to its member; a second ROLLUP adds up members, and of the node's own chain the
part above the node is taken off.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tablejury.llm.common import join_groups, numbered, parts, stored

WIDTH = 8
RUN = 4096  # rows of one conversation or chain that a window adds up at a time
CHUNK = 1000  # ids joined to one string before the strings of a node meet
WORD = r"[^\x20\x09-\x0D]+"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, tid, pos): turns numbered from 0 in order of turn (NULL first), then role, then text; written once.

    `tid` is a digest of role and text, followed by the text's number of words. Rows
    without conv_id take no part; a NULL role or text is empty; repeated rows are turns of
    their own. Range partitions number their rows, so a conversation may be of any length.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("copy"))  # spreads equal rows over partitions; their order makes no difference
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    tid = F.concat_ws("-", _digest(F.length("role"), "role", "text"), F.regexp_count("text", F.lit(WORD)))
    ids = rows.repartitionByRange(parts(rows), *order).sortWithinPartitions(*order).select("conv_id", tid.alias("tid"))
    return stored(numbered(ids, "conv_id", "pos", "trie-turns"), "trie-numbered")


def _digest(*columns):
    return F.substring(F.sha2(F.concat_ws(":", *columns), 256), 1, 32)


def shared_heads(rows: DataFrame, group=20, most=4) -> DataFrame:
    """(conv_id, pos, tid, length): conversations rebuilt so that those of a group share their first turns.

    Conversation c takes the first h turns of c - c % `group` (all if there are fewer, none
    if it is absent), h = crc32(c) % `most`, and goes on with its own turns after its first
    h (% as in SQL: the remainder has the sign of c). A further row without `tid` marks the end of each conversation, also of those left
    without turns: its `pos` and `length` are the number of turns.
    """
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("turns"))
    heads = (rows.where((F.col("pos") < most - 1) & (F.col("conv_id") % group == 0)).groupBy(F.col("conv_id").alias("base"))
             .agg(F.sort_array(F.collect_list(F.struct("pos", "tid"))).alias("head")))  # at most `most` - 1 turns
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    none = F.array().cast("array<struct<pos:bigint,tid:string>>")
    convs = stored(sizes.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
                   .join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", none), F.lit(1), F.col("h")))
                   .withColumn("taken", F.size("head").cast("long")).drop("base"), "trie-conversations")
    own = join_groups(rows, convs.select("conv_id", "turns", "h", "taken"), "conv_id", "turns").where(F.col("pos") >= F.col("h"))
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "tid")
    led = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.pos", "t.tid")
    ends = convs.select("conv_id", (F.col("taken") + F.greatest(F.lit(0), F.col("turns") - F.col("h"))).alias("pos"))
    return _with_ends(own.unionByName(led), ends)


def as_they_are(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, tid, length): the conversations unchanged, each with a row that marks its end."""
    return _with_ends(rows.select("conv_id", "pos", "tid"), rows.groupBy("conv_id").agg(F.count("*").alias("pos")))


def _with_ends(rows, ends):
    return (rows.withColumn("length", F.lit(None).cast("long"))
            .unionByName(ends.select("conv_id", "pos", F.lit(None).cast("string").alias("tid"), F.col("pos").alias("length"))))


def _running(df, by, order, names):
    """`before_x`: the sum of x over earlier rows of `by`, within runs of RUN rows and then over whole runs."""
    df = df.withColumn("run", F.floor(F.col(order) / RUN))
    within = W.partitionBy(by, "run").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy(by).orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = df.groupBy(by, "run").agg(*[F.sum(x).alias(x) for x in names])
    runs = runs.select(by, "run", *[F.sum(x).over(across).alias(f"runs_{x}") for x in names]).where("run > 0")
    zero = F.lit(0).cast("long")
    out = df.select("*", *[F.coalesce(F.sum(x).over(within), zero).alias(f"rows_{x}") for x in names]).join(runs, [by, "run"], "left")
    return out.select(*[c for c in df.columns if c != "run"],
                      *[(F.col(f"rows_{x}") + F.coalesce(f"runs_{x}", zero)).alias(f"before_{x}") for x in names])


def blocks(rebuilt: DataFrame, width) -> DataFrame:
    """(conv_id, block, key, t0.., length): one row per conversation and `width` turns; written once."""
    at = F.col("pos") % width
    rows = rebuilt.groupBy("conv_id", F.floor(F.col("pos") / width).alias("block")).agg(
        *[F.max(F.when(at == i, F.col("tid"))).alias(f"t{i}") for i in range(width)], F.max("length").alias("length"))
    name = F.sha2(F.concat_ws(":", "block", *[f"t{i}" for i in range(width)]), 256)
    lanes = [f"lane{i}" for i in range(4)]
    rows = rows.select("*", *[F.conv(F.substring(name, 8 * i + 1, 8), 16, 10).cast("long").alias(x) for i, x in enumerate(lanes)])
    return stored(_running(rows, "conv_id", "block", lanes)
                  .withColumn("key", F.concat_ws("-", *[f"before_{x}" for x in lanes]))
                  .drop(*lanes, *[f"before_{x}" for x in lanes]), "trie-blocks")


def rollup(rows: DataFrame, width, *values) -> DataFrame:
    """(block, level, path, values..) of every prefix of every block, by one ROLLUP; `values` are SQL aggregates."""
    ids = ", ".join(f"t{i}" for i in range(width))
    groups = rows.sparkSession.sql(f"""
        SELECT block, key, {width} - bit_count(grouping_id()) AS level, array_compact(array({ids})) AS path, {", ".join(values)}
        FROM {{rows}} GROUP BY block, key, ROLLUP({ids})""", rows=rows)
    return groups.where(F.size("path") == F.col("level"))  # groups past the end of their conversations are no prefixes


def _node(path):
    return _digest("block", "key", path)


def ends_hash(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id) rows: SHA-256 of each node's ids in numeric order, comma-joined.

    Sorted range partitions join runs of ids to strings first; then the strings of a node are
    hashed one after the other, so that a node with most of the ids is read as a stream.
    """
    def chunks(batches):
        node, ids = None, []
        for batch in batches:
            rows = []
            for n, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n != node or len(ids) == CHUNK:
                    if ids:
                        rows.append((node, ids[0], ",".join(map(str, ids))))
                    node, ids = n, []
                ids.append(i)
            yield _batch(rows, CHUNKS)
        if ids:
            yield _batch([(node, ids[0], ",".join(map(str, ids)))], CHUNKS)

    def hashes(batches):
        node, sha = None, None
        for batch in batches:
            rows = []
            for n, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if n == node:
                    sha.update(b"," + text.encode())
                else:
                    if sha:
                        rows.append((node, sha.hexdigest()))
                    node, sha = n, hashlib.sha256(text.encode())
            yield _batch(rows, HASHES)
        if sha:
            yield _batch([(node, sha.hexdigest())], HASHES)

    n = parts(ends)
    joined = ends.repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(chunks, "node string, first long, ids string")
    return joined.repartition(n, "node").sortWithinPartitions("node", "first").mapInArrow(hashes, "node string, ends_sha256 string")


CHUNKS = pa.schema([("node", pa.string()), ("first", pa.int64()), ("ids", pa.string())])
HASHES = pa.schema([("node", pa.string()), ("ends_sha256", pa.string())])


def _batch(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def trie(rebuilt: DataFrame, width=WIDTH) -> DataFrame:
    """One row per distinct sequence of first turns, from rows of `shared_heads` or `as_they_are`.

    conv_id (smallest member) and depth name a node. parent_conv_id is the parent's conv_id
    (root: NULL); n_convs its members; n_children; n_leaves the childless nodes of its
    subtree, itself included; saved_tokens the sum over its subtree of (n_convs - 1) times the
    words of the last text; ends_sha256 the hash of the members that end there. Without
    conversations there is no node, not even the root.
    """
    rows = blocks(rebuilt, width)
    last = F.element_at("path", -1)
    found = (rollup(rows, width, "min(conv_id) AS conv_id", "count(*) AS n_convs")
             .select("conv_id", (F.col("block") * width + F.col("level")).alias("depth"), "n_convs", _node("path").alias("node"),
                     F.when(F.col("level") > 0, _node(F.slice("path", F.lit(1), F.col("level") - 1))).alias("parent"),
                     F.when(F.col("level") > 0, F.substring_index(last, "-", -1).cast("long")).alias("words")))
    found = stored(found, "trie-found")
    kids = found.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    ends = rows.where("length IS NOT NULL").select(
        _node(F.array_compact(F.array(*[f"t{i}" for i in range(width)]))).alias("node"), "conv_id")
    found = stored(found.join(kids, "node", "left").join(ends_hash(ends), "node", "left"), "trie-counted")
    # the last prefix of a block and the start of the block after it are one node
    real = F.col("parent").isNotNull() | (F.col("depth") == 0)
    nodes = found.groupBy("conv_id", "depth").agg(
        F.max("n_convs").alias("n_convs"), F.max(F.when(real, F.col("node"))).alias("node"), F.max("parent").alias("parent"),
        F.coalesce(F.max("words"), F.lit(0)).alias("words"), F.coalesce(F.sum("n_children"), F.lit(0)).alias("n_children"),
        F.coalesce(F.max("ends_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
    nodes = nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("words"))
    nodes = stored(_running(nodes, "conv_id", "depth", ["own"]), "trie-nodes")

    parents = stored(found.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("kids")), "trie-parents")
    named = join_groups(nodes, parents, "parent", "kids").drop("kids").unionByName(
        nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))

    chains = nodes.groupBy("conv_id").agg(F.sum("own").alias("saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    chains = stored(chains.join(rows.groupBy("conv_id").agg(F.count("*").alias("rows")), "conv_id"), "trie-chains")
    below = rollup(join_groups(rows, chains, "conv_id", "rows"), width, "sum(saved) AS saved", "sum(leaves) AS n_leaves")
    below = below.where((F.col("level") > 0) | (F.col("block") == 0)).select(_node("path").alias("node"), "saved", "n_leaves")
    return named.join(below, "node").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("saved") - F.col("before_own")).alias("saved_tokens"), "ends_sha256")
