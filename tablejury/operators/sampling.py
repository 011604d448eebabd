"""Reproducible samples and trial queues, ordered by keyed digests."""

from functools import cached_property

from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string
from pyspark.sql.window import Window as W

from tablejury.functions import packs
from tablejury.functions.digests import digest, seed_int, unit
from tablejury.functions.ranking import bottom_n, digest_rank, top_k
from tablejury.schema import CONDITIONS, REAL, SYNTHETIC
from tablejury.session import dropping_shuffles, shared_table, spread

TAKE_LIMIT = 10_000


def exact_sample(df, n, seed, row_id):
    """Exactly n rows (or all): a top-n for small n, the digest cut for large n."""
    keyed = df.withColumn("_digest", digest(seed, *row_id))
    if n <= TAKE_LIMIT:
        return keyed.orderBy("_digest", *row_id).limit(n).drop("_digest")
    quota = df.sparkSession.createDataFrame([(n,)], "n_take bigint")
    return bottom_n(keyed, [], quota, tie=row_id).drop("_digest")


def sample_per_group(df, by, n, seed, row_id):
    """n rows per group for a small constant n."""
    return top_k(df.withColumn("_digest", digest(seed, *by, *row_id)), by, n, "_digest", *row_id).drop("_digest")


def shown_rows(df, n, seed, row_id):
    """The sample that is shown to a judge, back in table order."""
    return exact_sample(df, n, seed, row_id).orderBy(*row_id)


def fraction_samples(df, methods, fraction, seed, row_id):
    """Every method's own fraction of the rows, all in one pass over the table."""
    tagged = df.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    return tagged.filter(unit(digest(seed, "method", *row_id)) < fraction)


DIGITS = 4  # hex digits that a pass over the tables counts by
SPAN = 8  # average buckets in a block of places
BUCKET_ROWS = 4096  # buckets of more rows are counted by further digits before their rows are sorted
BLOCK_ROWS = 32_768  # rows of one table, by leading digits, that meet their draws in one task
MOST_BLOCKS = 65_536  # their counts go to the driver
WAVE = 1 << 23  # requests whose draws are on disk at a time; every wave reads the tables
WAVE_ROWS = 4  # rows of the tables a request of a wave, at most


def draw_positions(n_total, n, seed, *key):
    """n distinct positions below n_total (all, if fewer) for every key: uniform, without replacement, by Floyd's method.

    Step j draws below n_total - n + j + 1 and, if that position is taken, takes the last of them.
    """
    n = F.least(F.lit(n).cast("bigint"), n_total)
    steps = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    draws = F.transform(steps, lambda j: F.struct(
        (seed_int(F.lit(seed), *key, j, digits=15) % (n_total - n + j + 1)).alias("drawn"), (n_total - n + j).alias("last")))
    return F.aggregate(draws, F.array().cast("array<bigint>"), lambda taken, d: F.concat(
        taken, F.array(F.when(F.array_contains(taken, d["drawn"]), d["last"]).otherwise(d["drawn"]))))


class RowIndex:
    """Random access to rows by position in the digest order of their table, without writing or sorting the tables.

    One pass counts each table's rows by the first hex digits of their digests: 16 ** DIGITS
    numbers a table at most. Running counts turn a position into a bucket and a place in it; only
    rows of the buckets asked for are read by a semi-join and sorted, bucket by bucket. Where such
    a bucket is still large, its rows are first counted by further digits.
    """

    def __init__(self, rows, by, row_id, columns, seed):
        self.by, self.tie = by, [row_id, *columns]
        self.rows = rows.select(by, row_id, *columns, digest(seed, by, row_id).alias("_digest"))
        self.counts = self._count(self.rows, DIGITS)
        self.sizes = shared_table(self.counts.groupBy(by).agg(F.sum("_n").alias("n_total")), "sizes")  # one row a table: stored, so that requests need no shuffle to meet it

    def _count(self, rows, depth):
        return shared_table(rows.groupBy(self.by, F.substring("_digest", 1, depth).alias("_prefix")).agg(F.count(F.lit(1)).alias("_n")), "buckets")

    def _descend(self, wanted, counts, depth):
        """Move every wanted place from its bucket of `depth` digits to that of DIGITS more.

        Buckets and places meet in blocks of places, a block being as long as SPAN average buckets.
        """
        key = [self.by, "_parent"]
        earlier = W.partitionBy(*key).orderBy("_prefix").rowsBetween(W.unboundedPreceding, -1)
        counts = counts.withColumn("_parent", F.substring("_prefix", 1, depth)).withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        blocks = counts.groupBy(*key).agg((SPAN * F.ceil(F.sum("_n") / F.count(F.lit(1)))).alias("_span"))
        blocks = shared_table(blocks, "blocks")  # stored, so that their size is known and wanted rows need no shuffle to meet them
        last = F.col("_start") + F.col("_n") - 1
        buckets = shared_table(counts.join(blocks, key).select(
            *key, "_prefix", "_start", last.alias("_last"), F.explode(F.sequence(F.expr("_start div _span"), F.expr("(_start + _n - 1) div _span"))).alias("_block")), "starts")
        wanted = wanted.withColumnRenamed("_prefix", "_parent").join(blocks, key).withColumn("_block", F.expr("_place div _span")).drop("_span")
        found = wanted.join(buckets, [*key, "_block"]).where("_place BETWEEN _start AND _last")
        return shared_table(found.withColumn("_place", F.col("_place") - F.col("_start")).drop("_parent", "_block", "_start", "_last"), "wanted")

    def fetch(self, wanted, position="pos"):
        """Every row of `wanted` (table, position, ...) with the columns of the row at that position, counted from 0."""
        wanted = self._descend(wanted.withColumn("_prefix", F.lit("")).withColumn("_place", F.col(position)), self.counts, 0)
        depth, counts, key = DIGITS, self.counts, [self.by, "_prefix"]
        while True:
            asked = wanted.select(*key).distinct()
            largest = counts.join(asked, key, "left_semi").agg(F.max("_n")).first()[0] or 0
            rows = self.rows.withColumn("_prefix", F.substring("_digest", 1, depth)).join(asked, key, "left_semi").drop("_prefix")
            if largest <= BUCKET_ROWS or depth >= 32:
                break
            counts = self._count(rows, depth + DIGITS)
            wanted, depth = self._descend(wanted, counts, depth), depth + DIGITS
        place = F.row_number().over(W.partitionBy(*key).orderBy("_digest", *self.tie)) - 1
        rows = rows.withColumn("_prefix", F.substring("_digest", 1, depth)).withColumn("_place", place.cast("bigint")).drop("_digest")
        return wanted.join(rows, [*key, "_place"]).drop("_prefix", "_place")

    def numbered(self, requests):
        """Each distinct request with n_total, a number of its own (`_request`) and how often it is asked (`_times`); stored, as the numbers must stay."""
        distinct = requests.groupBy(*requests.columns).agg(F.count(F.lit(1)).alias("_times"))
        with dropping_shuffles(requests.sparkSession):
            return shared_table(distinct.join(self.sizes, self.by).select(*requests.columns, "n_total", "_times").withColumn("_request", F.monotonically_increasing_id()), "requests", packs.CHUNK)

    def waves(self, numbered):
        """Numbered requests in parts of about WAVE, or more where the tables are so large that each part should take a share of their rows."""
        size = max(WAVE, (self.sizes.agg(F.sum("n_total")).first()[0] or 0) // WAVE_ROWS)
        n = -(-numbered.count() // size)
        wave = F.pmod(F.xxhash64(F.expr(f"_request div {packs.CHUNK}")), F.lit(n))
        return [numbered.where(wave == i) for i in range(n)] if n > 1 else [numbered]

    def drawn(self, numbered, key, n, seed):
        """n rows for every numbered request, drawn for its key alone: table, _request, pos and the row's columns, no other of the request's."""
        requests = spread(numbered, "_request")  # a stored table of requests is a few small files, and draws are most of the work
        return self.fetch(requests.select(self.by, "_request", F.explode(draw_positions(F.col("n_total"), n, seed, *key)).alias("pos")))

    def shown(self, numbered, key, n, seed):
        """Every numbered request with `_rows`: the row ids and columns of the n rows drawn for it, in no order.

        Many draws travel in packs, by blocks of rows with the same first digits and by chunks of requests.
        Where most buckets are not asked for, or equal digests make a block too large, each draw is a row.
        """
        asked = numbered.count()
        blocks = self.blocks if asked * n >= max(1, self.counts.count()) else []
        if not blocks:
            rows = spread(self.drawn(numbered, key, n, seed).select("_request", *self.tie), "_request")  # the last shuffle of rows and requests
            return rows.groupBy("_request").agg(F.collect_list(F.struct(*self.tie)).alias("_rows")).join(numbered, "_request").select(*numbered.columns, "_rows")
        spark, digits = numbered.sparkSession, len(blocks[0][1])
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        size = min(packs.CHUNK, max(256, 1 << (asked // (4 * parts)).bit_length()))  # a power of two: chunks enough to fill all partitions evenly, if there are the requests
        salts = -(-parts // len(blocks))  # of the few blocks of small tables each part of the chunks has its own copy

        def name(table, prefix):
            return F.concat(prefix, F.lit("|"), table)

        kinds = dict(self.rows.dtypes)
        rows = self.rows.select(
            name(F.col(self.by).cast("string"), F.substring("_digest", 1, digits)).alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"),
            F.lit(-1).cast("bigint").alias("_chunk"), F.unhex("_digest").alias("_digest"), *self.tie, F.lit(None).cast("binary").alias("_pack")).where("_block IS NOT NULL")
        chunked = numbered.withColumn("_chunk", F.expr(f"_request div {size}"))
        wanted = chunked.select("_chunk", "_request", F.col(self.by).cast("string").alias("_table"), F.concat_ws("||", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]).alias("_key"), "n_total")
        place, either = ["_block", "_salt", "_chunk"], StructType([StructField(f.name, f.dataType) for f in rows.schema])
        drawn = wanted.mapInArrow(packs.draws(to_arrow_schema(either), [(t, f"{p}|{t}", c) for t, p, c in blocks], n, size, salts), either)
        met = spread(rows.unionByName(drawn), *place[:2]).sortWithinPartitions(*place, "_digest", *self.tie)
        halves = _parse_datatype_string("_chunk long, _found binary, _asked binary")
        arrow = to_arrow_schema(halves)
        found = met.mapInArrow(packs.found(arrow, self.tie), halves).unionByName(chunked.mapInArrow(packs.asked(arrow), halves))
        out = numbered.withColumn("_rows", F.array(F.struct(*[F.lit(None).cast(kinds[c]).alias(c) for c in self.tie]))).schema
        return spread(found, "_chunk").sortWithinPartitions("_chunk").mapInArrow(packs.joined(to_arrow_schema(out), self.tie, size), out)

    @cached_property
    def blocks(self):
        """(table as text, first digits, rows) of every block in order, by as few digits as keep blocks small; none if that takes too many."""
        depths = F.explode(F.sequence(F.lit(1), F.lit(DIGITS))).alias("_depth")
        levels = self.counts.select(F.col(self.by).cast("string").alias("_table"), "_prefix", "_n", depths).where("_table IS NOT NULL") \
            .groupBy("_table", "_depth", F.expr("substring(_prefix, 1, _depth)").alias("_prefix")).agg(F.sum("_n").alias("_n"))
        levels = shared_table(levels, "levels")
        sizes = levels.groupBy("_depth").agg(F.count(F.lit(1)).alias("_blocks"), F.max("_n").alias("_most"))
        depth = sizes.where((F.col("_most") <= BLOCK_ROWS) & (F.col("_blocks") <= MOST_BLOCKS)).agg(F.min("_depth")).first()[0]
        return [] if depth is None else [tuple(r) for r in levels.where(F.col("_depth") == depth).select("_table", "_prefix", "_n").orderBy("_table", "_prefix").collect()]

    def sample(self, requests, key, n, seed):
        """n rows for every request, drawn for its key alone: the request's columns, n_total, pos and the row's columns."""
        numbered = self.numbered(requests)
        rows = numbered.join(self.drawn(numbered, key, n, seed).drop(self.by), "_request")
        return rows.withColumn("_times", F.explode(F.expr("array_repeat(0, int(_times))"))).drop("_request", "_times")


CHUNK = 65_536


def number_off(df, count, name):
    """Rows 1..count for each input row, in chunks, so one huge count is still spread over tasks."""
    chunks = df.withColumn("_count", count.cast("bigint")).filter(F.col("_count") > 0) \
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_count - 1) div {CHUNK}"))))
    spread = chunks.repartition(*df.columns, "_chunk")
    first = F.col("_chunk") * CHUNK + 1
    numbers = F.sequence(first, F.least(F.col("_count"), first + (CHUNK - 1)))
    return spread.withColumn(name, F.explode(numbers)).select(*df.columns, name)


def balanced_queue(targets, conditions=CONDITIONS):
    """Unshuffled queue: half of ``n_trials`` per label and condition for every target row."""
    keys = [c for c in targets.columns if c != "n_trials"]
    half = F.floor(F.col("n_trials") / 2)
    return (number_off(targets, half, "rep")
            .withColumn("condition", F.explode(F.array(*[F.lit(c) for c in conditions])))
            .withColumn("true_label", F.explode(F.array(F.lit(REAL), F.lit(SYNTHETIC))))
            .select(*keys, "condition", "true_label", "rep"))


def trial_queue(targets, seed, conditions=CONDITIONS):
    """Balanced queue with sequential trial ids along a shuffled order per target."""
    keys = [c for c in targets.columns if c != "n_trials"]
    queue = balanced_queue(targets, conditions)
    ranked = digest_rank(queue.withColumn("_digest", digest(seed, *keys, "condition", "true_label", "rep")),
                         keys, tie=["condition", "true_label", "rep"])
    return ranked.select(*keys, "condition", "true_label", "rep", (F.col("rank") - 1).alias("trial_id"))


def annotator_queue(sessions, n_pairs, seed):
    """Per annotator session: n pairs drawn from n REAL and n SYNTHETIC, each with its own sample seed."""
    keys = sessions.columns
    cards = (sessions.withColumn("card", F.explode(F.sequence(F.lit(1), F.lit(2 * n_pairs))))
             .withColumn("true_label", F.when(F.col("card") <= n_pairs, REAL).otherwise(SYNTHETIC))
             .withColumn("_digest", digest(seed, *keys, "card")))
    drawn = top_k(cards, keys, n_pairs, "_digest", "card", rank_column="pair_id")
    return drawn.select(*keys, "pair_id", "true_label", seed_int(F.lit(seed), *keys, "pair_id").alias("sample_seed"))
