"""Cross-entropy difference of a target and a background n-gram model over one shared vocabulary.

Tokens are subwords: runs of letters, of digits and of other signs (ASCII letters without
case, the white space before a run as one leading space), cut into pieces of four bytes.
The shared vocabulary is every piece of every document. Both models are bigram models with
the same smoothing (Witten-Bell, interpolated down to the uniform distribution); the target
model sees the target documents, the background model all documents.

Vocabulary, bigrams and losses are Spark tables that grow with the corpus. A piece is a
32-bit number, so a bigram is exactly one 64-bit key and nothing is hashed. Documents are
cut once into slices of bounded size. A slice is written as one row per distinct bigram, and
apart from them the places of the documents that hold each. Only the rows of bigrams are
counted and meet their losses: at most one per slice and bigram, however often it occurs, so no
key is large. The losses return to their slice, where they are added up for each document, as
whole numbers that do not depend on the order of work.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablejury.llm.common import slices, stored, text_buffer

PIECE = 4  # bytes
STEP = 8_000_000  # bytes of text encoded at once
SLICE = 64_000_000  # bytes of text whose bigrams are folded together
MOST_PLACES = 1 << 16  # documents of a slice: places are 16-bit numbers
RANKS = 1 << 16  # bigrams of a slice whose places are written as one row
UNIT = 1 << 24  # losses are whole multiples of 1 / UNIT bits

_KIND = np.full(256, 3, np.uint8)  # 0 white space and control signs, 1 letters, 2 digits, 3 other signs
_KIND[:33] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[:33] = 32


def pieces(data, offsets):
    """(piece codes, bounds): the subwords of all documents; those of document d are bounds[d]:bounds[d + 1]."""
    n, docs = len(data), len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    kinds = _KIND[data]
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=change[1:])
    opens = np.zeros(n, bool)
    opens[offsets[:-1][offsets[:-1] < n]] = True
    edges = np.flatnonzero(change | opens)
    ends = np.append(edges[1:], n)
    word = kinds[edges] != 0
    starts, ends = edges[word], ends[word]
    starts = starts - ((kinds[np.maximum(starts - 1, 0)] == 0) & ~opens[starts])
    count = (ends - starts + PIECE - 1) // PIECE
    at = np.repeat(starts - PIECE * (np.cumsum(count) - count), count) + PIECE * np.arange(count.sum())
    end = np.repeat(ends, count)
    low = np.concatenate([_LOWER[data], np.zeros(PIECE, np.uint8)])
    code = np.zeros(len(at), np.uint64)
    for i in range(PIECE):
        code <<= np.uint64(8)
        code |= np.where(at + i < end, low[at + i], 0).astype(np.uint64)
    return code, np.searchsorted(at, offsets)


def bigrams(data, offsets):
    """(keys, bounds): previous piece (0 at the start of a document) and piece of every token, as one 64-bit number."""
    code, bounds = pieces(data, offsets)
    before = np.empty_like(code)
    before[1:] = code[:-1]
    before[bounds[:-1][bounds[:-1] < len(code)]] = 0
    return ((before << np.uint64(32)) | code).view(np.int64), bounds


class _Slice:
    """Documents whose bigrams are folded together."""

    def __init__(self, number):
        self.number, self.size, self.bytes, self.parts, self.docs = number, 0, 0, [], []

    def add(self, data, offsets, target, ids):
        keys, bounds = bigrams(data, offsets)
        place = np.repeat(np.arange(self.size, self.size + len(ids)).astype(np.uint16), np.diff(bounds))
        hits = np.repeat(target, np.diff(bounds))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        ends = np.append(first, len(keys))
        total = np.append(0, np.cumsum(hits[order]))
        self.parts.append((keys[first], np.diff(ends), np.diff(total[ends]), place[order]))
        self.docs.append((ids, np.diff(bounds)))
        self.size += len(ids)
        self.bytes += len(data)

    def tables(self):
        """Columns by name: the bigrams, their places in rows of RANKS bigrams, and the documents."""
        keys, counts, hits, places = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, hits = keys[order], hits[order]
        runs = counts[order].astype(np.int32)
        shift = (np.cumsum(counts) - counts)[order] - (np.cumsum(runs, dtype=np.int64) - runs)
        at = np.repeat(shift.astype(np.int32), runs)
        at += np.arange(len(places), dtype=np.int32)
        places = places[at]
        if len(keys):
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            n, hits, keys = np.add.reduceat(runs, first, dtype=np.int64), np.add.reduceat(hits, first), keys[first]
            ends = np.append(0, np.cumsum(n))
            yield {"rank": pa.array(np.arange(len(keys), dtype=np.int32)), "key": pa.array(keys), "n": pa.array(n),
                   "n_target": pa.array(hits.astype(np.int64))}
            for lo in range(0, len(keys), RANKS):
                hi = min(lo + RANKS, len(keys))
                yield {"rank": pa.array([lo], pa.int32()), "counts": pa.array([n[lo:hi].astype(np.int32).tobytes()], pa.binary()),
                       "places": pa.array([places[ends[lo]:ends[hi]].tobytes()], pa.binary())}
        yield {"place": pa.array(np.arange(self.size, dtype=np.int32)), "doc_id": pa.concat_arrays([i for i, _ in self.docs]),
               "n": pa.array(np.concatenate([n for _, n in self.docs]).astype(np.int64))}


def folded(documents: DataFrame) -> DataFrame:
    """Slices, written once: rows with a `key` are bigrams, with `places` their places, with a `place` documents.

    `documents` has doc_id, text and target (whether it is a target document).
    """
    kind = documents.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("slice", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("key", T.LongType()),
        T.StructField("n", T.LongType()), T.StructField("n_target", T.LongType()), T.StructField("counts", T.BinaryType()),
        T.StructField("places", T.BinaryType()), T.StructField("place", T.IntegerType()), T.StructField("doc_id", kind)])

    def rows(group, types):
        for columns in group.tables():
            size = len(next(iter(columns.values())))
            columns["slice"] = pa.array(np.full(size, group.number))
            yield pa.RecordBatch.from_arrays([columns.get(f, pa.nulls(size, types[f])) for f in schema.names], names=schema.names)

    def fold(batches):
        types = {"slice": pa.int64(), "rank": pa.int32(), "key": pa.int64(), "n": pa.int64(), "n_target": pa.int64(), "counts": pa.binary(),
                 "places": pa.binary(), "place": pa.int32()}
        group = _Slice(TaskContext.get().partitionId() << 32)
        for batch in batches:
            ids = batch.column(0)
            types["doc_id"] = ids.type
            data, offsets = text_buffer(batch.column(1))
            target = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for start, end in slices(offsets, STEP):
                for lo in range(start, end, MOST_PLACES):
                    hi = min(end, lo + MOST_PLACES)
                    if group.size and (group.size + hi - lo > MOST_PLACES or group.bytes + offsets[hi] - offsets[lo] > SLICE):
                        yield from rows(group, types)
                        group = _Slice(group.number + 1)
                    group.add(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], target[lo:hi], ids.slice(lo, hi - lo))
        if group.size:
            yield from rows(group, types)

    return stored(documents.select("doc_id", "text", "target").mapInArrow(fold, schema), "lm-slices")


def loss_table(counts: DataFrame) -> DataFrame:
    """key, target_loss, background_loss (whole multiples of 1 / UNIT bits) of every bigram of the corpus.

    `counts` has key, n, n_target and is a stored table. Bigrams of one context, and of one piece, are
    distinct, so their joins hold at most the vocabulary per key; adaptive joins split what is uneven.
    """
    grams = counts.select("key", "n", "n_target", F.shiftrightunsigned("key", 32).alias("before"),
                          F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("piece"))
    contexts = grams.groupBy("before").agg(
        F.sum("n").alias("c"), F.count("*").alias("k"), F.sum("n_target").alias("ct"), F.count_if(F.col("n_target") > 0).alias("kt"))
    vocabulary = grams.groupBy("piece").agg(F.sum("n").alias("u"), F.sum("n_target").alias("ut"))
    all_, size, targets, seen = vocabulary.agg(
        F.sum("u"), F.count("*"), F.sum("ut"), F.count_if(F.col("ut") > 0)).first()  # four numbers

    def mixed(n, total, kinds, rest):
        return F.when(total > 0, (n + kinds * rest) / (total + kinds)).otherwise(rest)

    uniform = F.lit(1.0 / max(size, 1))
    single = mixed(F.col("u"), F.lit(all_ or 0), F.lit(size), uniform)
    single_target = mixed(F.col("ut"), F.lit(targets or 0), F.lit(seen), uniform)
    vocabulary = vocabulary.select("piece", single.alias("p"), single_target.alias("pt"))

    def loss(probability):
        return F.round(-F.log2(probability) * UNIT).cast("long")

    return grams.join(contexts, "before").join(vocabulary, "piece").select(
        "key", loss(mixed(F.col("n_target"), F.col("ct"), F.col("kt"), F.col("pt"))).alias("target_loss"),
        loss(mixed(F.col("n"), F.col("c"), F.col("k"), F.col("p"))).alias("background_loss"))


def _added(losses, places):
    """The losses of a slice's bigrams, added up for each of its documents. A slice is bounded, whatever the corpus."""
    rank = losses["rank"].to_numpy()
    each = np.zeros((2, len(rank)), np.int64)
    each[0, rank], each[1, rank] = losses["target_loss"].to_numpy(), losses["background_loss"].to_numpy()
    sums = np.zeros((2, MOST_PLACES), np.int64)
    for lo, counts, at in zip(places["first"].to_pylist(), places["counts"].to_pylist(), places["places"].to_pylist(), strict=True):
        counts, at = np.frombuffer(counts, np.int32), np.frombuffer(at, np.uint16)
        for row in (0, 1):
            np.add.at(sums[row], at, np.repeat(each[row, lo:lo + len(counts)], counts))
    used = np.flatnonzero(sums.any(0))
    return pa.table({"slice": np.full(len(used), places["of"][0].as_py()), "place": used.astype(np.int32),
                     "target": sums[0, used], "background": sums[1, used]})


def cross_entropy_difference(documents: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score for every row of `documents`.

    Losses are bits per token under the models; score is target_loss -
    background_loss, so lower means closer to the target. `target` holds the
    doc_ids of the target documents (NULLs and repetitions are ignored). NULL and
    empty texts, and texts of white space, have no tokens and losses of 0. Without target
    documents the target model is uniform. Rows with NULL or repeated doc_ids are scored one by
    one; other columns are ignored; an empty table gives no rows.
    """
    ids = stored(target.select("doc_id").where(F.col("doc_id").isNotNull()).distinct(), "lm-target").withColumn("target", F.lit(True))
    marked = documents.select("doc_id", "text").join(ids, "doc_id", "left") \
        .select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    rows = folded(marked)
    grams = rows.where(F.col("key").isNotNull())
    counts = stored(grams.groupBy("key").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target")), "lm-bigrams")
    met = grams.select("slice", "rank", "key").join(stored(loss_table(counts), "lm-losses"), "key") \
        .select("slice", "rank", "target_loss", "background_loss")
    places = rows.where(F.col("places").isNotNull()).select(
        F.col("slice").alias("of"), F.col("rank").alias("first"), "counts", "places")
    sums = met.groupBy("slice").cogroup(places.groupBy("of")).applyInArrow(
        _added, "slice long, place int, target long, background long")
    docs = rows.where(F.col("place").isNotNull()).select("slice", "place", "doc_id", F.col("n").alias("n_tokens"))

    def mean(total):
        return F.coalesce(F.col(total) / (F.col("n_tokens") * F.lit(float(UNIT))), F.lit(0.0))

    scored = docs.join(sums, ["slice", "place"], "left")
    return scored.select("doc_id", "n_tokens", mean("target").alias("target_loss"), mean("background").alias("background_loss")) \
        .withColumn("score", F.col("target_loss") - F.col("background_loss"))
