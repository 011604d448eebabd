"""Document fingerprints by locally consistent parsing.

A text is parsed level by level. On each level, runs of one symbol become one
symbol; deterministic coin tossing (the lowest bit in which a symbol differs from
its left neighbour, and its value) shrinks the alphabet to six colours in a few
rounds; local maxima of the colours begin phrases, which are two to a dozen
symbols long; a hash of its symbols names each phrase, and the names are the
symbols of the next level. A boundary depends on a bounded neighbourhood only, so
equal substrings are cut alike, except near their ends, wherever they stand.

The fingerprint is a one-permutation minimum sketch of the names of the levels
from `LEVEL` on (of the top level of texts too short for that): `BINS` minima of
16 bits. The likeness of two fingerprints is the share of equal bins among the
bins that either fills.
"""

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tablejury.llm.common import mix, parts, stored, text_buffer

LEVEL, BINS, SLICE = 3, 64, 1_000_000
EMPTY = np.uint32(1 << 16)  # a bin without names
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _toss(x, first):
    """One round of coin tossing against the left neighbour; neighbours differ before and after."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[first] = x[first] ^ np.uint64(1)
    low = x ^ left
    low &= ~low + np.uint64(1)
    bit = np.bitwise_count(low - np.uint64(1)).astype(np.uint64)
    return (bit << np.uint64(1)) | ((x >> bit) & np.uint64(1))


def _colours(x, first):
    """Six colours from 64-bit symbols whose neighbours differ: 64 bits to 7, to 4, to 3 bits."""
    c = _toss(_toss(_toss(_toss(x, first), first), first), first)
    return c.astype(np.int8)


def phrases(x, doc):
    """The next level: (names, document of each name) of the phrases of every document's symbols."""
    first = np.empty(len(x), bool)
    first[0] = True
    np.not_equal(doc[1:], doc[:-1], out=first[1:])
    edge = first.copy()
    edge[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(edge)
    run = np.diff(np.append(at, len(x))).astype(np.uint64)
    with np.errstate(over="ignore"):
        x, doc, first = mix(x[at] + run * _ODD), doc[at], first[at]
        c = _colours(x, first)
        left, right = np.empty_like(c), np.empty_like(c)
        left[1:], right[:-1] = c[:-1], c[1:]
        left[0] = right[-1] = -1
        last = np.append(first[1:], True)
        left[first] = -1
        right[last] = -1
        start = first | ((c > left) & (c >= right) & ~last)
        begin = np.flatnonzero(start)
        place = np.arange(len(x)) - np.repeat(begin, np.diff(np.append(begin, len(x))))
        names = mix(np.add.reduceat(x * (mix(place.astype(np.uint64) + np.uint64(1)) | np.uint64(1)), begin))
    return names, doc[begin]


def sketches(data, offsets):
    """One row of BINS minima for every document."""
    docs = len(offsets) - 1
    out = np.full((docs, BINS), EMPTY, np.uint32)
    x, doc = data.astype(np.uint64) + np.uint64(1), np.repeat(np.arange(docs), np.diff(offsets))
    level = 0
    while len(x):
        x, doc = phrases(x, doc)
        level += 1
        size = np.bincount(doc, minlength=docs)
        keep = np.ones(len(x), bool) if level >= LEVEL else size[doc] == 1
        h, d = mix(x[keep] + np.uint64(level if level >= LEVEL else 0)), doc[keep]
        cell = d * BINS + (h >> np.uint64(58)).astype(np.int64)
        np.minimum.at(out.reshape(-1), cell, ((h >> np.uint64(40)) & np.uint64(0xFFFF)).astype(np.uint32))
        more = size[doc] > 1
        x, doc = x[more], doc[more]
    return out


def written(sketch):
    """Hexadecimal: four digits a bin, dashes for an empty one."""
    return ["".join("----" if v == EMPTY else f"{v:04x}" for v in row) for row in sketch.tolist()]


def likeness(a, b):
    """Share of equal bins among those that either fills; 1 for two empty sketches."""
    used = (a != EMPTY) | (b != EMPTY)
    equal = (used & (a == b)).sum(1)
    n = used.sum(1)
    return np.where(n > 0, equal / np.maximum(n, 1), 1.0)


def edited(text, following):
    """The text with its last third replaced by the start of the following one."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


COLUMNS = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _compare(ids, texts, following, kind):
    """Result rows for texts and the texts that follow them."""
    new = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    own, other, nxt = (sketches(*text_buffer(pa.array(x, pa.large_string()))) for x in (texts, new, following))
    return _rows(ids, texts, new, own, other, nxt, kind)


def _rows(ids, texts, new, own, other, nxt, kind):
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, kind), pa.array([len(t) for t in texts], pa.int64()),
         pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
         pa.array(written(own), pa.string()), pa.array(written(other), pa.string()),
         pa.array(likeness(own, other)), pa.array(likeness(own, nxt))],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _squeezed(batches):
    """Texts compressed one by one, so that the only shuffle of texts stays small."""
    press = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
    for batch in batches:
        z = pa.array([press(t.encode()) for t in batch.column(2).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), z], names=["doc_id", "h", "z"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The order is descending doc_id (NULL last, repeated ids by text hash); the
    last row is followed by the first, a single row by itself. NULL texts count
    as empty; empty texts have an empty sketch, alike only to another empty one.
    Other columns are ignored. An empty table gives no rows. Long texts are
    parsed whole; the pieces of work are runs of whole texts.
    """
    kind = dict(documents.dtypes)["doc_id"]
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(
        _squeezed, f"doc_id {kind}, h long, z binary")
    order = [F.desc_nulls_last("doc_id"), "h"]
    ordered = rows.repartitionByRange(parts(rows), *order).sortWithinPartitions(*order, "z")

    def compare(batches):
        """Rows of a partition in order; its first and last row also go out, to be joined across partitions."""
        part, held, head = TaskContext.get().partitionId(), None, None
        nothing = {"part": pa.int32(), "side": pa.int32(), "text": pa.string()}

        def full(batch):
            blank = [pa.nulls(batch.num_rows, t) for t in nothing.values()]
            return pa.RecordBatch.from_arrays([*batch.columns, *blank], names=[*batch.schema.names, *nothing])

        def edge(doc_id, text, side, arrow):
            n = [pa.array([doc_id], arrow), pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.string())] * 3, *[pa.nulls(1, pa.float64())] * 2,
                 pa.array([part], pa.int32()), pa.array([side], pa.int32()), pa.array([text], pa.string())]
            return pa.RecordBatch.from_arrays(n, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                                                        "near_edited", "near_next", *nothing])

        arrow, expand = None, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            arrow = batch.column(0).type
            every = [expand(z).decode() for z in batch.column(2).to_pylist()]
            size = np.array([len(t) for t in every], np.int64)
            cuts = np.flatnonzero(np.diff(np.append(-1, np.cumsum(size) // SLICE)))
            for lo, hi in zip(cuts, np.append(cuts[1:], batch.num_rows), strict=True):
                ids, texts = batch.column(0)[lo:hi].to_pylist(), every[lo:hi]
                if head is None and texts:
                    head = (ids[0], texts[0])
                if held is not None:
                    ids, texts = [held[0], *ids], [held[1], *texts]
                held = (ids[-1], texts[-1])
                if len(texts) > 1:
                    new = [edited(t, f) for t, f in zip(texts[:-1], texts[1:], strict=True)]
                    own = sketches(*text_buffer(pa.array(texts, pa.large_string())))
                    other = sketches(*text_buffer(pa.array(new, pa.large_string())))
                    yield full(_rows(ids[:-1], texts[:-1], new, own[:-1], other, own[1:], arrow))
        if held is not None:
            yield edge(*head, 0, arrow)
            yield edge(*held, 1, arrow)

    done = stored(ordered.mapInArrow(compare, f"doc_id {kind}, {COLUMNS}, part int, side int, text string"), "fingerprints")
    edges = done.where(F.col("side").isNotNull()).select("doc_id", "part", "side", "text")
    ranks = edges.select("part").distinct()  # one row per partition
    ranks = ranks.withColumn("rank", F.row_number().over(W.orderBy("part"))).withColumn("parts", F.count("*").over(W.partitionBy()))
    edges = edges.join(ranks, "part")
    heads = edges.where("side = 0").select(((F.col("rank") + F.col("parts") - 2) % F.col("parts") + 1).alias("rank"),
                                           F.col("text").alias("following"))
    tails = edges.where("side = 1").select("doc_id", "text", "rank").join(heads, "rank").select("doc_id", "text", "following")

    def across(batches):
        for batch in batches:
            if batch.num_rows:
                yield _compare(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(0).type)

    names = ["doc_id", *[c.split()[0] for c in COLUMNS.split(", ")]]
    return done.where(F.col("side").isNull()).select(*names).unionByName(
        tails.mapInArrow(across, f"doc_id {kind}, {COLUMNS}"))
