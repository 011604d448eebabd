"""Best-fit packing of whole documents after Martello-Toth dominance reduction.

Packing needs only how many pieces there are of each length, at most `capacity`
numbers whatever the corpus. On these counts the driver
  1. fixes every set of at most three lengths that dominates all other ways to fill
     the sequence of its longest piece, as often as it occurs (`reduce_dominated`);
  2. packs what is left by best fit, longest first, whole groups of equal sequences
     at a time (`best_fit`).
Both give slots: the next pieces of a length go, so many to a sequence, into a run
of sequences. Tasks number the pieces of each length (numbers within the partition,
then starting points by two-pass prefix sums) and look their slot up.
"""

import bisect
import itertools
import math
import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablejury.llm.common import partition_starts, slices, span_hashes, stored, text_buffer

CAPACITY = 4096
END_ID = 1
SLICE = 1_000_000  # bytes of text whose distinct words are encoded together (a longer text is its own slice)
CACHE = 8_000_000  # ids of known words a worker keeps; it starts over beyond them
_ENCODERS = {}
BLANK, LETTER, MARK = 1, 2, 4
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = BLANK
_KIND[97:123] = _KIND[65:91] = LETTER
_KIND[list(b".,;:!?()")] = MARK


def tokenizer_path(name="word_bpe_49k.json"):
    import public_tokenizers

    return public_tokenizers.path(name)


class Words:
    """Ids of whole texts by a tokenizer whose units never cross white space: each distinct word is encoded once.

    A word is also cut between an ASCII letter and sentence punctuation, where the
    tokenizer's pattern always ends a unit, and its ASCII letters are made lower case,
    as the tokenizer does itself. Only the strings of special tokens mind the case.
    """

    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task: Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self):
        self.known = np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, words, hashes):
        """Encode words whose hashes (ascending) are new; `known` stays sorted."""
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, encoded), np.int64, len(encoded))
        begin = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(encoded), np.uint32, int(size.sum()))])
        spot = np.searchsorted(self.known, hashes)
        self.known, self.begin, self.size = np.insert(self.known, spot, hashes), np.insert(self.begin, spot, begin), np.insert(self.size, spot, size)

    def folded(self, data):
        """ASCII letters in lower case, unless that could make up a special token."""
        low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
        return data if any(t in low.tobytes() for t in self.special) else low

    def batch(self, data, offsets, end_id):
        """(all ids with `end_id` after each document, number of ids per document)."""
        docs, data = len(offsets) - 1, self.folded(data)
        kind = _KIND[data]
        # a word begins after white space, at a document's begin, and between a letter and a sentence mark
        edge = np.zeros(len(data) + 1, bool)
        edge[1:-1] = (kind[1:] == BLANK) | (kind[:-1] == BLANK) | (kind[1:] + kind[:-1] == LETTER + MARK)
        edge[offsets] = True
        edges = np.flatnonzero(edge)
        starts, ends = edges[:-1], edges[1:]
        word = kind[starts] != BLANK if len(starts) else np.zeros(0, bool)
        starts, ends = starts[word], ends[word]
        bounds = np.searchsorted(starts, offsets)
        distinct, at, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.ids) > CACHE:
            self.forget()
        new = np.flatnonzero(~np.isin(distinct, self.known, assume_unique=True))
        if len(new):
            raw = data.tobytes()
            self.learn([raw[i:j].decode() for i, j in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)], distinct[new])
        spot = np.searchsorted(self.known, distinct)[which]
        # every document's words, then its end id, as runs of one source of ids
        source = np.append(self.ids, np.uint32(end_id))
        place = np.arange(len(starts)) + np.repeat(np.arange(docs), np.diff(bounds))
        begins, sizes = np.full(len(starts) + docs, len(self.ids), np.int64), np.ones(len(starts) + docs, np.int64)
        begins[place], sizes[place] = self.begin[spot], self.size[spot]
        total = np.cumsum(sizes)
        n = np.diff(np.append(0, total[bounds[1:] + np.arange(docs)]))
        return source[np.repeat(begins - (total - sizes), sizes) + np.arange(int(n.sum()))], n


def encoder(path):
    if path not in _ENCODERS:
        _ENCODERS[path] = Words(path)
    return _ENCODERS[path]


def dominating(left, size, capacity):
    """Sizes of a set that dominates every other way to fill the sequence of a piece of `size`, or None.

    `left[s]` is the number of pieces of size s. A set dominates another if the
    other's pieces can be split among its own so that no share exceeds its piece:
    swapping them then never needs more sequences.
    """
    room = capacity - size
    left[size] -= 1
    try:
        there = np.flatnonzero(left[:room + 1])
        if not len(there):
            return [size]
        best = int(there[-1])
        if best == room:
            return [size, best]
        low = np.repeat(there[:3], np.minimum(left[there[:3]], 3))[:3]
        if len(low) < 2 or low[0] + low[1] > room:
            return [size, best]
        if len(low) == 3 and low.sum() <= room:
            return None
        # exactly two further pieces fit: the pair of the largest sum
        spot = np.searchsorted(there, room - there, side="right") - 1
        spot -= (spot >= 0) & (there[spot] == there) & (left[there] < 2)
        pair = np.where(spot >= 0, there + there[spot], 0)
        if best >= pair.max():
            return [size, best]
        if pair[-1] < pair.max():
            return None
        second = int(there[spot[-1]])
        above = np.flatnonzero(left[second + 1:room + 1])[:2] + second + 1
        two = np.repeat(above, np.minimum(left[above], 2))[:2]
        return [size, best, second] if len(two) < 2 or two.sum() > room else None
    finally:
        left[size] += 1


class Plan:
    """Slots filled so far: pieces `first`.. of `size`, `per` to a sequence, into sequences `start`.. from place `offset`."""

    def __init__(self, counts, capacity):
        self.capacity, self.left, self.taken, self.sequences, self.rows = capacity, counts.copy(), np.zeros_like(counts), 0, []

    def put(self, size, per, start, sequences, offset):
        self.rows.append((size, int(self.taken[size]), per, start, offset))
        self.taken[size] += per * sequences
        self.left[size] -= per * sequences

    def open(self, sequences):
        self.sequences += sequences
        return self.sequences - sequences

    def reduce_dominated(self):
        """Fix dominating sets for good, until no length has one. Removing pieces never ends a set's dominance, so it is taken as often as it is there."""
        fixed = True
        while fixed:
            fixed = False
            for size in np.flatnonzero(self.left)[::-1].tolist():
                while self.left[size] and (chosen := dominating(self.left, size, self.capacity)):
                    times = min(int(self.left[s]) // chosen.count(s) for s in set(chosen))
                    start, offset = self.open(times), 0
                    for s in sorted(set(chosen), reverse=True):
                        self.put(s, chosen.count(s), start, times, offset)
                        offset += s * chosen.count(s)
                    fixed = True
        return self

    def best_fit(self):
        """Longest first, each piece into the sequence with the least sufficient room; equal sequences are handled as one group."""
        groups, rooms = {}, []  # room left -> [(first sequence, sequences)], the rooms in order

        def add(room, start, sequences):
            if sequences and room:
                if room not in groups:
                    bisect.insort(rooms, room)
                groups.setdefault(room, []).append((start, sequences))

        for size in np.flatnonzero(self.left)[::-1].tolist():
            while self.left[size]:
                n, at = int(self.left[size]), bisect.bisect_left(rooms, size)
                if at < len(rooms):
                    room = rooms[at]
                    start, sequences = groups[room].pop()
                    if not groups[room]:
                        del groups[room], rooms[at]
                else:
                    room = self.capacity
                    sequences = math.ceil(n / (room // size))
                    start = self.open(sequences)
                per = min(n, room // size)
                used = min(sequences, n // per)
                self.put(size, per, start, used, self.capacity - room)
                add(room - per * size, start, used)
                add(room, start + used, sequences - used)
        return self

    def slots(self):
        rows = np.array(sorted(self.rows), np.int64).reshape(-1, 5)
        return rows[:, :2], rows[:, 2:]


def plan(counts, capacity=CAPACITY) -> Plan:
    """Sequences for `counts[s]` pieces of each size s from 1 to `capacity`."""
    return Plan(np.asarray(counts, np.int64), capacity).reduce_dominated().best_fit()


def tokenized(documents: DataFrame, path, capacity, end_id) -> DataFrame:
    """Pieces of at most `capacity` ids, numbered by length within each partition; written to the shared folder."""
    kind = dict(documents.dtypes)["doc_id"]

    def encode(batches):
        part, seen, words = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(path)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in slices(offsets, SLICE):
                flat, n = words.batch(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], end_id)
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(hi - lo), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.minimum(n[doc] - piece * capacity, capacity)
                where = np.append(0, np.cumsum(length))
                order = np.argsort(length, kind="stable")
                sizes, first, counts = np.unique(length[order], return_index=True, return_counts=True)
                local = np.empty(len(doc), np.int64)
                local[order] = np.arange(len(doc)) - np.repeat(first, counts) + np.repeat(seen[sizes], counts)
                seen[sizes] += counts
                raw = flat.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[a * 4:b * 4]) for a, b in zip(where[:-1].tolist(), where[1:].tolist(), strict=True)]
                ids = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(where * 4), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(doc), part, np.int32)), batch.column(0).take(pa.array(doc + lo)), pa.array(piece.astype(np.int32)),
                     pa.array(piece * capacity), pa.array(length), ids.cast(pa.binary()), pa.array(crc, pa.int64()), pa.array(local)],
                    names=["part", "doc_id", "piece", "start", "length", "ids", "ids_crc32", "local"])

    return stored(documents.select("doc_id", "text").mapInArrow(
        encode, f"part int, doc_id {kind}, piece int, start long, length long, ids binary, ids_crc32 long, local long"), "binpack-pieces")


def pack(documents: DataFrame, capacity=CAPACITY, path=None, end_id=END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (4 bytes each), ids_crc32, sequence_id, offset.

    A NULL or empty text is just the end id. Strings of the tokenizer's special
    tokens get their ids, as its library does by default. Repeated rows and repeated
    or NULL doc_ids are packed as often as they occur; other columns are ignored. An
    empty table gives no rows. Only documents longer than `capacity` are cut. Pieces of
    equal length are alike to the packing: which of them takes which slot follows
    storage order.
    """
    rows = tokenized(documents, path or tokenizer_path(), capacity, end_id)
    totals = stored(rows.groupBy("part", "length").agg(F.count("*").alias("total")), "binpack-totals")
    counts = np.zeros(capacity + 1, np.int64)
    for r in totals.groupBy("length").agg(F.sum("total").alias("n")).collect():  # at most `capacity` rows
        counts[r.length] = r.n
    keys, values = plan(counts, capacity).slots()
    shift = int(counts.max()).bit_length() + 1
    order = (keys[:, 0] << shift) + keys[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        size, n = length.to_numpy(np.int64), number.to_numpy(np.int64)
        at = np.searchsorted(order, (size << shift) + n, side="right") - 1
        per, start, offset = values[at].T
        past = n - keys[at, 1]
        return pd.DataFrame({"sequence_id": start + past // per, "offset": offset + past % per * size})

    starts = stored(partition_starts(totals, ["length"]), "binpack-starts")
    return (rows.join(starts, ["part", "length"])
            .withColumn("slot", slot("length", F.col("base") + F.col("local")))
            .select("doc_id", "piece", "start", "length", "ids", "ids_crc32", "slot.sequence_id", "slot.offset"))


def pack_digest(pieces: DataFrame) -> DataFrame:
    """The pieces without their ids."""
    return pieces.drop("ids")
