"""Packing by concatenate-and-cut: two-pass prefix sums give global token offsets, fixed windows cut them.

Pass one tokenises every text once, writes the ids with each partition's own
running total, and so fixes the order of the concatenated stream. Pass two adds
up the partitions' totals, which turns local totals into global offsets; each
document is then cut at multiples of the sequence length. A document that spans
a boundary yields one boundary record per window it touches, so no task needs
another task's tokens. Only the last sequence is padded.
"""

import base64
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablejury.llm.common import partition_starts, run_hashes, slices, small, stored, text_buffer

SEQUENCE = 2048
END_ID = 1
SLICE = 2_000_000  # bytes of text whose distinct words are encoded together (a longer text is its own slice)
_ENCODERS = {}


def tokenizer_path(name="byte_bpe_50k.tiktoken"):
    import public_tokenizers

    return public_tokenizers.path(name)


def special_tokens(path):
    """String -> id of the special tokens, from the ``.json`` file beside the ranks, if there is one."""
    described = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(described):
        return {}
    with open(described, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


class WordEncoder:
    """Byte-pair ids of whole texts; each distinct word of a slice of texts is encoded once.

    The tokenizer's pattern starts a new unit at every space between visible
    characters, so such a text is the concatenation of its words, each with the
    space before it. Texts where a space touches other white space are encoded whole,
    and so are texts that hold a special token's string, which stands for its id.
    """

    def __init__(self, path):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = special_tokens(path)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.width[rank] = len(token)

    def ids(self, text):
        if not self.special:
            return np.array(self.encoding.encode_ordinary(text), np.uint32)
        parts = [[self.special[x]] if x in self.special else self.encoding.encode_ordinary(x) for x in self.split.split(text)]
        return np.array([i for part in parts for i in part], np.uint32)

    def batch(self, data, offsets, end_id):
        """(all ids with `end_id` after each document, number of ids per document)."""
        docs, raw = len(offsets) - 1, data.tobytes()
        whole = _awkward(data, offsets)
        for token in self.special:
            for found in re.finditer(re.escape(token.encode()), raw):
                whole[np.searchsorted(offsets, found.start(), side="right") - 1] = True
        h, starts, bounds = run_hashes(data, (data != 32).view(np.uint8), offsets)
        lengths = np.diff(np.append(starts, len(data)))
        ends = starts + lengths
        spaces = np.append(np.flatnonzero((data == 32) | _marks(offsets, len(data))), len(data))
        ends = np.minimum(ends, spaces[np.searchsorted(spaces, starts + 1)])
        first = np.zeros(len(h), bool)
        first[bounds[:-1][np.diff(bounds) > 0]] = True
        first &= np.isin(starts, offsets[:-1])
        doc = np.repeat(np.arange(docs), np.diff(bounds))
        word = ~first & ~whole[doc]
        _, at, which = np.unique(h[word], return_index=True, return_inverse=True)
        begin, stop = starts[word][at].tolist(), ends[word][at].tolist()
        vocabulary = self.ids((b" " + b" ".join([raw[i:j] for i, j in zip(begin, stop, strict=True)])).decode()) if begin else self.ids("")
        edge = np.cumsum(self.width[vocabulary])
        upto = np.searchsorted(edge, np.cumsum(np.array(stop, np.int64) - np.array(begin, np.int64) + 1), side="left") + 1
        from_ = np.append(0, upto)[:-1]
        # heads: the first word of ordinary documents, all of the awkward ones; then the words; then the end id
        head = []
        first_of = np.full(docs, -1, np.int64)
        first_of[doc[first]] = np.flatnonzero(first)
        for d in range(docs):
            if whole[d]:
                head.append(self.ids(raw[offsets[d]:offsets[d + 1]].decode()))
            elif first_of[d] >= 0:
                head.append(self.ids(raw[starts[first_of[d]]:ends[first_of[d]]].decode()))
            else:
                head.append(np.zeros(0, np.uint32))
        heads = np.array([len(x) for x in head], np.int64)
        words = np.bincount(doc[word], minlength=docs)
        piece_count = words + 2
        piece_end = np.cumsum(piece_count)
        n_pieces = int(piece_end[-1]) if docs else 0
        source = np.concatenate([vocabulary, *head, np.array([end_id], np.uint32)])
        begins, sizes = np.empty(n_pieces, np.int64), np.empty(n_pieces, np.int64)
        head_at, end_at = piece_end - piece_count, piece_end - 1
        begins[head_at], sizes[head_at] = len(vocabulary) + np.cumsum(heads) - heads, heads
        begins[end_at], sizes[end_at] = len(source) - 1, 1
        middle = np.ones(n_pieces, bool)
        middle[head_at] = middle[end_at] = False
        begins[middle], sizes[middle] = from_[which], (upto - from_)[which]
        total = np.cumsum(sizes)
        flat = source[np.repeat(begins - (total - sizes), sizes) + np.arange(total[-1] if n_pieces else 0)]
        return flat, np.diff(np.append(0, total[end_at]))


def _marks(offsets, n):
    """Where documents begin."""
    out = np.zeros(n, bool)
    out[offsets[:-1][offsets[:-1] < n]] = True
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def _awkward(data, offsets):
    """Documents where a space stands beside other white space or at the end."""
    n = len(data)
    begins, ends = _SPACE[data], _SPACE[data]  # first and last byte of a white-space character
    for i in np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3))).tolist():
        size = 2 if data[i] == 0xC2 else 3
        if bytes(data[i:i + size]).decode().isspace():
            begins[i] = ends[i + size - 1] = True
    space = data == 32
    bad = np.zeros(n + 1, bool)
    if n:
        inside = ~_marks(offsets, n)[1:]
        bad[1:n] = ((space[:-1] & begins[1:]) | (ends[:-1] & space[1:])) & inside
        last = offsets[1:][np.diff(offsets) > 0] - 1
        bad[last] |= space[last]
    total = np.append(0, np.cumsum(bad))
    return total[offsets[1:]] > total[offsets[:-1]]


def encoder(path):
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenized(documents: DataFrame, path=None, end_id=END_ID) -> DataFrame:
    """Pass one: (part, local_start, doc_id, n_tokens, ids), written to the shared folder."""
    path = path or tokenizer_path()
    kind = dict(documents.dtypes)["doc_id"]

    def encode(batches):
        part, total = TaskContext.get().partitionId(), 0
        bpe = encoder(path)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in slices(offsets, SLICE):
                flat, n = bpe.batch(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], end_id)
                where = np.append(0, np.cumsum(n))
                ids = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(where * 4), pa.py_buffer(flat.astype("<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(hi - lo, part, np.int32)), pa.array(total + where[:-1]), batch.column(0).slice(lo, hi - lo),
                     pa.array(n), ids.cast(pa.binary())], names=["part", "local_start", "doc_id", "n_tokens", "ids"])
                total += int(where[-1])

    rows = documents.select("doc_id", "text").mapInArrow(
        encode, f"part int, local_start long, doc_id {kind}, n_tokens long, ids binary")
    return stored(rows, "packing-tokens")


def pack(documents: DataFrame, sequence=SEQUENCE, path=None, end_id=END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, 4 bytes each), doc_tokens, sequence_id, offset.

    Order of the stream: the documents' storage order. A NULL or empty text is
    just the end id. Repeated rows and repeated doc_ids are packed as often as
    they occur; a NULL doc_id is carried along. Any other columns are ignored. An
    empty table gives no rows. Very long texts are cut like any other: their
    pieces hold slices, never copies of the whole.
    """
    rows = tokenized(documents, path, end_id)
    totals = rows.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("total"))
    starts = stored(partition_starts(totals, []), "packing-starts")
    placed = (rows.join(small(starts, starts.count()), "part")
              .select("doc_id", "ids", "n_tokens", (F.col("base") + F.col("local_start")).alias("at")))
    piece = F.expr(f"""transform(sequence(at div {sequence}, (at + n_tokens - 1) div {sequence}), s ->
        struct(greatest(s * {sequence}, at) - at AS start,
               least((s + 1) * {sequence}, at + n_tokens) - greatest(s * {sequence}, at) AS length,
               substring(ids, CAST((greatest(s * {sequence}, at) - at) * 4 + 1 AS INT),
                         CAST((least((s + 1) * {sequence}, at + n_tokens) - greatest(s * {sequence}, at)) * 4 AS INT)) AS ids,
               s AS sequence_id,
               greatest(s * {sequence}, at) - s * {sequence} AS offset))""")
    return (placed.select("doc_id", F.col("n_tokens").alias("doc_tokens"), F.explode(piece).alias("p"))
            .select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset"))


def pack_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")
