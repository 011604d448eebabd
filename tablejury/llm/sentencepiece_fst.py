"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The model file is compiled into three machines: the normaliser (a mark in front
of the text, spaces to marks), the pieces (a trie from characters to piece ids)
and the byte fallback (a character that is no piece to its bytes). Composed with
an input they form a lattice of positions and last pieces, whose shortest path
in the tropical semiring is the encoding.

For a unigram model the weight of a piece is its negative score. A BPE model
asks for the result of its merges instead, which scores alone do not give: there
an arc between two adjacent pieces has weight 0 if merging their joined text gives
exactly these two pieces again, and infinity otherwise. A segmentation is what the
merges give if and only if all its adjacent pairs pass, so one path is finite, and
every position is reached by one last piece; the search follows finite arcs only.

Pieces never hold a mark after another character, so marked words are composed
on their own, and each distinct word of a slice of texts once.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablejury.llm.common import slices, span_hashes, text_buffer

MARK = "▁"
# Bytes of text encoded together; bounds of the memos of adjacent pairs and of words (emptied when full)
SLICE, MEMO, WORDS = 3_000_000, 500_000, 600_000
_COMPILED = {}


def model_path(name="piece_bpe_32k.model"):
    import public_tokenizers

    return public_tokenizers.path(name)


class Transducer:
    def __init__(self, serialized: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        model.ParseFromString(serialized)
        kinds = proto.ModelProto.SentencePiece
        if model.normalizer_spec.precompiled_charsmap:
            raise ValueError("only the identity normaliser is compiled")
        if model.trainer_spec.model_type not in (proto.TrainerSpec.UNIGRAM, proto.TrainerSpec.BPE):
            raise ValueError("only unigram and BPE models are compiled")
        if any(p.type == kinds.USER_DEFINED for p in model.pieces):
            raise ValueError("user-defined pieces are not compiled")
        self.bpe = model.trainer_spec.model_type == proto.TrainerSpec.BPE
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.squeeze = model.normalizer_spec.remove_extra_whitespaces
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.text, self.weight, self.id, self.trie = {}, {}, {}, {}
        for i, p in enumerate(model.pieces):
            if p.type == kinds.NORMAL:
                self.text[i], self.weight[i], self.id[p.piece] = p.piece, -p.score, i
                node = self.trie
                for c in p.piece:
                    node = node.setdefault(c, {})
                node[""] = i
        self.unknown_weight = max(self.weight.values(), default=0.0) + 10.0
        self.words = not any(MARK in p.lstrip(MARK) for p in self.id)
        self.pairs, self.known = {}, {}
        out = []
        for i, p in enumerate(model.pieces):
            out.append(p.piece.replace(MARK, " ").encode() if p.type == kinds.NORMAL else
                       bytes([int(p.piece[1:-1], 16)]) if p.type == kinds.BYTE else
                       " ⁇ ".encode() if p.type == kinds.UNKNOWN else b"")
        self.surface = out

    def merged(self, text):
        """The pieces that the model's merges make of a text: best score first, leftmost among equals."""
        parts = list(text)
        while True:
            best, at = math.inf, -1
            for i in range(len(parts) - 1):
                w = self.weight.get(self.id.get(parts[i] + parts[i + 1]), math.inf)
                if w < best:
                    best, at = w, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def adjacent(self, left, right):
        """Whether the pair survives its own merges."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            a, b = self.text[left], self.text[right]
            known = self.pairs[key] = self.merged(a + b) == [a, b]
        return known

    def word(self, text):
        """Piece ids of the shortest path through the composed lattice of one word."""
        path = self._finite(text) if self.bpe else self._shortest(text)
        if -2 not in path:
            return path
        out, at = [], 0
        for piece in path:  # unknown characters to their bytes
            size = 1 if piece == -2 else len(self.text[piece])
            out += [piece] if piece >= 0 else [self.bytes[b] for b in text[at].encode()] if self.bytes else [self.unknown]
            at += size
        return out

    def _arcs(self, text, p):
        """(piece, end) of the pieces that begin at p, shortest first; an unknown character is a piece of its own."""
        node, out = self.trie, []
        for q in range(p, len(text)):
            node = node.get(text[q])
            if node is None:
                break
            piece = node.get("")
            if piece is not None:
                out.append((piece, q + 1))
        if text[p] not in self.id:
            out.insert(0, (-2, p + 1))
        return out

    def _finite(self, text):
        """The one path of finite weight, depth first with the longest arcs first; positions that lead nowhere are left out."""
        n, p, before, dead, out, trail = len(text), 0, -1, set(), [], []
        pairs, adjacent, arcs = self.pairs, self.adjacent, self._arcs(text, 0)
        while p < n:
            while arcs:
                piece, q = arcs.pop()
                if q in dead:
                    continue
                if before < 0 or piece < 0:
                    break
                known = pairs.get(before << 32 | piece)
                if adjacent(before, piece) if known is None else known:
                    break
            else:
                dead.add(p)
                p, before, arcs = trail.pop()
                out.pop()
                continue
            trail.append((p, before, arcs))
            out.append(piece)
            p, before = q, piece
            if p < n:
                arcs = self._arcs(text, p)
        return out

    def _shortest(self, text):
        n = len(text)
        cost, back = [0.0] + [math.inf] * n, [None] * (n + 1)
        for p in range(n):
            for piece, q in self._arcs(text, p):
                weight = cost[p] + (self.weight[piece] if piece >= 0 else self.unknown_weight)
                if weight < cost[q]:
                    cost[q], back[q] = weight, (p, piece)
        out, p = [], n
        while p > 0:
            p, piece = back[p]
            out.append(piece)
        return out[::-1]

    def batch(self, data, offsets):
        """(all ids, number of ids per document) of UTF-8 texts."""
        docs = len(offsets) - 1
        if self.squeeze:
            raw = data.tobytes()
            texts = [b" ".join(x for x in raw[offsets[d]:offsets[d + 1]].split(b" ") if x) for d in range(docs)]
            data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
        full = np.diff(offsets) > 0
        if self.prefix:
            data = np.insert(data, offsets[:-1][full], 32)
            offsets = offsets + np.append(0, np.cumsum(full))
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(docs, np.int64)
        edge = np.zeros(n, bool)
        if self.words:
            edge[1:] = (data[1:] == 32) & (data[:-1] != 32)
            mark = np.flatnonzero((data[:-3] == 0xE2) & (data[1:-2] == 0x96) & (data[2:-1] == 0x81))  # a mark in the text itself
            edge[mark + 3] = False
        edge[offsets[:-1][full]] = True
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], n)
        _, at, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        raw, known, found = data.tobytes(), self.known, []
        for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True):
            text = raw[i:j]
            ids = known.get(text)
            if ids is None:
                ids = tuple(self.word(text.decode().replace(" ", MARK)))
                if j - i <= 64:  # long words are not worth their memory
                    if len(known) >= WORDS:
                        known.clear()
                    known[text] = ids
            found.append(ids)
        sizes = np.array([len(x) for x in found], np.int64)
        source = np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))
        begins = (np.cumsum(sizes) - sizes)[which]
        sizes = sizes[which]
        total = np.cumsum(sizes)
        flat = source[np.repeat(begins - (total - sizes), sizes) + np.arange(total[-1])]
        where = np.append(0, total)[np.searchsorted(starts, offsets)]
        return flat, np.diff(where)

    def decoded(self, ids):
        """The text of piece ids; bytes that form no character become replacement characters."""
        surface = self.surface
        text = b"".join([surface[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


def transducer(path):
    if path not in _COMPILED:
        with open(path, "rb") as f:
            _COMPILED[path] = Transducer(f.read())
    return _COMPILED[path]


def encode(documents: DataFrame, path=None) -> DataFrame:
    """(doc_id, n_tokens, ids) for every row: ids as little-endian unsigned 32-bit numbers in a binary.

    NULL and empty texts have no ids. Rows with NULL or repeated doc_ids are
    encoded one by one; other columns are ignored; an empty table gives no rows.
    Long texts are encoded whole. `path` is a model file on every executor.
    """
    path, kind = path or model_path(), dict(documents.dtypes)["doc_id"]

    def run(batches):
        fst = transducer(path)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in slices(offsets, SLICE):
                flat, n = fst.batch(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                where = np.append(0, np.cumsum(n)) * 4
                ids = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(where), pa.py_buffer(flat.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), ids.cast(pa.binary())],
                                                 names=["doc_id", "n_tokens", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path=None) -> DataFrame:
    """(doc_id, n_tokens, ids, text) from what `encode` gives; NULL ids give an empty text."""
    path, kind = path or model_path(), dict(encoded.dtypes)["doc_id"]

    def run(batches):
        fst = transducer(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [fst.decoded(np.frombuffer(x, "<u4").tolist()) if x else "" for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "text"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, text string")


def digest(decoded: DataFrame) -> DataFrame:
    """Checksums in place of ids and texts."""
    return decoded.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.length("text").cast("long").alias("n_chars"),
                          F.sha2("text", 256).alias("decoded_sha256"))
