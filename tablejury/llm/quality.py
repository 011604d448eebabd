"""Document quality: random-indexing word vectors, pooled per document, into a two-layer network.

Random indexing gives every token a sparse random index vector (fixed by its
hash) and adds, for every occurrence in the corpus, the index vectors of its
neighbours to its own word vector. Tokens are maximal runs of letters, digits or
other visible marks; they are hashed into a fixed number of buckets, so the
table of word vectors has a fixed size whatever the corpus, is summed exactly in
integers over all documents, and can be broadcast. A document's vector is the
mean of its tokens' unit word vectors. The network is trained on a bounded sample of
labelled documents under a Gaussian prior on its weights, which counts as much as PRIOR rows
and so matters where labels are few; its temperature is fitted on a part kept out of training.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablejury.llm.common import mix, run_hashes, slices, stored, text_buffer

BUCKETS, WIDTH, WINDOW, NONZERO = 16_384, 32, 2, 4
MAX_LABELLED = 20_000  # bound of the labelled sample: the rows with the smallest hash of their id
HIDDEN, EPOCHS, BATCH, SEED, PRIOR = 24, 60, 256, 7, 2.0

_KIND = np.full(256, 3, np.uint8)  # 0 white space, 1 letters (and all bytes beyond ASCII), 2 digits, 3 other marks
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 1


def tokens(data, offsets, buckets=BUCKETS):
    """(bucket of every token, bounds of every document)."""
    h, _, bounds = run_hashes(data, _KIND[data], offsets)
    return (h >> np.uint64(40)).astype(np.int64) % buckets, bounds


def index_vectors(buckets=BUCKETS, width=WIDTH, nonzero=NONZERO):
    """Sparse random vectors of +1 and -1, the same in every process."""
    out = np.zeros((buckets, width), np.int8)
    seed = np.arange(buckets, dtype=np.uint64) * np.uint64(nonzero)
    for i in range(nonzero):
        h = mix(seed + np.uint64(i + 1))
        out[np.arange(buckets), (h >> np.uint64(8)).astype(np.int64) % width] = np.where(h & np.uint64(1), 1, -1)
    return out


def word_vectors(documents: DataFrame, buckets=BUCKETS, width=WIDTH, window=WINDOW) -> np.ndarray:
    """Sums of neighbours' index vectors over all documents: a table of buckets x width integers."""
    def add_up(batches):
        index = index_vectors(buckets, width)
        total = np.zeros((buckets, width), np.int64)
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for lo, hi in slices(offsets, 1_000_000):
                ids, bounds = tokens(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], buckets)
                if not len(ids):
                    continue
                doc = np.repeat(np.arange(hi - lo), np.diff(bounds))
                context = np.zeros((len(ids), width), np.int16)
                mine = index[ids]
                for d in range(1, window + 1):
                    if len(ids) <= d:
                        break
                    same = (doc[d:] == doc[:-d])[:, None]
                    context[d:] += mine[:-d] * same
                    context[:-d] += mine[d:] * same
                order = np.argsort(ids, kind="stable")
                ordered = ids[order]
                first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
                total[ordered[first]] += np.add.reduceat(context[order], first, axis=0, dtype=np.int64)
        used = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used)] + [pa.array(total[used, i]) for i in range(width)],
                                         names=["bucket"] + [f"x{i}" for i in range(width)])

    names = [f"x{i}" for i in range(width)]
    sums = (documents.select("text").mapInArrow(add_up, "bucket long, " + ", ".join(f"{n} long" for n in names))
            .groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]))
    out = np.zeros((buckets, width))
    frame = sums.toPandas()  # at most `buckets` rows
    if len(frame):
        out[frame["bucket"].to_numpy(np.int64)] = frame[names].to_numpy(np.float64)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1)


def pooled(column, table):
    """Means of the tokens' rows of `table` for each text of an Arrow column; zeros without tokens."""
    data, offsets = text_buffer(column)
    out = np.zeros((len(offsets) - 1, table.shape[1]))
    for lo, hi in slices(offsets, 1_000_000):
        ids, bounds = tokens(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], len(table))
        n = np.diff(bounds)
        full = np.flatnonzero(n)
        if len(full):
            out[lo + full] = np.add.reduceat(table[ids], bounds[full], axis=0) / n[full, None]
    return out


class Network:
    """Two layers (tanh, logistic) on standardised inputs, trained by Adam; scores divide by a temperature."""

    def __init__(self, x, y, seed=SEED):
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        cut = max(1, len(x) // 5) if len(x) >= 10 else 0
        held, train = order[:cut], order[cut:]
        self.decay = PRIOR / len(x)
        self.mean, self.scale = x[train].mean(0), x[train].std(0) + 1e-6
        z = (x - self.mean) / self.scale
        self.p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(q) for q in self.p], [np.zeros_like(q) for q in self.p], 0
        for epoch in range(EPOCHS):
            rate = 0.01 * (1 - epoch / EPOCHS) + 0.0005
            for rows in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
                t += 1
                for i, g in enumerate(self._gradients(z[rows], y[rows])):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - rate * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
        self.temperature = self._calibrated(self._logits(z[held]), y[held]) if len(held) else 1.0

    def _logits(self, z):
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def _gradients(self, z, y):
        h = np.tanh(z @ self.p[0] + self.p[1])
        e = (1 / (1 + np.exp(-(h @ self.p[2] + self.p[3]))) - y) / len(y)
        back = np.outer(e, self.p[2]) * (1 - h * h)
        return [z.T @ back + self.decay * self.p[0], back.sum(0), h.T @ e + self.decay * self.p[2], e.sum(keepdims=True)]

    @staticmethod
    def _calibrated(logits, y):
        """The temperature of least log loss on rows kept out of training."""
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [np.logaddexp(0, np.where(y > 0.5, -logits, logits) / t).mean() for t in grid]
        return float(grid[int(np.argmin(loss))])

    def folded(self, vectors):
        """The first layer applied to every word vector: it is linear, so pooling may follow it."""
        w = self.p[0] / self.scale[:, None]
        return (vectors @ w).astype(np.float32), self.p[1] - self.mean @ w

    def scores(self, means, bias):
        """means: what `pooled` gives for the folded word vectors; bias: the layer's."""
        return 1 / (1 + np.exp(-np.clip((np.tanh(means + bias) @ self.p[2] + self.p[3]) / self.temperature, -500, 500)))


def held_out(doc_id="doc_id"):
    """The fold whose labels are never learnt from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, vectors: np.ndarray, max_labelled=MAX_LABELLED):
    """A network, or the constant score where the labels do not hold two classes."""
    one = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
           .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
           .where((F.col("quality") == F.col("most")) & F.col("quality").isin(0, 1))
           .select(F.col("doc_id"), "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    sample = stored(one, "quality-labels")

    def vector(batches):
        for batch in batches:
            x = pooled(batch.column(0), vectors)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))],
                                             names=["doc_id", "quality", "x"])

    kinds = dict(sample.dtypes)
    rows = (documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "doc_id", "quality")
            .mapInArrow(vector, f"doc_id {kinds['doc_id']}, quality {kinds['quality']}, x array<double>").toPandas())
    rows = rows.drop_duplicates("doc_id").sort_values("doc_id", ignore_index=True)
    y = rows["quality"].to_numpy(np.float64)
    if len(y) == 0 or y.min() == y.max():
        return (y.sum() + 1) / (len(y) + 2)
    return Network(np.vstack(rows["x"].to_numpy()), y)


def _scorer(documents: DataFrame, labels: DataFrame, max_labelled):
    """A function from an Arrow column of texts to scores."""
    vectors = word_vectors(documents)
    model = train(documents, labels, vectors, max_labelled)
    if not isinstance(model, Network):
        return lambda column: np.full(len(column), model)
    table, bias = model.folded(vectors)
    return lambda column: model.scores(pooled(column, table), bias)


def score(documents: DataFrame, labels: DataFrame, max_labelled=MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `documents`.

    NULL and empty texts (and texts of white space) have no tokens; their vector is
    zero and they are scored like any other. Labels that are NULL, not 0 or 1, or
    contradict each other for a doc_id are not learnt from; without both classes
    the score is the smoothed share of label 1 (0.5 without labels). Rows with a
    NULL or repeated doc_id are scored one by one. Other columns are ignored.
    """
    scorer, kind = _scorer(documents, labels, max_labelled), dict(documents.dtypes)["doc_id"]

    def apply(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer(batch.column(1)))], names=["doc_id", "score"])

    return (documents.select("doc_id", "text").mapInArrow(apply, f"doc_id {kind}, score double")
            .select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))


def accepted(documents: DataFrame, labels: DataFrame, max_labelled=MAX_LABELLED) -> DataFrame:
    """The rows of `documents`, all columns, whose score is at least 0.5."""
    scorer, at = _scorer(documents, labels, max_labelled), documents.columns.index("text")

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch.column(at)) >= 0.5))

    return documents.mapInArrow(keep, documents.schema)
