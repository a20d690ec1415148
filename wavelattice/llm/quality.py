"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, temperature calibration.

A text's tokens are its runs of letters, of digits and of other characters.
Each token has two words: the token itself (A-Z lower-cased) and its shape
(kind, capitals, length). Words fall into a fixed number of hash buckets. A
bucket's index vector is sparse and ternary, drawn from its number; its
context vector is the sum of the index vectors of the words next to it, over
every text given. The table of both is of fixed size and is what the workers
get. A document's features are the means of its words' vectors, their norms,
its length and its share of different words.

The network is fitted on a bounded sample of labelled rows: the
``max_train_rows`` with the smallest id hashes outside the held-out fold, of
which a sixth only serve to stop the fit and to set the temperature that
divides the logits. Labels, language, source and id are never inputs.

Null text counts as empty and gets the score of its (zero) features. Labels
that are null or contradict each other for one id are left out. With labels of
one class only, or none, every score is the share of that class, or a half.
Extra columns are ignored. Rows without an id are scored, not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelattice.llm import kernel
from wavelattice.llm.ngram_lm import held_out_fold

U = np.uint64
BUCKETS, DIMS, NONZERO = 1 << 13, 32, 4
MAX_TRAIN_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 256, 2e-3, 1e-4
_TOKEN_SLICE = 1 << 19

# Byte classes: 0 white space, 1 letters (all bytes above ASCII among them), 2 digits, 3 the rest.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[kernel.SPACE] = 0
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_CLASS[48:58] = 2
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
SHAPES = 3 * 4 * 8


def index_vectors(buckets: int = BUCKETS, dims: int = DIMS, nonzero: int = NONZERO) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the places and signs of its index vector's entries."""
    rng = np.random.default_rng(11)
    places = np.argsort(rng.random((buckets, dims)), axis=1)[:, :nonzero]
    return places, rng.choice(np.array([-1.0, 1.0]), (buckets, nonzero))


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and shapes of all tokens of a slice, and n+1 token offsets."""
    kind = _CLASS[raw]
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change[offsets[(offsets > 0) & (offsets < n)]] = True
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], n)
    word = kind[starts] > 0
    starts, ends = starts[word], ends[word]
    hashes = kernel.run_hashes(raw, starts, ends, kernel.LOWER_CODES)
    upper = np.concatenate(([0], np.cumsum(_UPPER[raw])))
    caps, size = upper[ends] - upper[starts], ends - starts
    style = np.where(caps == 0, 0, np.where(caps == size, 3, np.where((caps == 1) & (_UPPER[raw[starts]] == 1), 1, 2)))
    style[(caps == size) & (size == 1)] = 1
    shape = (kind[starts].astype(np.int64) - 1) * 32 + style * 8 + np.minimum(size, 8) - 1
    return (hashes % U(BUCKETS - SHAPES)).astype(np.int64) + SHAPES, shape, np.searchsorted(starts, offsets)


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for first, end, raw, offsets in kernel.slices(column, _TOKEN_SLICE):
        yield first, end, *tokens(raw, offsets)


def _context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's context sums: one row for each block of buckets."""
    places, signs = index_vectors()
    total = np.zeros(BUCKETS * DIMS)
    used = False
    for batch in batches:
        for _, _, words, shapes, bounds in _pieces(batch.column(0)):
            if len(words) < 2:
                continue
            used = True
            joined = np.ones(len(words) - 1, bool)
            inner = bounds[1:-1]
            joined[inner[(inner > 0) & (inner < len(words))] - 1] = False
            left, right = words[:-1][joined], words[1:][joined]
            shape_left, shape_right = shapes[:-1][joined], shapes[1:][joined]
            for a, b in ((left, right), (right, left), (shape_left, shape_right), (shape_right, shape_left)):
                for k in range(NONZERO):
                    total += np.bincount(a * DIMS + places[b, k], signs[b, k], BUCKETS * DIMS)
    if used:
        rows = total.astype(np.float32).reshape(32, -1)
        yield pa.RecordBatch.from_pydict({"block": pa.array(range(32), pa.int32()), "sums": pa.array([r.tobytes() for r in rows], pa.binary())})


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(sums.as_py(), np.float32).astype(np.float64)
            total[block] = total[block] + x if block in total else x
    yield pa.RecordBatch.from_pydict(
        {"block": pa.array(list(total), pa.int32()), "sums": pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())}
    )


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Index and normalised context vectors of all buckets, from every text (one string column)."""
    schema = "block int, sums binary"
    parts = texts.mapInArrow(kernel.lean(_context), schema)
    groups = 32
    sums = parts.repartition(groups, "block").mapInArrow(_add, schema).collect()
    context = np.zeros((32, BUCKETS * DIMS // 32))
    for r in sums:
        context[r.block] += np.frombuffer(r.sums, np.float32)
    context = context.reshape(BUCKETS, DIMS)
    context -= context.mean(axis=0)
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    context = np.divide(context, norm, out=np.zeros_like(context), where=norm > 0)
    places, signs = index_vectors()
    index = np.zeros((BUCKETS, DIMS))
    np.put_along_axis(index, places, signs / np.sqrt(NONZERO), axis=1)
    return np.concatenate([index, context], axis=1).astype(np.float32)


def pooled(words: np.ndarray, shapes: np.ndarray, bounds: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Features of each text of a slice."""
    n_texts = len(bounds) - 1
    n = np.diff(bounds)
    width = vectors.shape[1]
    means = np.zeros((n_texts, 2 * width))
    full = np.flatnonzero(n)
    extra = np.zeros((n_texts, 4))
    if len(full):
        starts = bounds[full]
        for part, ids in enumerate((words, shapes)):
            # Blocks of texts bound the gathered rows.
            done = 0
            while done < len(full):
                stop = max(done + 1, int(np.searchsorted(starts, starts[done] + 40_000)))
                a, b = starts[done], starts[stop] if stop < len(full) else len(ids)
                sums = np.add.reduceat(vectors[ids[a:b]], starts[done:stop] - a, axis=0)
                means[full[done:stop], part * width : (part + 1) * width] = sums / n[full[done:stop], None]
                done = stop
        text = np.repeat(np.arange(n_texts), n)
        distinct = np.sort(text * BUCKETS + words)
        first = np.concatenate(([True], distinct[1:] != distinct[:-1]))
        extra[:, 0] = np.bincount(distinct[first] // BUCKETS, minlength=n_texts) / np.maximum(n, 1)
    extra[:, 1] = np.log1p(n)
    extra[:, 2] = np.linalg.norm(means[:, :DIMS], axis=1)
    extra[:, 3] = np.linalg.norm(means[:, width : width + DIMS], axis=1)
    return np.concatenate([means, extra], axis=1)


@dataclass
class Network:
    """A two-layer network over standardised features; probabilities after the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _constant(p: float, width: int) -> Network:
    zeros = np.zeros(width)
    return Network(zeros, zeros + 1, np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))) if 0 < p < 1 else (40.0 if p else -40.0))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Network:
    """Adam on the logistic loss; the best epoch on the held-back sixth; then its temperature."""
    if not len(y) or y.min() == y.max():
        return _constant(float(y.mean()) if len(y) else 0.5, x.shape[1] if x.ndim == 2 else 1)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    back, use = order[: len(y) // 6], order[len(y) // 6 :]
    if not len(back) or y[use].min() == y[use].max():
        back = use = order
    mean, scale = x[use].mean(axis=0), x[use].std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = (x - mean) / scale
    p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    best, kept, step = np.inf, None, 0
    for _ in range(EPOCHS):
        use = rng.permutation(use)
        for k in range(0, len(use), BATCH):
            rows = use[k : k + BATCH]
            a = z[rows] @ p[0] + p[1]
            h = np.maximum(a, 0)
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[rows]) / len(rows)
            dh = np.outer(d, p[2]) * (a > 0)
            grads = [z[rows].T @ dh + DECAY * p[0], dh.sum(axis=0), h.T @ d + DECAY * p[2], d.sum(keepdims=True)]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        now = _loss(np.maximum(z[back] @ p[0] + p[1], 0) @ p[2] + p[3], y[back])
        if now < best:
            best, kept = now, [a.copy() for a in p]
    net = Network(mean, scale, kept[0], kept[1], kept[2], float(kept[3][0]))
    logits = net.logits(x[back])
    temperatures = np.exp(np.linspace(np.log(0.25), np.log(8), 200))
    net.temperature = float(min(temperatures, key=lambda t: _loss(logits / t, y[back])))
    return net


def _features(vectors: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, *parts in _pieces(batch.column(1)):
                x = pooled(*parts, vectors).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])

    return run


def _probabilities(vectors, network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, *parts in _pieces(batch.column(2)):
                p = network.probabilities(pooled(*parts, vectors).astype(np.float32).astype(np.float64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first), pa.array(p)], names=["doc_id", "held_out", "score"]
                )

    return run


@dataclass
class Classifier:
    vectors: np.ndarray
    network: Network

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, held_out and score for rows (doc_id, held_out, text)."""
        return docs.select("doc_id", "held_out", "text").mapInArrow(kernel.lean(_probabilities(self.vectors, self.network)), "doc_id long, held_out boolean, score double")


def train(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> Classifier:
    """Vectors from all ``docs`` (doc_id, held_out, text); the network from labels (doc_id, label 0 or 1)."""
    vectors = word_vectors(docs.select("text"))
    clean = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    clean = clean.where("label = other and label in (0, 1)").where(~held_out_fold("doc_id", 5)).select("doc_id", "label")
    sample = clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_rows)
    rows = docs.join(F.broadcast(sample), "doc_id").where("not held_out").select("label", "text")
    got = rows.mapInArrow(kernel.lean(_features(vectors)), "label int, x binary").toArrow()
    y = np.array(got.column("label").to_pylist(), np.float64)
    x = np.array([np.frombuffer(b, np.float32) for b in got.column("x").to_pylist()], np.float64)
    # The rows' order depends on the files; the fit must not.
    order = np.lexsort(x.T) if len(y) else np.zeros(0, np.int64)
    width = 4 * DIMS + 4
    return Classifier(vectors, fit(x[order].reshape(-1, width), y[order]))


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out_fold(id_col, 5).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    scored = train(rows, marks).score(rows)
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns, in one pass over the texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out_fold("doc_id", 5).alias("held_out"), F.col("text").cast("string").alias("text"))
    model = train(rows, labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, *parts in _pieces(batch.column(at)):
                p = model.network.probabilities(pooled(*parts, model.vectors).astype(np.float32).astype(np.float64))
                yield batch.slice(first, end - first).filter(pa.array(p >= threshold))

    return docs.mapInArrow(kernel.lean(run), docs.schema)
