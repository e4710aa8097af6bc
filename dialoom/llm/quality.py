"""Quality classifier: a factorisation machine over hashed words and structure statistics.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]):
all pairwise interactions in time linear in the words, by the sum-of-squares
identity. The features of a text are its hashed words (square roots of their
shares), and statistics of its structure and length in bands. Nothing but the
text enters a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import id_crc_mod, slices, text_bytes

WORD_BITS = 14
WORDS = 1 << WORD_BITS
#: Structure statistics, each a share or a logarithm in 0..1, in 16 bands.
STATS = ("length", "mean_word", "upper", "letters", "digits", "symbols", "spaces", "lines", "distinct", "top_word", "repeated_pairs", "high_bytes", "long_words", "stops")
BANDS = 16
FEATURES = WORDS + BANDS * len(STATS)
FACTORS = 8
#: Labelled rows that a model is fitted on at most, chosen by the hash of their ids.
SAMPLE_ROWS = 8000
THRESHOLD = 0.3

_KINDS = np.zeros(256, dtype=np.uint8)
for _lo, _hi, _k in ((65, 90, 1), (97, 122, 2), (48, 57, 3), (128, 255, 6)):
    _KINDS[_lo : _hi + 1] = _k
_KINDS[[32, 9, 11, 12, 13]] = 4
_KINDS[10] = 5
_STOPS = b".,;:"


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's features; an empty text has its bands alone."""
    words = text.lower().split()
    n, size = len(words), len(text)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    full, repeats = np.unique(hashed, return_counts=True)
    bucket, where = np.unique((full >> np.uint64(64 - WORD_BITS)).astype(np.int64), return_inverse=True)
    share = np.sqrt(np.bincount(where, repeats, len(bucket)) / max(1, n)) if n else np.zeros(0)
    kinds = np.bincount(_KINDS[np.frombuffer(text, np.uint8)], minlength=7) / max(1, size)
    pairs = hashed[1:] * np.uint64(0x9E3779B97F4A7C15) ^ hashed[:-1]
    stops = sum(map(text.count, (b".", b",", b";", b":")))
    stats = (
        np.log2(size + 1) / 20,
        (size / max(1, n)) / 24,
        kinds[1] * 1.5,
        kinds[2] + kinds[1] + kinds[6],
        kinds[3] * 4,
        (kinds[0] - stops / max(1, size)) * 4,
        kinds[4] * 3,
        np.log2(1 + 1000 * kinds[5]) / 8,
        len(full) / max(1, n),
        (repeats.max() if n else 0) / max(1, n) * 2,
        1 - len(np.unique(pairs)) / max(1, n - 1) if n > 1 else 0,
        kinds[6] * 3,
        sum(len(w) > 16 for w in words) / max(1, n) * 4,
        stops / max(1, n) * 2,
    )
    bands = np.clip((np.array(stats) * BANDS).astype(np.int64), 0, BANDS - 1) + WORDS + BANDS * np.arange(len(STATS))
    return np.concatenate([bucket, bands]), np.concatenate([share, np.full(len(STATS), 0.5)]).astype(np.float32)


class Model:
    """Weights of a factorisation machine; about 600 kB whatever the corpus."""

    def __init__(self, bias: float, linear: np.ndarray, factors: np.ndarray):
        self.bias, self.linear, self.factors = bias, linear, factors

    def margin(self, index: np.ndarray, value: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Margins of rows whose features lie one after another from ``start`` on."""
        vx = self.factors[index] * value[:, None]
        crossed = np.add.reduceat(vx, start) ** 2 - np.add.reduceat(vx * vx, start)
        return self.bias + np.add.reduceat(self.linear[index] * value, start) + 0.5 * crossed.sum(axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[tuple[bytes, int]], steps: int = 1200, rate: float = 0.02, decay: float = 1e-4, batch: int = 64, seed: int = 7) -> Model:
    """Logistic loss by at least ``steps`` steps of Adam over (text, label); without both labels the score is their share."""
    rng = np.random.default_rng(seed)
    label = np.array([y for _, y in rows], dtype=np.float32)
    share = (label.sum() + 1) / (len(label) + 2)
    model = Model(float(np.log(share / (1 - share))), np.zeros(FEATURES, np.float32), rng.normal(0, 0.02, (FEATURES, FACTORS)).astype(np.float32))
    if not len(rows) or label.min() == label.max():
        model.factors[:] = 0
        return model
    made = [features(text) for text, _ in rows]
    wide = FACTORS + 1
    weights = np.concatenate([model.linear[:, None], model.factors], axis=1)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    step, bias_first, bias_second = 0, 0.0, 0.0
    epochs = -(-steps // -(-len(rows) // batch))
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        pace = rate * (1 - epoch / epochs)
        for at in range(0, len(order), batch):
            own = [made[i] for i in order[at : at + batch]]
            y = label[order[at : at + batch]]
            sizes = np.array([len(i) for i, _ in own])
            start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            index, value = (np.concatenate(x) for x in zip(*own))
            model.linear, model.factors = weights[:, 0], weights[:, 1:]
            vx = weights[index, 1:] * value[:, None]
            total = np.add.reduceat(vx, start)
            margin = model.bias + np.add.reduceat(weights[index, 0] * value, start) + 0.5 * (total**2 - np.add.reduceat(vx * vx, start)).sum(axis=1)
            error = ((_sigmoid(margin) - y) / len(y)).astype(np.float32)
            spread = np.repeat(error, sizes) * value
            grad = np.empty((len(index), wide), np.float32)
            grad[:, 0] = spread
            grad[:, 1:] = spread[:, None] * (np.repeat(total, sizes, axis=0) - vx)
            touched, where = np.unique(index, return_inverse=True)
            g = np.stack([np.bincount(where, grad[:, k], len(touched)) for k in range(wide)], axis=1) + decay * weights[touched]
            step += 1
            first[touched] = 0.9 * first[touched] + 0.1 * g
            second[touched] = 0.999 * second[touched] + 0.001 * g * g
            weights[touched] -= pace * (first[touched] / (1 - 0.9**step)) / (np.sqrt(second[touched] / (1 - 0.999**step)) + 1e-8)
            b = float(error.sum())
            bias_first, bias_second = 0.9 * bias_first + 0.1 * b, 0.999 * bias_second + 0.001 * b * b
            model.bias -= pace * (bias_first / (1 - 0.9**step)) / (np.sqrt(bias_second / (1 - 0.999**step)) + 1e-8)
    model.linear, model.factors = np.ascontiguousarray(weights[:, 0]), np.ascontiguousarray(weights[:, 1:])
    return model


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, quality) of at most ``sample_rows`` labelled texts outside the held-out fold, by the hash of their ids; in order of id, in one partition."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (id_crc_mod(F.col("doc_id"), 5) != 0))
    chosen = known.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("label_id"), "label_id").limit(sample_rows)
    size = docs.select("doc_id", text_bytes("text").alias("text"))
    found = size.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))  # the sample's bound is the broadcast's
    once = found.groupBy("doc_id").agg(F.max(F.struct("text", "quality")).alias("x"))  # at most sample_rows rows
    return once.repartition(1).sortWithinPartitions("doc_id").select("x.text", F.col("x.quality").cast("int").alias("quality"))


def fitted(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model of the sampled rows, fitted in a task: the driver gets its weights, never a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[bytes, int]] = []
        for batch in batches:
            rows += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        if rows:
            model = fit(rows)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (model.bias, model.linear.tobytes(), model.factors.tobytes())], names=["bias", "linear", "factors"])

    found = training_rows(docs, labels, sample_rows).mapInArrow(run, "bias double, linear binary, factors binary").first()
    if found is None:
        return fit([])
    return Model(found["bias"], np.frombuffer(found["linear"], np.float32), np.frombuffer(found["factors"], np.float32).reshape(FEATURES, FACTORS))


def score_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Score every text: doc_id, held_out, score in 0..1 and predicted.

    Needs ``doc_id`` and ``text`` of the documents and ``doc_id`` and
    ``quality`` of the labels; other columns are never read. Null texts are
    empty ones and get a score as well; null ids count as the empty id for
    the fold; repeated rows get equal scores; without any labels every score is
    one half. A document labelled twice counts with its higher label.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, sample_rows))
    return score_with(docs, model)


def _scores(model: Model, texts: list[bytes]) -> list[float]:
    scores: list[float] = []
    for at in range(0, len(texts), 64):
        made = [features(t) for t in texts[at : at + 64]]
        index, value = (np.concatenate(x) for x in zip(*made))
        start = np.concatenate([[0], np.cumsum([len(i) for i, _ in made])[:-1]])
        scores += _sigmoid(model.margin(index, value, start).astype(np.float64)).tolist()
    return scores


def score_with(docs: DataFrame, model) -> DataFrame:
    """Scores under a broadcast model."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            scores = _scores(model.value, texts)
            held = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0 for i in ids]
            predicted = pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(scores, pa.float64()), predicted], names=["doc_id", "held_out", "score", "predicted"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes("text").alias("text"))
    return chosen.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts to be good, with all their columns; decided in place, without a shuffle.

    Each row is judged by its own text, whatever its id; null texts are empty ones and are scored as such; repeated
    rows go or stay together; columns of any name are passed through; an empty table stays so; without labels all rows stay.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, sample_rows))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = _scores(model.value, batch.column(at).cast(pa.binary()).fill_null(b"").to_pylist())
            yield batch.filter(pa.array([s >= THRESHOLD for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
