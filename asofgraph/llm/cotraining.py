"""Quality classification by co-training.

One view is the text itself: byte frequencies, repetition of words and of 5-word shingles, lengths.
The other is the page's metadata: source, declared language, declared length. A logistic regression
for each learns from the labelled rows; over rounds each names the pool documents it is sure of,
by calibrated probability, and the other learns from those. In the end both are calibrated on
labelled rows kept out of training, and a last regression over the two calibrated views scores
every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofgraph.llm.common import pieces, read_table, small_batches
from asofgraph.llm.shingles import shingle_sets, text_bytes, words

#: Bounds of what the fit gathers: labelled rows, and documents that pseudo-labels may come from.
LABELLED = 6000
POOL = 4000
ROUNDS = 5
#: A view is sure from this calibrated probability on (or below 1 - it), of at most this share of the pool a round.
SURE = 0.95
ROUND_SHARE = 0.1
PSEUDO_WEIGHT = 0.3
SOURCE_SLOTS, LANG_SLOTS, LENGTH_SLOTS = 64, 32, 16
TEXT_WIDTH = 256 + 5
META_WIDTH = SOURCE_SLOTS + LANG_SLOTS + LENGTH_SLOTS
THRESHOLD = 0.5


def text_view(text: pa.Array) -> np.ndarray:
    """One row of TEXT_WIDTH floats a text; null and empty texts are all zero."""
    data, at = text_bytes(text)
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    out = np.zeros((len(n), TEXT_WIDTH), np.float32)
    out[:, :256] = np.sqrt(np.bincount(row * 256 + data, minlength=256 * len(n)).reshape(len(n), 256) / np.maximum(n, 1)[:, None])
    word, word_at = words(data, at)
    count = np.diff(word_at)
    owner = np.repeat(np.arange(len(n)), count)
    same = np.bincount(owner[1:][(word[1:] == word[:-1]) & (owner[1:] == owner[:-1])], minlength=len(n)) if len(word) else np.zeros(len(n))
    for a, b in zip(word_at[:-1].tolist(), word_at[1:].tolist(), strict=True):
        word[a:b].sort()
    new = np.bincount(owner[1:][(word[1:] != word[:-1]) | (owner[1:] != owner[:-1])], minlength=len(n)) if len(word) else np.zeros(len(n))
    if len(word):
        new[owner[0]] += 1
    _, shingle_at = shingle_sets(text)
    least = np.maximum(count, 1)
    out[:, 256] = new / least
    out[:, 257] = np.diff(shingle_at) / np.maximum(count - 4, 1)
    out[:, 258] = same / least
    out[:, 259] = np.log1p(count) / 10
    out[:, 260] = n / least / 20
    out[n == 0] = 0
    return out


def meta_view(slots: np.ndarray) -> np.ndarray:
    """One-hot rows of three slots each."""
    out = np.zeros((len(slots), META_WIDTH), np.float32)
    out[np.arange(len(slots))[:, None], slots] = 1
    return out


def meta_slots() -> F.Column:
    """array<int>: a place for the source, the language and the length; null is a value of its own."""
    slot = lambda c, n, base: (F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0"))), F.lit(n)) + base).cast("int")
    length = F.least(F.lit(LENGTH_SLOTS - 1), F.coalesce(F.floor(F.log2(F.greatest(F.col("n_chars"), F.lit(0)) + 1)) - 2, F.lit(0)))
    return F.array(slot("source", SOURCE_SLOTS, 0), slot("lang", LANG_SLOTS, SOURCE_SLOTS), (F.greatest(length, F.lit(0)) + SOURCE_SLOTS + LANG_SLOTS).cast("int"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Coefficients and intercept by Newton's method; ``y`` from 0 to 1."""
    z = np.column_stack((x, np.ones(len(x)))).astype(np.float64)
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    beta = np.zeros(z.shape[1])
    for _ in range(25):
        p = sigmoid(z @ beta)
        slope = z.T @ (weight * (p - y)) + penalty * beta
        bend = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        beta -= step
        if np.abs(step).max() < 1e-7:
            break
    return beta


def applied(beta: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x.astype(np.float64) @ beta[:-1] + beta[-1]


@dataclass(frozen=True)
class Model:
    text: np.ndarray
    text_scale: tuple[np.ndarray, np.ndarray]
    meta: np.ndarray
    calibration: tuple[np.ndarray, np.ndarray]
    combination: np.ndarray

    def views(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Calibrated log-odds of the two views."""
        raw = applied(self.text, (text - self.text_scale[0]) / self.text_scale[1]), applied(self.meta, meta)
        return np.column_stack([applied(c, r[:, None]) for c, r in zip(self.calibration, raw, strict=True)])

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(combined, text alone, metadata alone), each a probability of good quality."""
        views = np.clip(self.views(text, meta), -30, 30)
        return sigmoid(applied(self.combination, views)), sigmoid(views[:, 0]), sigmoid(views[:, 1])


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Every fourth labelled row is kept for calibration; rows come in a fixed order."""
    kept = np.arange(len(y)) % 4 == 3
    if not kept.any() or len(np.unique(y[kept])) < 2 or len(np.unique(y[~kept])) < 2:
        kept = np.zeros(len(y), bool)
    check = kept if kept.any() else ~kept
    scale = text[~kept].mean(0), text[~kept].std(0) + 1e-3
    own = [(text[~kept] - scale[0]) / scale[1], meta[~kept]]
    held = [(text[check] - scale[0]) / scale[1], meta[check]]
    pool = [(pool_text - scale[0]) / scale[1], pool_meta]
    given = [(np.empty(0, np.int64), np.empty(0)), (np.empty(0, np.int64), np.empty(0))]  # pseudo-labels that each view has got
    ridge, beta, calibration = (3.0, 3.0), [None, None], [None, None]
    for turn in range(rounds + 1):
        for v in (0, 1):
            place, label = given[v]
            x = np.concatenate((own[v], pool[v][place]))
            target = np.concatenate((y[~kept], label))
            beta[v] = logistic(x, target, np.concatenate((np.ones((~kept).sum()), np.full(len(place), PSEUDO_WEIGHT))), ridge[v])
            calibration[v] = logistic(applied(beta[v], held[v])[:, None], y[check], np.ones(check.sum()), 1e-2)
        if turn == rounds or not len(pool_text):
            break
        for v in (0, 1):
            p = sigmoid(applied(calibration[v], applied(beta[v], pool[v])[:, None]))
            sure = np.flatnonzero((p >= SURE) | (p <= 1 - SURE))
            fresh = np.setdiff1d(sure, given[1 - v][0])
            fresh = fresh[np.lexsort((fresh, -np.abs(p[fresh] - 0.5)))][:int(ROUND_SHARE * len(p))]
            given[1 - v] = np.concatenate((given[1 - v][0], fresh)), np.concatenate((given[1 - v][1], (p[fresh] >= 0.5).astype(float)))
    views = np.column_stack([applied(calibration[v], applied(beta[v], held[v])[:, None]) for v in (0, 1)])
    return Model(beta[0], scale, beta[1], tuple(calibration), logistic(np.clip(views, -30, 30), y[check], np.ones(check.sum()), 1e-2))


def _view_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        views = text_view(batch["text"])
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["quality"], batch["slots"], pa.array([v.tobytes() for v in views], pa.binary())], names=["doc_id", "quality", "slots", "view"])


def prepared(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", meta_slots().alias("slots"))


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> Model | None:
    """A model from at most ``labelled`` labels and about ``pool`` other documents, drawn by doc_id.

    Several labels of a document count by their mean, rounded up from a half; null labels and
    labels without a document don't count. Of several rows of a doc_id one counts, so a doc_id with very
    many rows brings no more to the driver than another. None if fewer than two classes are left.
    """
    mean = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("quality"))
    chosen = mean.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(labelled)
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in chosen.collect()], "doc_id long, quality double")
    share = min(1.0, pool / max(1, docs.count()))
    draw = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rows = prepared(docs).join(F.broadcast(chosen), "doc_id", "left").filter(F.col("quality").isNotNull() | (draw < share))
    found = rows.select("doc_id", "quality", "slots", "text").mapInArrow(_view_rows, "doc_id long, quality double, slots array<int>, view binary")
    found = found.groupBy("doc_id", "quality").agg(F.min(F.struct("view", "slots")).alias("first")).select("doc_id", "quality", "first.*").collect()
    found.sort(key=lambda r: (r.doc_id is None, r.doc_id))
    named, other = [r for r in found if r.quality is not None], [r for r in found if r.quality is None][:2 * pool]
    views = lambda rs: np.frombuffer(b"".join(bytes(r.view) for r in rs), np.float32).reshape(len(rs), TEXT_WIDTH)
    metas = lambda rs: meta_view(np.array([r.slots for r in rs], np.int64).reshape(len(rs), 3))
    y = np.array([r.quality for r in named])
    if len(np.unique(y)) < 2:
        return None
    return co_train(views(named), metas(named), y, views(other), metas(other))


def _score(model: Model | None, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    if model is None:
        return tuple(np.full(batch.num_rows, 0.5) for _ in range(3))
    slots = batch["slots"].flatten().to_numpy(zero_copy_only=False).reshape(-1, 3).astype(np.int64)
    return model.scores(text_view(batch["text"]), meta_view(slots))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, text_score, page_score, keep for every row of ``docs``.

    Scores are probabilities of good quality from 0 to 1, combined and by view; keep means a score
    of THRESHOLD or more. Without a model all are 0.5. Null texts, sources, languages and lengths
    are values of their own. Repeated rows stay. Other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = _score(model, batch)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, found), pa.array(found[0] >= THRESHOLD)], names=["doc_id", "score", "text_score", "page_score", "keep"])
    return prepared(docs).mapInArrow(run, "doc_id long, score double, text_score double, page_score double, keep boolean")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, train(docs, read_table(spark, sf_dir, "labels")))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score THRESHOLD or more."""
    model, names = train(docs, labels), docs.columns
    slots = next(n for n in (f"slots{'_' * k}" for k in range(len(names) + 1)) if n not in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            views = pa.RecordBatch.from_arrays([batch["text"], batch[slots]], names=["text", "slots"])
            yield batch.filter(pa.array(_score(model, views)[0] >= THRESHOLD)).select(names)
    return docs.withColumn(slots, meta_slots()).mapInArrow(run, docs.schema)
