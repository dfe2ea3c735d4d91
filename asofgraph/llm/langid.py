"""Language identification by a blended-spectrum string kernel.

A text's spectrum is the set of all its letter n-grams of 1 to 3 bytes (lower-cased UTF-8, anything
but letters one blank), hashed to ``DIMENSIONS`` places. The kernel of two texts is the cosine of
their presence vectors. Nyström: kernels with a few landmark texts stand for the whole kernel
matrix. One ridge regression for each language is fitted on them, and every text is scored by two
matrix products a batch: presence by landmarks, kernels by coefficients.

The regressions share one design and an intercept, so their outputs sum to a constant and the best of few
languages is never low: a score says which language, not whether any. That is told by the share of a
text's n-grams that no fitted text has, against that share in the fitted texts themselves, each left out
in turn. All languages count together, as a text may mix them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofgraph.llm.common import pieces, read_table, small_batches
from asofgraph.llm.shingles import text_bytes

DIMENSIONS = 1 << 13
ORDERS = (1, 2, 3)
#: What the fit gathers: about so many texts over all languages, and landmarks among them. Of each language, however
#: many there are, come at least LEAST_TEXTS texts and LEAST_LANDMARKS landmarks (of 1 KB a text).
SAMPLE = 3000
LANDMARKS = 160
LEAST_TEXTS = 8
LEAST_LANDMARKS = 2
RIDGE = 1e-2
UNKNOWN = "und"
#: Scores below this mean that no language claims the text.
REJECT_BELOW = 0.25
#: Share of unseen n-grams that is always allowed; where fitted texts have more, SLACK times their 99th percentile is.
UNSEEN = 0.1
SLACK = 2.0

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)


def presence(texts: pa.Array) -> np.ndarray:
    """0/1 matrix of rows by hashed n-grams over each whole text."""
    data, at = text_bytes(pc.utf8_lower(texts.fill_null("")))
    out = np.zeros((len(texts), DIMENSIONS), np.uint8)
    if len(data):
        letters = _FOLD[data]
        row = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(at))
        flat, code, shift = out.reshape(-1), np.zeros(len(data), np.uint32), 32 - (DIMENSIONS.bit_length() - 1)
        for order in range(1, max(ORDERS) + 1):
            last = len(data) - order + 1
            if last <= 0:
                break
            code = code[:last] * np.uint32(257) + letters[order - 1:]
            inside = row[:last] == row[order - 1:]
            place = ((code + np.uint32(order)) * np.uint32(2654435761)) >> np.uint32(shift)
            flat[(row[:last] * DIMENSIONS + place)[inside]] = 1
    return out


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    landmarks: np.ndarray  # dimensions x landmarks, each at unit length
    weights: np.ndarray  # landmarks + 1 x languages
    seen: np.ndarray  # dimensions, 1 where a fitted text has the n-gram
    unseen: float  # share of other n-grams allowed

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        x = rows.astype(np.float32)
        return (x @ self.landmarks) / np.sqrt(np.maximum(rows.sum(1, dtype=np.int64), 1))[:, None].astype(np.float32)

    def decide(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the language, score from 0 to 1): the largest regression output, -1 to 1, rescaled."""
        value = self.kernel(rows) @ self.weights[:-1] + self.weights[-1]
        best = value.argmax(1)
        return best, np.clip((value[np.arange(len(best)), best].astype(np.float64) + 1) / 2, 0, 1)


    def claimed(self, rows: np.ndarray) -> np.ndarray:
        """Whether enough of each text's n-grams were seen in fitted texts.

        Beyond the share allowed, as many as chance may add to so few n-grams (two deviations and one):
        texts too short to tell are claimed.
        """
        n = rows.sum(1, dtype=np.int64)
        allowed = self.unseen * n + 2 * np.sqrt(self.unseen * (1 - self.unseen) * n) + 1
        return n - rows.astype(np.float32) @ self.seen <= allowed


def spectrum_of(rows: np.ndarray) -> tuple[np.ndarray, float]:
    """(seen, unseen) of Model. A fitted text's own share counts what no other fitted text has."""
    count = rows.sum(0, dtype=np.int64)
    share = rows.astype(np.float32) @ (count == 1).astype(np.float32) / np.maximum(rows.sum(1, dtype=np.int64), 1)
    return (count > 0).astype(np.float32), min(1.0, max(UNSEEN, SLACK * float(np.quantile(share, 0.99))))


def fit(rows: np.ndarray, langs: list[str]) -> Model:
    """``rows`` in a fixed order: landmarks are taken from the languages in turn."""
    names, y = np.unique(langs, return_inverse=True)
    turn = np.zeros(len(y), np.int64)
    for k in range(len(names)):
        turn[y == k] = np.arange((y == k).sum())
    chosen = np.lexsort((y, turn))[:max(LANDMARKS, LEAST_LANDMARKS * len(names))]
    unit = rows.astype(np.float32) / np.sqrt(np.maximum(rows.sum(1, dtype=np.int64), 1))[:, None].astype(np.float32)
    landmarks = np.ascontiguousarray(unit[chosen].T)
    spectrum = spectrum_of(rows)
    value, vector = np.linalg.eigh((unit[chosen] @ landmarks).astype(np.float64))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])  # kernels times this: the Nyström features
    z = (unit @ landmarks).astype(np.float64) @ root
    weight = 1 / np.bincount(y)[y]  # every language counts alike
    weight *= len(y) / weight.sum()
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    if len(names) == 1:
        return Model(tuple(names.tolist()), landmarks, np.vstack((np.zeros((len(chosen), 1)), np.ones(1))).astype(np.float32), *spectrum)
    mean, base = np.average(z, 0, weight), np.average(target, 0, weight)
    centred = (z - mean) * weight[:, None]
    inner = np.linalg.solve(centred.T @ (z - mean) + RIDGE * len(y) * np.eye(z.shape[1]) * 0.1, centred.T @ (target - base))
    return Model(tuple(names.tolist()), landmarks, np.vstack((root @ inner, base - mean @ inner)).astype(np.float32), *spectrum)


def _spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        packed = np.packbits(presence(batch["text"]), axis=1)
        yield pa.RecordBatch.from_arrays([batch["draw"], batch["lang"], pa.array([r.tobytes() for r in packed], pa.binary())], names=["draw", "lang", "bits"])


def has_letters(text: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(text, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False).copy()


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of the rows that are not held out and have a language and a letter; None without such rows.

    About ``sample`` rows, evenly over the languages and LEAST_TEXTS of each at least, are gathered as
    bitmaps of DIMENSIONS bits. Whether a row is drawn depends on its doc_id and text; rows equal in
    both and in language count once. Every language that a row has is learned.
    """
    small_batches(docs.sparkSession)
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64(F.lit(11), "doc_id", "text").alias("draw"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return None
    quota = max(LEAST_TEXTS, sample // len(counts))
    share = docs.sparkSession.createDataFrame([(lang, min(1.0, 2 * quota / n)) for lang, n in sorted(counts.items())], "lang string, share double")
    drawn = rows.join(share, "lang").filter((F.pmod("draw", F.lit(1 << 30)) / float(1 << 30) < F.col("share")) & F.col("text").rlike(r"\p{L}"))
    found = drawn.select("draw", "lang", "text").mapInArrow(_spectra, "draw long, lang string, bits binary").groupBy("draw", "lang").agg(F.first("bits").alias("bits")).collect()
    found.sort(key=lambda r: (r.draw, r.lang))
    taken: Counter[str] = Counter()
    kept = []
    for r in found:  # twice the quota was drawn, so that a language of few rows has some
        taken[r.lang] += 1
        if taken[r.lang] <= quota:
            kept.append(r)
    found = kept
    if not found:
        return None
    bits = np.unpackbits(np.frombuffer(b"".join(bytes(r.bits) for r in found), np.uint8).reshape(len(found), -1), axis=1)
    return fit(bits, [r.lang for r in found])


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            letters = has_letters(batch["text"])
            lang, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            if model is not None and letters.any():
                best, found = model.decide(presence(batch["text"].filter(pa.array(letters))))
                lang[letters], score[letters] = np.array(model.languages, object)[best], found
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(lang, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])
    return run


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text).

    ``und`` with score 0 where the text is null or has no letter, and everywhere without a model.
    Ties go to the language first in order. Repeated rows stay; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that a language claims with a score of REJECT_BELOW or more.

    Null and letterless texts go, texts with too many n-grams that no fitted text has, and all without a model.
    """
    model = train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            good = has_letters(batch["text"]) if model is not None else np.zeros(batch.num_rows, bool)
            if good.any():
                rows = presence(batch["text"].filter(pa.array(good)))
                good[good] = (model.decide(rows)[1] >= REJECT_BELOW) & model.claimed(rows)
            yield batch.filter(pa.array(good))
    return docs.mapInArrow(run, docs.schema)
