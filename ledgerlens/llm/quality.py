"""Ordinal quality classifier: a cumulative-link (proportional odds) model on graded ratings.

One weight vector over hashed text features is shared by all grades, ordered thresholds cut its score:
P(grade >= k) = sigmoid(w.x - theta_k). It gives the expected grade, and the tail probability for selection.

Features, each 0 or 1, hashed to 2^BITS places: the distinct words (lower case, ASCII punctuation as white space),
their stems, and shape bands (share of capitals, digits, each ASCII mark, immediate repeats, distinct words, mean word length).

Fitting uses a bounded sample of the labelled rows: about SAMPLE rows, chosen by a hash of the id. Their features are
made in Spark; the bounded matrix is fitted in numpy. Scoring is one pass over whole texts without a shuffle.

Defined cases: a null or empty text has the features of no words. Labels with a null or unknown grade, and labels of
no document, don't train; equal labels count once, repeated documents train as often as they occur (within the bound). With fewer than two grades, the
model gives every text the only (or highest) grade. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import string
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import filtered, sliced

BITS = 18
#: Bytes of a word's beginning that count as its stem.
STEM = 4
SAMPLE = 20_000
#: Features in fewer sampled texts, or whose texts' mean grade lies within SCREEN standard errors of the mean of all,
#: keep weight zero: words that say nothing of the grade must not add up to noise in long texts.
LEAST_TEXTS, SCREEN, EFFECT = 4, 3.0, 0.4
EPOCHS, BATCH, RATE, DECAY = 150, 256, 1.0, 1e-5
_GAPS = bytes(32 if chr(b) in string.punctuation or b < 32 else b for b in range(256))
_MARKS = [m.encode() for m in string.punctuation]
_CAPITALS = bytes(range(65, 91))
_DIGITS = b"0123456789"


def features(text: str | None) -> np.ndarray:
    """Distinct hashed features of a whole text."""
    raw = (text or "").encode()
    words = raw.lower().translate(_GAPS).split()
    plain = raw.split()
    n, letters = max(1, len(plain)), max(1, len(raw))
    distinct = set(words)
    tenth = lambda x: min(20, int(10 * x))
    shape = [f"caps {tenth((letters - len(raw.translate(None, _CAPITALS))) / letters)}",
             f"digits {tenth((letters - len(raw.translate(None, _DIGITS))) / letters)}",
             f"distinct {tenth(len(distinct) / max(1, len(words)))}", f"long {min(20, int(letters / n))}",
             f"repeats {tenth(sum(a == b for a, b in zip(plain, plain[1:])) / n)}"]
    shape += [f"{m.decode()} {tenth(k / n)}" for m in _MARKS if (k := raw.count(m)) * 10 >= n]
    mask = (1 << BITS) - 1
    stems = {w[:STEM] for w in distinct if len(w) > STEM}
    return np.unique(np.array([crc32(w) & mask for w in distinct] + [crc32(w, 2) & mask for w in stems]
                              + [crc32(s.encode(), 1) & mask for s in shape], np.int32))


@dataclass
class Ordinal:
    """Shared weights and ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray = field(default_factory=lambda: np.empty(0))

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ..."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds - self.weights[x].sum(dtype=np.float64), -500, 500)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, seed: int = 0) -> Ordinal:
    """Maximum likelihood by AdaGrad over mini-batches. rows: feature places of each text."""
    size = 1 << BITS
    if len(np.unique(grades)) < 2:
        top = int(grades[0]) if len(grades) else n_grades - 1
        return Ordinal(np.zeros(size, np.float32), np.where(np.arange(1, n_grades) <= top, -30.0, 30.0))
    places, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    texts = np.bincount(places, minlength=size)
    shift = np.bincount(places, (grades - grades.mean())[owner], minlength=size) / grades.std()
    seen = (texts >= LEAST_TEXTS) & (np.abs(shift) >= np.maximum(SCREEN * np.sqrt(texts), EFFECT * texts))
    kept = np.flatnonzero(seen)
    number = np.cumsum(seen) - 1
    rows = [number[r[seen[r]]] for r in rows]
    at_least = np.array([(grades >= k).mean() for k in range(1, n_grades)]).clip(1e-4, 1 - 1e-4)
    w, past = np.zeros(len(kept)), np.full(len(kept), 1e-8)
    theta = np.sort(-np.log(at_least / (1 - at_least)))
    base, gaps = theta[0], np.log(np.diff(theta) + 1e-3)
    past_t = np.full(n_grades - 1, 1e-8)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), BATCH):
            part = order[i: i + BATCH]
            places = np.concatenate([rows[k] for k in part])
            owner = np.repeat(np.arange(len(part)), [len(rows[k]) for k in part])
            eta = np.bincount(owner, w[places], minlength=len(part))
            theta = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
            y = grades[part]
            # F(k) = P(grade < k) for k = 0 .. n_grades, and its slope
            low = np.concatenate([[-np.inf], theta, [np.inf]])
            with np.errstate(over="ignore"):
                f = 1.0 / (1.0 + np.exp(-(low[None, :] - eta[:, None])))
            slope = f * (1 - f)
            rows_at = np.arange(len(part))
            p = np.maximum(f[rows_at, y + 1] - f[rows_at, y], 1e-9)
            up, down = slope[rows_at, y + 1] / p, slope[rows_at, y] / p
            g_eta = up - down  # of -log p
            g_w = np.bincount(places, g_eta[owner], minlength=len(kept)) / len(part) + DECAY * w
            past += g_w ** 2
            w -= RATE * g_w / np.sqrt(past)
            g_theta = np.zeros(n_grades + 1)
            np.add.at(g_theta, y + 1, -up)
            np.add.at(g_theta, y, down)
            g_theta = g_theta[1:-1] / len(part)
            g = np.concatenate([[g_theta.sum()], np.cumsum(g_theta[::-1])[::-1][1:] * np.exp(gaps)])
            past_t += g ** 2
            step = RATE * g / np.sqrt(past_t)
            base, gaps = base - step[0], np.clip(gaps - step[1:], -6, 4)
    theta = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
    weights = np.zeros(size, np.float32)
    weights[kept] = w
    return Ordinal(weights, theta)


def fit(docs: DataFrame, labels: DataFrame, grade: Column, n_grades: int, id_col: str = "doc_id", text_col: str = "text",
        sample: int = SAMPLE) -> Ordinal:
    """The model of a bounded sample of the labelled rows. grade: a column over labels, 0 .. n_grades - 1."""
    graded = labels.select(F.col(id_col).alias("id"), grade.cast("int").alias("grade")).where(
        F.col("id").isNotNull() & F.col("grade").between(0, n_grades - 1)).distinct()
    total = graded.count()
    if total > sample:
        graded = graded.where(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1_000_000)) < int(1_000_000 * sample / total))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in sliced(batches):
            x = [features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(x, pa.list_(pa.int32()))], names=["grade", "x"])

    # the sample is bounded by its parameter, so it may be broadcast; ids that repeat in docs mustn't break the bound
    met = rows.join(F.broadcast(graded), "id")
    n = met.count()
    if n > 2 * sample:
        met = met.where(F.rand(3) < sample / n)
    got = met.select("text", "grade").mapInArrow(run, "grade int, x array<int>").toArrow()
    lists = got.column("x").combine_chunks()
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    return fit_ordinal([values[i:j] for i, j in zip(ends[:-1], ends[1:])], got.column("grade").to_numpy(), n_grades)


def predict(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, expected_grade, tails): tails[k - 1] = P(grade >= k)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in sliced(batches):
            tails = [shared.value.tails(features(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([float(t.sum()) for t in tails], pa.float64()), pa.array(tails, pa.list_(pa.float64()))],
                names=["id", "expected_grade", "tails"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, expected_grade double, tails array<double>")


def select(docs: DataFrame, model: Ordinal, grade: int, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, with P(grade or more) at `least` or over."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filtered(docs, text_col, lambda t: shared.value.tails(features(t))[grade - 1] >= least)
