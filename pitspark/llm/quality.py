"""Quality rules: exact counts per text, and a logistic regression over hashed word and character n-grams.

The regression is fitted on a bounded sample of labelled rows (``max_rows``): their features are written once, every
step sums the slope over them in Spark, and the driver holds the weights alone. Its margin is
turned into a probability on rows held back from the fit, and all texts are scored in Arrow batches
against a fixed threshold. Texts stay where they are read; nothing is shuffled but the labels of the sample and the parts of a slope.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fitting import Slices
from .shared import written
from .textbytes import BASES, SPACE, Slice, mix, slices

#: Probability of label 1 from which a document is kept.
THRESHOLD = 0.5
#: Labelled rows the regression learns from, chosen by the hash of their id.
MAX_ROWS = 4_000
BUCKETS = 1 << 16
SCALE = 30.0

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def rule_counts(s: Slice) -> dict[str, np.ndarray]:
    """The exact counts of every text of a slice."""
    start, end, of = s.words
    n_words = np.bincount(of, minlength=s.count)
    counts = {"n_words": n_words, "word_chars": s.per_text(~SPACE[s.data] & (s.data & 0xC0 != 0x80)), "n_symbols": s.per_text(SYMBOL[s.data])}

    # lines: every newline of the slice ends one, the newline after each text too
    line_end = np.flatnonzero(s.data == 10)
    line_start = np.concatenate(([0], line_end[:-1] + 1))[: len(line_end)]
    line_of = np.searchsorted(s.end, line_start, side="left")
    has_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    key = s.hash.of(line_start, line_end)[has_word] ^ mix(line_of[has_word].astype(np.uint64))
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    counts["n_dup_lines"] = np.bincount(line_of[has_word][~first], minlength=s.count)

    repeated = np.zeros(len(start), bool)
    if len(start) >= 3:
        h, inside = s.word_hash, np.flatnonzero(of[:-2] == of[2:])  # a window never reaches into the next text
        window = (mix(mix(h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(3) + h[2:]) ^ mix(of[:-2].astype(np.uint64)))[inside]
        _, back, times = np.unique(window, return_inverse=True, return_counts=True)
        again = inside[times[back] > 1]
        for shift in range(3):
            repeated[again + shift] = True
    counts["n_repeat_words"] = np.bincount(of[repeated], minlength=s.count)
    return counts


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def grams(s: Slice) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per family of n-grams (words, word pairs, four characters): hash buckets and the text of each occurrence."""
    _, _, of = s.words
    h = s.word_hash
    mask = np.uint64(BUCKETS - 1)
    out = [((h & mask).astype(np.int64), of)]
    pair = of[:-1] == of[1:]
    out.append(((mix(h[:-1] * np.uint64(3) + h[1:])[pair] & mask).astype(np.int64) + BUCKETS, of[:-1][pair]))
    place = np.flatnonzero(s.data & 0xC0 != 0x80)  # where the characters begin
    if len(place) >= 4:
        width = np.diff(place, append=len(s.data))
        char = s.data[place].astype(np.uint64)
        for k in range(1, 4):
            more = width > k
            char[more] |= s.data[place[more] + k].astype(np.uint64) << np.uint64(8 * k)
        four = char[:-3]
        for k in range(1, 4):
            four = four * np.uint64(BASES[0]) + char[k: len(char) - 3 + k]
        text = np.searchsorted(s.end, place[:-3], side="left")
        inside = place[3:] < s.end[text]
        out.append(((mix(four) & mask).astype(np.int64)[inside] + 2 * BUCKETS, text[inside]))
    return out


@dataclass
class QualityModel:
    """``weights`` per bucket, each family averaged over its occurrences; ``slope`` and ``shift`` calibrate the margin."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, s: Slice) -> np.ndarray:
        total = np.full(s.count, self.bias)
        for bucket, text in grams(s):
            n = np.bincount(text, minlength=s.count)
            total += SCALE * np.bincount(text, self.weights[bucket], minlength=s.count) / np.maximum(n, 1)
        return total

    def probability(self, s: Slice) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(s) + self.shift, -50, 50)))


#: Cells of a slice of the training set: a text's label and whether it is held back; text, bucket and averaged value of every feature.
CELLS = ["label", "held", "row", "bucket", "value"]


def _sparse(s: Slice, labels: np.ndarray, held: np.ndarray) -> tuple[bytes, ...]:
    rows, buckets, values = [], [], []
    for bucket, text in grams(s):
        n = np.bincount(text, minlength=s.count)
        key, times = np.unique(text * (3 * BUCKETS) + bucket, return_counts=True)
        row = key // (3 * BUCKETS)
        rows.append(row.astype(np.int32))
        buckets.append((key % (3 * BUCKETS)).astype(np.int32))
        values.append((SCALE * times / n[row]).astype(np.float32))
    return tuple(x.tobytes() for x in (labels.astype(np.int8), held.astype(bool), np.concatenate(rows), np.concatenate(buckets), np.concatenate(values)))


def _read(label: bytes, held: bytes, row: bytes, bucket: bytes, value: bytes) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(x, t) for x, t in ((label, np.int8), (held, bool), (row, np.int32), (bucket, np.int32), (value, np.float32)))


def _tally(_):
    """Rows by label and whether they are held back."""
    def one(*cells: bytes) -> np.ndarray:
        y, held = _read(*cells)[:2]
        return np.bincount((y > 0) + 2 * held, minlength=4).astype(float)
    return one


def _slope(state):
    """The slope of the loss: by weight, by bias."""
    weights, bias, share, hold = state

    def one(*cells: bytes) -> np.ndarray:
        y, held, row, bucket, value = _read(*cells)
        z = np.bincount(row, value * weights[bucket], minlength=len(y)) + bias
        gap = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - (y > 0)) * share[(y > 0).astype(int)]
        gap[held & hold] = 0
        return np.append(np.bincount(bucket, value * gap[row], minlength=len(weights)), gap.sum())
    return one


def _margins(state):
    weights, bias = state

    def one(*cells: bytes) -> tuple[bytes, ...]:
        y, held, row, bucket, value = _read(*cells)
        return (np.bincount(row, value * weights[bucket], minlength=len(y)) + bias).tobytes(), cells[0], cells[1]
    return one


def fit(texts: list[str], labels: np.ndarray, epochs: int = 60, rate: float = 0.05, decay: float = 1e-6) -> QualityModel:
    """The model of a list of texts; one row in five is held back for the calibration."""
    y, parts = np.asarray(labels, np.float64), []
    for s in slices(pa.array(texts, pa.large_string())):
        at = np.arange(s.first, s.first + s.count)
        parts.append(_sparse(s, y[at] > 0, at % 5 == 4))
    return fit_slices(Slices(parts), epochs, rate, decay)


def fit_slices(rows: Slices, epochs: int = 60, rate: float = 0.05, decay: float = 1e-6) -> QualityModel:
    """Full-batch Adam on the rows that are not held back, then Platt's scaling on those that are.

    Without rows of both labels nothing can be learnt, and the model gives every text the share of label 1
    (1 without any row).
    """
    weights, bias = np.zeros(3 * BUCKETS), 0.0
    n = rows.total(_tally, None, 4)
    bad, good = n[0] + n[2], n[1] + n[3]
    if not (bad and good):
        return QualityModel(weights, 0.0, 1.0, -50.0 if bad else 50.0)
    hold = bool(n.all())
    share = np.array([0.5 / n[0], 0.5 / n[1]]) if hold else np.array([0.5 / bad, 0.5 / good])
    m, v, mb, vb = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0
    for step in range(1, epochs + 1):
        slope = rows.total(_slope, (weights, bias, share, hold), len(weights) + 1)
        slope, bias_slope = slope[:-1] + decay * weights, slope[-1]
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        mb, vb = 0.9 * mb + 0.1 * bias_slope, 0.99 * vb + 0.01 * bias_slope**2
        weights = weights - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
        bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-10)
    # a number a row, and the rows are bounded
    found = rows.map(_margins, (weights, bias), ["z", "label", "held"]).rows
    found = found if isinstance(found, list) else [tuple(r) for r in found.collect()]
    z, y, held = (np.frombuffer(b"".join(bytes(r[i]) for r in found), t) for i, t in enumerate((np.float64, np.int8, bool)))
    order = np.lexsort((y, z))  # the slices come in any order
    order = order[held[order]] if hold else order
    return QualityModel(weights, bias, *_platt(z[order], y[order].astype(np.float64)))


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the calibrated margin by Newton's method, with Platt's softened targets."""
    target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y <= 0).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        grad = np.array([((p - target) * z).sum(), (p - target).sum()])
        hess = np.array([[(w * z * z).sum() + 1e-6, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(max(a, 1e-3)), float(b)


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fit on at most ``max_rows`` labelled documents, those with the smallest hash of their id; rows without label or text are left out.

    The features stay in the executors; the driver holds one number a feature. Of repeated ids every row is used.
    """
    wanted = labels.where("quality IS NOT NULL").select(F.col(id_col), F.col("quality").cast("int").alias("quality"))
    wanted = wanted.withColumn("_h", F.xxhash64(F.col(id_col))).orderBy("_h", id_col, "quality").limit(max_rows)
    rows = documents.select(id_col, F.col(text_col).alias("text")).where("text IS NOT NULL").join(F.broadcast(wanted), id_col)
    rows = rows.select("text", "quality", (F.pmod(F.xxhash64(F.col(id_col), F.lit("held")), F.lit(5)) == 4).alias("held"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, held = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for s in slices(batch.column(0)):
                at = slice(s.first, s.first + s.count)
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in _sparse(s, y[at] > 0, held[at])], names=CELLS)

    return fit_slices(Slices(written(rows.mapInArrow(features, ", ".join(f"{c} binary" for c in CELLS)))))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score(df: DataFrame, model: QualityModel, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with the counts, ``base_failed``, ``probability`` and ``kept`` of every row.

    A null or empty text has zero words and fails the base rules. Repeated rows and null ids stay. A kept
    column with the name of a result is replaced by the result.
    """
    results = [*((n, T.LongType()) for n in COUNTS), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("probability", T.DoubleType())]
    names = [n for n in keep if n not in dict(results)]
    schema = T.StructType([df.schema[n] for n in names] + [T.StructField(n, t) for n, t in results])
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = names.index(text_col) if text_col in names else len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(at)):
                counts = rule_counts(s)
                failed, p = base_failed(counts), shared.value.probability(s)
                columns = [*(pa.array(counts[n].astype(np.int64)) for n in COUNTS), pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)]
                rows = [batch.column(i).slice(s.first, s.count) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*rows, *columns], names=schema.names)

    return df.select(*names, *([] if text_col in names else [F.col(text_col).alias("_text")])).mapInArrow(run, schema)
