"""Toxicity by a small convolutional text classifier over hashed word embeddings.

A word is hashed to a bucket, and so are its first ``STEM`` bytes; a word's embedding is the sum of both
buckets' embeddings. Filters of several widths run over the embeddings of a text, and each filter's largest value
over the whole text goes to one logistic output. All of it is trained
on every labelled row, whose word buckets are written once and summed over in Spark in every step, and scored in Arrow batches. For scoring, a filter is folded into
one table per place of its window (bucket -> contribution), so a text costs a few look-ups a word.

The first component of an embedding starts as the bucket's shrunken log odds of occurring in toxic and clean
training texts; the filters and the other components start small, and all are then trained together.

The score reads the text alone. ``flagged`` compares it with a threshold per language, calibrated on labelled
rows that were kept out of the fit.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fitting import Slices
from .shared import held_out, written
from .textbytes import Slice, mix, slices

BUCKETS = 1 << 16
STEM = 5
DIM = 6
WIDTHS = (1, 2, 3)
FILTERS = 4
EPOCHS = 12
#: Prior occurrences that shrink the log odds of a bucket.
SHRINK = 4.0
#: Labels that are broadcast at once.
BROADCAST_LABELS = 1_000_000


@dataclass
class Model:
    """``embedding`` (buckets of words, then of stems) x DIM; ``filters[w]`` w x DIM x FILTERS; ``shift[w]``; ``output`` over all filters; ``bias``; ``scale`` and ``offset`` calibrate."""

    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    shift: dict[int, np.ndarray]
    output: np.ndarray
    bias: float = 0.0
    scale: float = 1.0
    offset: float = 0.0
    thresholds: dict[str | None, float] = field(default_factory=dict)

    def tables(self) -> dict[int, list[np.ndarray]]:
        return {w: [(self.embedding @ f[i]).astype(np.float32) for i in range(w)] for w, f in self.filters.items()}

    def margin(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.output + self.bias

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margin(pooled) + self.offset, -40, 40)))


def buckets(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word of a slice and of its stem, punctuation at its ends left off, and its text."""
    start, end, of = s.words
    letter = LETTER[s.data]
    n = len(s.data)
    # first letter at or after each position, last letter before it
    after = np.minimum.accumulate(np.where(letter, np.arange(n), n)[::-1])[::-1]
    before = np.maximum.accumulate(np.where(letter, np.arange(n) + 1, 0))
    first, last = np.minimum(after[start], end), np.maximum(before[end - 1], start)
    bare = first >= last
    first, last = np.where(bare, start, first), np.where(bare, end, last)
    both = [s.hash.of(first, end) % np.uint64(BUCKETS) for end in (last, np.minimum(first + STEM, last))]
    return np.stack(both, 1).astype(np.int64) + [0, BUCKETS], of


LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def pooled(bucket: np.ndarray, text: np.ndarray, count: int, tables: dict[int, list[np.ndarray]], shift: dict[int, np.ndarray], where: bool = False):
    """Largest value of every filter over every text, at least 0, and, with ``where``, the word at which it starts (-1: none above 0).

    A window that reaches past the end of its text counts the words it has.
    """
    out, places = [], []
    n = len(bucket)
    first = np.searchsorted(text, np.arange(count))
    some = np.flatnonzero(np.diff(np.append(first, n)))
    for w, parts in tables.items():
        value = parts[0][bucket[:, 0]] + parts[0][bucket[:, 1]] + shift[w]
        for i in range(1, w):
            inside = text[i:] == text[:n - i]
            value[: n - i] += (parts[i][bucket[i:, 0]] + parts[i][bucket[i:, 1]]) * inside[:, None]
        best = np.zeros((count, value.shape[1]), np.float32)
        if len(some):
            best[some] = np.maximum(np.maximum.reduceat(value, first[some], axis=0), 0)
        out.append(best)
        if where:
            place = np.full((count, value.shape[1]), -1)
            for c in range(value.shape[1]):
                hit = np.flatnonzero((value[:, c] == best[text, c]) & (best[text, c] > 0))
                place[text[hit][::-1], c] = hit[::-1]
            places.append(place)
    return (np.concatenate(out, 1), places) if where else np.concatenate(out, 1)


def _spread(x: np.ndarray) -> np.ndarray:
    return mix(x.astype(np.uint64) + np.uint64(1))


#: Cells of a slice of the training set: label and whether held back by text, words by text, buckets of every word and its stem, languages.
CELLS = ["label", "held", "size", "words", "lang"]
SIZES = {w: w * DIM * FILTERS for w in WIDTHS}


def _cells(s: Slice, labels: np.ndarray, langs: list) -> tuple[bytes, ...]:
    """Texts with the same four smallest word hashes, which are copies as a rule, are held back together or not at all."""
    bucket, text = buckets(s)
    least = np.lexsort((_spread(bucket[:, 0]), text))
    first, held = np.searchsorted(text, np.arange(s.count + 1)), np.zeros(s.count, bool)
    for i in range(s.count):
        own = bucket[least[first[i]: first[i + 1]], 0]
        held[i] = zlib.crc32(own[np.sort(np.unique(own, return_index=True)[1])[:4]].tobytes()) % 5 == 4
    return labels.astype(np.int8).tobytes(), held.tobytes(), np.diff(first).astype(np.int32).tobytes(), (bucket - [0, BUCKETS]).astype(np.uint16).tobytes(), json.dumps(langs).encode()


def _read(label: bytes, held: bytes, size: bytes, words: bytes, part: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Labels, what is held back, buckets and text of every word; with ``part`` of those texts alone that are held back (1) or not (0)."""
    y, held, size = np.frombuffer(label, np.int8).astype(float), np.frombuffer(held, bool), np.frombuffer(size, np.int32)
    bucket = np.frombuffer(words, np.uint16).reshape(-1, 2) + np.array([0, BUCKETS])
    if part is not None:
        keep = held == part
        bucket, y, held, size = bucket[np.repeat(keep, size)], y[keep], held[keep], size[keep]
    return y, held, bucket, np.repeat(np.arange(len(y)), size)


def _tally(_):
    """Rows by label and whether they are held back."""
    def one(label: bytes, held: bytes, *_: bytes) -> np.ndarray:
        return np.bincount(np.frombuffer(label, np.int8) + 2 * np.frombuffer(held, bool), minlength=4).astype(float)
    return one


def _occurrences(part):
    """Texts that hold a bucket, clean ones first."""
    def one(label: bytes, held: bytes, size: bytes, words: bytes, _: bytes) -> np.ndarray:
        y, _, bucket, text = _read(label, held, size, words, part)
        pairs = np.unique(text[:, None] * (2 * BUCKETS) + bucket)
        return np.bincount(pairs % (2 * BUCKETS) + 2 * BUCKETS * (y[pairs // (2 * BUCKETS)] > 0), minlength=4 * BUCKETS).astype(float)
    return one


def _start(clean: np.ndarray, toxic: np.ndarray, share: float, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    base = max(share, 1e-6)
    odds = np.log((toxic + SHRINK * base) / (clean + SHRINK * (1 - base))) - np.log(base / max(1 - base, 1e-6))
    embedding = rng.normal(0, 0.02, (2 * BUCKETS, DIM)).astype(np.float32)
    embedding[:, 0] = np.clip(odds, -3, 6) / 2
    embedding[toxic + clean == 0] = 0
    filters = {w: rng.normal(0, 0.05, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    for f in filters.values():
        f[0, 0, 0] += 1.0
    return Model(embedding, filters, {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, rng.normal(0, 0.1, len(WIDTHS) * FILTERS) + np.tile([1.0] + [0.0] * (FILTERS - 1), len(WIDTHS)))


def _slopes(state):
    """The slope of the loss: by output, bias, filters and shifts of each width, embedding."""
    model, weight, part = state
    tables = model.tables()

    def one(label: bytes, held: bytes, size: bytes, words: bytes, _: bytes) -> np.ndarray:
        y, _, tb, tt = _read(label, held, size, words, part)
        values, places = pooled(tb, tt, len(y), tables, model.shift, where=True)
        gap = (1 / (1 + np.exp(-np.clip(model.margin(values), -40, 40))) - y) * weight[(y > 0).astype(int)]
        slope_e, out = np.zeros(model.embedding.shape), [values.T.astype(np.float64) @ gap, [gap.sum()]]
        for j, w in enumerate(WIDTHS):
            back = gap[:, None] * model.output[j * FILTERS:(j + 1) * FILTERS]
            slope_f, slope_s = np.zeros(model.filters[w].shape), np.zeros(FILTERS)
            for c in range(FILTERS):
                rows = np.flatnonzero(places[j][:, c] >= 0)
                at, g = places[j][rows, c], back[rows, c]
                slope_s[c] = g.sum()
                for i in range(w):
                    ok = at + i < len(tb)
                    ok[ok] = tt[at[ok] + i] == rows[ok]
                    word = tb[at[ok] + i]
                    slope_f[i, :, c] = g[ok] @ model.embedding[word].sum(1)
                    for half in (0, 1):
                        np.add.at(slope_e, word[:, half], g[ok][:, None] * model.filters[w][i, :, c])
            out += [slope_f.ravel(), slope_s]
        return np.concatenate([*out, slope_e.ravel()])
    return one


def _values(model):
    """Label, what is held back, the pooled values and the language of every text."""
    tables = model.tables()

    def one(label: bytes, held: bytes, size: bytes, words: bytes, lang: bytes) -> tuple[bytes, ...]:
        y, _, bucket, text = _read(label, held, size, words)
        return label, held, pooled(bucket, text, len(y), tables, model.shift).astype(np.float32).tobytes(), lang
    return one


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.step, self.state = rate, 0, {}

    def __call__(self, name, value, slope):
        m, v = self.state.get(name, (np.zeros_like(slope), np.zeros_like(slope)))
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        self.state[name] = m, v
        return value - self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> Model:
    """The model of a list of texts."""
    y = np.asarray(labels, np.float64) > 0
    parts = slices(pa.array(texts, pa.large_string()), lower=True)
    return fit_slices(Slices([_cells(s, y[s.first: s.first + s.count], [None] * s.count) for s in parts]), epochs, seed)[0]


def fit_slices(rows: Slices, epochs: int = EPOCHS, seed: int = 1) -> tuple[Model, Slices | None]:
    """Train on the rows that are not held back (four fifths), calibrate the margin on the rest so that 0.5 is as likely toxic as not.

    Every row is used, a step sums over all of them. The second result has the pooled values. Without rows of both labels the model gives
    every text the share of label 1 (0 without any row), and there are no values.
    """
    n = rows.total(_tally, None, 4, 1.0)
    clean, toxic = n[0] + n[2], n[1] + n[3]
    if not (clean and toxic):
        model = _start(np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS), 0.0, seed)
        model.output[:] = 0
        model.offset = 40.0 if toxic else -40.0
        return model, None
    part = 0 if n.all() else None
    if part == 0:
        clean, toxic = n[0], n[1]
    found = rows.total(_occurrences, part, 4 * BUCKETS, 1.0)
    model, adam = _start(found[: 2 * BUCKETS], found[2 * BUCKETS:], toxic / (clean + toxic), seed), _Adam(0.02)
    weight = np.array([0.5 / clean, 0.5 / toxic])
    k = len(WIDTHS) * FILTERS
    cuts = np.cumsum([k, 1, *(n for w in WIDTHS for n in (SIZES[w], FILTERS))])
    for _ in range(epochs):
        adam.step += 1
        output, bias, *by_width, slope_e = np.split(rows.total(_slopes, (model, weight, part), int(cuts[-1]) + model.embedding.size), cuts)
        output = adam("o", model.output, output + 1e-4 * model.output)
        model.bias = float(adam("b", np.array(model.bias), np.array(bias[0])))
        for j, w in enumerate(WIDTHS):
            model.filters[w] = adam(f"f{w}", model.filters[w], by_width[2 * j].reshape(model.filters[w].shape)).astype(np.float32)
            model.shift[w] = adam(f"s{w}", model.shift[w], by_width[2 * j + 1]).astype(np.float32)
        slope_e = slope_e.reshape(model.embedding.shape)
        touched = np.flatnonzero(np.abs(slope_e).sum(1))
        size = np.abs(slope_e[touched]).max() if len(touched) else 1.0
        model.embedding[touched] -= (0.05 * slope_e[touched] / size).astype(np.float32)
        model.output = output
    # the output alone is convex: finish it with Newton steps on the pooled values
    values = rows.map(_values, model, ["label", "held", "values", "lang"])
    model.output, model.bias = _logistic(values, k, weight, 1.0 / (clean + toxic), part)
    part = None if part is None else 1
    count = n[2] + n[3] if part else n.sum()
    coefficients, model.offset = _logistic(values, 1, np.full(2, 1 / count), 0.1 / count, part, model)
    model.scale = float(max(coefficients[0], 1e-3))
    return model, values


def _newton(state):
    """Slope and curvature of the weighted log loss of the pooled values, or of ``model``'s margin."""
    beta, weight, part, model = state

    def one(label: bytes, held: bytes, values: bytes, _: bytes) -> np.ndarray:
        y, held = np.frombuffer(label, np.int8).astype(float), np.frombuffer(held, bool)
        x = np.frombuffer(values, np.float32).reshape(len(y), -1)
        if part is not None:
            x, y = x[held == part], y[held == part]
        x = np.column_stack([x if model is None else model.margin(x), np.ones(len(x))]).astype(np.float64)
        p, w = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30))), weight[(y > 0).astype(int)]
        return np.append(x.T @ (w * (p - y)), (x * (w * p * (1 - p))[:, None]).T @ x)
    return one


def _logistic(values: Slices, k: int, weight: np.ndarray, ridge: float, part: int | None, model: Model | None = None) -> tuple[np.ndarray, float]:
    """Weighted ridge logistic regression on ``k`` numbers a row by damped Newton steps, each a sum over all rows; ``weight`` by label, 1 in all."""
    beta, pull = np.zeros(k + 1), np.append(np.full(k, ridge), 1e-3 * ridge)
    for _ in range(40):
        found = values.total(_newton, (beta, weight, part, model), (k + 1) * (k + 2))
        slope, curve = found[: k + 1] + pull * beta, found[k + 1:].reshape(k + 1, k + 1)
        step = np.linalg.solve(curve + np.diag(pull + 1e-9), slope)
        beta = beta - step * min(1.0, 3.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-5:
            break
    return beta[:-1], float(beta[-1])


#: Steps of a threshold.
STEPS = 10_000


def best_thresholds(scored: DataFrame) -> dict[str, float]:
    """Of ``lang, score, toxic``, each language's threshold with the best F1 over all its rows, in steps of ``1 / STEPS``; of equals the one nearest 0.5.

    A language whose rows have one label alone has none.
    """
    step = F.floor(F.col("score") * STEPS).cast("int").alias("step")
    counts = scored.where("lang IS NOT NULL").groupBy("lang", step).agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    every = Window.partitionBy("lang")
    down = every.orderBy(F.desc("step"))
    x = counts.select("lang", F.sum("t").over(down).alias("hits"), F.sum("n").over(down).alias("took"), F.sum("t").over(every).alias("toxic"), F.sum("n").over(every).alias("rows"),
                      ((F.col("step") + F.coalesce(F.lead("step").over(down) + 1, F.lit(0))) / (2 * STEPS)).alias("at"))
    f1 = F.round(2 * F.col("hits") / (F.col("took") + F.col("toxic")), 12)
    best = x.where("toxic > 0 AND toxic < rows").groupBy("lang").agg(F.max_by("at", F.struct(f1, -F.abs(F.col("at") - 0.5))).alias("at"))
    return {r["lang"]: r["at"] for r in best.collect()}


def labelled(documents: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = BROADCAST_LABELS) -> DataFrame:
    """``text, lang, toxic``: every text with each of its labels among those ``learn`` marks.

    The labels go to the texts, which are read once and stay where they are. More than ``most`` labels are dealt out by
    their ids in as many parts as keep a broadcast within it, one pass over the texts each.
    """
    marked = labels.where(F.col("toxic").isin(0, 1)).where(learn).select(F.col(id_col), F.col("toxic").cast("int").alias("toxic"))
    texts = documents.select(id_col, F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL")
    parts = max(1, -(-marked.count() // most))
    part = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(parts))
    found = [texts.where(part == i).join(F.broadcast(marked.where(part == i)), id_col) if parts > 1 else texts.join(F.broadcast(marked), id_col) for i in range(parts)]
    return reduce(DataFrame.unionAll, found).select("text", "lang", "toxic")


def train(documents: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on all labelled documents among those ``learn`` marks (by default those whose crc32 of the id as text is not divisible by 5).

    Rows without a label or a text are left out.
    """
    learn = ~held_out(F.col(id_col), 5) if learn is None else learn
    texts = labelled(documents, labels, learn, id_col, text_col, lang_col)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(0), lower=True):
                lang, toxic = (batch.column(i).slice(s.first, s.count) for i in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in _cells(s, toxic.to_numpy(), lang.to_pylist())], names=CELLS)

    model, values = fit_slices(Slices(written(texts.mapInArrow(words, ", ".join(f"{c} binary" for c in CELLS)))))
    if values is None:
        return model

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cells in zip(*batch.columns):
                label, held, x, lang = (c.as_py() for c in cells)
                held = np.frombuffer(held, bool)
                p = model.probability(np.frombuffer(x, np.float32).reshape(len(held), -1))[held]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, h in zip(json.loads(lang), held) if h], pa.string()), pa.array(p), pa.array(np.frombuffer(label, np.int8)[held].astype(np.int32))], names=["lang", "score", "toxic"])

    # thresholds by language, from the rows the fit kept back
    model.thresholds = best_thresholds(values.rows.mapInArrow(scores, "lang string, score double, toxic int"))
    return model


def score_slice(s: Slice, model: Model, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
    return model.probability(pooled(*buckets(s), s.count, tables, model.shift))


def score(df: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The columns ``keep`` with ``score`` (0 to 1), ``predicted`` (1 if the score is at least 0.5) and ``flagged`` (the score reaches its language's threshold, 0.5 if it has none).

    A null or empty text is scored as a text without words. Repeated rows and null ids stay; other columns
    are left out; a kept column with the name of a result is replaced by it.
    """
    names = [n for n in keep if n not in ("score", "predicted", "flagged")]
    schema = T.StructType([df.schema[n] for n in names] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("flagged", T.BooleanType())])
    shared = df.sparkSession.sparkContext.broadcast((model, model.tables()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tables = shared.value
        at = len(names)
        for batch in batches:
            for s in slices(batch.column(at), lower=True):
                p = score_slice(s, model, tables)
                limit = np.array([model.thresholds.get(x, 0.5) for x in batch.column(at + 1).slice(s.first, s.count).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(s.first, s.count) for i in range(at)), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(p >= limit)], names=schema.names)

    return df.select(*names, F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).mapInArrow(run, schema)
