"""Language of texts by unigram piece models, with all segmentations of a word summed.

The pieces of a public vocabulary file span a lattice over every word; a language is a distribution over
pieces, and a word's probability in it is the sum over all segmentations of the product of the pieces'
probabilities, by a forward recursion in log space over all languages at once. The distributions start
from the scores of the file and are learnt by expectation maximisation over all segmentations of the words
of a bounded sample of labelled rows (``ROWS`` a language, those with the smallest hash of their id).

A word is a run of bytes outside space and 0x09-0x0D, A-Z in lower case; a run of more than ``STRETCH`` bytes
is read as several words, cut at the first character boundary after every ``STRETCH`` bytes, so the work
is linear in the text. A word's probability is mixed with its mean over the languages (``BLUR``), so
that no single word decides. A text's score is the posterior of its best language, all languages being
equally likely beforehand. Texts are scored where they are read: a batch's distinct words once, nothing is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lattice
from .pieces import DEFAULT_MODEL, load
from .shared import written
from .textbytes import Slice, slices

#: Labelled rows a language is learnt from, at most.
ROWS = 2_000
#: Languages with a model, those with most training rows; a model takes 256 KB.
LANGUAGES = 128
ITERATIONS = 2
#: Pieces' worth of the starting weights that the learnt counts are added to.
STRENGTH = 2_000.0
BLUR = 0.05
STRETCH = 64
UNKNOWN = "und"
#: Languages that are scored together, which bounds a task's tables.
TOGETHER = 8


def words(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word of a slice; long runs are cut."""
    start, end, of = s.words
    more = np.maximum(end - start - 1, 0) // STRETCH
    if not more.any():
        return start, end, of
    rows = np.repeat(np.arange(len(start)), more)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(more) - more, more) + 1
    cut = start[rows] + nth * STRETCH
    for _ in range(3):  # to the next place that begins a character
        cut += s.data[cut] & 0xC0 == 0x80
    inside = cut < end[rows]
    starts = np.sort(np.concatenate((start, cut[inside])))
    ends = np.sort(np.concatenate((end, cut[inside])))
    return starts, ends, np.searchsorted(s.end, starts, side="right")


def likelihood(batch: list[str], vocabulary, log_p: np.ndarray) -> np.ndarray:
    """The log probability of every word in every language: words x languages. ``log_p``: languages x pieces."""
    out = np.empty((len(batch), len(log_p)))
    for rows in lattice.together(batch):
        paths = lattice.build([batch[i] for i in rows], vocabulary)
        edges = [(a, b, which, piece) for a, b, which, piece in paths.edges] + [(a, a + 1, which, (matrix, counts)) for a, (which, matrix, counts) in paths.spelt.items()]
        edges.sort(key=lambda e: e[:2])
        for first in range(0, len(log_p), TOGETHER):
            p = np.ascontiguousarray(log_p[first: first + TOGETHER].T)
            alpha = np.full((paths.length.max() + 1, len(rows), p.shape[1]), -np.inf)
            alpha[0] = 0.0
            for a, b, which, piece in edges:
                weight = p[piece] if isinstance(piece, np.ndarray) else np.where((np.arange(4) < piece[1][:, None])[:, :, None], p[piece[0]], 0.0).sum(1)
                alpha[b, which] = np.logaddexp(alpha[b, which], alpha[a, which] + weight)
            out[rows, first: first + TOGETHER] = alpha[paths.length, np.arange(len(rows))] + p[-1]
    return out


def blurred(log_p: np.ndarray) -> np.ndarray:
    """Words x languages, mixed with the mean over the languages."""
    top = log_p.max(1, keepdims=True)
    mean = top + np.log(np.exp(log_p - top).mean(1, keepdims=True))
    return np.logaddexp(np.log1p(-BLUR) + log_p, np.log(BLUR) + mean)


def sample(train: DataFrame, rows: int = ROWS, languages: int = LANGUAGES) -> tuple[DataFrame, list]:
    """``class, text`` of the rows that are learnt from, and the language of each class. ``train`` has ``id, lang, text``."""
    train = train.where("lang IS NOT NULL AND text IS NOT NULL")
    names = [r["lang"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()]
    names = sorted(names)
    # first the rows by id alone, so that the texts of the chosen ones are all that is shuffled
    order = Window.partitionBy("lang").orderBy("h")
    picked = train.select("lang", F.xxhash64("id", "text").alias("h")).where(F.col("lang").isin(names)).distinct()
    picked = picked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= rows).drop("r")
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("lang")).cast("int") - 1 if names else F.lit(0)
    chosen = train.withColumn("h", F.xxhash64("id", "text")).join(F.broadcast(picked), ["lang", "h"], "left_semi")
    return chosen.select(number.alias("class"), "text"), names


def word_counts(chosen: DataFrame, classes: int) -> DataFrame:
    """``word, c0, c1, ...`` of the rows that are learnt from."""
    names = [f"c{k}" for k in range(classes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column(0).to_numpy()
            for s in slices(batch.column(1), lower=True):
                start, end, of = words(s)
                raw = s.data.tobytes()
                each = [Counter() for _ in names]
                for a, b, k in zip(start.tolist(), end.tolist(), kind[s.first + of].tolist(), strict=True):
                    each[k][raw[a:b]] += 1
                seen = list(set().union(*each))
                yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in seen], pa.string()), *(pa.array([c[w] for w in seen], pa.int64()) for c in each)], names=["word", *names])

    return chosen.mapInArrow(run, "word string, " + ", ".join(f"{c} long" for c in names)).groupBy("word").agg(*[F.sum(c).alias(c) for c in names])


def learn(train: DataFrame, rows: int = ROWS, languages: int = LANGUAGES, model: str = DEFAULT_MODEL, iterations: int = ITERATIONS, strength: float = STRENGTH) -> tuple[list, np.ndarray]:
    """The languages and their log probabilities of pieces, bytes and the stop of a word. ``train`` has ``id, lang, text``.

    What comes to the driver is one row per language and piece.
    """
    vocabulary = load(model)
    start = lattice.prior(vocabulary)
    chosen, names = sample(train, rows, languages)
    log_p = np.tile(start, (len(names), 1))
    if not names:
        return names, log_p
    table = written(word_counts(chosen, len(names)))
    for _ in range(iterations):
        shared = train.sparkSession.sparkContext.broadcast((vocabulary, log_p))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vocabulary, log_p = shared.value
            total = np.zeros(log_p.shape)
            for batch in batches:
                found = batch.column(0).to_pylist()
                times = np.stack([batch.column(1 + k).to_numpy() for k in range(len(log_p))])
                for part in lattice.together(found):
                    paths = lattice.build([found[i] for i in part], vocabulary)
                    for k in range(len(log_p)):
                        if times[k, part].any():
                            total[k] += lattice.expected(paths, log_p[k], times[k, part].astype(float))
                total[:, -1] += times.sum(1)
            kind, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(piece), pa.array(total[kind, piece])], names=["class", "piece", "times"])

        got = table.repartition("word").mapInArrow(run, "class long, piece long, times double").groupBy("class", "piece").agg(F.sum("times").alias("times")).toPandas()
        counts = np.tile(strength * np.exp(start), (len(names), 1))
        counts[got["class"].to_numpy(), got["piece"].to_numpy()] += got["times"].to_numpy()
        log_p = np.log(counts / counts.sum(1, keepdims=True))
    return names, log_p


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(df: DataFrame, names: list, log_p: np.ndarray, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score``, the posterior of that language.

    A text that is null or without a letter is ``und`` with score 0, and so is every text if no language was learnt.
    Of equally likely languages the first by name wins. Every row is scored on its own: repeated rows
    get equal results. Other columns are left out; a kept column with the name of a result is replaced.
    """
    kept = [n for n in keep if n not in ("lang_pred", "score")]
    schema = T.StructType([*(df.schema[n] for n in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    rows = df.select(*[F.col(n).alias(f"c{i}") for i, n in enumerate(kept)], F.when(has_letter(F.col(text_col)), F.col(text_col)).alias("text"))
    if not names:
        return rows.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(kept)], F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = df.sparkSession.sparkContext.broadcast((load(model), log_p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, log_p = shared.value
        for batch in batches:
            texts = batch.column(len(kept))
            known = texts.is_valid().to_numpy(zero_copy_only=False)
            keys, of, found = [], [], {}
            for s in slices(texts, lower=True):
                start, end, text = words(s)
                key, first, back = np.unique(s.hash.of(start, end), return_index=True, return_inverse=True)
                raw = s.data.tobytes()
                for h, i in zip(key.tolist(), first.tolist(), strict=True):
                    if h not in found:
                        found[h] = raw[start[i]: end[i]].decode("utf-8", "replace")
                keys.append(key[back] if len(back) else key)
                of.append(s.first + text)
            weight = blurred(likelihood(list(found.values()), vocabulary, log_p)) if found else np.zeros((0, len(log_p)))
            hashes = np.fromiter(found, np.uint64, len(found))
            order = np.argsort(hashes)
            total = np.zeros((len(batch), len(log_p)))
            for key, text in zip(keys, of, strict=True):
                place = order[np.searchsorted(hashes, key, sorter=order)]
                for k in range(len(log_p)):
                    total[:, k] += np.bincount(text, weight[place, k], minlength=len(batch))
            best = total.argmax(1)
            share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            said = np.array([*names, UNKNOWN], object)[np.where(known, best, len(names))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(said, pa.string()), pa.array(np.where(known, share, 0.0))], names=schema.names)

    return rows.mapInArrow(run, schema)
