"""Log probability of documents under lattices of subwords and words.

A text is its words, each behind the word mark, and one end. The pieces of an existing vocabulary file span
a lattice over every word, and a word's spelling probability is the sum over all segmentations of the product
of the pieces' probabilities, computed by a forward recursion in log space. Starting from the scores of the
file, the pieces' probabilities are learnt from the distinct training words by expectation maximisation over
all their segmentations. A training word is one more edge, over the whole word: its count less an absolute
discount (from the numbers of words seen once and twice) goes to that edge, and what the discount frees is
spread over all words by their spelling. So tokens have one distribution that sums to one.

There is one such model per class of training documents (their language), and a text's score is the marginal
over classes and over all segmentations of all its words; the class of a text is never read when it is scored.

Only distinct words are segmented: counting words is the one shuffle of the corpus and grows with it. The
scores of the ``frequent`` commonest words (a bound on the broadcast) are added up where the texts are read;
the rest of the words are joined with the table of words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lattice
from .pieces import DEFAULT_MODEL, load
from .shared import commonest, held_out, written

#: Commonest words whose scores are broadcast, at most.
FREQUENT = 200_000
#: Classes with a model of their own, the ones with most training documents; all others share one more.
CLASSES = 6
ITERATIONS = 2
#: Pieces' worth of the starting weights that the learnt counts are added to.
STRENGTH = 100.0
#: Added to every count by the plain word model beside it.
ADD = 0.1


@dataclass
class Totals:
    """Of one class of training documents: its share, texts, tokens (ends included), distinct words, and the discount."""

    share: float
    texts: int
    tokens: int
    distinct: int
    discount: float


def _tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case; bytes.split() cuts at space and 0x09-0x0D exactly."""
    return text.encode().lower().split() if text else []


def classed(train: DataFrame, class_col: str, most: int) -> tuple[Column, list[int]]:
    """The class number of a row, and the training texts of each class."""
    rows = train.groupBy(class_col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col(class_col).asc_nulls_last()).limit(most).collect()
    total, texts = train.count(), [r["n"] for r in rows]
    number = F.lit(len(rows))
    for i, r in enumerate(rows):
        number = F.when(F.col(class_col).eqNullSafe(F.lit(r[class_col])), i).otherwise(number)
    if total > sum(texts) or not texts:
        texts.append(total - sum(texts))
    return number.cast("int"), texts


def word_counts(docs: DataFrame, classes: int) -> DataFrame:
    """``word, c0, c1, ..., n`` from ``train, class, text``: counts in the training documents of each class, and in all documents."""
    names = [f"c{k}" for k in range(classes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, learnt = Counter(), [Counter() for _ in names]
            for train, kind, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = _tokens(text.as_py())
                seen.update(words)
                if train:
                    learnt[kind].update(words)
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), *(pa.array([c[w] for w in seen], pa.int64()) for c in learnt), pa.array(list(seen.values()), pa.int64())], names=["word", *names, "n"])

    schema = ", ".join(f"{c} long" for c in names)
    return docs.select("train", "class", "text").mapInArrow(run, f"word string, {schema}, n long").groupBy("word").agg(*[F.sum(c).alias(c) for c in (*names, "n")])


def totals(words: DataFrame, texts: list[int]) -> list[Totals]:
    each = words.agg(*[f.alias(f"{name}{k}") for k in range(len(texts)) for c in [F.col(f"c{k}")] for name, f in
                       (("t", F.sum(c)), ("v", F.count(F.when(c > 0, 1))), ("a", F.count(F.when(c == 1, 1))), ("b", F.count(F.when(c == 2, 1))))]).first()
    return [Totals(n / max(1, sum(texts)), n, (each[f"t{k}"] or 0) + n, each[f"v{k}"], (each[f"a{k}"] + 0.5) / (each[f"a{k}"] + 2 * each[f"b{k}"] + 1.5)) for k, n in enumerate(texts)]


def learn(words: DataFrame, classes: int, model: str = DEFAULT_MODEL, iterations: int = ITERATIONS, strength: float = STRENGTH) -> list[np.ndarray]:
    """Per class, log probabilities of pieces, bytes and the stop of a word from its distinct training words.

    What comes back to the driver is one row per class and piece.
    """
    vocabulary = load(model)
    start = lattice.prior(vocabulary)
    log_p = [start] * classes
    for _ in range(iterations):
        shared = words.sparkSession.sparkContext.broadcast((vocabulary, log_p))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vocabulary, log_p = shared.value
            total = np.zeros((classes, len(log_p[0])))
            for batch in batches:
                words = np.array(batch.column(0).to_pylist(), object)
                for k in range(classes):
                    own = words[batch.column(1 + k).to_numpy() > 0].tolist()
                    total[k, -1] += len(own)
                    for rows in lattice.together(own):
                        total[k] += lattice.expected(lattice.build([own[i] for i in rows], vocabulary), log_p[k], np.ones(len(rows)))
            kind, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(piece), pa.array(total[kind, piece])], names=["class", "piece", "times"])

        rows = words.select("word", *[f"c{k}" for k in range(classes)]).mapInArrow(run, "class long, piece long, times double").groupBy("class", "piece").agg(F.sum("times").alias("times")).toPandas()
        counts = np.tile(strength * np.exp(start), (classes, 1))
        counts[rows["class"].to_numpy(), rows["piece"].to_numpy()] += rows["times"].to_numpy()
        log_p = [np.log(c / c.sum()) for c in counts]
    return log_p


def word_scores(words: DataFrame, log_p: list[np.ndarray], of: list[Totals], model: str = DEFAULT_MODEL) -> DataFrame:
    """``word, c, n, p0, p1, ...``: counts in training and in all, and the log10 probability of the word as a token of each class.

    ``log_p[k][-1]`` is the stop of a word, drawn like a piece. A class without training words only spells.
    """
    classes = len(of)
    shared = words.sparkSession.sparkContext.broadcast((load(model), log_p))
    names = [f"p{k}" for k in range(classes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, log_p = shared.value
        for batch in batches:
            words, out = batch.column(0).to_pylist(), np.empty((classes, len(batch)))
            for rows in lattice.together(words):
                paths = lattice.build([words[i] for i in rows], vocabulary)
                for k in range(classes):
                    out[k, rows] = lattice.forward(paths, log_p[k])[1] + log_p[k][-1]
            for k, t in enumerate(of):
                if t.distinct:
                    with np.errstate(divide="ignore"):
                        own = np.log(np.maximum(batch.column(3 + k).to_numpy() - t.discount, 0.0) / t.tokens)
                    out[k] = np.logaddexp(own, np.log(t.discount * t.distinct / t.tokens) + out[k])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(p / np.log(10)) for p in out)], names=["word", "c", "n", *names])

    c = [F.col(f"c{k}") for k in range(classes)]
    return words.select("word", sum(c[1:], c[0]).alias("c"), "n", *c).mapInArrow(run, "word string, c long, n long, " + ", ".join(f"{n} double" for n in names))


def score(df: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", class_col: str = "lang", model: str = DEFAULT_MODEL, frequent: int = FREQUENT,
          classes: int = CLASSES, iterations: int = ITERATIONS, strength: float = STRENGTH) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``train`` marks the rows to learn from (by default those whose crc32 of the id as text is not divisible
    by 10), ``class_col`` the classes of training rows; null is a class. ``score`` is the log10 probability of the text under the
    lattices, ``base_score`` that under word counts with ``ADD`` added. Tokens are words and one end. A null
    or empty text is its end alone. Repeated rows stay and count as often as they occur; other columns are
    left out. Without training rows words are spelt from the starting weights, and ``base_score`` gives every
    token the same probability.
    """
    train = ~held_out(F.col(id_col), 10) if train is None else train
    docs = df.select(F.col(id_col).alias("k1"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("k2"), F.coalesce(train, F.lit(False)).alias("train"), F.col(class_col).alias("kind"), F.col(text_col).alias("text"))
    number, texts = classed(docs.where("train"), "kind", classes)
    docs = docs.withColumn("class", number)
    words = written(word_counts(docs, len(texts)))
    of = totals(words, texts)
    seen = words.agg(F.count(F.when(sum([F.col(f"c{k}") for k in range(len(of))], F.lit(0)) > 0, 1)).alias("v")).first()["v"]
    tokens, distinct = sum(t.tokens for t in of), seen + (1 if sum(texts) else 0)
    log_p = learn(words, len(of), model, iterations, strength)
    scores = written(word_scores(words, log_p, of, model))
    names = [f"p{k}" for k in range(len(of))]

    def base(c):
        return np.log10((c + ADD) / (tokens + ADD * (distinct + 1)))

    common = scores.where(F.col("n") >= commonest(scores, frequent)).toPandas()
    place = {w.encode(): i for i, w in enumerate(common["word"])}
    values = np.column_stack([(common["c"] > 0).to_numpy(float), base(common["c"].to_numpy()), *(common[n].to_numpy() for n in names)]).reshape(len(common), len(names) + 2)
    shared = df.sparkSession.sparkContext.broadcast((place, values))
    end = np.array([float(sum(texts) > 0), base(sum(texts)), *(np.log10(t.texts / t.tokens) if t.texts else p[-1] / np.log(10) for t, p in zip(of, log_p, strict=True))])
    schema = T.StructType([T.StructField("k1", docs.schema["k1"].dataType), T.StructField("k2", T.LongType()), T.StructField("train", T.BooleanType()), T.StructField("word", T.StringType()),
                           T.StructField("n", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in ("known", "base", *names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, values = shared.value
        for batch in batches:
            for first in range(0, len(batch), 1_000):
                part = batch.slice(first, 1_000)
                sums = np.tile(end, (len(part), 1))
                tokens, rare_row, rare, rare_n = [], [], [], []
                for i, text in enumerate(part.column(3)):
                    counts = Counter(_tokens(text.as_py()))
                    at = [place.get(w, -1) for w in counts]
                    where, times = np.array(at, np.int64), np.fromiter(counts.values(), np.int64, len(counts))
                    got = where >= 0
                    sums[i] += times[got] @ values[where[got]]
                    tokens.append(1 + int(times[got].sum()))
                    for w, p in zip(counts, at, strict=True):
                        if p < 0:
                            rare_row.append(i)
                            rare.append(w.decode())
                            rare_n.append(counts[w])
                at = pa.array([*range(len(part)), *rare_row], pa.int64())
                none = [None] * len(rare)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in range(3)), pa.array([*([None] * len(part)), *rare], pa.string()), pa.array([*tokens, *rare_n], pa.int64()),
                                                  *(pa.array([*column.tolist(), *none], pa.float64()) for column in sums.T)], names=schema.names)

    parts = written(docs.select("k1", "k2", "train", "text").mapInArrow(run, schema))
    n = F.col("n")
    base_of = F.log10((F.col("c") + ADD) / (tokens + ADD * (distinct + 1)))
    rare = parts.where("word IS NOT NULL").select("k1", "k2", "train", "word", "n").join(scores.withColumnRenamed("n", "_"), "word")
    rare = rare.select("k1", "k2", "train", F.lit(0).cast("long").alias("rows"), "n", F.when(F.col("c") > 0, n).otherwise(0).cast("double").alias("known"), (n * base_of).alias("base"), *[(n * F.col(p)).alias(p) for p in names])
    own = parts.where("word IS NULL").select("k1", "k2", "train", F.lit(1).cast("long").alias("rows"), "n", "known", "base", *names)
    sums = own.union(rare).groupBy("k1", "k2", "train").agg(*[F.sum(x).alias(x) for x in ("rows", "n", "known", "base", *names)])
    # rows equal in id and text were summed together
    each = sums.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    logs = [F.col(p) / F.col("rows") + float(np.log10(t.share) if t.share else (0.0 if len(of) == 1 else -np.inf)) for p, t in zip(names, of, strict=True)]
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    whole = top + F.log10(sum([F.pow(F.lit(10.0), x - top) for x in logs], F.lit(0.0)))
    return each.select(F.col("k1").alias(id_col), (~F.col("train")).alias("held_out"), F.floor(n / F.col("rows")).alias("n_tokens"), F.floor(F.col("known") / F.col("rows") + 0.5).alias("n_known"),
                       F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") / F.col("rows")).alias("base_score"), whole.alias("score"))
