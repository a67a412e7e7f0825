"""Importance resampling towards a target text, with every distinct line's features counted once.

A feature is a run of 1 to ``most`` consecutive words, known by the crc32 of its bytes modulo ``buckets``.
A bucket's gain is the floored log ratio of its share in the target to its share in the corpus; a
document's weight is the floored mean of its features' gains, and with a Gumbel number of its id added
it is its score. The documents with the highest scores are the sample.

No word crosses a newline, so a text is its lines, and most lines of a corpus of copies and boilerplate
occur more than once:

* a task cuts its texts into lines, knows a line by 128 bits of its content, and hands each distinct line on
  once with its number of occurrences; one shuffle makes the table of distinct lines;
* each distinct line is read once into the buckets of its features. Counts of the corpus are those buckets
  times the line's occurrences; a line's sum of gains is again computed once and joined to the documents by
  its key, a row of some forty bytes per document and distinct line. A line that very many documents
  share meets them in a join whose skewed side AQE splits;
* features of two words and more that cross from one line into a later one belong to the text alone. They are
  counted where the texts are read and added separately, to the corpus counts and to the documents' sums.

What the driver holds is one number per bucket.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written
from .textbytes import LOWER, Slice, runs, slices

BUCKETS = 10_000
MOST = 1
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"

#: Bytes of words: digits, small letters, everything outside ASCII.
INSIDE = np.zeros(256, bool)
INSIDE[48:58] = INSIDE[97:123] = INSIDE[128:] = True
#: Bytes of a word that are taken a byte at a time over all words; longer words are finished one by one.
STRIDE = 64


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


CRC = _crc_table()


def crc_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """crc32 of every range of ``data``, continuing from the crc32 ``before`` of what stands before it."""
    state = ~before if before is not None else np.full(len(start), 0xFFFFFFFF, np.uint32)
    order = np.argsort(start - end, kind="stable")  # longest first
    state, at, size = state[order], start[order], (end - start)[order]
    for offset in range(min(STRIDE, int(size[0]) if len(size) else 0)):
        n = len(size) if size[-1] > offset else int(np.searchsorted(-size, -offset))
        state[:n] = CRC[(state[:n] ^ data[at[:n] + offset]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    for i in range(int(np.searchsorted(-size, -STRIDE))):
        state[i] = ~np.uint32(zlib.crc32(data[at[i] + STRIDE: at[i] + size[i]], int(~state[i])))
    out = np.empty(len(start), np.uint32)
    out[order] = ~state
    return out


def features(s: Slice, most: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of one word, of two, ...: bucket, text, and whether the run stays in one line."""
    start, end, of = runs(s, INSIDE)
    line = np.searchsorted(np.flatnonzero(s.data == 10), start)
    space = np.array([32], np.uint8)
    crc = crc_of(s.data, start, end)
    for n in range(1, most + 1):
        last = len(start) - n + 1
        if last <= 0:
            return
        if n > 1:
            crc = crc_of(space, np.zeros(last, np.int64), np.ones(last, np.int64), crc[:last])
            crc = crc_of(s.data, start[n - 1:], end[n - 1:], crc)
        together = of[:last] == of[n - 1:]
        yield (crc % np.uint32(buckets)).astype(np.int64)[together], of[:last][together], (line[:last] == line[n - 1:])[together]


def _digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def _lower(text: str | None) -> bytes:
    return (text or "").encode().translate(LOWER.tobytes())


def lines(docs: DataFrame, most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """``line, times, n, codes`` of every distinct line of the column ``text``: its key, occurrences in all texts, features, and their buckets as packed numbers."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[bytes] = Counter()
            for text in batch.column(0):
                seen.update(_lower(text.as_py()).split(b"\n"))
            found, times = list(seen), list(seen.values())
            for i in range(0, len(found), 5_000):
                part = found[i: i + 5_000]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in part], pa.binary()), pa.array([x.decode() for x in part], pa.string()), pa.array(times[i: i + 5_000], pa.int64())], names=["line", "content", "times"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(1)):
                each = [(b, of) for b, of, _ in features(s, most, buckets)]
                bucket, of = (np.concatenate(x) for x in zip(*each, strict=True)) if each else (np.zeros(0, np.int64),) * 2
                order = np.argsort(of, kind="stable")
                n = np.bincount(of, minlength=s.count)
                codes = bucket[order].astype(kind).tobytes()
                ends = np.concatenate(([0], np.cumsum(n))) * kind().itemsize
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.count), batch.column(2).slice(s.first, s.count), pa.array(n.astype(np.int64)),
                                                  pa.array([codes[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())], names=["line", "times", "n", "codes"])

    found = docs.select("text").mapInArrow(cut, "line binary, content string, times long")
    found = found.groupBy("line").agg(F.first("content").alias("content"), F.sum("times").alias("times"))
    return found.select("line", "content", "times").mapInArrow(read, "line binary, times long, n long, codes binary")


def _line_counts(found: DataFrame, buckets: int) -> DataFrame:
    """``bucket, n``: the features of all lines, each times its occurrences."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), kind)
            once = np.repeat(batch.column(0).to_numpy() == 1, batch.column(1).to_numpy())
            total += np.bincount(codes[once], minlength=buckets)
            again = codes[~once]
            times = np.repeat(batch.column(0).to_numpy(), batch.column(1).to_numpy())[~once]
            np.add.at(total, again, times)  # whole numbers, exact beyond 2**53
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return found.select("times", "n", "codes").mapInArrow(run, "bucket long, n long")


def _crossing_counts(docs: DataFrame, most: int, buckets: int) -> DataFrame:
    """``bucket, n``: the features that cross from one line into another, of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for s in slices(batch.column(0), lower=True):
                for bucket, _, within in features(s, most, buckets):
                    total += np.bincount(bucket[~within], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket long, n long")


def counts(docs: DataFrame, found: DataFrame, most: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts, from their distinct lines ``found`` and what crosses lines."""
    rows = _line_counts(found, buckets)
    if most > 1:
        rows = rows.union(_crossing_counts(docs, most, buckets))
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The floored log ratio of each bucket, a thousandfold, in doubles."""
    size, all_s, all_t = float(len(corpus)), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_s + size) / ((s + 1) * (all_t + size)))) for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def _sums(docs: DataFrame, found: DataFrame, gain: np.ndarray, most: int, buckets: int) -> DataFrame:
    """``id, own, copies, words, n, gain``: one row per distinct (id, text) with the number of its rows, and sums over one of them."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).to_numpy()
            sums = np.concatenate(([0], np.cumsum(shared.value[np.frombuffer(b"".join(batch.column(2).to_pylist()), kind)])))
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums[ends] - sums[ends - n])], names=["line", "n", "gain"])

    key = [docs.schema["id"], T.StructField("own", T.BinaryType())]
    held = T.StructType([*key, T.StructField("line", T.BinaryType()), T.StructField("times", T.LongType()), T.StructField("first", T.LongType())])

    def holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, own, line, times, first = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                data = _lower(text.as_py())
                of = _digest((text.as_py() or "").encode())
                each = Counter(data.split(b"\n"))
                row += [i] * len(each)
                own += [of] * len(each)
                line += [_digest(x) for x in each]
                times += each.values()
                first += [1] + [0] * (len(each) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(own, pa.binary()), pa.array(line, pa.binary()), pa.array(times, pa.int64()), pa.array(first, pa.int64())], names=held.names)

    crossed = T.StructType([*key, T.StructField("n", T.LongType()), T.StructField("gain", T.LongType()), T.StructField("first", T.LongType())])

    def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(1), lower=True):
                n, total = np.zeros(s.count, np.int64), np.zeros(s.count, np.int64)
                for bucket, of, within in features(s, most, buckets):
                    n += np.bincount(of[~within], minlength=s.count)
                    np.add.at(total, of[~within], shared.value[bucket[~within]])
                rows = batch.slice(s.first, s.count)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([_digest((t.as_py() or "").encode()) for t in rows.column(1)], pa.binary()), pa.array(n), pa.array(total), pa.array(np.zeros(s.count, np.int64))], names=crossed.names)

    weighed = found.select("line", "n", "codes").mapInArrow(weigh, "line binary, n long, gain long")
    rows = docs.select("id", "text").mapInArrow(holds, held).join(weighed, "line").select("id", "own", (F.col("n") * F.col("times")).alias("n"), (F.col("gain") * F.col("times")).alias("gain"), "first")
    if most > 1:
        rows = rows.union(docs.select("id", "text").mapInArrow(crossing, crossed).where("n > 0"))
    each = rows.groupBy("id", "own").agg(F.sum("first").alias("copies"), F.sum("n").alias("n"), F.sum("gain").alias("gain"))
    return each.select("id", "copies", F.expr("n div copies").alias("n"), F.expr("gain div copies").alias("gain"))


def words_of(n: F.Column, most: int) -> F.Column:
    """The words of a text from the number of its features: w + (w - 1) + ... down to w - most + 1, none below zero."""
    if most == 1:
        return n
    full = most * (most - 1) // 2  # features missing at the end of a text of at least `most` words
    short = F.ceil((F.sqrt(n * 8.0 + 1) - 1) / 2)
    return F.when(n >= most * (most + 1) // 2, (n + full) / most).otherwise(short).cast("long")


def score(documents: DataFrame, target: DataFrame, most: int = MOST, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``documents``: ``id_col, n_features, weight, score, rank`` (long); ``target`` is a table with the column ``text_col``.

    Of the rows of at least ``min_words`` words the ``floor(percent * rows / 100)`` highest scores have the
    ranks 1, 2, 3, ..., equal scores by ascending id, null ids last; all others have none. A null text is empty, has
    no feature and weight 0. A null id counts as an empty string in the draw. Rows that repeat an id are
    rows of their own, and so are equal rows. An empty target or corpus has no features, and the formulas hold.
    """
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    aims = target.select(F.col(text_col).alias("text"))
    found = written(lines(docs, most, buckets))
    gain = gains(counts(docs, found, most, buckets), counts(aims, lines(aims, most, buckets), most, buckets))
    each = _sums(docs, found, gain, most, buckets)
    weight = F.when(F.col("n") > 0, F.expr("(gain - pmod(gain, n)) div n")).otherwise(F.lit(0).cast("long"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    each = each.select("id", F.col("n").alias("n_features"), weight.alias("weight"), (words_of(F.col("n"), most) >= min_words).alias("able"), "copies")
    each = each.withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("_", "copies")
    return _ranked(written(each), percent).withColumnRenamed("id", id_col)


def _ranked(each: DataFrame, percent: int) -> DataFrame:
    """Ranks without a sort of all rows in one task.

    Scores are whole thousandths of logarithms of 64-bit counts and of 32-bit fractions, so there are at most
    some 150,000 different ones, however many rows: rows of higher scores are a running sum over
    the table of scores, and rows of one score are ranked among themselves.
    """
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    table = each.where("able").groupBy("score").agg(F.count("*").alias("rows"))
    n = each.where("able").count()
    table = table.withColumn("above", F.coalesce(F.sum("rows").over(above), F.lit(0))).where(F.col("above") < percent * n // 100).select("score", "above")
    among = Window.partitionBy("score", "able").orderBy(F.col("id").asc_nulls_last(), "n_features", "weight")
    rank = F.col("above") + F.row_number().over(among)
    rows = each.join(table, "score", "left").withColumn("rank", F.when(F.col("able"), rank))
    return rows.select("id", "n_features", "weight", "score", F.when(F.col("rank") <= percent * n // 100, F.col("rank")).cast("long").alias("rank"))


def resample(documents: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The drawn rows of ``documents`` with all their columns. Rows that share a drawn id come with it."""
    drawn = score(documents, target, id_col=id_col, text_col=text_col, **options).where("rank IS NOT NULL").select(id_col).distinct()
    return documents.join(drawn, documents[id_col].eqNullSafe(drawn[id_col]), "left_semi")


RESAMPLING_SQL = r"""
WITH crc AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS b))),
texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
words AS (
  SELECT side, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
counted AS (SELECT side, id, w, count(*) AS n FROM words GROUP BY ALL),
bucket AS (
  SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(hex(w)) // 2 + 1), lambda i: ('0x' || substr(hex(w), 2 * i - 1, 2))::BIGINT)),
    lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]))) % 10000 AS b
  FROM (SELECT DISTINCT w FROM counted), crc),
totals AS (SELECT b, sum(CASE WHEN side = 'd' THEN n ELSE 0 END)::DOUBLE AS s, sum(CASE WHEN side = 'b' THEN n ELSE 0 END)::DOUBLE AS t FROM counted JOIN bucket USING (w) GROUP BY b),
sides AS (SELECT sum(s) AS alls, sum(t) AS allt FROM totals),
gain AS (SELECT b, floor(1000 * ln((t + 1) * (alls + 10000) / ((s + 1) * (allt + 10000))))::BIGINT AS g FROM totals, sides),
weighed AS (SELECT id, sum(n)::BIGINT AS n, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight FROM counted JOIN bucket USING (w) JOIN gain USING (b) WHERE side = 'd' GROUP BY id),
scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM documents LEFT JOIN weighed ON id = doc_id),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END::BIGINT AS rank FROM scored s LEFT JOIN drawn d ON s.doc_id = d.doc_id
"""
