"""Removal of byte strings that repeat anywhere in the corpus, by a blockwise sort of suffixes.

Every suffix that starts a repeated string of ``length`` bytes has an equal neighbour in suffix order, so
only equality of the first ``length`` bytes counts. The sort is cut into buckets and needs a cover sample
with precomputed ranks:

* The cover sample. A difference cover fixes sample positions by number, so that two suffixes meet sampled
  positions at a common shift; across many documents its ranks would need a sample of every tenth byte
  to be joined. Here the sample is fixed by content instead: of the strings of half the length that begin
  in a window of the other half, the one with the smallest hash is sampled (the leftmost of equals). Equal
  strings of ``length`` bytes then hold a sample at the same shift, which is all the cover is needed for,
  and one byte in a hundred is sampled. The rank of a sample is the hash of its ``length // 2`` bytes.
* Ranks alone settle most ties: a sample whose rank occurs once starts no repeat; one whose whole
  surrounding (all strings of ``length`` bytes through the sample) occurs twice is repeated throughout.
* Buckets. What is left are samples of equal rank with different surroundings, the ends of repeats. A bucket
  holds one member per distinct surrounding. Its suffixes, all starts of strings through the sample, are
  sorted bucket by bucket in a task by the bytes left and right of the sample, the tie on the sample itself
  being settled by its rank. A bucket of more than ``heavy`` members is sorted by a shuffle of its suffixes
  instead, so memory has a bound.

Hashes are 64 bits wide; two strings count as equal if the hashes of the sample and of the parts beside it agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written
from .textbytes import RangeHash, Slice, mix, slices

LENGTH = 400
#: Members of a bucket that one task sorts; larger buckets are sorted by a shuffle.
HEAVY = 20_000
#: Members that a task sorts in one go if buckets are small.
TOGETHER = 2_000


def samples(s: Slice, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the slice of the sampled strings, and the text of each."""
    half = length // 2
    width = length - half + 1
    if len(s.data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = (s.hash.rolling(half) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(s.data) - half + 1, dtype=np.uint64)
    # smallest of every `width` neighbours: from block starts forward and from block ends backward
    padded = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(key) - width + 1
    least = (np.minimum(back[:n], ahead[width - 1: width - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.maximum(s.end - length + 1 - s.start, 0)  # strings that start in each text
    at = np.repeat(s.start - np.concatenate(([0], np.cumsum(starts)[:-1])), starts) + np.arange(starts.sum())
    text = np.repeat(np.arange(s.count), starts)
    found = least[at]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    return found[fresh], text[fresh]


SAMPLE_FIELDS = [("k1", T.LongType()), ("k2", T.LongType()), ("pos", T.IntegerType()), ("left", T.ShortType()), ("right", T.ShortType()), ("rank", T.LongType()), ("around", T.LongType())]


def _sampled(docs: DataFrame, length: int) -> DataFrame:
    """One row per sample: key of its text, position, bytes of its surrounding left and right of it, rank, hash of the surrounding."""
    half = length // 2
    schema = T.StructType([T.StructField(n, t) for n, t in SAMPLE_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for s in slices(batch.column(2)):
                at, text = samples(s, length)
                low, high = np.maximum(s.start[text], at - (length - half)), np.minimum(s.end[text], at + length)
                around = mix(s.hash.of(low, high) + (at - low).astype(np.uint64))
                rows = s.first + text
                yield pa.RecordBatch.from_arrays([pa.array(k1[rows]), pa.array(k2[rows]), pa.array((at - s.start[text]).astype(np.int32)), pa.array((at - low).astype(np.int16)),
                                                  pa.array((high - at - half).astype(np.int16)), pa.array(s.hash.of(at, at + half).view(np.int64)), pa.array(around.view(np.int64))], names=schema.names)

    return docs.select("k1", "k2", "text").mapInArrow(run, schema)


def _contexts(docs: DataFrame, members: DataFrame, length: int) -> DataFrame:
    """The bytes left and right of each member: ``rank, k1, k2, pos, before, after``."""
    half = length // 2
    lists = members.groupBy("k1", "k2").agg(F.collect_list(F.struct("rank", "pos", "left", "right")).alias("at"))
    schema = T.StructType([T.StructField("rank", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("pos", T.IntegerType()),
                           T.StructField("before", T.BinaryType()), T.StructField("after", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, texts, lists = (batch.column(i) for i in range(4))
            columns: list[list] = [[] for _ in schema.names]
            for i in range(len(batch)):
                data = texts[i].as_py().encode()
                for m in lists[i].as_py():
                    p = m["pos"]
                    for column, value in zip(columns, (m["rank"], k1[i].as_py(), k2[i].as_py(), p, data[p - m["left"]: p], data[p + half: p + half + m["right"]]), strict=True):
                        column.append(value)
            for first in range(0, len(columns[0]), 5_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[first: first + 5_000], t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=schema.names)

    return docs.select("k1", "k2", "text").join(lists, ["k1", "k2"]).mapInArrow(run, schema)


def _padded(column: pa.Array, width: int, backward: bool) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as the rows of a matrix, from their start or from their end, and their lengths."""
    values = column.to_pylist()
    lengths = np.array([len(v) for v in values])
    joined = b"".join((v[::-1] if backward else v).ljust(width, b"\0") for v in values)
    return np.frombuffer(joined, np.uint8).reshape(len(values), width), lengths


def suffix_keys(before: pa.Array, after: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort key of the string that starts ``a`` bytes before each sample, for a from 0 to half the length, and whether it lies in the text.

    The sample itself is common to a bucket, so the key takes the ``a`` bytes before and the bytes after it alone.
    """
    half = length // 2
    reach = length - half
    left, n_left = _padded(before, reach, True)
    right, n_right = _padded(after, reach, False)
    keys = []
    for matrix in (left, right):
        step = RangeHash(np.zeros(reach, np.uint8)).up[:reach]
        sums = np.zeros((len(matrix), reach + 1), np.uint64)
        np.cumsum((matrix.astype(np.uint64) + np.uint64(1)) * step, axis=1, out=sums[:, 1:])
        keys.append(sums)
    a = np.arange(reach + 1)
    key = mix(mix(keys[0]) * np.uint64(5) + keys[1][:, ::-1] * np.uint64(3) + a.astype(np.uint64))
    return key, (a <= n_left[:, None]) & (reach - a <= n_right[:, None])


def _sorted_buckets(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated stretches ``k1, k2, start, end`` of the members of buckets that a task can sort."""
    half = length // 2
    schema = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])

    def stretches(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        key, inside = suffix_keys(rows["before"].combine_chunks() if rows.num_rows else rows["before"], rows["after"].combine_chunks(), length)
        rank = rows["rank"].to_numpy().view(np.uint64)
        flat = mix(key ^ mix(rank)[:, None])[inside]
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        same = ordered[1:] == ordered[:-1]
        twice = np.zeros(len(flat), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = np.zeros((len(rank), half + 2 + (length % 2)), bool)
        hit[:, :-1][inside] = twice
        # runs of neighbouring starts are one stretch
        edge = np.diff(hit.astype(np.int8), axis=1, prepend=0)
        row, first = np.nonzero(edge == 1)
        _, last = np.nonzero(edge == -1)
        pos = rows["pos"].to_numpy()[row]
        return pa.RecordBatch.from_arrays([pa.array(rows["k1"].to_numpy()[row]), pa.array(rows["k2"].to_numpy()[row]), pa.array((pos - last + 1).astype(np.int32)),
                                           pa.array((pos - first + length).astype(np.int32))], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            waiting = now if waiting is None else pa.concat_tables([waiting, now])
            rank = waiting["rank"].to_numpy()
            ends = np.flatnonzero(rank[1:] != rank[:-1]) + 1  # the last bucket may go on in the next batch
            done = 0
            while done < len(ends):
                until = max(np.searchsorted(ends, (ends[done - 1] if done else 0) + TOGETHER), done + 1)
                begin, stop = (ends[done - 1] if done else 0), ends[until - 1]
                yield stretches(waiting.slice(begin, stop - begin))
                done = until
            if len(ends):
                waiting = waiting.slice(ends[-1])
        if waiting is not None and waiting.num_rows:
            yield stretches(waiting)

    return contexts.repartition("rank").sortWithinPartitions("rank").mapInArrow(run, schema)


def _shuffled_buckets(contexts: DataFrame, length: int) -> DataFrame:
    """The same for larger buckets: their suffixes are shuffled by key and counted."""
    schema = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("rank", T.LongType()), T.StructField("key", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), TOGETHER):
                part = batch.slice(first, TOGETHER)
                key, inside = suffix_keys(part.column(4), part.column(5), length)
                row, a = np.nonzero(inside)
                rank, k1, k2, pos = (part.column(i).to_numpy() for i in range(4))
                yield pa.RecordBatch.from_arrays([pa.array(k1[row]), pa.array(k2[row]), pa.array((pos[row] - a).astype(np.int32)), pa.array(rank[row]), pa.array(key[inside].view(np.int64))], names=schema.names)

    suffixes = contexts.mapInArrow(run, schema)
    twice = suffixes.groupBy("rank", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return suffixes.join(twice, ["rank", "key"], "left_semi").select("k1", "k2", "start", (F.col("start") + length).alias("end"))


def repeated(docs: DataFrame, length: int = LENGTH, heavy: int = HEAVY) -> DataFrame:
    """Stretches of bytes ``k1, k2, start, end`` whose every byte lies in a string of ``length`` bytes that also starts elsewhere; they may overlap."""
    half = length // 2
    found = written(_sampled(docs, length))
    # written first, so that a rank of very many samples meets its one row in a join whose large side can be split
    twice = written(found.groupBy("rank").agg(F.count("*").alias("n")).where("n > 1").select("rank"))
    found = written(found.join(twice, "rank", "left_semi"))
    classes = found.groupBy("rank", "around").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "pos", "left", "right")).alias("one"))
    classes = written(classes)
    whole = found.join(classes.where("n > 1").select("rank", "around"), ["rank", "around"], "left_semi")
    whole = whole.select("k1", "k2", (F.col("pos") - F.col("left")).cast("int").alias("start"), (F.col("pos") + half + F.col("right")).cast("int").alias("end"))
    members = classes.join(classes.groupBy("rank").agg(F.count("*").alias("size")).where("size > 1"), "rank")
    contexts = written(_contexts(docs, members.select("rank", "size", "one.*"), length).join(members.select("rank").where(F.col("size") > heavy).distinct().withColumn("heavy", F.lit(True)), "rank", "left"))
    small = _sorted_buckets(contexts.where("heavy IS NULL").drop("heavy"), length)
    large = _shuffled_buckets(contexts.where("heavy").drop("heavy"), length)
    return whole.union(small).union(large)


def _character(data: bytes, at: int, forward: bool) -> int:
    """The nearest place between two characters, after ``at`` or before it."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1 if forward else -1
    return at


def remove_repeats(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, heavy: int = HEAVY, as_text: bool = False) -> DataFrame:
    """The columns ``keep`` with ``n_bytes, n_removed`` (long), ``spans`` (removed stretches ``start, end``, maximal, in order) and ``kept`` (the remaining bytes).

    With ``as_text`` the last column is ``text`` instead: the text without the characters whose bytes are all
    removed; a character that a stretch cuts through stays whole.

    Strings are judged on the input as it is, within and across documents; matches never cross documents.
    A null text is empty. Rows that repeat an id, or are equal throughout, are separate documents, and so
    repeat each other. Other columns are left out; a kept column with the name of a result is replaced by it.
    """
    results = {"n_bytes": T.LongType(), "n_removed": T.LongType(), "spans": T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])), "text" if as_text else "kept": T.StringType() if as_text else T.BinaryType()}
    names = [n for n in keep if n not in results]
    schema = T.StructType([df.schema[n] for n in names] + [T.StructField(n, t) for n, t in results.items()])
    text = F.coalesce(F.col(text_col), F.lit(""))
    # a row without an id is known by 128 bits of its text, any other by its id and 64 bits
    own = F.col(id_col).cast("long") if isinstance(df.schema[id_col].dataType, (T.LongType, T.IntegerType)) else F.xxhash64(id_col)
    key = [F.when(F.col(id_col).isNull(), F.xxhash64(F.lit("no id"), text)).otherwise(own).alias("k1"), F.xxhash64(F.col(id_col).isNull(), text).alias("k2")]
    docs = df.select(*key, text.alias("text"))
    lists = repeated(docs, length, heavy).groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_cut"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = len(names)
        for batch in batches:
            n_bytes, n_removed, spans, kept = [], [], [], []
            for value, cut in zip(batch.column(at), batch.column(at + 1), strict=True):
                data, merged = value.as_py().encode(), []
                for one in cut.as_py() or ():
                    if merged and one["start"] <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], one["end"])
                    else:
                        merged.append(one)
                edges = [0, *(e for m in merged for e in (m["start"], m["end"])), len(data)]
                removed = sum(m["end"] - m["start"] for m in merged)
                if as_text:
                    edges[1:-1] = [_character(data, e, i % 2 == 0) for i, e in enumerate(edges[1:-1])]
                rest = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                for column, x in zip((n_bytes, n_removed, spans, kept), (len(data), removed, merged, rest.decode() if as_text else rest), strict=True):
                    column.append(x)
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(at)), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string() if as_text else pa.binary())], names=schema.names)

    rows = df.select(*[F.col(n).alias(f"c{i}") for i, n in enumerate(names)], text.alias("_text"), *key).join(lists, ["k1", "k2"], "left")
    return rows.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], "_text", "_cut").mapInArrow(run, schema)
