"""Ranked lexical search by a dual-tree: items against documents, whole batches pruned by exact bounds.

A score is an inner product of whole numbers: an item's weight of each of its terms times the document's
saturated frequency of that term. All factors are at least zero, so the product of the coordinate maxima of
a group of items and a group of documents bounds every score between them.

* The items are worked on in blocks of a bounded number of items and terms; a block is what is broadcast.
* The texts are read once per block into profiles, their length and the frequencies of the block's terms,
  and the profiles are written. Document frequencies and lengths of the whole corpus come from them.
* Every task builds a hierarchy over the documents of a batch, ordered by their heaviest terms so that like
  documents stand together, with the coordinate maxima of each node, and walks it against the hierarchy over
  the items. A pair of nodes is dropped with all below it if its bound is less than the weakest k-th score of
  the node's items. What is left at the leaves is scored exactly, the most promising first, which raises the k-th scores.
* The k-th scores start from a search over a hash sample of the documents, which can only be too low, so
  nothing is lost. Tasks hand on at most k rows an item, and a window per item ranks those.

Bounds and scores are whole numbers below 2**53 in doubles, or 64-bit integers where an item is longer.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written
from .textbytes import LOWER, RangeHash, Slice, runs, slices

K = 10
#: Items and terms of a block, at most; an item with more terms is a block of its own.
BLOCK_ITEMS = 1_024
BLOCK_TERMS = 16_384
#: Items and documents of a leaf, and children of a node.
ITEM_LEAF, DOC_LEAF, FAN = 16, 32, 4
#: Documents of one hierarchy.
FOREST = 8_192
#: One document in so many is searched first for the k-th scores to start from.
SEED_SHARE = 32
#: Documents that are scored between two updates of the k-th scores.
ROUND = 512
#: No saturated frequency reaches this.
CEILING = 1_000_000

#: Bytes of terms: digits, letters, everything outside ASCII.
INSIDE = np.zeros(256, bool)
INSIDE[48:58] = INSIDE[65:91] = INSIDE[97:123] = INSIDE[128:] = True
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms(text: str | None) -> list[bytes]:
    return [t.translate(LOWER.tobytes()) for t in TERM.findall((text or "").encode())]


@dataclass
class Block:
    """Items ``ids`` with the counts of their terms (``item, term, times``); ``names`` are the terms, known by sorted ``hashes`` in the order ``places``."""

    ids: list
    item: np.ndarray
    term: np.ndarray
    times: np.ndarray
    names: list[bytes]
    hashes: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> Block:
        names: dict[bytes, int] = {}
        item, term, times = [], [], []
        for i, (_, counts) in enumerate(rows):
            for name, n in counts.items():
                item.append(i)
                term.append(names.setdefault(name, len(names)))
                times.append(n)
        found = [s.hash.of(s.start, s.end) for s in slices(pa.array([n.decode("utf-8", "replace") for n in names], pa.large_string()))]
        hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
        places = np.argsort(hashes)
        return cls([r[0] for r in rows], np.array(item, np.int64), np.array(term, np.int64), np.array(times, np.int64), list(names), hashes[places], places)

    def find(self, s: Slice, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The term at every range of a slice, -1 where there is none of the block's."""
        if not len(self.hashes):
            return np.full(len(start), -1)
        h = s.hash.of(start, end)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        out = np.where(self.hashes[at] == h, self.places[at], -1)
        for i in np.flatnonzero((out >= 0) & (end - start > 256)):  # hashes of long ranges could be made to agree
            if s.data[start[i]: end[i]].tobytes() != self.names[out[i]]:
                out[i] = -1
        return out


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    """The items in blocks, read a partition at a time; items without a term match nothing and are left out."""
    rows, seen = [], set()
    for r in items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).toLocalIterator():
        counts = Counter(terms(r["text"]))
        if rows and (len(rows) >= BLOCK_ITEMS or len(seen | counts.keys()) > BLOCK_TERMS):
            yield Block.of(rows)
            rows, seen = [], set()
        if counts:
            rows.append((r["id"], counts))
            seen |= counts.keys()
    if rows:
        yield Block.of(rows)


def profiles(docs: DataFrame, block: Block) -> DataFrame:
    """``id, n, term, times`` of every text with a term: its number of terms, and the block's terms in it with their frequencies, as packed numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    schema = T.StructType([docs.schema["id"], T.StructField("n", T.LongType()), T.StructField("term", T.BinaryType()), T.StructField("times", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(shared.value.names)
        for batch in batches:
            for s in slices(batch.column(1), lower=True):
                start, end, of = runs(s, INSIDE)
                term = shared.value.find(s, start, end)
                hit = term >= 0
                key, times = np.unique(of[hit] * size + term[hit], return_counts=True)
                n = np.bincount(of, minlength=s.count)
                ends = 4 * np.concatenate(([0], np.cumsum(np.bincount(key // size, minlength=s.count))))
                packed = [(key % size).astype(np.int32).tobytes(), times.astype(np.int32).tobytes()]
                some = pa.array(np.flatnonzero(n))
                columns = [pa.array([p[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary()) for p in packed]
                yield pa.RecordBatch.from_arrays([c.take(some) for c in (batch.column(0).slice(s.first, s.count), pa.array(n.astype(np.int64)), *columns)], names=schema.names)

    return docs.select("id", "text").mapInArrow(run, schema)


def document_frequencies(found: DataFrame, size: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    out = np.zeros(size, np.int64)
    for r in found.select("term").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def levels(leaf_of: np.ndarray, row: np.ndarray, term: np.ndarray, value: np.ndarray, size: int, dtype) -> list[np.ndarray]:
    """Coordinate maxima of the nodes, root first; the leaves of ``rows`` are given, ``FAN`` nodes have one parent."""
    leaves = int(leaf_of.max()) + 1
    table = np.zeros((leaves, size), dtype)
    np.maximum.at(table, (leaf_of[row], term), value)
    out = [table]
    while len(out[-1]) > 1:
        below = out[-1]
        pad = -len(below) % FAN
        out.append(np.concatenate((below, np.zeros((pad, size), dtype))).reshape(-1, FAN, size).max(1) if pad else below.reshape(-1, FAN, size).max(1))
    return out[::-1]


def like_order(rows: int, row: np.ndarray, term: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The rows ordered by their heaviest coordinate, then the second heaviest: neighbours share them."""
    order = np.lexsort((term, -value, row))
    first = np.searchsorted(row[order], np.arange(rows))
    n = np.bincount(row, minlength=rows)
    key = [np.where(n > i, term[order[np.minimum(first + i, max(len(order) - 1, 0))]], -1) if len(order) else np.zeros(rows) for i in range(3)]
    return np.lexsort(key[::-1])


class Items:
    """The hierarchy over a block's items: coordinate maxima per level, and the items of each leaf."""

    def __init__(self, block: Block, weight: np.ndarray):
        value = block.times * weight[block.term]
        count, self.size = len(block.ids), len(block.names)
        # sizes travel with the hierarchy to the tasks
        self.leaf, self.doc_leaf, self.forest, self.round = ITEM_LEAF, DOC_LEAF, FOREST, ROUND
        self.dtype = np.float64 if np.bincount(block.item, value, minlength=1).max() * CEILING < 2**53 else np.int64
        order = like_order(count, block.item, block.term, value)
        place = np.empty(count, np.int64)
        place[order] = np.arange(count)
        self.number = order  # the item at each place
        self.levels = levels(np.arange(count) // self.leaf, place[block.item], block.term, value, self.size, self.dtype)
        self.rows = np.zeros((count, self.size), self.dtype)
        self.rows[place[block.item], block.term] = value

    def weakest(self, kth: np.ndarray, level: int) -> np.ndarray:
        """The least k-th score of the items below every node of a level. ``kth`` is by place."""
        width = self.leaf * FAN ** (len(self.levels) - 1 - level)
        return np.minimum.reduceat(kth, np.arange(0, len(kth), width))


def saturated(times: np.ndarray, length: np.ndarray, documents: int, tokens: int) -> np.ndarray:
    m = 25 + (75 * length * documents) // tokens
    return (1_000_000_000 * times) // (1000 * times + 8 * m)


class Search:
    """The best ``k`` documents of every item among the batches it has been given."""

    def __init__(self, items: Items, kth: np.ndarray, k: int, id_type: pa.DataType):
        self.items, self.k = items, k
        self.kth = kth[items.number].astype(np.int64)  # by place; a score below it is of no use
        self.best = pa.table({"item": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "id": pa.array([], id_type)})
        self.scored = 0

    def keep(self, place: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        """Take in scored pairs and raise the k-th scores."""
        all_ = pa.concat_tables([self.best, pa.table({"item": place, "score": score, "id": ids})]).combine_chunks()
        order = pc.sort_indices(all_, sort_keys=[("item", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_end")
        all_ = all_.take(order)
        item = all_["item"].to_numpy()
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        self.best = all_.filter(pa.array(nth < self.k)).combine_chunks()
        full = nth == self.k - 1
        self.kth[item[full]] = np.maximum(self.kth[item[full]], all_["score"].to_numpy()[full])

    def add(self, ids: pa.Array, row: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        """Walk both hierarchies over the documents ``ids`` with coordinates ``(row, term, value)``."""
        items, rows = self.items, len(ids)
        order = like_order(rows, row, term, value)
        place = np.empty(rows, np.int64)
        place[order] = np.arange(rows)
        trees = levels(np.arange(rows) // items.doc_leaf, place[row], term, value, items.size, items.dtype)
        # step by step both go down a level; the deeper hierarchy goes first, alone
        ahead = max(len(trees), len(items.levels))
        pairs = (np.zeros(1, np.int64), np.zeros(1, np.int64))
        for step in range(ahead):
            a, b = max(0, step - ahead + len(items.levels)), max(0, step - ahead + len(trees))
            if step:
                pairs = self.children(pairs, a > 0 and step - ahead + len(items.levels) > 0, b > 0 and step - ahead + len(trees) > 0, len(items.levels[a]), len(trees[b]))
            bound = self.bounds(items.levels[a], trees[b], pairs)
            some = bound >= np.maximum(items.weakest(self.kth, a)[pairs[0]], 1)
            pairs, bound = (pairs[0][some], pairs[1][some]), bound[some]
        self.leaves(pairs, bound, ids.take(pa.array(order)), place[row], term, value)

    @staticmethod
    def children(pairs: tuple[np.ndarray, np.ndarray], first: bool, second: bool, most_first: int, most_second: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = pairs
        if first:
            a, b = (FAN * a[:, None] + np.arange(FAN)).ravel(), np.repeat(b, FAN)
        if second:
            a, b = np.repeat(a, FAN), (FAN * b[:, None] + np.arange(FAN)).ravel()
        there = (a < most_first) & (b < most_second)
        return a[there], b[there]

    @staticmethod
    def bounds(left: np.ndarray, right: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The products of the pairs; the nodes that still stand are multiplied together, a bounded part at a time."""
        a, at_a = np.unique(pairs[0], return_inverse=True)
        b, at_b = np.unique(pairs[1], return_inverse=True)
        out = np.zeros(len(pairs[0]), left.dtype)
        for first in range(0, len(b), 1024):
            inside = (at_b >= first) & (at_b < first + 1024)
            out[inside] = (left[a] @ right[b[first: first + 1024]].T)[at_a[inside], at_b[inside] - first]
        return out

    def leaves(self, pairs: tuple[np.ndarray, np.ndarray], bound: np.ndarray, ids: pa.Array, row: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        items = self.items
        by_row = np.argsort(row, kind="stable")
        row, term, value = row[by_row], term[by_row], value[by_row]
        # document leaves in the order of their best bound over any item's need
        need = np.maximum(items.weakest(self.kth, len(items.levels) - 1), 1)
        lead = np.zeros(-(-len(ids) // items.doc_leaf))
        np.maximum.at(lead, pairs[1], bound / need[pairs[0]])
        todo = np.argsort(-lead, kind="stable")[: np.count_nonzero(lead)]
        by_doc = np.argsort(pairs[1], kind="stable")
        a, b, bound = pairs[0][by_doc], pairs[1][by_doc], bound[by_doc]
        step = max(1, items.round // items.doc_leaf)
        for first in range(0, len(todo), step):
            need = np.maximum(items.weakest(self.kth, len(items.levels) - 1), 1)
            which, score, of = [], [], []
            for leaf in todo[first: first + step].tolist():
                low, high = np.searchsorted(b, [leaf, leaf + 1])
                left = a[low:high][bound[low:high] >= need[a[low:high]]]
                if not len(left):
                    continue
                r0, r1 = leaf * items.doc_leaf, min((leaf + 1) * items.doc_leaf, len(ids))
                c0, c1 = np.searchsorted(row, [r0, r1])
                dense = np.zeros((r1 - r0, items.size), items.dtype)
                dense[row[c0:c1] - r0, term[c0:c1]] = value[c0:c1]
                place = (left[:, None] * items.leaf + np.arange(items.leaf)).ravel()
                place = place[place < len(items.rows)]
                got = items.rows[place] @ dense.T
                self.scored += got.size
                i, j = np.nonzero(got >= np.maximum(self.kth[place], 1)[:, None])
                which.append(place[i])
                of.append(r0 + j)
                score.append(got[i, j].astype(np.int64))
            if which:
                which, score, of = map(np.concatenate, (which, score, of))
                self.keep(which, score, ids.take(pa.array(of)))


def best(found: DataFrame, items: Items, kth: np.ndarray, k: int, documents: int, tokens: int) -> DataFrame:
    """``item, id, score``: the best ``k`` of every task, none below ``kth``; ``item`` is the number in the block."""
    shared = found.sparkSession.sparkContext.broadcast((items, kth))
    schema = T.StructType([T.StructField("item", T.LongType()), found.schema["id"], T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, kth = shared.value
        search = None
        for batch in batches:
            search = search or Search(items, kth, k, batch.column(0).type)
            for first in range(0, len(batch), items.forest):
                part = batch.slice(first, items.forest)
                packed = part.column(2).to_pylist()
                if not any(packed):
                    continue
                row = np.repeat(np.arange(len(part)), [len(p) // 4 for p in packed])
                term, times = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.int32).astype(np.int64) for i in (2, 3))
                search.add(part.column(0), row, term, saturated(times, part.column(1).to_numpy()[row], documents, tokens))
        if search and search.best.num_rows:
            rows = search.best
            yield pa.RecordBatch.from_arrays([pa.array(items.number[rows["item"].to_numpy()]), rows["id"].combine_chunks(), rows["score"].combine_chunks()], names=schema.names)

    return found.mapInArrow(run, schema)


def search(documents: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seed_share: int = SEED_SHARE) -> DataFrame:
    """``item_col, rank, id_col, score``: the ``k`` best documents of every item by score, those above 0; equal scores by ascending id, null ids last.

    A null text has no term. Every row of ``items`` is an item and every row of ``documents`` a document, also
    if they repeat: rows equal in item id are ranked apart. Items without a match, an empty table on either side:
    no rows. Other columns are left out.
    """
    spark: SparkSession = documents.sparkSession
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField(item_col, items.schema[item_col].dataType), T.StructField("rank", T.IntegerType()), T.StructField(id_col, docs.schema["id"].dataType), T.StructField("score", T.LongType())])
    out = spark.createDataFrame([], schema)
    for block in blocks(items, item_col, item_text_col):
        found = written(profiles(docs, block))
        sizes = found.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
        if not sizes["n"]:
            return out
        df = document_frequencies(found, len(block.names)).astype(float)
        weight = np.floor(1000 * np.log((2.0 * sizes["n"] + 2) / (2 * df + 1))).astype(np.int64)
        tree = Items(block, weight)
        none = np.zeros(len(block.ids), np.int64)
        first = best(found.where(F.pmod(F.xxhash64("id"), F.lit(seed_share)) == 0), tree, none, k, sizes["n"], sizes["l"])
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
        top = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        kth = none.copy()
        for r in top(first).where(F.col("rank") == k).select("item", "score").collect():  # one row an item of the block
            kth[r["item"]] = r["score"]
        rows = top(best(found, tree, kth, k, sizes["n"], sizes["l"]))
        ids = spark.createDataFrame([(i, name) for i, name in enumerate(block.ids)], T.StructType([T.StructField("item", T.LongType()), T.StructField(item_col, schema[item_col].dataType)]))
        rows = rows.join(F.broadcast(ids), "item").select(F.col(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
        out = out.union(rows)
    return out


SEARCH_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
sizes AS (SELECT count(*)::BIGINT AS all_docs, sum(len(terms))::BIGINT AS all_terms FROM docs WHERE len(terms) > 0),
wanted AS (
  SELECT item_id, term, count(*)::BIGINT AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
held AS (
  SELECT doc_id, term, any_value(n)::BIGINT AS n, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM wanted) GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, sizes GROUP BY term, all_docs),
scored AS (
  SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * all_docs) // all_terms))))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN held h USING (term), sizes GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scored WHERE score > 0)
SELECT item_id, r::INTEGER AS rank, doc_id, score FROM ranked WHERE r <= 10
"""
