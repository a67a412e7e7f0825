"""SentencePiece encoding and decoding with a relational lattice.

The text, with a space before it, is cut wherever two neighbouring bytes never stand side by side in any piece:
no piece can cross such a place, so the best segmentation of a text is that of its parts, here called words
(a word with the space before it, a comma, a line break, ...). Every distinct word is segmented once:

* its substrings of at most the longest piece's length are exploded and equi-joined with the piece table;
* a character that is no piece is an edge of its byte pieces, ten below the lowest score;
* edges know their word by 96 bits; they are grouped by word, and a fold over them in the order of their ends
  (``aggregate``) keeps the best score and last edge of every place, from which a second fold reads the best path.
  Of equal scores the one whose last piece is longer wins.

A run of more than ``BLOCK`` characters without a cut (spaces of a table, a rule, letters without blanks) is one word
and is folded block by block. A piece may cross a border, so what passes from block to block are the scores of
the first places of the next one. Equal blocks are one: their edges are joined and folded once for every place
they can be entered at, which gives a small matrix from entries to exits; a fold over a word's matrices gives the
scores that every block is entered with. With these a block is folded again, once for all that are entered alike, keeping the path of every exit,
and a fold over the blocks from the last one picks the exits that the best path goes through. No row holds more
than a block's edges, or some numbers per block of a word.

Texts are encoded where they are read with the ids of the commonest words, a broadcast of at most ``frequent``
words; the other words of a text are joined with the table of words and put into their places.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pieces import DEFAULT_MODEL, MARK, Vocabulary, load
from .shared import commonest, written
from .textbytes import BASES, RangeHash, Slice, slices

#: Commonest words whose ids are broadcast (some forty bytes each).
FREQUENT = 600_000
#: What a character without a piece scores below the lowest piece.
PENALTY = 10.0
#: Characters of a word that are folded at once.
BLOCK = 256
#: Bytes from which words are known by a cryptographic hash: those of shorter ranges cannot be made to agree.
PLAIN = 512
#: Rows of word counts that a task holds before it hands them on.
HELD = 600_000
#: Ids of a word that may be broadcast.
SHORT = 64
#: Texts that a task counts the words of at once.
TEXTS = 1_000
#: Size of the parts that words are dealt out in before they become edges, some thirty times as large.
PART = "1m"


def source_pieces(vocabulary: Vocabulary) -> list[str]:
    """The pieces as they stand in a text: the word mark is a space. A word mark in a text is no piece's."""
    return [p.replace(MARK, " ") for p in vocabulary.pieces]


def inseparable(vocabulary: Vocabulary) -> np.ndarray:
    """Which pairs of bytes stand side by side in some piece."""
    pairs = np.zeros((256, 256), bool)
    for piece in source_pieces(vocabulary):
        b = np.frombuffer(piece.encode(), np.uint8)
        pairs[b[:-1], b[1:]] = True
    return pairs


def spaced(texts: pa.Array) -> pa.Array:
    """Every text with a space before it; a null or empty text stays empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    with_space = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
    return pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, with_space)


def words(s: Slice, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every word of a slice."""
    d = s.data
    cut = np.ones(len(d) + 1, bool)
    cut[1:-1] = ~pairs[d[:-1], d[1:]] & (d[1:] & 0xC0 != 0x80)
    cut[s.start] = cut[s.end] = True
    places = np.flatnonzero(cut)
    start, end = places[:-1], places[1:]
    of = np.searchsorted(s.end, start, side="right")
    inside = start != s.end[np.minimum(np.searchsorted(s.end, start), s.count - 1)]  # not the newline behind a text
    return start[inside], end[inside], of[inside]


def keys(s: Slice, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of a slice: 64 and 32 bits that name each, its first place among ``start``, and of every place its number."""
    names = s.hash.of(start, end)
    for i in np.flatnonzero(end - start > PLAIN):
        names[i] = int.from_bytes(blake2b(s.data[start[i]: end[i]].tobytes(), digest_size=8).digest(), "little")
    first_names, first, back = np.unique(names, return_index=True, return_inverse=True)
    second = RangeHash(s.data, BASES[1]).of(start[first], end[first])
    for i in np.flatnonzero(end[first] - start[first] > PLAIN):
        second[i] = int.from_bytes(blake2b(s.data[start[first[i]]: end[first[i]]].tobytes(), digest_size=8, key=b"2").digest(), "little")
    return first_names, second.astype(np.uint32).view(np.int32), first, back


def word_table(texts: DataFrame, model: str) -> DataFrame:
    """``h1, h2, word, n``: the distinct words of the column ``text``, their keys and how often they occur.

    A task adds up the words of its batches before they are shuffled.
    """
    pairs = inseparable(load(model))
    names = ["h1", "h2", "word", "n"]

    def together(held: list[pa.Table]) -> pa.Table:
        rows = pa.concat_tables(held).combine_chunks()
        h1 = rows["h1"].to_numpy()
        _, first, back = np.unique(h1, return_index=True, return_inverse=True)
        times = np.zeros(len(first), np.int64)
        np.add.at(times, back, rows["n"].to_numpy())
        return rows.take(pa.array(first)).set_column(3, "n", pa.array(times))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for column in (batch.column(0).slice(at, TEXTS) for batch in batches for at in range(0, len(batch), TEXTS)):
            for s in slices(spaced(column)):
                start, end, _ = words(s, pairs)
                h1, h2, first, back = keys(s, start, end)
                times = np.bincount(back, minlength=len(first))
                raw = s.data.tobytes()
                found = [raw[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
                held.append(pa.table([pa.array(h1.view(np.int64)), pa.array(h2), pa.array(found, pa.string()), pa.array(times.astype(np.int64))], names=names))
                if sum(map(len, held)) > HELD:
                    held = [together(held)]
                    if len(held[0]) > HELD * 2 // 3:
                        yield from held[0].to_batches(20_000)
                        held = []
        if held:
            yield from together(held).to_batches(20_000)
        held = []
        pa.default_memory_pool().release_unused()  # the worker waits for its next task beside the JVM

    found = texts.select("text").mapInArrow(run, "h1 long, h2 int, word string, n long")
    # dealt out by the key alone, so that the edges of a word need no shuffle of their own
    return found.repartition("h1", "h2").groupBy("h1", "h2", "word").agg(F.sum("n").alias("n"))


def piece_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    rows = pa.table({"piece": source_pieces(vocabulary), "id": pa.array(vocabulary.ids), "score": pa.array(vocabulary.scores)})
    return spark.createDataFrame(rows)


NODE = "struct<score: double, start: int, id: int>"
NEVER = "-double('infinity')"
EDGE = "named_struct('score', {score}, 'start', {start}, 'id', {id})"


def _edges(parts: DataFrame, names: list[str], text: str, width: Column, vocabulary: Vocabulary, penalty: float) -> DataFrame:
    """``names, edges``: the lattice over the first ``width`` characters of ``text``, ordered by end and start; edges may end behind them.

    ``names`` are unique and ``parts`` is dealt out by the first two of them. A character without a piece has the
    number -1 less its code point. Where ``width`` is null there are no edges.
    """
    lowest, longest = float(vocabulary.scores.min() - penalty), vocabulary.longest
    pieces = F.broadcast(piece_table(parts.sparkSession, vocabulary))
    starts = parts.select(*names, F.col(text).alias("_text"), F.length(text).alias("_size"), F.explode_outer(F.sequence(F.lit(0), width - 1)).alias("start"))
    ends = F.explode_outer(F.sequence(F.col("start") + 1, F.least(F.col("start") + longest, F.col("_size"))))
    cut = starts.select(*names, "_text", "start", ends.alias("end")).select(*names, "start", "end", F.substring("_text", F.col("start") + 1, F.col("end") - F.col("start")).alias("piece"))
    edges = cut.join(pieces, "piece", "left").where(F.col("id").isNotNull() | F.col("start").isNull() | (F.col("end") == F.col("start") + 1))
    edge = F.struct("end", "start", F.coalesce("score", F.lit(lowest)).alias("score"), F.coalesce("id", -1 - F.ascii("piece")).alias("id"))
    return edges.select(*names, F.when(F.col("start").isNotNull(), edge).alias("edge")).groupBy(*names).agg(F.sort_array(F.collect_list("edge")).alias("edges"))


def _in_bytes(ids: Column, vocabulary: Vocabulary) -> Column:
    """Numbers below zero as the byte pieces of their character."""
    bytes_ = F.array(*[F.lit(i) for i in vocabulary.byte_ids])
    rest = lambda c, shift: 128 + F.shiftright(c, shift).bitwiseAND(63)

    def spelt(x: Column) -> Column:
        c = -1 - x
        numbers = (F.when(c < 0x80, F.array(c)).when(c < 0x800, F.array(192 + F.shiftright(c, 6), rest(c, 0)))
                   .when(c < 0x10000, F.array(224 + F.shiftright(c, 12), rest(c, 6), rest(c, 0)))
                   .otherwise(F.array(240 + F.shiftright(c, 18), rest(c, 12), rest(c, 6), rest(c, 0))))
        return F.transform(numbers, lambda b: F.get(bytes_, b))

    in_bytes = F.flatten(F.transform(ids, lambda x: F.when(x >= 0, F.array(x)).otherwise(spelt(x))))
    return F.when(F.exists(ids, lambda x: x < 0), in_bytes).otherwise(ids)


def _short(parts: DataFrame, vocabulary: Vocabulary, penalty: float, block: int) -> DataFrame:
    """``h1, h2, n, ids, word``: the ids of words of at most a block, or the text of a longer word.

    Both come from one pass; a filter for either would reach below the count of words and run it twice.
    """
    fits = F.length("word") <= block
    parts = parts.withColumn("long", F.when(~fits, F.col("word")))
    grouped = _edges(parts, ["h1", "h2", "n", "long"], "word", F.when(fits, F.length("word")), vocabulary, penalty)
    better = "e.score + get(s.done, e.start).score"
    folded = F.expr(f"""aggregate(edges,
        named_struct('done', CAST(array() AS array<{NODE}>), 'at', 0, 'now', {EDGE.format(score='0D', start='-1', id='0')}),
        (s, e) -> IF(e.end > s.at,
            named_struct('done', array_append(s.done, s.now), 'at', e.end, 'now', {EDGE.format(score='e.score + IF(e.start = s.at, s.now.score, get(s.done, e.start).score)', start='e.start', id='e.id')}),
            IF({better} > s.now.score,
                named_struct('done', s.done, 'at', s.at, 'now', {EDGE.format(score=better, start='e.start', id='e.id')}), s)),
        s -> array_append(s.done, s.now))""")
    path = F.expr("""aggregate(sequence(1, size(best)), named_struct('at', size(best) - 1, 'ids', CAST(array() AS array<int>)),
        (p, _) -> IF(p.at <= 0, p, named_struct('at', get(best, p.at).start, 'ids', array_append(p.ids, get(best, p.at).id))), p -> reverse(p.ids))""")
    found = grouped.select("h1", "h2", "n", "long", folded.alias("best")).select("h1", "h2", "n", "long", path.alias("ids"))
    return found.select("h1", "h2", "n", F.when(F.col("long").isNull(), _in_bytes(F.col("ids"), vocabulary)).alias("ids"), F.col("long").alias("word"))


def _block_fold(init: str) -> str:
    """SQL for the best score and last edge of every place of a block that is entered with the scores ``init`` at its first places."""
    entered = f"coalesce(get({init}, e.end), {NEVER})"
    into = "e.score + IF(e.start = s.at, s.now.score, get(s.done, e.start).score)"
    return f"""aggregate(filter(edges, e -> e.end <= width),
        named_struct('done', CAST(array() AS array<{NODE}>), 'at', 0, 'now', {EDGE.format(score=f'coalesce(get({init}, 0), {NEVER})', start='-1', id='0')}),
        (s, e) -> IF(e.end > s.at,
            named_struct('done', array_append(s.done, s.now), 'at', e.end, 'now',
                IF({entered} >= {into}, {EDGE.format(score=entered, start='-1', id='0')}, {EDGE.format(score=into, start='e.start', id='e.id')})),
            IF(e.score + get(s.done, e.start).score > s.now.score,
                named_struct('done', s.done, 'at', s.at, 'now', {EDGE.format(score='e.score + get(s.done, e.start).score', start='e.start', id='e.id')}), s)),
        s -> array_append(s.done, s.now))"""


#: The score of an exit ``x`` places behind a block whose places have ``best``, and the edge that leads there: the longest of the best.
_LAST = f"""aggregate(filter(edges, e -> e.end = width + x), named_struct('score', {NEVER}, 'start', -1, 'id', 0),
    (m, e) -> IF(e.score + get(best, e.start).score > m.score, named_struct('score', e.score + get(best, e.start).score, 'start', e.start, 'id', e.id), m))"""


def _long(longs: DataFrame, vocabulary: Vocabulary, penalty: float, block: int) -> DataFrame:
    """``h1, h2, n, ids`` of words of more than a block."""
    reach = vocabulary.longest - 1
    chunks = F.regexp_extract_all("word", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    cut = longs.select("h1", "h2", "n", chunks.alias("chunks"))
    part = F.transform("chunks", lambda c, i: F.struct(F.length(c).alias("width"), F.concat(c, F.substring(F.coalesce(F.get("chunks", i + 1), F.lit("")), 1, reach)).alias("text")))
    parts = cut.select("h1", "h2", "n", F.posexplode(part).alias("blk", "part")).select("h1", "h2", "n", "blk", "part.*")
    parts = written(parts.withColumns({"b1": F.xxhash64("width", "text"), "b2": F.xxhash64("text", F.lit(1), "width")}))
    # equal blocks are one
    kinds = parts.groupBy("b1", "b2", "width", "text").agg(F.count("*").alias("_")).drop("_")
    lattices = _edges(kinds.repartition("b1", "b2"), ["b1", "b2", "width"], "text", F.col("width"), vocabulary, penalty)
    lattices = written(lattices.join(kinds.select("b1", "b2", (F.length("text") - F.col("width")).alias("ahead")), ["b1", "b2"]))

    exits = f"transform(sequence(0, ahead), x -> IF(x = 0, get(best, width).score, {_LAST}.score))"
    entries = f"transform(sequence(0, least({reach}, width)), en -> transform(sequence(0, en), p -> IF(p = en, 0D, {NEVER})))"
    matrix = lattices.select("b1", "b2", "width", "ahead", "edges", F.expr(f"transform({entries}, init -> {_block_fold('init')})").alias("folds"))
    matrix = matrix.select("b1", "b2", F.expr(f"transform(folds, best -> {exits})").alias("matrix"))
    chain = parts.join(matrix, ["b1", "b2"]).groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("blk", "matrix"))).alias("all"))
    # the scores that each block is entered with, from those of the block before and its matrix
    entered = F.expr(f"""aggregate(all, named_struct('seen', CAST(array() AS array<array<double>>), 'now', array(0D)),
        (s, b) -> named_struct('seen', array_append(s.seen, s.now), 'now', transform(sequence(0, size(get(b.matrix, 0)) - 1), x ->
            aggregate(sequence(0, size(b.matrix) - 1), {NEVER}, (m, en) -> greatest(m, coalesce(get(s.now, en), {NEVER}) + get(get(b.matrix, en), x))))), s -> s.seen)""")
    init = chain.select("h1", "h2", F.posexplode(entered).alias("blk", "init"))
    # which paths are best depends on the scores' differences alone, so a block entered alike is folded once
    init = init.withColumn("init", F.transform("init", lambda x: x - F.array_max("init"))).withColumns({"i1": F.xxhash64("init"), "i2": F.xxhash64(F.lit(1), "init")})
    alike = ["b1", "b2", "i1", "i2"]
    placed = written(parts.select("h1", "h2", "blk", "b1", "b2").join(init, ["h1", "h2", "blk"]))
    opened = placed.groupBy(*alike).agg(F.any_value("init").alias("init")).join(lattices, ["b1", "b2"])
    opened = opened.select(*alike, "width", "ahead", "edges", F.expr(_block_fold("init")).alias("best"))
    # back from every exit to the place where its path entered
    none = "CAST(array() AS array<int>)"
    step = "(p, _) -> IF(get(best, p.at).start < 0, p, named_struct('at', get(best, p.at).start, 'ids', array_append(p.ids, get(best, p.at).id)))"
    inside = f"aggregate(sequence(0, width), named_struct('at', width, 'ids', {none}), {step})"
    across = f"transform(array({_LAST}), last -> aggregate(sequence(0, width), named_struct('at', last.start, 'ids', array(last.id)), {step}))[0]"
    traced = opened.select(*alike, F.posexplode(F.expr(f"transform(sequence(0, ahead), x -> IF(x = 0, {inside}, {across}))")).alias("x", "path"))
    traced = written(traced.select(*alike, "x", F.col("path.at").alias("entry"), F.reverse("path.ids").alias("ids")))
    maps = traced.groupBy(*alike).agg(F.transform(F.sort_array(F.collect_list(F.struct("x", "entry"))), lambda e: e["entry"]).alias("entries"))
    maps = placed.drop("init").join(maps, alike).groupBy("h1", "h2").agg(F.reverse(F.sort_array(F.collect_list(F.struct("blk", "entries")))).alias("all"))
    taken = F.expr(f"aggregate(all, named_struct('taken', {none}, 'x', 0), (s, b) -> named_struct('taken', array_append(s.taken, s.x), 'x', get(b.entries, s.x)), s -> reverse(s.taken))")
    on = maps.select("h1", "h2", F.posexplode(taken).alias("blk", "x")).join(placed.drop("init"), ["h1", "h2", "blk"]).join(traced, [*alike, "x"])
    ids = on.groupBy("h1", "h2").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("blk", "ids"))), lambda p: p["ids"])).alias("ids"))
    return longs.select("h1", "h2", "n").join(ids, ["h1", "h2"]).select("h1", "h2", "n", _in_bytes(F.col("ids"), vocabulary).alias("ids"))


def encode_words(table: DataFrame, model: str = DEFAULT_MODEL, penalty: float = PENALTY, block: int = BLOCK) -> DataFrame:
    """``h1, h2, n, ids`` of a table of distinct words (``h1, h2, word, n``, dealt out by its key), written."""
    vocabulary = load(model)
    spark = table.sparkSession
    # grouped by sorting: edges of a word stand together, and a hash table of lists would be sorted and spilled twice;
    # the shuffled words are not needed once the table is written; parts are small, as a task sorts the edges of all its words
    settings = {"spark.sql.execution.useObjectHashAggregateExec": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": PART}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        found = written(_short(table, vocabulary, penalty, block))
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    short = found.where("word IS NULL").drop("word")
    longs = found.where("word IS NOT NULL").drop("ids")
    if not longs.limit(1).count():
        return short
    return short.union(written(_long(longs, vocabulary, penalty, block)))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL, frequent: int = FREQUENT, penalty: float = PENALTY, block: int = BLOCK) -> DataFrame:
    """``id_col, n_pieces, ids, exact`` of every row; ``exact`` tells whether the ids, decoded where they are put together, spell the text again.

    A null text is empty; an empty text has no pieces. Repeated rows and null ids stay; other columns are left out.
    """
    spark = df.sparkSession
    vocabulary = load(model)
    pairs = inseparable(vocabulary)
    docs = df.select(F.col(id_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("k", F.xxhash64("text").alias("h"), "text")
    table = encode_words(word_table(docs, model), model, penalty, block)
    least = commonest(table, frequent)
    often = (F.col("n") >= least) & (F.size("ids") <= SHORT)
    common = table.where(often).select("n", "h1", "h2", "ids").toArrow()
    # the commonest words by their sorted keys; their number is their rank, so that common ones take one byte
    n, h1, h2 = (common.column(i).to_numpy() for i in range(3))
    ids = common.column("ids").combine_chunks()
    ids = ids if isinstance(ids, pa.ListArray) else pa.concat_arrays(ids.chunks) if ids.num_chunks else pa.array([], pa.list_(pa.int32()))
    by_rank = np.lexsort((h1, -n))
    ids = ids.take(pa.array(by_rank))
    h1, h2 = h1[by_rank].view(np.uint64), h2[by_rank]
    sizes, flat = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int32), ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    order = np.argsort(h1, kind="stable").astype(np.int32)
    shared = spark.sparkContext.broadcast((h1[order], h2[order], order, (np.cumsum(sizes) - sizes).astype(np.int64), sizes, flat))
    del common, ids

    def known(s: Slice) -> tuple[np.ndarray, ...]:
        """The text of every word of a slice and its rank among the commonest (-1: not one), its number among the distinct words, and their keys."""
        start, end, of = words(s, pairs)
        h1, h2, _, back = keys(s, start, end)
        first, second, rank = shared.value[:3]
        at = np.minimum(np.searchsorted(first, h1), max(len(first) - 1, 0))
        place = np.where((first[at] == h1) & (second[at] == h2), rank[at], -1) if len(first) else np.full(len(h1), -1)
        return of, place[back] if len(back) else np.zeros(0, np.int64), back, h1, h2

    def rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(spaced(batch.column(2))):
                of, place, back, h1, h2 = known(s)
                nth = np.arange(len(of)) - np.searchsorted(of, of)
                rare = np.flatnonzero(place < 0)
                rows = pa.array(s.first + of[rare])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(nth[rare].astype(np.int32)),
                                                  pa.array(h1[back[rare]].view(np.int64)), pa.array(h2[back[rare]])], names=["k", "h", "nth", "h1", "h2"])

    def templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(spaced(batch.column(2))):
                of, place, _, _, _ = known(s)
                code, size = _pack(place + 1)
                text = s.data.tobytes()
                whole = np.array([_digest(text[a:b]) for a, b in zip(s.start.tolist(), s.end.tolist(), strict=True)], np.int64)
                ends = np.cumsum(np.bincount(of, size, minlength=s.count).astype(np.int64))
                raw = code.tobytes()
                codes = [_squeezed(raw[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.count), batch.column(1).slice(s.first, s.count), pa.array(whole), pa.array(codes, pa.binary())], names=["k", "h", "whole", "code"])

    kind = docs.schema["k"].dataType
    names = [T.StructField("k", kind), T.StructField("h", T.LongType())]
    rare = docs.mapInArrow(rare_words, T.StructType([*names, T.StructField("nth", T.IntegerType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.IntegerType())]))
    filled = rare.join(table.where(~often).select("h1", "h2", "ids"), ["h1", "h2"]).select("k", "h", "nth", "ids")
    # dealt out before they are put into lists: a list per task would have one entry as a rule and cost more than the entry
    filled = filled.repartition(F.struct("k", "h")).groupBy(F.struct("k", "h").alias("key")).agg(F.collect_list(F.struct("nth", "ids")).alias("parts"))
    whole = docs.mapInArrow(templates, T.StructType([*names, T.StructField("whole", T.LongType()), T.StructField("code", T.BinaryType())])).withColumn("key", F.struct("k", "h")).join(filled, "key", "left").select("k", "whole", "code", "parts")
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_pieces", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())])
    spelt = spellings(vocabulary)
    lengths = np.array([len(b) for b in spelt], np.int64)
    spelling = spark.sparkContext.broadcast((np.frombuffer(b"".join(spelt), np.uint8), np.cumsum(lengths) - lengths, lengths))

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, sizes, flat = shared.value[3:]
        flat_bytes, byte_at, byte_n = spelling.value
        for batch in batches:
            for first in range(0, len(batch), 100):
                part = batch.slice(first, 100)
                rows = [_ids(_expanded(code.as_py()), *rare, starts, sizes, flat) for code, rare in zip(part.column(2), _rare_parts(part.column(3)), strict=True)]
                n = np.array([len(r) for r in rows], np.int64)
                offsets = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
                ids = np.concatenate(rows).astype(np.int32)
                size = byte_n[ids]
                spelt = flat_bytes[np.repeat(byte_at[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))].tobytes()
                ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(n)))].tolist()
                again = np.array([_digest(spelt[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(again == part.column(1).to_numpy())], names=schema.names)

    return whole.mapInArrow(put_together, schema)


def _digest(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


def _rare_parts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of every text, the places of its rare words, how many ids each has, and all their ids."""
    flat = column.flatten()
    nth, lists = flat.field("nth").to_numpy(zero_copy_only=False), flat.field("ids")
    size, ids = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(size)))
    count = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    at = np.concatenate(([0], np.cumsum(count)))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield nth[a:b], size[a:b], ids[ends[a]: ends[b]]


def _pack(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2**28 as bytes, seven bits each, the last byte of a number marked; and the bytes each takes."""
    size = 1 + (numbers >= 1 << 7).astype(np.int64) + (numbers >= 1 << 14) + (numbers >= 1 << 21)
    last = np.cumsum(size) - 1
    out = np.zeros(int(size.sum()), np.uint8)
    for i in range(4):
        has = size > i
        out[last[has] - i] = (numbers[has] >> (7 * i)) & 127
    out[last] |= 128
    return out, size


def _unpack(code: bytes) -> np.ndarray:
    data = np.frombuffer(code, np.uint8)
    last = np.flatnonzero(data & 128)
    size = np.diff(np.concatenate(([-1], last)))
    out = np.zeros(len(last), np.int64)
    for i in range(4):
        has = size > i
        out[has] |= (data[last[has] - i] & 127).astype(np.int64) << (7 * i)
    return out


def _squeezed(code: bytes) -> bytes:
    """A template for the shuffle, whose own compression does not weigh bytes by how often they occur."""
    return len(code).to_bytes(4, "little") + pa.compress(code, codec="zstd", asbytes=True) if code else b""


def _expanded(squeezed: bytes) -> bytes:
    return pa.decompress(squeezed[4:], int.from_bytes(squeezed[:4], "little"), codec="zstd", asbytes=True) if squeezed else b""


def _ids(code: bytes, nth: np.ndarray, size: np.ndarray, rare: np.ndarray, starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The ids of a text from its template and its rare words."""
    place = _unpack(code) - 1
    n = np.where(place >= 0, sizes[np.maximum(place, 0)], 0) if len(sizes) else np.zeros(len(place), np.int64)
    n[nth] = size
    begin = np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.int32)

    def fill(to: np.ndarray, m: np.ndarray, source: np.ndarray, at: np.ndarray) -> None:
        step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        out[np.repeat(to, m) + step] = source[np.repeat(at, m) + step]

    here = np.flatnonzero(place >= 0)
    if len(here):
        fill(begin[here], n[here], flat, starts[place[here]])
    if len(nth):
        fill(begin[nth], size, rare, np.cumsum(size) - size)
    return out


def spellings(vocabulary: Vocabulary) -> list[bytes]:
    """The bytes of every id; ids of no piece spell nothing."""
    out = [b""] * (max(int(vocabulary.ids.max()), *vocabulary.byte_ids) + 1)
    for i, piece in zip(vocabulary.ids.tolist(), source_pieces(vocabulary), strict=True):
        out[i] = piece.encode()
    for b, i in enumerate(vocabulary.byte_ids):
        out[i] = bytes([b])
    return out


def spell(ids: np.ndarray, spelt: list[bytes]) -> bytes:
    """The bytes that ids stand for, with the space before the text."""
    return b"".join(map(spelt.__getitem__, ids.tolist()))


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """``df`` without ``ids_col`` and with the text the ids spell. Bytes that make no character, which no encoded text has, become U+FFFD. Null ids spell an empty text."""
    names = [c for c in df.columns if c not in (ids_col, out_col)]
    schema = T.StructType([*(df.schema[n] for n in names), T.StructField(out_col, T.StringType())])
    shared = df.sparkSession.sparkContext.broadcast(spellings(load(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 500):
                part = batch.slice(first, 500)
                texts = [spell(np.array(ids or [], np.int64), shared.value)[1:].decode("utf-8", "replace") for ids in part.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(texts, pa.string())], names=schema.names)

    return df.select(*names, ids_col).mapInArrow(run, schema)
