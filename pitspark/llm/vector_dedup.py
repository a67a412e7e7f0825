"""Near-duplicate vectors by a pivot-permutation index.

A bounded sample of vectors, thinned so that no two are alike, serves as pivots. Every vector is described by
its ``NEAREST`` nearest pivots in order; inverted lists hold the vectors under each pair of their pivots, so
two vectors meet in a list exactly if they share two pivots or more. Vectors that meet are verified by their
cosine in double precision, and a pair is counted only in the list of the two smallest pivots it shares.

Equal vectors are one vector with a count. A list can still hold any part of the rows when they are alike,
so vectors within half the linking angle of a leader (the first vector with the same two nearest pivots)
form a core: all of a core are linked with each other by the triangle inequality and are counted without
being compared. Only pairs of different cores are compared; a list with one large core is cut into blocks of
that core with the others replicated, and any other long list into pairs of blocks. Nothing is capped.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import written

#: Pivots at most, thinned from a sample of four times as many vectors, and the cosine two pivots must stay below.
PIVOTS = 512
APART = 0.6
NEAREST = 8
#: Rounds of choosing leaders among vectors that are in no core yet.
ROUNDS = 2
#: Pairs of different cores per member up to which a list is compared around its largest core; members of a block.
LEAF = 512
BLOCK = 2_048
#: Margin that keeps rounding from putting a vector into a core it is only just too far for.
MARGIN = 1e-9


def usable(vector: str):
    """Whether a vector has a direction: not null or empty, no null or non-finite component, not all zero."""
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & sound & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(column: pa.Array) -> list[np.ndarray]:
    """The vectors of a list column in double precision, scaled to length 1."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)[column.offsets[0].as_py(): column.offsets[-1].as_py()]
    out = np.split(flat, np.cumsum(lengths)[:-1]) if len(lengths) else []
    # the largest component first, so that squares neither vanish nor overflow
    return [x / np.sqrt((x * x).sum()) for x in (v / np.abs(v).max() for v in out)]


def choose_pivots(vectors: list[np.ndarray], most: int = PIVOTS, apart: float = APART) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per length of vectors: the numbers of its pivots and their matrix. In order of the sample, those below ``apart`` to all before."""
    out: dict[int, tuple[list, list]] = {}
    number = 0
    for v in vectors:
        numbers, rows = out.setdefault(len(v), ([], []))
        if number < most and (not rows or (np.array(rows) @ v).max() < apart):
            numbers.append(number)
            rows.append(v)
            number += 1
    return {n: (np.array(a), np.array(b)) for n, (a, b) in out.items()}


def nearest(vectors: list[np.ndarray], pivots: dict, count: int, most: int) -> np.ndarray:
    """The nearest pivots of each vector in order, -1 where there are fewer.

    Each length of vectors also has two pivots of its own, numbered behind the real ones, for lengths with
    less than two real ones.
    """
    out = np.full((len(vectors), count), -1, np.int64)
    length = np.array([len(v) for v in vectors])
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        numbers, matrix = pivots.get(int(n), (np.zeros(0, np.int64), None))
        have = min(len(numbers), count)
        if have:
            cos = np.stack([vectors[i] for i in rows]) @ matrix.T
            out[rows, :have] = numbers[np.argsort(-cos, axis=1, kind="stable")[:, :have]]
        if have < 2:
            out[rows, have: 2] = most + 2 * int(n) + np.arange(2 - have)
    return out


def _described(vectors: DataFrame, pivots: dict, count: int, most: int) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = nearest(unit(batch.column(2)), shared.value, count, most)
            near = pa.array([[int(x) for x in row if x >= 0] for row in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, near], names=["u", "copies", "vector", "near"])

    schema = vectors.select("u", "copies", "vector", F.array(F.lit(0).cast("long")).alias("near")).schema
    return vectors.select("u", "copies", "vector").mapInArrow(run, schema)


def _cored(vectors: DataFrame, half_angle_cos: float, rounds: int) -> DataFrame:
    """``vectors`` with ``core``: the vector's leader, or the vector itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, lead = unit(batch.column(1)), unit(batch.column(3))
            inside = [len(a) == len(b) and a @ b >= half_angle_cos + MARGIN for a, b in zip(own, lead, strict=True)]
            same = (batch.column(0).to_numpy() == batch.column(2).to_numpy())
            core = [leader if ok or eq else None for leader, ok, eq in zip(batch.column(2).to_pylist(), inside, same, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(core, pa.int64())], names=["u", "core"])

    rest = vectors.select("u", "vector", F.least(F.col("near")[0], F.col("near")[1]).alias("p"), F.greatest(F.col("near")[0], F.col("near")[1]).alias("q"))
    found = None
    for i in range(rounds):
        leaders = rest.groupBy("p", "q").agg(F.min_by(F.struct(F.col("u").alias("leader"), F.col("vector").alias("lead")), "u").alias("x"), F.count("*").alias("n")).where("n > 1")
        tried = rest.join(leaders.select("p", "q", "x.leader", "x.lead"), ["p", "q"])
        got = written(tried.select("u", "vector", "leader", "lead").mapInArrow(run, "u long, core long").where("core IS NOT NULL"))
        found = got if found is None else found.union(got)
        if i + 1 < rounds:
            rest = rest.join(got.select("u"), "u", "left_anti")
    return vectors.join(found, "u", "left").withColumn("core", F.coalesce("core", "u"))


def linked(cell: np.ndarray, p: np.ndarray, q: np.ndarray, core: np.ndarray, vectors: np.ndarray, near: np.ndarray, least_cos: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of linked pairs of different cores inside each run of equal ``cell``, where (p, q) are the two smallest pivots shared."""
    start = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(cell)))
    found = []
    for m in np.unique(size[(size > 1) & (size <= 32)]):
        i, j = np.triu_indices(m, 1)
        at = start[size == m][:, None]
        a, b = (at + i).ravel(), (at + j).ravel()
        other = core[a] != core[b]
        a, b = a[other], b[other]
        for f in range(0, len(a), 20_000):
            x, y = a[f: f + 20_000], b[f: f + 20_000]
            yes = np.einsum("ij,ij->i", vectors[x], vectors[y]) >= least_cos
            found.append((x[yes], y[yes]))
    for at, m in zip(start[size > 32], size[size > 32], strict=True):
        kinds, times = np.unique(core[at: at + m], return_counts=True)
        lesser = core[at: at + m] != kinds[np.argmax(times)]  # every pair of different cores has one of these
        place = np.where(lesser, np.cumsum(lesser), 0)
        asks = np.flatnonzero(lesser)
        for f in range(0, len(asks), 512):
            rows = asks[f: f + 512]
            x, y = np.nonzero(vectors[at + rows] @ vectors[at: at + m].T >= least_cos)
            x = rows[x]
            new = (core[at + x] != core[at + y]) & (~lesser[y] | (place[x] < place[y]))
            found.append((at + x[new], at + y[new]))
    if not found:
        return start[:0], start[:0]
    a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
    keep = np.zeros(len(a), bool)
    for f in range(0, len(a), 50_000):
        x, y = a[f: f + 50_000], b[f: f + 50_000]
        sorted_near = np.sort(near[x], axis=1)
        shared = (sorted_near[:, :, None] == near[y][:, None, :]).any(2) & (sorted_near >= 0)
        nth = np.cumsum(shared, axis=1)
        first = np.where(shared & (nth == 1), sorted_near, 0).sum(1)
        second = np.where(shared & (nth == 2), sorted_near, 0).sum(1)
        keep[f: f + 50_000] = (first == p[x]) & (second == q[x])
    return a[keep], b[keep]


def _verified(cells: DataFrame, least_cos: float) -> DataFrame:
    """From rows ``cell, p, q, low, high, mine, u, core, copies, vector, near``: ``u, links`` (copies linked from other cores) and ``a, b`` (linked cores), apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            cell, p, q, u, core, copies = (t.column(n).to_numpy() for n in ("cell", "p", "q", "u", "core", "copies"))
            rows = unit(t.column("vector").chunk(0))
            vectors = np.zeros((len(rows), max(map(len, rows))))
            for i, v in enumerate(rows):
                vectors[i, : len(v)] = v
            lists = t.column("near").to_pylist()
            near = np.full((len(lists), max(map(len, lists))), -1, np.int64)
            for i, v in enumerate(lists):
                near[i, : len(v)] = v
            low, high, mine = (t.column(n).to_numpy() for n in ("low", "high", "mine"))
            a, b = linked(cell, p, q, core, vectors, near, least_cos)
            # of a pair of blocks, pairs between the two, or inside if they are one; around a core, pairs of others in the first block only
            counted = (low[a] == -1) | (low[a] == high[a]) | (mine[a] != mine[b])
            a, b = a[counted], b[counted]
            who, at = np.unique(u[np.concatenate((a, b))], return_inverse=True)
            links = np.bincount(at, copies[np.concatenate((b, a))], minlength=len(who)).astype(np.int64)
            edges = np.unique(np.stack([np.minimum(core[a], core[b]), np.maximum(core[a], core[b])], 1), axis=0)
            none_edges, none_links = [None] * len(who), [None] * len(edges)
            return pa.RecordBatch.from_arrays([pa.array([*who.tolist(), *none_links], pa.int64()), pa.array([*links.tolist(), *none_links], pa.int64()),
                                               pa.array([*none_edges, *edges[:, 0].tolist()], pa.int64()), pa.array([*none_edges, *edges[:, 1].tolist()], pa.int64())], names=["u", "links", "a", "b"])

        waiting = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            waiting = now if waiting is None else pa.concat_tables([waiting, now])
            cell = waiting.column("cell").to_numpy()
            ends = np.flatnonzero(cell[1:] != cell[:-1]) + 1
            if len(ends):
                yield results(waiting.slice(0, ends[-1]))
                waiting = waiting.slice(ends[-1])
        if waiting is not None and waiting.num_rows:
            yield results(waiting)

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "u long, links long, a long, b long")


def near_duplicates(df: DataFrame, least_cos: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, count: int = NEAREST,
                    leaf: int = LEAF, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """``id_col, n_links, component_id, kept`` of every row: how many other rows it is linked with directly, and the smallest id reachable.

    Rows are linked when the index brings them together and their cosine in double precision is at least
    ``least_cos``. A vector that is null, empty, all zero, or holds a null or non-finite component is linked
    with nothing; vectors of different lengths are never linked. Repeated rows count as separate vectors and
    are linked. A null id is no name: such a row is named by the smallest id it reaches, null if there is
    none. ``kept`` marks rows whose id names their component, and rows without a named component. Other
    columns are left out.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.when(usable(vector_col), F.xxhash64(vector_col)).alias("u"), F.col(vector_col).alias("vector"))
    vectors = written(rows.where("u IS NOT NULL").groupBy("u").agg(F.count("*").alias("copies"), F.first("vector").alias("vector")))
    sample = vectors.orderBy(F.xxhash64("u"), "u").limit(4 * pivots).select("vector").toArrow()
    sample = sample.column(0).combine_chunks()
    chosen = choose_pivots(unit(sample.chunk(0) if isinstance(sample, pa.ChunkedArray) else sample) if len(sample) else [], pivots)
    half = float(np.cos(np.arccos(least_cos) / 2))
    known = written(_cored(written(_described(vectors, chosen, count, pivots)), half, rounds))

    pairs = F.array(*[F.struct(F.least(F.col("near")[i], F.col("near")[j]).alias("p"), F.greatest(F.col("near")[i], F.col("near")[j]).alias("q")) for i, j in itertools.combinations(range(count), 2)])
    pairs = F.filter(pairs, lambda x: x["p"].isNotNull() & x["q"].isNotNull() & (x["p"] != x["q"]))
    postings = known.withColumn("near", F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: F.try_element_at("near", i)))
    postings = postings.where(F.col("near")[1].isNotNull()).select("u", "core", F.explode(F.filter(pairs, lambda x: x["p"].isNotNull())).alias("x")).select("u", "core", "x.p", "x.q")
    parts = postings.groupBy("p", "q", "core").agg(F.count("*").alias("c"))
    stats = parts.groupBy("p", "q").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("square"), F.max(F.struct("c", "core"))["core"].alias("main"))
    stats = stats.withColumn("cross", (F.col("n") * F.col("n") - F.col("square")) / 2).where("cross > 0").withColumn("few", F.col("cross") <= leaf * F.col("n"))
    here = written(postings.join(stats.select("p", "q", "n", "main", "few"), ["p", "q"]))
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("u"), blocks).cast("int")
    every = F.sequence(F.lit(0), blocks - 1)
    # around the largest core: its members in one block each, the others in all; pairs of others count in block 0
    few = here.where("few").withColumn("main", F.col("core") == F.col("main")).select("p", "q", "u", F.explode(F.when(F.col("main"), F.array(own)).otherwise(every)).alias("low"), F.lit(-1).alias("high"), F.col("main").cast("int").alias("mine"))
    many = here.where("NOT few").select("p", "q", "u", own.alias("mine"), F.explode(every).alias("o")).select("p", "q", "u", F.least("mine", "o").alias("low"), F.greatest("mine", "o").alias("high"), "mine")
    cells = few.union(many.select("p", "q", "u", "low", "high", "mine").distinct())
    cells = cells.withColumn("cell", F.xxhash64("p", "q", "low", "high")).withColumn("low", F.when(F.col("high") >= 0, F.col("low")).when(F.col("low") == 0, -1).otherwise(F.lit(-2)))
    found = written(_verified(cells.join(known, "u"), least_cos))

    counts = found.where("u IS NOT NULL").groupBy("u").agg(F.sum("links").alias("links"))
    comps = components(found.where("a IS NOT NULL").select("a", "b"))
    sizes = known.groupBy("core").agg(F.sum("copies").alias("core_size"))
    per = known.select("u", "core").join(sizes, "core").join(counts, "u", "left").join(comps.withColumnRenamed("id", "core"), "core", "left")
    per = per.select("u", (F.col("core_size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "core").alias("component"))
    named = written(rows.select("id", "u").join(per, "u", "left"))
    least = named.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("first"))
    out = named.join(least, "component", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("first")))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", (F.col("component_id").isNull() | F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))).alias("kept"))
