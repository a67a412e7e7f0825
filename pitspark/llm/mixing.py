"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks. DataFrame functions only.

Each source's documents are shuffled (by the md5 of their id) and laid end to end; the line of words is
cut into blocks of nearly equal length. Slot i of the schedule is the golden-ratio point frac(i * phi),
mapped through the cumulative weights of the sources; the r-th slot of a source takes its r-th block,
starting over after the last, at most three times. So at every moment of the schedule each source has
had close to its share, and reruns agree.

A source may hold any part of the rows: positions within a source are sums over shuffle buckets plus a
sum inside one bucket, slots are ranked inside chunks of the schedule plus a sum over chunks, so no task
ever holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, written

#: Words per block of a large source, and the least blocks a source is cut into if it has that many words.
BLOCK = 1024
LEAST_BLOCKS = 1024
#: Slots per chunk of the schedule, and cells of the grid that finds a point's source.
CHUNK = 65_536
CELLS = 65_536
PHI = 0.6180339887498949
MOST = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null and tells a null source from every other."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """``key, source, source_size, weight, target`` from one row per source (``key, source, source_size``).

    Sources in the order of their code points, null last, weigh 1, 2, 3, 1, 2, ...; together they get the
    words of all. A target stops at ``most`` times the source's size and the excess goes to the others by
    weight: the sources that stop are those with the smallest size per weight, found by running sums.
    The table has one row per distinct source, which bounds the unpartitioned windows.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", ((F.row_number().over(ordered) - 1) % 3 + 1).cast("double")).withColumn("most", (F.col("source_size") * most).cast("double"))
    w = w.withColumn("per", F.col("most") / F.col("weight"))
    by_cap = Window.orderBy("per", F.col("source").asc_nulls_last())
    before, rest = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    w = w.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # the first source that does not stop fixes the level of all
    w = w.withColumn("level", F.min(F.when(F.col("level") <= F.col("per"), F.struct("per", "level"))).over(everything)["level"])
    return w.select("key", "source", "source_size", "weight", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def plan(docs: DataFrame, block: int = BLOCK, least: int = LEAST_BLOCKS) -> DataFrame:
    """``targets`` with ``length`` (words per block), ``blocks``, the bounds ``low``, ``high`` of the source's slice of the unit interval, and ``slots``, the length of the schedule.

    Blocks have ``block`` words; a source of fewer than ``block * least`` words is cut finer, into ``least``
    blocks or single words. The last block of a source may be shorter.
    """
    t = targets(docs.groupBy("key", "source").agg(F.sum("size").alias("source_size")))
    size = F.col("source_size")
    t = t.withColumn("length", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(size / least))).cast("long"))
    t = t.withColumn("blocks", F.ceil(size / F.col("length")).cast("long"))
    t = t.withColumn("need", F.when(size > 0, F.col("target") * F.col("blocks") / size).otherwise(F.lit(0.0)))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    t = t.withColumn("total", F.sum("need").over(Window.partitionBy()))
    t = t.withColumn("high", F.sum("need").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) / F.col("total"))
    # adjoining slices share one bound, so that no point falls between them or into two
    t = t.withColumn("low", F.coalesce(F.lag("high").over(ordered), F.lit(0.0)))
    return t.withColumn("slots", F.round("total").cast("long")).drop("need", "total", "weight")


def schedule(plan_: DataFrame, most: int = MOST) -> DataFrame:
    """``slot, key, block``: which block of which source stands at each place of the mix.

    A slot whose source has had every block ``most`` times is left out.
    """
    n = plan_.agg(F.max("slots")).first()[0] or 0
    i = F.col("id")
    slots = plan_.sparkSession.range(n).select(i.alias("slot"), F.floor(i / CHUNK).alias("chunk"), (i * PHI - F.floor(i * PHI)).alias("x"))
    slots = slots.withColumn("cell", F.floor(F.col("x") * CELLS))
    cells = F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1))))
    cut = plan_.where("high > low").select("key", "blocks", "low", "high", cells.alias("cell"))
    hit = slots.join(cut, "cell").where("x >= low AND x < high").select("slot", "chunk", "key", "blocks")
    inside = F.row_number().over(Window.partitionBy("chunk", "key").orderBy("slot")) - 1
    before = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = hit.groupBy("chunk", "key").agg(F.count("*").alias("n")).select("chunk", "key", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranked = hit.withColumn("inside", inside).join(starts, ["chunk", "key"]).withColumn("rank", F.col("start") + F.col("inside"))
    return ranked.where(F.col("rank") < most * F.col("blocks")).select("slot", "key", (F.col("rank") % F.col("blocks")).alias("block"))


def laid_out(docs: DataFrame) -> DataFrame:
    """``docs`` with ``start``, the words of the same source that stand before the document in the shuffled line.

    The line is ordered by the md5 of the id; the first four digits make 65,536 buckets per source. Rows
    that repeat an id stand by text digest, and rows equal in both side by side in either order.
    """
    docs = docs.withColumn("_md5", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("_bucket", F.substring("_md5", 1, 4))
    inner = Window.partitionBy("key", "_bucket").orderBy("_md5", F.col("doc_id").asc_nulls_first(), "tie").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = docs.groupBy("key", "_bucket").agg(F.sum("size").alias("_n")).select("key", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = docs.withColumn("_inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return inside.join(starts, ["key", "_bucket"]).withColumn("start", F.col("_start") + F.col("_inside")).drop("_start", "_inside", "_md5", "_bucket")


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row ``doc_id, tie, size, source, source_size, target, taken, times_low, times_high``: what the mix takes of it.

    ``tie`` is xxhash64 of the text, which tells rows of one id apart.

    ``taken`` are the words taken, repeats counted; ``times_low`` and ``times_high`` the least and most
    often that a part of the document is taken. A null text has size 0 and nothing is taken of it; null
    sources are one source; rows that repeat an id are separate documents; an empty table gives an empty one.
    """
    docs = written(documents.select(F.col(id_col).alias("doc_id"), source_key(F.col(source_col)).alias("key"), F.col(source_col).alias("source"),
                                    n_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("tie")))
    p = written(plan(docs))
    times = schedule(p).groupBy("key", "block").agg(F.count("*").alias("times"))
    lines = written(laid_out(docs).join(p.select("key", "source_size", "target", "length"), "key"))
    end, b, length = F.col("start") + F.col("size"), F.col("block"), F.col("length")
    pieces = lines.where("size > 0").select("*", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((end - 1) / length))).alias("block"))
    words = F.least(end, (b + 1) * length) - F.greatest(F.col("start"), b * length)
    got = pieces.withColumn("words", words).join(times, ["key", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    each = ["doc_id", "tie", "size", "source", "source_size", "target"]
    taken = got.groupBy(*each, "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"), F.min("times").alias("times_low"), F.max("times").alias("times_high"))
    zero = F.lit(0).cast("long")
    none = lines.where("size = 0").select(*each, zero.alias("taken"), zero.alias("times_low"), zero.alias("times_high"))
    return taken.drop("start").unionByName(none)


def mixed(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``documents``, each as many times as the mix takes it, 0 to 3 times.

    Blocks are taken in order, so a document is taken equally often throughout, but for the one at the end of
    a source's last round; that one goes by the nearest whole number. Rows without a word are in no block.
    Rows equal in id, source and text share what is taken of all of them evenly.
    """
    took = mix(documents, id_col, text_col, source_col).where("size > 0")
    key = F.struct(F.col("doc_id").alias("i"), F.col("tie").alias("t"), F.col("source").alias("s"))
    took = took.groupBy(key.alias("_key")).agg(F.floor(F.sum("taken") / F.sum("size") + 0.5).cast("int").alias("_n")).where("_n > 0")
    keyed = documents.withColumn("_key", F.struct(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("t"), F.col(source_col).alias("s")))
    times = keyed.join(took, "_key").withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return times.select(*documents.columns)


#: The query on these tables: the same schedule, point by point, as one statement.
MIX_SQL = f"""
WITH docs AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY 1),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS most FROM s),
l AS (SELECT *, most / weight AS per, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
lv AS (SELECT level FROM l WHERE level <= per ORDER BY per, level LIMIT 1),
t AS (SELECT source, source_size, least(most, coalesce((SELECT level FROM lv) * weight, most)) AS target, greatest(1, least({BLOCK}, source_size // {LEAST_BLOCKS}))::BIGINT AS length FROM l),
n AS (SELECT *, ceil(source_size / length)::BIGINT AS blocks, CASE WHEN source_size > 0 THEN target * ceil(source_size / length) / source_size ELSE 0 END AS need FROM t),
h AS (SELECT *, sum(need) OVER () AS total, sum(need) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) / sum(need) OVER () AS high FROM n),
p AS (SELECT *, coalesce(lag(high) OVER (ORDER BY source NULLS LAST), 0) AS low FROM h),
slots AS (SELECT i, i * {PHI}::DOUBLE - floor(i * {PHI}::DOUBLE) AS x FROM range((SELECT round(max(total))::BIGINT FROM h)) r(i)),
ranked AS (SELECT p.source, p.blocks, row_number() OVER (PARTITION BY p.source ORDER BY i) - 1 AS r FROM slots JOIN p ON x >= low AND x < high),
times AS (SELECT source, r % blocks AS block, count(*) AS times FROM ranked WHERE r < {MOST} * blocks GROUP BY 1, 2),
line AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM docs),
cut AS (SELECT line.*, p.source_size, p.target, p.length, unnest(range(start // p.length, CASE WHEN size > 0 THEN (start + size - 1) // p.length + 1 ELSE start // p.length + 1 END)) AS block
        FROM line JOIN p ON line.source IS NOT DISTINCT FROM p.source)
SELECT c.doc_id, c.size, c.source_size, c.target,
       sum(CASE WHEN size = 0 THEN 0 ELSE (least(start + size, (c.block + 1) * length) - greatest(start, c.block * length)) * coalesce(times, 0) END)::BIGINT AS taken
FROM cut c LEFT JOIN times t ON c.source IS NOT DISTINCT FROM t.source AND c.block = t.block GROUP BY 1, 2, 3, 4
"""
