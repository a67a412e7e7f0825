"""Ranked search, language identification and importance resampling against plain Python."""
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pitspark.llm import language_id, lattice, lexical_search, resampling
from pitspark.llm.pieces import MARK, Vocabulary, load
from pitspark.llm.textbytes import slices

ODD = [None, "", " \n\t", "a", "A a\nb A", "é È ü \x85  ", "line one\nline one\n\nline two\nline one\n \n ", "\n\n\n", "### $$$", "🙂 🙂🙂 x", "w " * 3000, "z" * 20_000, "Word-word_word's 12,5"]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def texts(seed, n=120, newline=True):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    line = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(30)]
    return ODD + [(rng.choice(["\n", ". \n", "\n\n"]) if newline else " ").join(rng.choice(line) if rng.random() < 0.6 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 12))) for _ in range(n)]


# ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, k=10):
    found = [(i, Counter(map(lower, TERM.findall(t or "")))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n, all_ = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        want = Counter(map(lower, TERM.findall(text or "")))
        scores = []
        for i, c in found:
            m = 25 + 75 * sum(c.values()) * n // all_
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in want.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize("items_of_block,forest", [(1_024, 8_192), (3, 20)])
def test_search_is_the_plain_ranking(spark, monkeypatch, items_of_block, forest):
    for name, value in (("BLOCK_ITEMS", items_of_block), ("FOREST", forest), ("ITEM_LEAF", 2), ("DOC_LEAF", 4), ("ROUND", 8)):
        monkeypatch.setattr(lexical_search, name, value)
    docs = [(i, t) for i, t in enumerate(texts(3))] + [(500 + i, "copy of a copy éß") for i in range(40)] + [(7, "a b same id"), (7, "a b same id"), (None, "a b no id"), (None, "copy of a copy éß")]
    items = [(i, t) for i, t in enumerate(texts(4, 20)[:30])] + [(90, "copy copy of"), (90, "a"), (None, "no id"), (91, "nothing-matches zzzz")]
    docs_df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, score int").repartition(5)
    items_df = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    got = [tuple(r) for r in lexical_search.search(docs_df, items_df, seed_share=4).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0, r[3])
    assert sorted(got, key=key) == sorted(plain_search(docs, items), key=key)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(0)
    names = [f"t{i}" for i in range(400)]
    items = [Counter(names[j].encode() for j in rng.integers(i, i + 12, 30)) for i in range(0, 360, 3)]
    block = lexical_search.Block.of(list(enumerate(items)))
    weight = rng.integers(1, 9000, len(block.names))
    tree = lexical_search.Items(block, weight)
    found = lexical_search.Search(tree, np.zeros(len(items), np.int64), 5, pa.int64())
    where = rng.integers(0, len(block.names) - 8, 4000)
    row = np.repeat(np.arange(4000), 8)
    term = (where[:, None] + np.arange(8)).ravel()
    value = rng.integers(1, 900_000, len(row))
    found.add(pa.array(np.arange(4000)), row, term, value)
    full = np.zeros((4000, len(block.names)), np.int64)
    full[row, term] = value
    wanted = np.zeros((len(items), len(block.names)), np.int64)
    np.add.at(wanted, (block.item, block.term), block.times * weight[block.term])
    exact = wanted @ full.T
    for place, item in enumerate(tree.number):
        mine = found.best.filter(pa.array(found.best["item"].to_numpy() == place))["id"].to_pylist()
        assert mine == sorted(np.flatnonzero(exact[item] > 0), key=lambda d: (-exact[item][d], d))[:5]
    assert found.scored < 0.3 * exact.size


def test_long_terms_are_told_apart_and_large_scores_stay_exact(spark):
    long = "x" * 5_000
    docs = spark.createDataFrame([(1, long), (2, long + "y"), (3, "q")], "doc_id long, text string")
    items = spark.createDataFrame([(1, long + "y"), (2, "q " * 400_000)], "item_id long, text string")
    got = {(r["item_id"], r["doc_id"]): r["score"] for r in lexical_search.search(docs, items).collect()}
    want = {(r[0], r[2]): r[3] for r in plain_search([(1, long), (2, long + "y"), (3, "q")], [(1, long + "y"), (2, "q " * 400_000)])}
    assert got == want


def test_search_in_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == lexical_search.search(docs, items.limit(0)).count() == 0
    assert lexical_search.search(docs.withColumn("text", F.lit(None).cast("string")), items).columns == ["item_id", "rank", "doc_id", "score"]


# language identification

def test_forward_sums_all_segmentations():
    rng = random.Random(2)
    pieces = sorted({"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))) for _ in range(25)})
    vocabulary = Vocabulary(pieces, np.arange(len(pieces)), np.zeros(len(pieces)), list(range(256)))
    p = np.random.default_rng(1).random((3, lattice.symbols(vocabulary)))
    log_p = np.log(p / p.sum(1, keepdims=True))
    batch = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(40)] + ["é", "a日b"]
    got = language_id.likelihood(batch, vocabulary, log_p)
    for w, row in zip(batch, got, strict=True):
        text, total = MARK + w, np.zeros(3)
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
            weight = np.ones(3)
            for a, b in itertools.pairwise(at):
                part = text[a:b]
                if part in pieces:
                    weight *= np.exp(log_p[:, pieces.index(part)])
                elif b == a + 1:
                    weight *= np.exp(log_p[:, [len(pieces) + x for x in part.encode()]].sum(1))
                else:
                    weight *= 0
            total += weight
        assert np.allclose(row, np.log(total) + log_p[:, -1])


def test_words_of_long_runs():
    column = ["a b", "x" * 64, "x" * 65, "é" * 100, "日本語" * 50 + " tail", None, "ab " * 100, "🙂" * 40]
    for size in (50, 1 << 20):
        for s in slices(pa.array(column), size=size):
            start, end, of = language_id.words(s)
            for i in range(s.count):
                mine = [s.data[a:b].tobytes().decode() for a, b, t in zip(start, end, of) if t == i]
                assert "".join(mine) == re.sub(r"[\x20\x09-\x0D]+", "", column[s.first + i] or "") and all(0 < len(w.encode()) <= 67 for w in mine)


def held_out_share(spark, sf, rows):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    names, log_p = language_id.learn(documents.where(~held).select(F.col("doc_id").alias("id"), "lang", "text"), rows=rows)
    assert names == ["de", "en", "es", "fr"] and np.allclose(np.exp(log_p).sum(1), 1)
    return language_id.predict(documents, names, log_p, keep=("doc_id", "lang")).where(held).toPandas()


def test_languages_of_rows_kept_out(spark, sf):
    got = held_out_share(spark, sf.replace("sf0.001", "sf0.01"), 60)
    known = got[got.lang_pred != "und"]
    assert (known.lang == known.lang_pred).mean() > 0.98 and known.score.between(0.25, 1).all()


def test_language_of_odd_rows(spark):
    rows = [(1, "the and of", "en"), (2, "der die und das", "de"), (3, "the cat of the house", "en"), (4, "und der das", "de"), (5, None, "xx"), (6, "der", None)]
    names, log_p = language_id.learn(spark.createDataFrame(rows, "id long, text string, lang string"))
    assert names == ["de", "en"]
    odd = [(1, None, "a"), (1, None, "a"), (2, "", "a"), (3, " 12 #!", "a"), (None, "the house", "a"), (4, "das der und", "a"), (5, "é" * 30_000, "a"), (6, "日本語", "a"), (7, "x" * 200_000, "a")]
    df = spark.createDataFrame(odd, "doc_id long, text string, score string")
    got = language_id.predict(df, names, log_p).collect()
    assert [(r["doc_id"], r["lang_pred"] == "und") for r in got] == [(i, t is None or not any(c.isalpha() for c in t)) for i, t, _ in odd]
    assert [r["lang_pred"] for r in got][4:6] == ["en", "de"] and all(0 <= r["score"] <= 1 for r in got)
    assert language_id.predict(df.limit(0), names, log_p).count() == 0
    none = language_id.learn(spark.createDataFrame([(1, "a", None)], "id long, text string, lang string"))
    assert {(r["lang_pred"], r["score"]) for r in language_id.predict(df, *none).collect()} == {("und", 0.0)}


# importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_resampling(docs, target, most=1, buckets=10_000, percent=10):
    def features(text):
        w = WORD.findall(lower(text))
        return len(w), [zlib.crc32(" ".join(w[i: i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(w) - n + 1)]
    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for i, words, f in found:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= 20])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    rank = {id(r): n for n, r in enumerate(able[: percent * len(able) // 100], 1)}
    return [(*r[:4], rank.get(id(r))) for r in rows]


@pytest.mark.parametrize("most,buckets", [(1, 10_000), (1, 50), (3, 10_000), (4, 100_000)])
def test_resampling_is_the_plain_one(spark, most, buckets):
    docs = [(i, t) for i, t in enumerate(texts(5))] + [(3, "same id"), (200, texts(5)[20]), (200, texts(5)[20]), (None, texts(5)[22]), (None, texts(5)[22]), (None, None)]
    target = texts(6, 15) + [None, ""]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, rank int").repartition(3)
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    got = [tuple(r) for r in resampling.score(df, aims, most=most, buckets=buckets, percent=30).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(plain_resampling(docs, target, most, buckets, 30), key=key)


def test_words_from_features():
    for most in (1, 2, 3, 5):
        rows = [(w, sum(max(0, w - n + 1) for n in range(1, most + 1))) for w in range(40)]
        import pandas as pd  # noqa: F401
        from pyspark.sql import SparkSession
        df = SparkSession.getActiveSession().createDataFrame(rows, "w long, n long")
        assert all(r["w"] == r["x"] for r in df.withColumn("x", resampling.words_of(F.col("n"), most)).collect())


def test_crc_of_ranges():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5_000).astype(np.uint8)
    start = rng.integers(0, 4_000, 300)
    end = start + rng.integers(0, 300, 300)
    whole = resampling.crc_of(data, start, end)
    assert [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end)] == whole.tolist()
    assert [zlib.crc32(data[a: b + 70].tobytes()) for a, b in zip(start, end)] == resampling.crc_of(data, end, end + 70, whole).tolist()


def test_drawn_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 50}" for j in range(30)), "s") for i in range(50)], "doc_id long, text string, weight string")
    aims = docs.limit(3).select("text")
    drawn = resampling.resample(docs, aims, percent=20)
    assert drawn.count() == 10 and drawn.columns == docs.columns
    assert resampling.score(docs.limit(0), aims).count() == 0
    assert resampling.score(docs, aims.limit(0)).count() == 50


def test_sql_of_the_queries(spark, sf):
    """The registered SQL agrees with the operators on the smallest tables."""
    from pitspark.llm import queries
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name in ("op11_lexical_search", "op13_resampling"):
        got = queries.QUERIES[name](spark, sf)
        want = con.execute(queries.ORACLES[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(got.columns)
        key = lambda r: tuple((x is None, x or 0) for x in r)
        assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key)
    assert load().longest > 1
