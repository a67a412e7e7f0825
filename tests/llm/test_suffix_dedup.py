import hashlib
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitspark.llm import suffix_dedup as sd


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for i, d in enumerate(data):
        for p in range(len(d) - length + 1):
            seen.setdefault(d[p:p + length], []).append((i, p))
    cut = [[False] * len(d) for d in data]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                cut[i][p:p + length] = [True] * length
    return [bytes(b for b, c in zip(d, flags) if not c) for d, flags in zip(data, cut)]


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(0, 5))]
        out.append(" ".join(parts))
    out += [out[3], out[3], out[5] + "x", "ab" * 150, "ab" * 90, "a" * 77, "", None, out[7][:len(out[7]) // 2] + "Q" + out[7][len(out[7]) // 2:]]
    return out


def check(spark, texts, length, heavy):
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, kept string, n_bytes int")
    rows = sd.remove_repeats(df, length=length, heavy=heavy).orderBy("doc_id").collect()
    want = brute(texts, length)
    assert [bytes(r["kept"]) for r in rows] == want
    for r, t in zip(rows, texts):
        data = (t or "").encode()
        assert r["n_bytes"] == len(data) and r["n_removed"] == len(data) - len(r["kept"]) == sum(s["end"] - s["start"] for s in r["spans"])
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_against_brute_force(spark):
    check(spark, corpus(1), 40, 20_000)


def test_odd_length_and_other_data(spark):
    check(spark, corpus(2, 40), 31, 20_000)


def test_large_buckets_are_sorted_by_shuffle(spark):
    check(spark, corpus(1), 40, 1)


def test_full_length(spark):
    rng = random.Random(7)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    texts = [base, base[:1500] + "#" + base[1501:], base[500:899], base[500:900], base[500:901] + "zz", "q" * 399, "q" * 400, "q" * 401, "z" * 20_000]
    check(spark, texts, 400, 20_000)


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = "x".join(str(i) for i in range(200))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None)], "doc_id long, text string")
    rows = sd.remove_repeats(df).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in rows) == [(0, 0)] + [(len(text), len(text))] * 3
    assert sd.remove_repeats(df.limit(0)).count() == 0


def test_one_id_with_two_texts_is_two_documents(spark):
    a, b = "x".join(str(i) for i in range(200)), "y".join(str(i) for i in range(200))
    rows = sd.remove_repeats(spark.createDataFrame([(1, a), (1, b), (2, a)], "doc_id long, text string")).collect()
    assert sorted(r["n_removed"] for r in rows) == [0, len(a), len(a)]


def test_null_ids_whose_texts_share_32_bits_are_two_documents(spark):
    shared = "".join(f"{i}," for i in range(200))
    plain = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{j}")), 512) for j in range(5)])
    texts = spark.range(400_000).select(F.when(F.col("id") % 2 == 0, F.concat(F.col("id").cast("string"), F.lit(shared))).otherwise(plain).alias("text"), (F.col("id") % 2).alias("odd"))
    alike = texts.groupBy(F.hash(F.lit(True), "text")).agg(F.max(F.when(F.col("odd") == 0, F.col("text"))).alias("a"), F.max(F.when(F.col("odd") == 1, F.col("text"))).alias("b"))
    a, b = alike.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").first()
    rows = sd.remove_repeats(spark.createDataFrame([(None, a), (None, b), (1, shared)], "doc_id long, text string")).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in rows) == sorted([(len(a), len(shared)), (len(b), 0), (len(shared), len(shared))])
