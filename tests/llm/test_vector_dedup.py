import numpy as np
import pytest

from pitspark.llm import vector_dedup as vd


def brute(vectors, least):
    n = len(vectors)
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if g else None for v, g in zip(vectors, good)]
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, links[i], find(i), find(i) == i) for i in range(n)]


def corpus(seed, n=300, dim=24):
    rng = np.random.default_rng(seed)
    out = []
    for size, noise in [(1, 0)] * (n // 3) + [(40, 0.03), (30, 0.06), (12, 0.09), (60, 0.05), (5, 0.1)]:
        c = rng.normal(size=dim)
        c /= np.linalg.norm(c)
        out += [(c + noise * rng.normal(size=dim)).astype(np.float32).tolist() for _ in range(size)]
    out += [out[5], out[5], [2 * x for x in out[6]], [0.0] * dim, None, [], [float("nan")] * dim, [None] + [1.0] * (dim - 1), [float("inf")] * dim, [1.0, 2.0], [2.0, 4.0], [-1.0, 1.0], [3.0]]
    return out


@pytest.mark.parametrize("seed,leaf,block,rounds", [(1, 512, 2048, 2), (2, 512, 8, 1), (3, 0, 8, 2)])
def test_against_brute_force(spark, seed, leaf, block, rounds):
    vectors = corpus(seed)
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, u string")
    got = [tuple(r) for r in vd.near_duplicates(df, leaf=leaf, block=block, rounds=rounds, pivots=64).orderBy("vec_id").collect()]
    want = brute(vectors, 0.9)
    total, found = sum(w[1] for w in want), sum(g[1] for g in got)
    assert all(g[1] <= w[1] for g, w in zip(got, want)) and found >= 0.9 * total
    if found == total:
        assert got == want


def test_every_pair_with_two_shared_pivots_is_counted_once(spark):
    vectors = corpus(4)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    one = vd.near_duplicates(df, pivots=2, count=2).orderBy("vec_id").collect()  # all vectors of a length share one list
    assert [tuple(r) for r in one] == brute(vectors, 0.9)
    blocks = vd.near_duplicates(df, pivots=2, count=2, leaf=0, block=16, rounds=1).orderBy("vec_id").collect()
    assert blocks == one
    around = vd.near_duplicates(df, pivots=2, count=2, leaf=10_000, block=16).orderBy("vec_id").collect()
    assert around == one


def test_repeated_and_null_ids_and_empty_table(spark):
    a = [1.0, 0.0, 1.0]
    df = spark.createDataFrame([(4, a), (4, a), (2, a), (None, a), (None, None), (9, [0.0, 1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted(((r["vec_id"] or 0), r["n_links"], r["component_id"] or 0, r["kept"]) for r in vd.near_duplicates(df).collect())
    assert got == [(0, 0, 0, True), (0, 3, 2, False), (2, 3, 2, True), (4, 3, 2, False), (4, 3, 2, False), (9, 0, 9, True)]
    assert vd.near_duplicates(df.limit(0)).count() == 0
