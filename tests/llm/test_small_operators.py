"""Token counts, quality rules, toxicity, language-model scoring and mixing against brute force."""
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pitspark.llm import lattice, lm_scoring, mixing, quality, token_counts, toxicity
from pitspark.llm.pieces import MARK, Vocabulary, load
from pitspark.llm.textbytes import slices

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "a", "a a a a", "x y\x0bz\x0c\r\nq", "é è ü \x85  ", "line one\nline one\n\nline two\nline one\n \n ", "\n\n\n", "#*$%&|<> ### x", "🙂 🙂🙂", "w " * 5000, "z" * 30_000]


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß,.") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    return ODD + [rng.choice([" ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(1, 150))) for _ in range(n)]


# token counts

def greedy(word, pieces, longest):
    at = n = 0
    while at < len(word):
        for end in range(min(len(word), at + longest), at, -1):
            if word[at:end] in pieces:
                at, n = end, n + 1
                break
        else:
            return -1
    return n


def test_automaton_counts_what_greedy_matching_cuts():
    rng = random.Random(5)
    for _ in range(60):
        pieces = list({"".join(rng.choice("ab▁c") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 25))})
        automaton = token_counts.Automaton(pieces)
        for _ in range(80):
            word = "".join(rng.choice("ab▁c") for _ in range(rng.randint(0, 25)))
            assert automaton.count(word) == greedy(word, set(pieces), 6)


def test_token_counts_of_the_vocabulary(spark):
    vocabulary = load()
    pieces = set(vocabulary.pieces)
    rows = list(enumerate(texts(1))) + [(0, "again"), (None, "no id")]
    got = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = []
    for i, t in rows:
        counts = [greedy(MARK + w, pieces, vocabulary.longest) for w in WORDS.findall(t or "")]
        want.append((i, len(counts), sum(c if c >= 0 else 1 for c in counts), sum(c < 0 for c in counts)))
    assert [tuple(r) for r in got] == want
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string, n_words int")).count() == 0


# quality rules

def plain_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            repeated |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def test_rule_counts(spark):
    rows = [(i, t, "s") for i, t in enumerate(texts(2))] + [(3, "twice twice", "s"), (None, None, None)]
    model = quality.fit([], np.zeros(0))
    got = quality.score(spark.createDataFrame(rows, "doc_id long, text string, kept string"), model).collect()
    for r, (i, t, _) in zip(got, rows):
        want = plain_counts(t)
        assert (r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (i, *want)
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r["kept"] == (not r["base_failed"])


def test_slices_of_any_size_agree():
    column = pa.array(texts(3))
    whole = [tuple(quality.rule_counts(s)[n][i] for n in quality.COUNTS) for s in slices(column) for i in range(s.count)]
    assert whole == [tuple(quality.rule_counts(s)[n][i] for n in quality.COUNTS) for s in slices(column, size=100) for i in range(s.count)]
    assert [w[0] for w in whole] == [len(WORDS.findall(t.as_py() or "")) for t in column]


def test_counts_do_not_depend_on_neighbours():
    """Tails and heads of few words that meet in every order, in slices of any size."""
    rng = random.Random(9)
    column = ["b c a q b c", "a z z", *(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(400)), *ODD]
    for _ in range(3):
        rng.shuffle(column)
        want = [plain_counts(t) for t in column]
        for size in (1, 7, 100, 1 << 20):
            assert [tuple(quality.rule_counts(s)[n][i] for n in quality.COUNTS) for s in slices(pa.array(column), size=size) for i in range(s.count)] == want


def test_character_grams_count_code_points():
    column = ["", "abc", "abcd", "éßñü", "日本語文字🙂🙂", "aé日🙂b", None]
    for s in slices(pa.array(column)):
        bucket, of = quality.grams(s)[2]
        assert np.bincount(of, minlength=len(column)).tolist() == [max(0, len(t or "") - 3) for t in column]
    (bucket, of), = [quality.grams(s)[2] for s in slices(pa.array(["日本語文", "x", "日本語文", "日本語女"]))]
    assert bucket[0] == bucket[1] != bucket[2]


def labelled(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_quality_on_rows_kept_out_of_the_fit(spark, sf):
    documents, labels = labelled(spark, sf.replace("sf0.001", "sf0.1"))
    model = quality.train(documents, labels.where("doc_id % 3 <> 0"), max_rows=1500)
    rows = quality.score(documents.where("doc_id % 3 = 0"), model).join(labels, "doc_id").where("NOT base_failed").toPandas()
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    assert good.kept.mean() > 0.97 and (1 - bad.kept.mean() > 0.8 or len(bad) < 5)


# toxicity

def test_pooling_takes_the_largest_window():
    rng = np.random.default_rng(1)
    tables = {w: [rng.normal(size=(2 * toxicity.BUCKETS, 2)).astype(np.float32) for _ in range(w)] for w in (1, 2, 3)}
    shift = {w: rng.normal(size=2).astype(np.float32) for w in (1, 2, 3)}
    text = np.repeat([0, 2, 3], [5, 1, 4])
    bucket = rng.integers(0, toxicity.BUCKETS, (10, 2)) + [0, toxicity.BUCKETS]
    got, places = toxicity.pooled(bucket, text, 5, tables, shift, where=True)
    for t in range(5):
        own = bucket[text == t]
        for j, w in enumerate((1, 2, 3)):
            for c in range(2):
                values = [shift[w][c] + sum(tables[w][k][own[i + k]].sum(0)[c] for k in range(w) if i + k < len(own)) for i in range(len(own))]
                best = max([0.0, *values])
                assert got[t, 2 * j + c] == pytest.approx(best, abs=1e-4)
                assert places[j][t, c] == (np.flatnonzero(text == t)[int(np.argmax(values))] if best > 0 else -1)


def test_toxicity_on_rows_kept_out_of_the_fit(spark, sf):
    documents, labels = labelled(spark, sf.replace("sf0.001", "sf0.1"))
    model = toxicity.train(documents, labels)
    rows = toxicity.score(documents, model).join(labels, "doc_id").toPandas()
    rows = rows[[zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]]
    hit = ((rows.predicted == 1) & (rows.toxic == 1)).sum()
    assert hit / (rows.toxic == 1).sum() > 0.6 and hit / (rows.predicted == 1).sum() > 0.8
    assert ((rows.predicted == 1) == (rows.score >= 0.5)).all() and rows.score.between(0, 1).all()


def test_score_reads_the_text_alone(spark):
    model = toxicity.fit([f"good day number {i}" for i in range(40)] + [f"you vile brute {i}" for i in range(40)], np.repeat([0, 1], 40))
    model.thresholds = {"en": 0.0, "de": 2.0}
    rows = [(i, t, l) for i, t in enumerate(["vile brute", "good day", None, "", "..."]) for l in ("en", "de", None)]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r["score"])
    assert all(v == pytest.approx([v[0]] * 3) for v in by.values()) and by[2] == pytest.approx(by[3])
    assert [r["flagged"] for r in got[:3]] == [True, False, got[2]["score"] >= 0.5] and got[0]["score"] > got[3]["score"]
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string, lang string"), toxicity.fit([], np.zeros(0))).count() == 0


# language model

def all_paths(word, p, vocabulary):
    pieces = {x: i for i, x in enumerate(vocabulary.pieces)}
    source = MARK + word
    total = [1.0] + [0.0] * len(source)
    for end in range(1, len(source) + 1):
        for start in range(end):
            part = source[start:end]
            if part in pieces:
                total[end] += total[start] * p[pieces[part]]
            elif end == start + 1:
                total[end] += total[start] * math.prod(p[len(pieces) + b] for b in part.encode())
    return total[-1]


def toy():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "bab", "é", "▁é"]
    return Vocabulary(pieces, np.arange(len(pieces)), -np.arange(len(pieces), dtype=float), list(range(100, 356)))


def test_lattice_sums_all_segmentations():
    v = toy()
    log_p = lattice.prior(v)
    words = ["a", "ab", "abab", "bababab", "éa", "xyz", "a" * 60, "aüb", "b🙂"]
    got = lattice.forward(lattice.build(words, v), log_p)[1]
    for w, g in zip(words, got):
        assert g == pytest.approx(math.log(all_paths(w, np.exp(log_p), v)), rel=1e-9)
    # expected counts are the derivative of the log probability
    times, step = np.arange(1.0, len(words) + 1), 1e-6
    counts = lattice.expected(lattice.build(words, v), log_p, times)
    for i in (0, 2, 3, 4, 8, len(v.pieces) + ord("x")):
        moved = log_p.copy()
        moved[i] += step
        change = (lattice.forward(lattice.build(words, v), moved)[1] - got) / step
        assert counts[i] == pytest.approx((change * times).sum(), rel=1e-4, abs=1e-4)
    assert sorted(np.concatenate(list(lattice.together(words, 40))).tolist()) == list(range(len(words)))


@pytest.mark.parametrize("frequent", [5, 200_000])
def test_scores_of_documents(spark, frequent):
    rng = random.Random(4)
    base = ["alpha", "beta", "Gamma", "delta,", "é", "日本"]
    rows = [(i, " ".join(rng.choice(base) for _ in range(rng.randint(1, 30))), rng.choice(["en", "de", None])) for i in range(60)]
    rows += [(61, None, "en"), (62, "", "en"), (63, "neverseen word", "de"), (5, rows[5][1], rows[5][2]), (None, "alpha", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = lm_scoring.score(df, frequent=frequent, classes=2).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = lambda t: (t or "").encode().lower().decode().split() if t else []
    c = Counter()
    for i, t, _ in rows:
        if not held(i):
            c.update([*tokens(t), "</end>"])
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, held(i), len(tokens(t)) + 1, sum(c[w] > 0 for w in [*tokens(t), "</end>"]), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*tokens(t), "</end>"]), 6)) for i, t, _ in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    same = [r["score"] for r in got if r["doc_id"] == 5]
    assert len(same) == 2 and same[0] == pytest.approx(same[1])


def test_token_probabilities_sum_to_one(spark):
    words = spark.createDataFrame([("a", 5, 0, 6), ("ab", 1, 2, 3), ("bab", 0, 0, 2), ("b", 2, 2, 4), ("aa", 1, 1, 2)], "word string, c0 long, c1 long, n long")
    of = lm_scoring.totals(words, [3, 2])
    assert [(t.tokens, t.distinct, t.texts) for t in of] == [(12, 4, 3), (7, 3, 2)]
    log_p = lm_scoring.learn(words, 2)
    assert all(np.exp(p).sum() == pytest.approx(1) for p in log_p)
    rows = lm_scoring.word_scores(words, log_p, of).collect()
    for k, t in enumerate(of):
        # seen words get their discounted counts, the rest of the mass goes to spellings, the end has its own
        spelt = {r["word"]: 10 ** r[f"p{k}"] - max([w for w in [(5, 0), (1, 2), (0, 0), (2, 2), (1, 1)]][["a", "ab", "bab", "b", "aa"].index(r["word"])][k] - t.discount, 0) / t.tokens for r in rows}
        freed = t.discount * t.distinct / t.tokens
        assert all(0 < s < freed for s in spelt.values())


def test_without_training_rows_and_empty_table(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(1, "one two", "en"), (2, None, "en")], "doc_id long, text string, lang string")
    rows = {r["doc_id"]: r for r in lm_scoring.score(df, train=F.lit(False)).collect()}
    assert rows[1]["train_tokens"] == 0 and rows[1]["n_known"] == 0 and rows[1]["score"] < rows[2]["score"] < 0
    assert lm_scoring.score(df.limit(0)).count() == 0


# mixing

def mix_rows(spark, rows):
    return mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_mix_equals_its_sql(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([None, "", "w " * rng.randint(1, 400), "one"]), rng.choice(["a"] * 5 + ["b", "c", "dé", "Z", None])) for i in range(400)]
    got = sorted(tuple(r) for r in mix_rows(spark, rows).select("doc_id", "size", "source_size", "target", "taken").collect())
    documents = pa.table({"doc_id": [r[0] for r in rows], "text": pa.array([r[1] for r in rows], pa.string()), "source": pa.array([r[2] for r in rows], pa.string())})  # noqa: F841
    want = sorted(duckdb.sql(mixing.MIX_SQL).fetchall())
    assert [(g[0], g[1], g[2], g[4]) for g in got] == [(w[0], w[1], w[2], w[4]) for w in want]
    assert all(g[3] == pytest.approx(w[3], rel=1e-12) for g, w in zip(got, want))


def test_targets_and_what_is_taken(spark):
    rng = random.Random(2)
    sizes = {"a": 60_000, "b": 3_000, "c": 500, "d": 20_000, "e": 40, None: 9_000}
    rows = []
    for source, n in sizes.items():
        left = n
        while left > 0:
            k = min(left, rng.choice([1, 7, 90, 700]))
            rows.append((len(rows), "w " * k, source))
            left -= k
    got = mix_rows(spark, rows).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
    weight = {"a": 1, "b": 2, "c": 3, "d": 1, "e": 2, None: 3}
    capped, level = set(), 0
    while True:
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in sizes if s not in capped)
        more = {s for s in sizes if level * weight[s] > 3 * sizes[s]}
        if more == capped:
            break
        capped = more
    for s in sizes:
        want = 3 * sizes[s] if s in capped else level * weight[s]
        assert target[s] == pytest.approx(want) and abs(taken[s] - want) <= max(0.02 * want, 3)


def test_the_mix_itself(spark):
    rows = [(i, "w " * (i % 50), "ab"[i % 5 == 0]) for i in range(300)] + [(1, "w ", "b"), (1, "w ", "b"), (None, "x y", None), (None, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed(df)
    assert out.columns == df.columns
    times = Counter(tuple(r) for r in out.collect())
    assert set(times) <= set(rows) and all(t <= 3 * rows.count(r) for r, t in times.items())
    assert Counter(tuple(r) for r in mixing.mixed(df).collect()) == times
    assert mixing.mixed(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def test_schedule_is_even_at_every_moment(spark):
    rows = [(i, "w " * 40, "abc"[i % 3]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("doc_id", "concat('s', source) AS key", "source", "40L AS size", "0L AS tie")
    slots = mixing.schedule(mixing.plan(docs)).orderBy("slot").collect()
    seen, n = Counter(), len(slots)
    share = Counter(r["key"] for r in slots)
    for i, r in enumerate(slots, 1):
        seen[r["key"]] += 1
        assert all(abs(seen[k] - i * share[k] / n) < 8 for k in share)
    assert max(share.values()) / min(share.values()) == pytest.approx(3, rel=0.05)


def test_fits_leave_their_rows_in_the_executors(spark, sf, monkeypatch):
    """No row of a training set comes to the driver, and where the slices stand does not matter."""
    documents, labels = labelled(spark, sf.replace("sf0.001", "sf0.01"))
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toPandas", lambda self: pytest.fail("a table was taken to the driver"))
    one, other = (quality.train(d, labels, max_rows=150) for d in (documents, documents.repartition(7)))
    assert np.abs(one.weights - other.weights).max() < 1e-6 and one.slope == pytest.approx(other.slope)
    assert one.weights.any()


def test_toxicity_learns_from_every_labelled_row(spark):
    """Every row that may be learnt from is in the fit, and a word that a few of many toxic rows hold is learnt."""
    rows = [(i, f"good day number {i % 97} of a year", "en", 0) for i in range(9000)] + [(i, f"you brute {i % 89}", "en", 1) for i in range(9000, 13000)]
    few = [(20000 + i, f"zorble {i}", "de", 1) for i in range(400)]
    rows = [r for r in rows + few if zlib.crc32(str(r[0]).encode()) % 5]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    taken, values = [], toxicity.fit_slices
    toxicity.fit_slices = lambda parts: (taken.append(parts.total(toxicity._tally, None, 4, 1.0).sum()), values(parts))[1]
    try:
        model = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"))
    finally:
        toxicity.fit_slices = values
    assert taken == [len(rows)]
    new = spark.createDataFrame([(1, "zorble", "en"), (2, "good day", "en"), (3, "brute", "en")], "doc_id long, text string, lang string")
    assert [r["predicted"] for r in toxicity.score(new, model).orderBy("doc_id").collect()] == [1, 0, 1]


def test_thresholds_are_the_best_of_all_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(["en", "de", "fr", None][i % 4], float(p), int(rng.random() < p) if i % 4 != 2 else 0) for i, p in enumerate(np.round(rng.random(2000), 2) + 0.00005)]
    got = toxicity.best_thresholds(spark.createDataFrame(rows, "lang string, score double, toxic int"))
    assert set(got) == {"en", "de"}
    for lang, at in got.items():
        p, y = np.array([r[1] for r in rows if r[0] == lang]), np.array([r[2] for r in rows if r[0] == lang])
        f1 = lambda t: 2 * y[p >= t].sum() / ((p >= t).sum() + y.sum())
        assert f1(at) == pytest.approx(max(f1(t) for t in p))


def test_labels_go_to_the_texts(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"good day number {i}" if i % 2 else f"you vile brute {i}", "en", 1 - i % 2) for i in range(60)], "doc_id long, text string, lang string, toxic int")
    labels = df.select("doc_id", "toxic").union(spark.createDataFrame([(4, 0), (500, 1), (None, 1), (5, None), (6, 7)], "doc_id long, toxic int"))
    plans, kept = [], toxicity.written
    monkeypatch.setattr(toxicity, "written", lambda x: (plans.append(x._jdf.queryExecution().executedPlan().toString()), kept(x))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        toxicity.train(df.drop("toxic"), labels)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans and "SortMergeJoin" not in plans[0] and "hashpartitioning" not in plans[0]


def test_labels_in_several_parts(spark):
    df = spark.createDataFrame([(i, f"text {i}" if i else None, "en") for i in range(40)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i % 30, i % 2) for i in range(50)] + [(None, 1)], "doc_id int, toxic int")
    rows = [sorted(toxicity.labelled(df, labels, F.col("doc_id") != 7, most=most).collect()) for most in (1_000, 9, 1)]
    assert rows[0] == rows[1] == rows[2] == sorted((f"text {i % 30}", "en", i % 2) for i in range(50) if i % 30 not in (0, 7))
