import random

import pytest
import sentencepiece as library
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from pitspark.llm import sentencepiece as sp
from pitspark.llm.pieces import DEFAULT_MODEL, load

TEXTS = ["The quick brown fox, it jumps.", "word", " lead", "two  spaces   three", "line\nbreak\n\n tab\there", "Ünïcödé ñandú größe", "日本語 text 🙂 done 🙂🙂", "literal ▁ mark ▁▁", " nbsp", "a" * 300, "x" * 50 + " " * 40 + "y", "ing" * 500,
         "", None, " ", "\n", "\r\n", "0123 4567.89, $5 #%&*", "the the the the", "\x00\x01 control", "É é"]


def best_path(text, vocabulary):
    """Viterbi over the whole text, character by character; of equal scores the longer last piece."""
    source = " " + text
    score_of = {p: (float(s), int(i)) for p, s, i in zip(sp.source_pieces(vocabulary), vocabulary.scores, vocabulary.ids)}
    lowest = float(vocabulary.scores.min() - sp.PENALTY)
    best = [(0.0, None, None)]
    for end in range(1, len(source) + 1):
        options = []
        for start in range(max(0, end - vocabulary.longest), end):
            piece = source[start:end]
            if piece in score_of:
                options.append((best[start][0] + score_of[piece][0], -start, [score_of[piece][1]]))
            elif end == start + 1:
                options.append((best[start][0] + lowest, -start, [vocabulary.byte_ids[b] for b in piece.encode()]))
        best.append(max(options, key=lambda o: o[:2]))
    out, at = [], len(source)
    while at:
        out = best[at][2] + out
        at = -best[at][1]
    return out if text else []


@pytest.mark.parametrize("frequent", [1, 40])
def test_ids_are_the_best_path_of_the_whole_text(spark, frequent):
    rng = random.Random(1)
    words = [p.strip("▁") for p in load().pieces if p.isascii()][300:900]
    texts = TEXTS + [" ".join(rng.choice(words) + rng.choice(["", ",", ".", "-", "\n"]) for _ in range(rng.randint(1, 80))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = sp.encode(df, frequent=frequent).orderBy("doc_id").collect()
    assert all(r["exact"] for r in rows) and len(rows) == len(texts)
    back = sp.decode(sp.encode(df, frequent=frequent).select("doc_id", "ids")).orderBy("doc_id").collect()
    assert [r["text"] for r in back] == [t or "" for t in texts]
    for r, t in zip(rows, texts):
        assert r["ids"] == best_path(t or "", load()) and r["n_pieces"] == len(r["ids"])


@pytest.mark.parametrize("block", [16, 37])
def test_words_of_many_blocks_are_the_best_path(spark, block):
    rng = random.Random(3)
    texts = [" " * 500, "=" * 333, "-" * 64, "x" * 65, "".join(rng.choice("eai nrt") for _ in range(700)), "".join(rng.choice("the ") for _ in range(200)), "日" * 90 + "ing" * 60, "ab" * 200, "\n" * 128, "é" * 100 + "a" * 100, "short one", "🙂" * 40 + "  " * 60]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, texts[0]), (99, texts[0])], "doc_id long, text string")
    rows = sp.encode(df, block=block).orderBy("doc_id").collect()
    assert all(r["exact"] for r in rows) and len(rows) == len(texts) + 2
    for r, t in zip(rows, [*texts, texts[0], texts[0]]):
        assert r["ids"] == best_path(t, load())


def test_a_run_of_a_million_characters(spark):
    n = 1_000_000
    df = spark.createDataFrame([(1, " " * n), (2, "=" * n + " end"), (3, "a b")], "doc_id long, text string")
    rows = sp.encode(df).orderBy("doc_id").collect()
    assert all(r["exact"] for r in rows)
    # what takes 5,000 characters takes a million, but for the ends
    small = [best_path(" " * 5_000, load()), best_path("=" * 5_000 + " end", load())]
    for r, want in zip(rows, small):
        assert sum(i == want[150] for i in r["ids"]) > 0.9 * len(r["ids"]) and abs(r["n_pieces"] / n - len(want) / 5_000) < 0.001


def test_keys_of_long_words_cannot_be_made_to_agree():
    """The Thue-Morse word and its complement agree under every polynomial hash modulo 2**64."""
    word = "a"
    while len(word) < 2_048:
        word += word.translate(str.maketrans("ab", "ba"))
    import numpy as np
    import pyarrow as pa

    from pitspark.llm.textbytes import slices
    (s,) = slices(pa.array([word, word.translate(str.maketrans("ab", "ba"))]))
    first, second, _, back = sp.keys(s, s.start, s.end)
    assert len(first) == len(set(second.tolist())) == 2 and back[0] != back[1] and len(np.unique(s.hash.of(s.start, s.end))) == 1


def test_agrees_with_the_library_on_the_same_scores(spark):
    proto = sentencepiece_model_pb2.ModelProto()
    with open(DEFAULT_MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = sentencepiece_model_pb2.TrainerSpec.UNIGRAM
    # the library adds scores as 32-bit numbers, so place the lowest where that is exact
    for p in proto.pieces:
        p.score = max(p.score, -40_000.0)
    reference = library.SentencePieceProcessor(model_proto=proto.SerializeToString())
    texts = ["The quick brown fox jumps over it.", "training data for language models", "some  spaces", "line\nbreak", "and that was the thing"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["ids"] for r in sp.encode(df).orderBy("doc_id").collect()]
    score = {int(i): float(s) for i, s in zip(load().ids, load().scores)}
    for ids, text in zip(got, texts):
        want = reference.encode(text)
        weigh = lambda path: sum(max(score.get(i, -1e9), -40_000.0) for i in path)
        assert ids == want or weigh(ids) == weigh(want)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one two"), (1, "other")], "doc_id long, text string")
    rows = sp.encode(df, frequent=1).collect()
    assert sorted((r["doc_id"] or 0, r["n_pieces"]) for r in rows) == sorted([(0, len(best_path("one two", load()))), *[(1, len(best_path("one two", load())))] * 2, (1, len(best_path("other", load())))]) and all(r["exact"] for r in rows)
    assert sp.encode(df.limit(0)).count() == 0


def test_decoding_of_no_ids(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, [], "y")], "doc_id long, ids array<int>, text string")
    assert [tuple(r) for r in sp.decode(df).orderBy("doc_id").collect()] == [(1, ""), (2, "")]


def test_packing():
    import numpy as np
    numbers = np.array([0, 1, 127, 128, 16_383, 16_384, 2_097_151, 2_097_152, (1 << 28) - 1] * 3)
    code, size = sp._pack(numbers)
    assert sp._unpack(code.tobytes()).tolist() == numbers.tolist() and size.sum() == len(code)


def test_templates_are_smaller_in_the_shuffle():
    import numpy as np
    rng = random.Random(5)
    codes = [sp._pack(np.array([int(rng.paretovariate(0.6)) % (1 << 20) for _ in range(n)], np.int64))[0].tobytes() for n in (0, 1, 2, 400, 5000)]
    squeezed = [sp._squeezed(c) for c in codes]
    assert [sp._expanded(c) for c in squeezed] == codes
    assert len(squeezed[-1]) < 0.95 * len(codes[-1])


def test_words_become_edges_in_small_parts(spark, monkeypatch):
    name, seen, kept = "spark.sql.adaptive.advisoryPartitionSizeInBytes", [], sp.written
    monkeypatch.setattr(sp, "written", lambda df: (seen.append(spark.conf.get(name)), kept(df))[1])
    before = spark.conf.get(name)
    monkeypatch.setattr(sp, "TEXTS", 3)
    df = spark.createDataFrame([(i, f"word {i % 7} and number {i}") for i in range(20)], "doc_id long, text string")
    counted = {r["word"]: r["n"] for r in sp.word_table(df, sp.DEFAULT_MODEL).collect()}
    assert counted[" word"] == counted[" number"] == 20
    assert sp.encode_words(sp.word_table(df, sp.DEFAULT_MODEL)).count() == len(counted)
    assert seen and seen[0] == sp.PART and spark.conf.get(name) == before
