import math

import duckdb
import numpy as np

from quirekit.llm import langid

AT = "/root/testdata/sf0.01"


def all_segmentations(word, prob):
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, len(word) + 1):
        if word[:k] in prob:
            total += prob[word[:k]] * all_segmentations(word[k:], prob)
        elif k == 1:
            total += math.exp(langid.UNKNOWN) * all_segmentations(word[k:], prob)
    return total


def test_forward_sums_all_segmentations():
    vocabulary = langid.pieces(langid.default_path())
    lookup = langid.Lookup(vocabulary)
    rng = np.random.RandomState(1)
    probs = rng.dirichlet(np.ones(len(vocabulary)), 2).T
    words = ["the", "a", "thering", "ñandú", "東京x", "zqxj", "über", "thererination", max(vocabulary, key=lambda p: len(p) * p.isalpha()), "ab" * 40]
    assert len(words[-2]) > 12
    logs = langid.word_logs(lookup, words, probs)
    for l in range(2):
        prob = dict(zip(vocabulary, probs[:, l]))
        for w, got in zip(words[:-1], logs[:-1, l]):
            assert abs(got - math.log(all_segmentations("▁" + w, prob))) < 1e-9
    assert np.isfinite(logs).all()


def test_expected_uses_cover_every_letter():
    vocabulary = langid.pieces(langid.default_path())
    lookup = langid.Lookup(vocabulary)
    probs = np.full(len(vocabulary), 1 / len(vocabulary))
    uses, total = langid.expected(lookup, ["thering", "on"], np.array([3.0, 2.0]), probs)
    assert abs(total - langid.word_logs(lookup, ["thering", "on"], probs[:, None])[:, 0] @ [3, 2]) < 1e-9
    assert abs((uses * [len(p) for p in vocabulary]).sum() - (3 * 8 + 2 * 3)) < 1e-4  # the start sign alone is no piece


def test_held_out_accuracy(spark):
    got = langid.op4_language(spark, AT).toPandas()
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{AT}/documents.parquet'").fetchall())
    assert len(got) == len(truth) and got.score.between(0, 1).all()
    rows = got[got.held_out]
    assert (rows.doc_id.map(truth) == rows.lang_pred).mean() > 0.97


def test_edges(spark):
    rows = [(1, None, "en", 0), (2, "", "en", 0), (3, "123 !?", "en", 0), (4, "the house", "en", 0), (5, "das haus", "de", 0), (None, "das haus", None, 0), (6, "x" * 60_000, None, 0), (4, "the house", "en", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = sorted((r.doc_id or 0, r.lang_pred, r.score) for r in langid.predict(df, "true").collect())
    assert [g[:2] for g in got] == [(0, "de"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "de"), (6, got[-1][1])]
    assert {r.lang_pred for r in langid.predict(df, "false").collect()} == {"und"}
    assert langid.predict(df.limit(0), "true").count() == 0


def test_a_language_never_learned_scores_low(spark):
    rng = np.random.RandomState(2)
    text = lambda parts, n: " ".join("".join(rng.choice(parts, rng.randint(1, 5))) for _ in range(n))
    known = {"aa": ["the", "ing", "and", "tion", "er"], "bb": ["sch", "ung", "heit", "ge", "ein"]}
    rows = [(i, text(known[k], 60), k) for i, k in enumerate(["aa", "bb"] * 60)]
    rows += [(1000, text(["kw", "zu", "mbi", "ng'o", "xh"], 60), None), (1001, text(known["aa"], 12), None), (1002, "東京都は日本の首都である" * 5, None)]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "true").collect()}
    assert got[1000].score < 0.5 and got[1002].score < 0.5 and got[1001].score > 0.5 and got[1001].lang_pred == "aa"
    assert all(got[i].score > 0.5 and got[i].lang_pred == k for i, _, k in rows[:120])
