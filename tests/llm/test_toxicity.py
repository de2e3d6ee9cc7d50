import duckdb
import numpy as np

from quirekit.llm import toxicity

AT = "/root/testdata/sf0.1"


def test_held_out(spark):
    got = toxicity.op3_toxicity(spark, AT).toPandas()
    truth = dict(duckdb.sql(f"SELECT doc_id, min(toxic) FROM '{AT}/labels.parquet' GROUP BY 1").fetchall())
    assert len(got) == duckdb.sql(f"SELECT count(*) FROM '{AT}/documents.parquet'").fetchall()[0][0]
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    rows = got[got.held_out & got.doc_id.isin(list(truth))]
    y = rows.doc_id.map(truth).to_numpy()
    assert (y == rows.predicted.to_numpy()).mean() > 0.97
    # Thin languages count as well: toxic documents caught in each.
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{AT}/documents.parquet'").fetchall())
    toxic = rows[y == 1]
    caught = toxic.predicted.groupby(toxic.doc_id.map(lang)).mean()
    assert len(caught) == 4 and caught.min() > 0.6 and toxic.predicted.mean() > 0.85
    assert rows.predicted[y == 0].mean() < 0.02


def test_learns_stems_and_single_words():
    rng = np.random.RandomState(3)
    hasher = toxicity.Hasher()

    def text(bad):
        w = [f"w{i}" for i in rng.zipf(1.3, 80) % 500]
        if bad:
            w.insert(rng.randint(len(w)), "vile" + rng.choice(list("abcdefghijkl")))
        return " ".join(w)

    y = (rng.rand(1200) < 0.3).astype(int)
    docs = hasher([text(b) for b in y])
    net = toxicity.Net().train(docs[:900], y[:900])
    p = net.logits(docs[900:]) > 0
    assert (p == y[900:]).mean() > 0.97
    late = hasher([" ".join(["w1"] * 30_000) + " vilezz"])
    assert net.logits(late)[0] > 0


def test_edges(spark):
    rows = [(1, None, "en", 0), (2, "", "en", 0), (2, "bad", None, 0), (None, "bad", "en", 0), (5, "w " * 50_000, "en", 0)] + [(10 + i, ("good words " if i % 2 else "foul words ") * 3, "en", 0) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(1, None), (None, 1), (5, 0), (5, 7)] + [(10 + i, 1 - i % 2) for i in range(60)], "doc_id long, toxic int")
    got = toxicity.classify(df, labels, "true").collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == 1 - r.doc_id % 2 for r in got if (r.doc_id or 0) >= 10)
    assert {r.score for r in toxicity.classify(df, labels.limit(0), "true").collect()} == {0.0}
    assert toxicity.classify(df.limit(0), labels, "true").count() == 0


def test_calibration_shifts_by_language_and_shrinks():
    rng = np.random.RandomState(1)
    n = 3000
    langs = (rng.rand(n) < 0.3).astype(int)
    z = rng.normal(0, 3, n)
    y = (rng.rand(n) < 1 / (1 + np.exp(-(1.5 * z - 1 - 2 * langs)))).astype(int)
    slope, shifts = toxicity.calibrated(z, y, langs, 3)
    assert abs(slope - 1.5) < 0.25 and abs(shifts[0] + 1) < 0.4 and abs(shifts[1] + 3) < 0.6
    # A language never met has the place common to all.
    assert min(shifts[:2]) < shifts[2] < max(shifts[:2]) + 1
