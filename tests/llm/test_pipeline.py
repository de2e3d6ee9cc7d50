import random

import corpus_pipeline
from quirekit.llm import common


def corpus():
    rng = random.Random(8)
    vocabulary = {lang: [f"{a}{b}{c}" for a in parts for b in parts for c in parts] for lang, parts in (("en", ["the", "ing", "and", "tion", "er", "on", "sh"]), ("de", ["sch", "ung", "ein", "heit", "ge", "ch", "über"]))}
    text = lambda lang, n: rng.choices(vocabulary[lang], k=n)
    rows, shared = [], text("en", 70)
    for i in range(200):
        lang = "en" if i % 3 else "de"
        w = text(lang, rng.randrange(80, 200))
        if i % 20 == 4:
            w += shared
        if i % 10 == 6:
            w.insert(5, "password=" + "".join(rng.choices("0123456789abcdef", k=18)))
        rows.append([i, " ".join(w), lang, f"src{i % 7}", 0])
    for i in range(30):
        w = rows[i][1].split()
        w[-1] = "changed"
        rows.append([1000 + i, " ".join(w), rows[i][2], "copy", 0])
    rows += [[2000, None, "en", "s", 0], [2001, "12 34", "en", "s", 0], [2002, "", None, None, None]]
    return rows, " ".join(shared)


def test_stage_by_stage(spark):
    rows, shared = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.save(stage(spark, docs, None), name)
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in seen["language"]} == {r[0] for r in rows} - {2000, 2001, 2002}
    assert {r.doc_id for r in seen["near_duplicates"]} == set(range(200))
    holding = [r.doc_id for r in seen["repeated_passages"] if shared in r.text]
    assert holding == [4] and len(seen["repeated_passages"]) == 200
    assert not any("password=" in r.text for r in seen["secrets"])
    assert sum("[SECRET]" in r.text for r in seen["secrets"]) == 20
    packed = seen["packing"]
    assert sum(r.size for r in packed) == sum(len(r.text.split()) for r in seen["secrets"])
    assert {r.doc_id for r in packed} == set(range(200))


def test_near_duplicates_judge_rows_by_their_text(spark):
    rng = random.Random(3)
    one, two, three = (" ".join(rng.choices([f"w{i}" for i in range(500)], k=60)) for _ in range(3))
    near = three.rsplit(" ", 1)[0] + " changed"
    rows = [(1, one), (5, one), (5, two), (5, two), (7, three), (7, near), (8, three), (9, None), (9, None), (9, ""), (None, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _gone", "2 AS gone", "3 AS _n", "4 AS number", "5 AS ident", "6 AS code", "7 AS kept", "8 AS group", "map(1, 2) AS m")
    out = corpus_pipeline.near_duplicates(spark, docs, None)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    keeper = {(7, three), (7, near)} & set(got)
    assert len(keeper) == 1
    assert got == sorted([(1, one), (5, two), *keeper, (9, None), (9, None), (9, ""), (None, one)], key=str)


def test_stages_on_clashing_names_ties_and_empty_tables(spark):
    rows, _ = corpus()
    rows += [rows[0], rows[1], [5, "another text of five that is unlike all others " * 3, "en", "s", 0], [3000, "the " * 40_000, "en", "s", 0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ("_key", "_repeats", "_gone", "_n", "key", "repeats", "h", "n", "node", "seed", "first", "kept", "group", "salt", "score", "cluster", "size", "shard", "spans")
    docs = docs.selectExpr("*", *[f"{i} AS {n}" for i, n in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), None)
        assert none.count() == 0
        docs_out = common.save(stage(spark, docs, None), name)
        if name != "packing":
            assert docs_out.columns == docs.columns and none.columns == docs.columns
        docs = docs_out
    assert docs.count() >= 200
