import random

import duckdb
import numpy as np

from quirekit.llm import topk


def brute(rows, k):
    seen = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        seen.setdefault(i, []).append([int(np.floor(1024.0 * x)) for x in v])
    out = []
    for q in (i for i in seen if i % 100 == 0):
        a = min(seen[q])
        best = []
        for i, vs in seen.items():
            scores = [sum(x * y for x, y in zip(a, v)) for v in vs if len(v) == len(a)]
            if i != q and scores:
                best.append((-max(scores), i))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(best)[:k])]
    return sorted(out)


def test_matches_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    base = [rng.gauss(0, 1) for _ in range(8)]
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(700)]
    rows += [(1000 + i, base) for i in range(60)] + [(2000, base), (2000, base), (2000, base[::-1]), (100, None)]
    rows += [(3000, []), (3100, [None] * 8), (3200, [float("nan")] * 8), (3300, [float("inf")] * 8), (None, base), (3400, base[:3]), (3401, base[:3]), (3500, [1e12] * 8), (3501, [-1e12] * 8)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, rank string").repartition(5)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    got = sorted(map(tuple, topk.top_k(df.where("vec_id % 100 = 0"), df, 10).collect()))
    assert got == brute(rows, 10)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_oracle(spark):
    at = "/root/testdata/sf0.001"
    got = sorted(map(tuple, topk.op1_top_k(spark, at).select("query_id", "rank", "vec_id", "score").collect()))
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{at}/embeddings.parquet'")
    assert got == sorted(duckdb.sql(topk.ORACLE).fetchall())


def test_an_id_on_several_vectors_counts_once(spark):
    rng = random.Random(4)
    rows = [(0, [1.0, 1.0])] + [(7, [3.0 - i / 10, 3.0]) for i in range(2)] + [(10 + i, [rng.random(), rng.random()]) for i in range(13)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = sorted(map(tuple, topk.top_k(df.where("vec_id % 100 = 0"), df, 10).collect()))
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], 10)
    assert got == want and sum(q == 0 for q, *_ in got) == 10


def test_oracle_merges_repeated_ids(spark, tmp_path):
    rows = [(0, [1.0, 1.0]), (0, [0.5, 2.0]), (7, [3.0, 3.0]), (7, [2.5, 3.0])] + [(10 + i, [i / 7, 1 - i / 5]) for i in range(13)] + [(100, None), (200, [1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(map(tuple, topk.op1_top_k(spark, str(tmp_path)).collect()))
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(duckdb.sql(topk.ORACLE).fetchall()) and len(got) == 10
