import random
import time
from collections import Counter

from quirekit.llm import packing


def naive(sizes, sources, clusters, capacity):
    """Best fit by looking at every bin; the first at the smallest residual that was put there."""
    bins, out, clock = [], [], 0
    for size, s, c in zip(sizes, sources, clusters):
        fits = [b for b in bins if b["r"] >= size and (s is None or s not in b["s"]) and (c is None or c not in b["c"])]
        if fits:
            b = min(fits, key=lambda b: (b["r"], b["t"]))
        else:
            b = {"r": capacity, "s": set(), "c": set(), "n": len(bins), "t": 0}
            bins.append(b)
        out.append((b["n"], capacity - b["r"]))
        clock += 1
        b["r"] -= size
        b["t"] = clock
        b["s"].add(s)
        b["c"].add(c)
    return out


def test_equals_naive_best_fit():
    rng = random.Random(1)
    for trial in range(30):
        n = rng.randrange(1, 200)
        sizes = sorted((rng.randint(1, 64) for _ in range(n)), reverse=True)
        sources = [rng.choice(["hot"] * 8 + [None] + [f"s{i}" for i in range(60 if trial % 2 else 4)]) for _ in range(n)]
        clusters = [rng.choice([None, *range(10 if trial % 3 else 1000)]) for _ in range(n)]
        assert packing.pack(sizes, sources, clusters, 64) == naive(sizes, sources, clusters, 64)


def test_every_word_once_and_no_conflict(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w%d" % rng.randrange(99)] * rng.randrange(1, 90)), rng.choice(["hot", "hot", "a", "b", "c", None])) for i in range(900)]
    rows += [(2000 + i, "Same  text here", f"q{i}") for i in range(40)] + [(3000, None, "a"), (3001, " \n", "a"), (3002, "long " * 500, "a"), (None, "x y", "a"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, bin_id int")
    got = packing.best_fit(df, capacity=100, shard_rows=300).collect()
    sizes = sorted(len((t or "").split()) for _, t, _ in rows)
    pieces, bins = {}, {}
    for r in got:
        pieces.setdefault((r.doc_id, r.start), []).append(r.size)
        if r.bin_id is None:
            assert r.size == 0
        else:
            bins.setdefault(r.bin_id, []).append(r)
    assert sum(r.size for r in got) == sum(sizes)
    assert [r.size for r in sorted((r for r in got if r.doc_id == 3002), key=lambda r: r.piece)] == [100] * 5
    where = {d: (s, " ".join((t or "").lower().split())) for d, t, s in rows}
    for held in bins.values():
        held.sort(key=lambda r: r.bin_offset)
        assert [r.bin_offset for r in held] == [sum(x.size for x in held[:k]) for k in range(len(held))]
        assert sum(r.size for r in held) <= 100
        sources = [where[r.doc_id][0] for r in held if where[r.doc_id][0] is not None]
        assert len(set(sources)) == len(sources)
        assert len({where[r.doc_id][1] for r in held}) == len(held)
    assert packing.best_fit(df.limit(0)).count() == 0
    assert packing.best_fit(df, cluster_col="bin_id").count() >= len(rows)


def test_one_cluster_does_not_walk_through_its_bins():
    n = 20_000
    began = time.time()
    out = packing.pack([100] * n, [str(i) for i in range(n)], [7] * n)
    assert [b for b, _ in out] == list(range(n)) and time.time() - began < 5


def test_copies_of_one_row_are_dealt_over_shards_and_sizes_can_be_given(spark):
    df = spark.range(3000).selectExpr("5L AS doc_id", "'a b c' AS text", "'s' AS source", "CAST(NULL AS long) AS none")
    got = packing.best_fit(df, capacity=10, cluster_col="none", shard_rows=300).collect()
    assert len(got) == 3000 and len({r.bin_id for r in got}) == 3000  # one source: none share a bin
    assert max(Counter(r.bin_id >> 32 for r in got).values()) < 600
    docs = spark.createDataFrame([(1, "x", "a", 700), (2, "y", "b", 300), (3, "z", "c", None), (4, "w", "d", -4), (5, None, "e", 2100)], "doc_id long, text string, source string, tokens int")
    rows = packing.best_fit(docs, capacity=1000, size_col="tokens", shard_rows=None).collect()
    by = {(r.doc_id, r.piece): r for r in rows}
    assert by[1, 0].bin_id == by[2, 0].bin_id and by[3, 0].bin_id is None and by[4, 0].size == 0
    assert [by[5, k].size for k in range(3)] == [1000, 1000, 100]


def test_shards_cost_little(spark):
    """Bins that shards open more than one place for all would, on the corpus."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    many, one = (packing.best_fit(docs, shard_rows=k).where("bin_id IS NOT NULL").select("bin_id").distinct().count() for k in (250, None))
    assert one <= many <= 1.1 * one
