import itertools
import random
import re

from quirekit.llm import neardup

COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


def brute(rows, words=4):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        inter = len(sets[i] & sets[j])
        if inter and 100 * inter >= 80 * len(sets[i] | sets[j]):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(d, low.get(find(i), d))
    return sorted((d, len(sets[i]), low[find(i)], d == low[find(i)]) for i, (d, _) in enumerate(rows))


def noisy(base, rng, n):
    w = base.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def test_matches_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    shared = " ".join(rng.choices(vocabulary, k=80))
    rows, ids = [], iter(rng.sample(range(10_000), 900))
    for _ in range(12):
        base = " ".join(rng.choices(vocabulary, k=rng.choice([8, 60, 150, 400])))
        for k in range(12):
            rows.append((next(ids), noisy(base, rng, rng.randrange(1 + len(base.split()) // 18))))
    rows += [(next(ids), " ".join(rng.choices(vocabulary, k=30)) + " " + shared) for _ in range(60)]
    rows += [(next(ids), shared.upper().replace(" ", "\t\n")) for _ in range(5)]
    rows += [(next(ids), t) for t in (None, "", "  \n", "one", "One", "two words", "a b c d", "TWO  words", "Ärger ärger", "ärger ärger")]
    rows += [rows[0], rows[-1]]
    df = spark.createDataFrame([(d, t, "en", 1) for d, t in rows], "doc_id long, text string, component_id string, kept int")
    got = sorted(map(tuple, neardup.near_duplicates(df).select(*COLUMNS).collect()))
    assert got == brute(rows)


def test_families_without_an_original(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(11)
    rows, ids = [], iter(rng.sample(range(10_000), 400))
    for _ in range(4):
        text = " ".join(rng.choices([f"w{i}" for i in range(900)], k=160))
        for _ in range(70):
            # Copies of copies: each resembles its neighbours, the ends do not.
            text = noisy(text, rng, rng.randrange(1, 7))
            rows.append((next(ids), text))
    rng.shuffle(rows)
    got = sorted(map(tuple, neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select(*COLUMNS).collect()))
    assert got == brute(rows)


def test_null_id_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (None, None)], "doc_id long, text string")
    got = {tuple(r) for r in neardup.near_duplicates(df).select(*COLUMNS).collect()}
    assert got == {(None, 2, None, True), (3, 2, 3, True), (None, 0, None, True)}
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_signature_distance():
    import numpy as np

    a = np.arange(100, dtype=np.uint64)
    assert (neardup.signature(a) == neardup.signature(a[::-1])).all()
    assert len(neardup.signature(a)) == neardup.SYMBOLS


def test_second_sketch_keeps_true_pairs():
    import numpy as np

    rng = np.random.RandomState(1)
    lost = kept = 0
    for n in (1, 5, 40, 600, 5000):
        for _ in range(60):
            both = rng.randint(0, 1 << 62, n + n // 4 + 1).astype(np.uint64) * np.uint64(4)
            a, b = np.unique(both[: n + n // 8]), np.unique(np.concatenate([both[:n], both[n + n // 8 :][: n // 8]]))
            inter = len(np.intersect1d(a, b))
            if 100 * inter >= 80 * (len(a) + len(b) - inter):
                kept += 1
                lost += not neardup.hopeful(neardup.bins_of(a)[None], neardup.bins_of(b)[None], len(a), len(b))[0]
    assert kept > 100 and not lost
    a, b = (np.unique(rng.randint(0, 1 << 62, 600).astype(np.uint64) * np.uint64(4)) for _ in range(2))
    c = np.unique(np.concatenate([a[:450], b[:150]]))
    assert not neardup.hopeful(neardup.bins_of(a)[None], neardup.bins_of(c)[None], len(a), len(c))[0]
