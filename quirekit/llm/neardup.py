"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A signature has ``CHUNKS`` chunks of ``WIDTH`` symbols of 12 bits, one long each. Two
signatures that differ in at most ``CHUNKS * (ERRORS + 1) - 1`` symbols differ
in at most ``ERRORS`` symbols of some chunk (pigeonhole), so keying every chunk
once for each set of ``ERRORS`` symbols left out finds every such pair. Pairs
further apart are found too, with high probability; ``FAR`` bounds what goes to
the exact check, which compares the full shingle sets.

Before the exact check a second sketch of each set (the smallest hash of every
bin of the hash range) drops pairs that lie ``SIGMAS`` standard deviations below
the threshold; it would lose a true pair with probability 1e-6.

At the link threshold of 0.8 a chunk of 5 agrees but for one symbol with
probability 0.74, so ten chunks miss a pair with probability 1.6e-6.

Hot groups: equal shingle sets become one node before anything is keyed. Every
node is then held against one pivot, the best connected node it shares a bucket
with; nodes still apart from the other pivots of their buckets against those. Only
members of a bucket that are left in different components are compared with
each other, as arrays of signatures and sketches, so only pairs that may be
linked leave the place; a pair that shares many buckets is compared in the first of
them alone, and a bucket of more than BLOCK members block by block.

Defined cases: a null or empty text, or one of white space only, has an empty
set, links with nothing and is its own component. Rows that repeat a doc_id
are rows of their own, each with the component of its text. A row with a null
doc_id links with nothing: component_id is null and kept is true.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from . import common

CHUNKS, WIDTH, ERRORS, FAR = 10, 5, 1, 25
SYMBOLS = CHUNKS * WIDTH
BITS = 12
LANES = np.arange(WIDTH, dtype=np.uint64) * np.uint64(BITS)
#: The lowest bit of every lane.
ONES = sum(1 << BITS * i for i in range(WIDTH))
SIG = [f"s{i}" for i in range(CHUNKS)]
PERCENT = 80
#: Bins of the second sketch: the smallest hash of each part of the hash range, in 8 bits.
BINS = 512
#: Members of a bucket that are compared in one place; larger buckets are compared block by block.
BLOCK = 2048
#: Standard deviations below the expected matches at the threshold that a pair may lie to be checked.
SIGMAS = 4.75
#: Ids beyond this many are matched with their texts by a shuffled join instead of a broadcast.
BROADCAST_IDS = 500_000

_rng = np.random.RandomState(20240607)
MULT = (_rng.randint(0, 1 << 62, SYMBOLS).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
ADD = _rng.randint(0, 1 << 62, SYMBOLS).astype(np.uint64)
SALT = common.mix64(np.arange(1, CHUNKS * WIDTH + 1, dtype=np.uint64))
#: Stands for the missing words of a text shorter than one shingle.
PAD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts, words):
    """For each text (bytes or None) its sorted distinct shingle hashes, uint64."""
    split = [t.lower().split() if t else [] for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(w) for doc in split for w in doc), np.uint64, int(sizes.sum()))
    del split
    # Every text is followed by words - 1 pads, so windows never mix two texts.
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out = []
    padded = np.concatenate([hashes, np.full(words - 1, PAD, np.uint64)])
    acc = common.mix64(padded[: len(hashes)])
    for k in range(1, words):
        acc = common.mix64(acc * np.uint64(31) + padded[k : k + len(hashes)])
    for n, a, b in zip(sizes, starts, ends):
        if n >= words:
            out.append(np.unique(acc[a : b - words + 1]))
        elif n:
            h = common.mix64(hashes[a : a + 1])
            for k in range(1, words):
                h = common.mix64(h * np.uint64(31) + (hashes[a + k] if k < n else PAD))
            out.append(h)
        else:
            out.append(hashes[:0])
    return out


def signature(s):
    """SYMBOLS symbols of BITS bits of a set of hashes."""
    low = np.full(SYMBOLS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(s), 1024):
        low = np.minimum(low, (s[i : i + 1024, None] * MULT + ADD).min(axis=0))
    return common.mix64(low) >> np.uint64(64 - BITS)


def bins_of(s):
    """BINS bytes of a sorted set of hashes, 0 where a bin is empty."""
    out = np.zeros(BINS, np.uint8)
    if len(s):
        at = (s >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        out[at[first]] = common.mix64(s[first]) % np.uint64(255) + np.uint64(1)
    return out


def hopeful(a, b, na, nb):
    """Which rows of two arrays of bins may belong to sets (of sizes na, nb) that reach the threshold.

    Each bin in use samples one hash of the union, without replacement; so few
    stay outside the sample for short texts that the test is nearly exact there.
    """
    used = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    share = PERCENT / 100
    union = (na + nb) / (1 + share)
    spread = np.sqrt(share * (1 - share) * used * np.clip((union - used) / np.maximum(union - 1, 1), 0, 1))
    return same >= share * used - SIGMAS * spread - 1


def _hopeful(batches):
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(b.schema.get_field_index(c)).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("bx", "by"))
            na, nb = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("na", "nb"))
            yield b.select(["a", "b", "doc_a", "doc_b"]).filter(pa.array(hopeful(x, y, na, nb)))


def _lanes(x):
    """How many lanes of numpy longs are not zero."""
    for k in (6, 3, 1, 1):
        x = x | (x >> np.uint64(k))
    return np.bitwise_count(x & np.uint64(ONES))


def apart_pairs(g):
    """Pairs of rows of one bucket (or pair of its blocks) that may be linked: row numbers (i, j), node i below node j.

    g: node, comp, n, slot, sig, bins, block of the members, and cross: whether only pairs of two blocks count.
    """
    node, comp, n, sig = g["node"], g["comp"], g["n"], g["sig"]
    chunk, first = divmod(int(g["slot"][0]), WIDTH)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    step = max(1, (1 << 20) // len(node))
    for a in range(0, len(node), step):
        rows = slice(a, a + step)
        ok = (node[rows, None] < node[None, :]) & (comp[rows, None] != comp[None, :])
        if g["cross"]:
            # A block pair holds both blocks; pairs within one are met elsewhere.
            ok &= g["block"][rows, None] != g["block"][None, :]
        ok &= np.minimum(n[rows, None], n[None, :]) * 100 >= np.maximum(n[rows, None], n[None, :]) * PERCENT
        i, j = np.nonzero(ok)
        i += a
        total = np.zeros(len(i), np.int64)
        for c in range(CHUNKS):
            d = _lanes(sig[i, c] ^ sig[j, c])
            if c < chunk:
                fits = d > ERRORS
            elif c == chunk:
                fits = (d == ERRORS) | (first == 0)
            else:
                fits = np.ones(len(i), bool)
            total += d
            fits &= total <= FAR
            i, j, total = i[fits], j[fits], total[fits]
        for k in range(0, len(i), 8192):
            x, y = i[k : k + 8192], j[k : k + 8192]
            good = hopeful(g["bins"][x], g["bins"][y], n[x], n[y])
            out.append((x[good], y[good]))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _apart(batches):
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "doc_a", "doc_b")])
    for t in common.groups(batches, ("key", "lo", "hi")):
        t = t.combine_chunks()
        long = lambda c: t.column(c).to_numpy()
        g = {c: long(c) for c in ("node", "comp", "n", "slot", "block")}
        g["cross"] = t.column("lo")[0].as_py() != t.column("hi")[0].as_py()
        g["sig"] = np.stack([long(c) for c in SIG], axis=1).view(np.uint64)
        g["bins"] = np.frombuffer(b"".join(t.column("bins").to_pylist()), np.uint8).reshape(-1, BINS)
        i, j = apart_pairs(g)
        if len(i):
            yield common.record(schema, g["node"][i], g["node"][j], long("doc")[i], long("doc")[j])


def node_of(s):
    """One 64-bit number for a set of hashes, 0 for the empty set."""
    if not len(s):
        return 0
    both = np.array([common.mix64(s).sum(), common.mix64(s ^ PAD).sum() + np.uint64(len(s))])
    return int(common.mix64(common.mix64(both[:1]) + both[1:]).view(np.int64)[0])


def _signed(words):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("bins", pa.binary())] + [(c, pa.int64()) for c in SIG])

    def run(batches):
        for t in common.chunks(batches):
            sets = shingle_sets(common.as_bytes(t.column("text").chunk(0)), words)
            sig = np.zeros((len(sets), CHUNKS, WIDTH), np.uint64)
            for i, s in enumerate(sets):
                if len(s):
                    sig[i] = signature(s).reshape(CHUNKS, WIDTH)
            packed = (sig << LANES).sum(axis=2, dtype=np.uint64)
            yield common.record(schema, t.column("doc_id").chunk(0), t.column("text_hash").chunk(0), np.fromiter(map(len, sets), np.int64, len(sets)), [node_of(s) for s in sets], [bins_of(s).tobytes() for s in sets], *np.ascontiguousarray(packed.T).view(np.int64))

    return run, "doc_id long, text_hash long, n long, node long, bins binary, " + ", ".join(f"{c} long" for c in SIG)


def _keyed(batches):
    """(key, node, slot): a key for every chunk and every symbol left out of it; slot tells which."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("slot", pa.int32())])
    for b in batches:
        if not b.num_rows:
            continue
        longs = np.stack([b.column(b.schema.get_field_index(c)).to_numpy() for c in SIG], axis=1).view(np.uint64)
        node = b.column(b.schema.get_field_index("node"))
        for e in range(WIDTH):
            rest = longs & ~(np.uint64((1 << BITS) - 1) << LANES[e])
            for c in range(CHUNKS):
                slot = c * WIDTH + e
                keys = common.mix64(rest[:, c] ^ SALT[slot])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), node, pa.array(np.full(len(keys), slot, np.int32))], schema=schema)


def _sets(words):
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for t in common.chunks(batches):
            sets = shingle_sets(common.as_bytes(t.column("text").chunk(0)), words)
            flat = np.concatenate(sets).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            shingles = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            # A repeated doc_id may carry several texts; the set must be the one that was asked for.
            asked = t.column("node").chunk(0).to_numpy()
            same = pa.array(asked == np.array([node_of(s) for s in sets], np.int64))
            yield pa.RecordBatch.from_arrays([t.column("node").chunk(0), shingles], schema=schema).filter(same)

    return run, "node long, shingles array<long>"


def differing(a, b, c):
    """Symbols of one chunk in which two signatures differ."""
    x = F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))
    for k in (6, 3, 1, 1):  # gathers the bits of each lane in its lowest one
        x = x.bitwiseOR(F.shiftrightunsigned(x, k))
    return F.bit_count(x.bitwiseAND(F.lit(ONES)))


def distance(a, b):
    return sum((differing(a, b, c) for c in SIG[1:]), differing(a, b, SIG[0]))


def close(a, b):
    """Set sizes and signatures leave room for the threshold."""
    lo, hi = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (lo * 100 >= hi * PERCENT) & (distance(a, b) <= FAR)


def _confirmed(docs, pairs, words):
    """The pairs (a, b) of (a, b, doc_a, doc_b) whose full shingle sets reach the threshold."""
    pairs = common.save(pairs, "pairs")
    need = pairs.selectExpr("a AS node", "doc_a AS doc_id").union(pairs.selectExpr("b AS node", "doc_b AS doc_id")).distinct()
    if 2 * pairs.count() <= BROADCAST_IDS:
        need = F.broadcast(need)
    run, schema = _sets(words)
    found = docs.where("text IS NOT NULL").join(need, "doc_id").select("node", "text").mapInArrow(run, schema)
    found = common.save(found.dropDuplicates(["node"]), "sets")
    left, right = found.selectExpr("node AS a", "shingles AS sa"), found.selectExpr("node AS b", "shingles AS sb")
    # The set of b travels to the place of a, whose set is copied where a is hot: what is sent is one set for each pair.
    some = common.salted_join(pairs.select("a", "b"), right, "b")
    both = common.salted_join(some, left, "a", pairs.groupBy("a").count())
    both = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("i"))
    links = common.save(both.where(f"100 * i >= {PERCENT} * (na + nb - i)").select("a", "b"), "links")
    common.drop(pairs, found)
    return links


def near_duplicates(docs, words=4):
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept, group, text_hash: one row for each row.

    ``words`` is the shingle length. Documents are linked where 100 times the
    intersection of their sets is at least 80 times the union; component_id is
    the smallest doc_id reachable over links. ``group`` numbers the component
    of the row's own text (null where it links with nothing by definition) and
    tells rows apart that repeat a doc_id; text_hash is Spark's xxhash64 of it.
    """
    common.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    run, schema = _signed(words)
    base = common.save(hashed.mapInArrow(run, schema), "signed")
    nodes = base.where("n > 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc"), *[F.first(c).alias(c) for c in ("n", "bins", *SIG)])
    nodes = common.save(nodes, "nodes")

    keys = nodes.select("node", *SIG).mapInArrow(_keyed, "key long, node long, slot int")
    met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    rows = met = common.save(keys.join(met, "key"), "buckets")
    # What a family was copied from meets more of it than the copies do: the best connected member is the pivot.
    weight = rows.groupBy("node").agg(F.sum("m").alias("weight"))
    rank = F.struct("weight", "node")
    rows = rows.drop("m").join(weight, "node")
    pivots = rows.groupBy("key").agg(F.max(rank).alias("top"))
    rows = common.save(rows.drop("weight").join(pivots, "key").where("node <> top.node"), "pivots")
    common.drop(met)

    def near(pairs):
        x, y = nodes.alias("x"), nodes.alias("y")
        met = pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).where(close("x", "y"))
        return promising(met.select("a", "b", F.col("x.doc").alias("doc_a"), F.col("y.doc").alias("doc_b"), F.col("x.bins").alias("bx"), F.col("y.bins").alias("by"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")))

    def promising(pairs):
        return pairs.mapInArrow(_hopeful, "a long, b long, doc_a long, doc_b long")

    def labelled(df, labels, node="node", comp="comp"):
        return df.join(labels.select(F.col("node").alias(node), F.col("comp").alias(comp)), node, "left").withColumn(comp, F.coalesce(comp, node))

    # Round 1: every node with the best connected pivot of its buckets. One step is enough to tell who is still apart.
    links = _confirmed(docs, near(rows.groupBy(F.col("node").alias("b")).agg(F.max("top").alias("t")).select(F.col("t.node").alias("a"), "b")), words)
    labels = links.select(F.col("b").alias("node"), F.col("a").alias("comp"))
    # Round 2: nodes with the other pivots they are still apart from.
    stars = rows.select(F.col("top.node").alias("a"), F.col("node").alias("b")).distinct()
    stars = labelled(labelled(stars, labels, "a", "ca"), labels, "b", "cb").where("ca <> cb").select("a", "b")
    links = links.union(_confirmed(docs, near(stars), words))
    labels = common.components(links)

    # Round 3: members of one bucket that are still apart, with each other.
    pivoted, rows = rows, common.save(labelled(rows.select("key", "node", "slot"), labels), "labelled")
    common.drop(pivoted)
    apart = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("m")).where("low <> high")
    rest = rows.join(apart.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "key")
    rest = rest.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("lo"), F.greatest("block", o).alias("hi")))
    rest = rest.withColumn("cell", F.explode(cells)).select("key", "cell.*", "node", "slot", "comp", "block").join(nodes, "node")
    rest = rest.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")
    more = _confirmed(docs, rest.mapInArrow(_apart, "a long, b long, doc_a long, doc_b long"), words)
    if more.limit(1).count():
        labels = common.components(links.union(more))

    named = labelled(nodes.select("node", "doc"), labels)
    least = named.groupBy("comp").agg(F.min("doc").alias("component_id"))
    named = common.save(named.join(least, "comp").select("node", "component_id", F.col("comp").alias("group")), "named")
    common.drop(rows, nodes)
    linked = F.expr("n > 0 AND doc_id IS NOT NULL")
    some = base.where(linked).select("doc_id", "text_hash", "n", "node")
    some = common.salted_join(some, named, "node", some.groupBy("node").count())
    none = base.where(~F.coalesce(linked, F.lit(False))).select("doc_id", "text_hash", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group"))
    out = some.select(*none.columns).union(none).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "group", "text_hash")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS d, doc_id AS c FROM s UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d),
l AS (SELECT d, min(c) AS component_id FROM r GROUP BY d)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN l ON d = doc_id
"""


def op7_near_duplicates(spark, sf_dir):
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")
