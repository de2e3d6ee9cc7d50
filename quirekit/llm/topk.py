"""Exact top-k inner products by a three-phase uniform threshold.

A node is one partition of the vectors; a query's score list at a node holds
the node's vectors by score. Phase 1 gathers every node's k best entries and
finds, for each query, the k-th best distinct id of them all: no answer can lie
below it, so it is a safe cutoff. Phase 2 broadcasts the cutoffs and collects
the entries that may reach them: a node first scores half of the components and
adds the largest value the other half can contribute (Cauchy-Schwarz), and
lets go only of what stays below the cutoff even so. Phase 3 resolves the
remaining half exactly, ranks the entries and keeps k.

The queries are taken in blocks of ``QUERY_BLOCK``, so what is broadcast is at
most that many vectors and cutoffs, whatever the input; each block is one pass
over the vectors, its answers are appended to a table and its broadcasts freed
before the next, so neither the plan nor memory grows with the blocks.

Components are floor(1024 * x) as integers. Sums are exact: float64 products
are used only where every partial sum stays below 2**53, 64-bit integers else.

Defined cases: a vector that is null or empty, holds a null or a non-finite
component, or has a null id takes no part. Vectors of another length than the query's are
no candidates of it. Rows that repeat an id count once per query, with their
best score; if the rows of a query id hold different vectors, the smallest in
array order is the query. Ties go to the smaller id.
"""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import common

QUERY_BLOCK = 4096
SCALE = 1024
ROWS = 4096
#: Scores held at once: queries of a block times rows of a slice.
SCORES = 1 << 20


def _slices(batches, block):
    """(ids, matrix, query ids, query matrix) of one length, of bounded product."""
    for ids, x in _tables(batches):
        if x.shape[1] in block.by_size:
            qids, q = block.by_size[x.shape[1]]
            step = max(1, SCORES // len(qids))
            for a in range(0, len(ids), step):
                yield ids[a : a + step], x[a : a + step], qids, q


def _tables(batches):
    """(ids, matrix) for each length of vectors, from batches without nulls."""
    held, n = [], 0

    def flush():
        t = pa.Table.from_batches(held).combine_chunks()
        ids = t.column("vec_id").chunk(0).to_numpy()
        lists = t.column("v").chunk(0)
        sizes = lists.value_lengths().to_numpy()
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            values = lists.take(pa.array(rows)).flatten().to_numpy()
            yield ids[rows], values.reshape(len(rows), size)

    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
            if n >= ROWS:
                yield from flush()
                held, n = [], 0
    if held:
        yield from flush()


def _exact(q, x):
    """Integer inner products of all rows of q with all rows of x."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if bound < 2.0**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


class Block:
    """Queries of one block, by length."""

    def __init__(self, rows):
        self.by_size = {}
        for i, v in rows:
            self.by_size.setdefault(len(v), []).append((i, v))
        self.by_size = {n: (np.array([i for i, _ in x], np.int64), np.array([v for _, v in x], np.int64)) for n, x in self.by_size.items()}


def _best(k, block):
    schema = pa.schema([("query_id", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())])

    def run(batches):
        best = {}
        for ids, x, qids, q in _slices(batches, block.value):
            scores = _exact(q, x)
            own = qids[:, None] == ids[None, :]
            # One more than k, as a query's own row is no entry of it. Rows that repeat an id may crowd others out: the cutoff is then lower, and still safe.
            m = min(k, len(ids))
            for r in range(len(qids)):
                s = scores[r]
                at = np.argpartition(-s, m)[: m + 1] if m < len(s) else np.arange(len(s))
                at = at[~own[r, at]]
                if len(at):
                    best.setdefault(int(qids[r]), []).append((s[at], ids[at]))
        for qid, parts in best.items():
            entries = sorted({(-int(s), int(i)) for p in parts for s, i in zip(*p)})[:k]
            yield pa.RecordBatch.from_arrays([pa.array([qid] * len(entries)), pa.array([-s for s, _ in entries]), pa.array([i for _, i in entries])], schema=schema)

    return run


def _reach(block, cutoffs):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        for ids, x, qids, q in _slices(batches, block.value):
            size = x.shape[1]
            cut_s, cut_i = cutoffs.value[size]
            half = size // 2
            part = _exact(q[:, :half], x[:, :half])
            rest = np.sqrt((q[:, half:].astype(np.float64) ** 2).sum(axis=1))[:, None] * np.sqrt((x[:, half:].astype(np.float64) ** 2).sum(axis=1))[None, :]
            # Rounded up well beyond the error of the bound, so nothing that can reach the cutoff is let go.
            maybe = part.astype(np.float64) + rest * (1 + 1e-9) + 1 + np.abs(part) * 1e-15 >= cut_s[:, None]
            maybe &= qids[:, None] != ids[None, :]
            r, c = np.nonzero(maybe)
            if not len(r):
                continue
            score = part[r, c]
            for a in range(0, len(r), 1 << 16):
                b = slice(a, a + (1 << 16))
                score[b] += (q[r[b], half:] * x[c[b], half:]).sum(axis=1)
            keep = (score > cut_s[r]) | (score == cut_s[r]) & (ids[c] <= cut_i[r])
            yield pa.RecordBatch.from_arrays([pa.array(qids[r[keep]]), pa.array(ids[c[keep]]), pa.array(score[keep])], schema=schema)

    return run


def top_k(queries, vectors, k=10):
    """queries, vectors (vec_id, embedding) -> query_id, rank, vec_id, score: the k best of every query."""
    spark = vectors.sparkSession

    def whole(df):
        finite = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
        scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
        return df.where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))

    asked = whole(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = common.save(asked.withColumn("h", F.xxhash64("vec_id")), "asked")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    data = whole(vectors)
    path = f"{common.scratch_dir(spark)}/quirekit-answers-{uuid.uuid4().hex}"
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # Blocks are ranges of a hash of the id: no sort of all queries, and a block's size is bounded as it is fetched.
    for n in range(blocks):
        rows = [(r.vec_id, r.v) for r in asked.where(F.pmod("h", F.lit(blocks)) == n).select("vec_id", "v").collect()]
        block = spark.sparkContext.broadcast(Block(rows))
        local = data.mapInArrow(_best(k, block), "query_id long, score long, vec_id long")
        # An id counts once, with its best score: the k-th entry may be a second vector of an id met before.
        local = local.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        last = local.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select("query_id", "score", "vec_id").collect()
        found = {r.query_id: (r.score, r.vec_id) for r in last}
        low = (np.iinfo(np.int64).min, np.iinfo(np.int64).max)
        cutoffs = {size: tuple(np.array(c, np.int64) for c in zip(*[found.get(int(i), low) for i in qids])) for size, (qids, _) in block.value.by_size.items()}
        sent = spark.sparkContext.broadcast(cutoffs)
        part = data.mapInArrow(_reach(block, sent), "query_id long, vec_id long, score long")
        part = part.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        ranked = part.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        ranked.write.mode("append").parquet(path)
        block.destroy()
        sent.destroy()
    where, files = common._files(spark, path)
    files.deleteOnExit(where)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         max(CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT)) AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  GROUP BY q.vec_id, c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op1_top_k(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors.where("vec_id % 100 = 0"), vectors)
