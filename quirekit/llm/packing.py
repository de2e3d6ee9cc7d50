"""Conflict-constrained best-fit packing of documents into training sequences.

A bin holds at most ``capacity`` words, no two pieces of one source and no two
of one duplicate cluster. Pieces go in order of falling size into the tightest
compatible bin: bins are ordered by their residual, each with a bitmap of its
sources and one of its clusters, and the successor search goes on from residual
to residual until a bin fits without a conflict; else a new bin opens. Sources
and clusters that are frequent have an index of the residuals at which some bin still lacks
them, so a hot source or cluster does not walk through all bins that hold it.

Sizes are words, or what a column of sizes (of tokens, say) tells. Documents
longer than the capacity are cut into full pieces, each a bin of its
own, and a rest. Documents are dealt by a hash into shards of about
``shard_rows``; bins never span shards, so a shard's size and memory are bounded
and the loss is a few open bins a shard. With ``shard_rows=None`` all documents are
one shard: the exact best fit, in the memory of one task.

Defined cases: null texts and texts without a word have one row with no bin
and size 0; a null source conflicts with nothing; texts that are equal but for case and
white space are one cluster unless a column of clusters is named, where null
conflicts with nothing; rows that repeat a doc_id are packed each for itself, equal
rows numbered and dealt over the shards; null or negative sizes count as 0.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
SHARD_ROWS = 20_000
#: Sources and clusters with an index of their own: those with this share of a shard's pieces.
FREQUENT = 0.02


SOURCE, CLUSTER = 0, 1


class Bins:
    """Open bins of one shard."""

    def __init__(self, capacity, frequent):
        self.capacity = capacity
        self.at = [{} for _ in range(capacity + 1)]  # bins by residual, in order of arrival
        self.open = 0  # bitmap of the residuals that have a bin
        self.residual, self.sources, self.clusters = [], [], []
        # For each frequent source or cluster (kind, its bit): bins that lack it, counted by residual, and the bitmap of those residuals.
        self.lack = {f: [0] * (capacity + 1) for f in frequent}
        self.free = {f: 0 for f in frequent}

    def place(self, size, source, cluster):
        """Index of the bin that takes a piece; source and cluster are bits, 0 for none."""
        found = self._tightest(size, source, cluster)
        if found is None:
            found = len(self.residual)
            self.residual.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        else:
            self._take(found)
        self.residual[found] -= size
        self.sources[found] |= source
        self.clusters[found] |= cluster
        self._put(found)
        return found

    def _tightest(self, size, source, cluster):
        rest = (self.free.get((SOURCE, source), self.open) & self.free.get((CLUSTER, cluster), self.open)) >> size
        r = size
        while rest:
            step = (rest & -rest).bit_length() - 1
            r += step
            for b in self.at[r]:
                if not (self.sources[b] & source or self.clusters[b] & cluster):
                    return b
            rest >>= step + 1
            r += 1
        return None

    def _take(self, b):
        r, mine = self.residual[b], (self.sources[b], self.clusters[b])
        del self.at[r][b]
        if not self.at[r]:
            self.open &= ~(1 << r)
        for f, counts in self.lack.items():
            if not mine[f[0]] & f[1]:
                counts[r] -= 1
                if not counts[r]:
                    self.free[f] &= ~(1 << r)

    def _put(self, b):
        r, mine = self.residual[b], (self.sources[b], self.clusters[b])
        if r == 0:
            return
        self.at[r][b] = None
        self.open |= 1 << r
        for f, counts in self.lack.items():
            if not mine[f[0]] & f[1]:
                counts[r] += 1
                self.free[f] |= 1 << r


def pack(sizes, sources, clusters, capacity=CAPACITY):
    """Bins of pieces given in order of falling size: (bin, offset) of each."""
    kinds, lists = [], (sources, clusters)
    frequent = []
    for kind, values in enumerate(lists):
        count = {}
        for v in values:
            if v is not None:
                count[v] = count.get(v, 0) + 1
        # What stands on one piece alone cannot conflict; what is frequent comes first, so that its bitmaps stay short.
        often = sorted((v for v in count if count[v] > 1), key=lambda v: (-count[v], str(v)))
        bits = {v: 1 << i for i, v in enumerate(often)}
        frequent += [(kind, bits[v]) for v in often if count[v] >= FREQUENT * len(sizes)]
        kinds.append(bits)
    bins, out = Bins(capacity, frequent), []
    for size, s, c in zip(sizes, *lists):
        b = bins.place(size, kinds[SOURCE].get(s, 0), kinds[CLUSTER].get(c, 0))
        out.append((b, capacity - bins.residual[b] - size))
    return out


def _sized(clustered, measured):
    schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("source", pa.string()), ("cluster", pa.int64())])

    def run(batches):
        for t in common.chunks(batches):
            texts = common.as_bytes(t.column("text").chunk(0))
            split = [x.lower().split() if x else [] for x in texts]
            if clustered:
                cluster = t.column("cluster").chunk(0)
            else:
                cluster = [xxhash.xxh3_64_intdigest(b" ".join(w)) - (1 << 63) if w else None for w in split]
            sizes = [max(0, n or 0) for n in t.column("size").to_pylist()] if measured else [len(w) for w in split]
            yield common.record(schema, t.column("doc_id").chunk(0), sizes, t.column("source").chunk(0), cluster)

    return run


OUT = "doc_id long, piece int, start long, size long, bin_id long, bin_offset int"


def _packed(capacity):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("size", pa.int64()), ("bin_id", pa.int64()), ("bin_offset", pa.int32())])

    def shard_rows(t):
        number = t.column("shard")[0].as_py() << 32
        full, rest = [], []
        for doc, size, source, cluster in zip(*[t.column(c).to_pylist() for c in ("doc_id", "size", "source", "cluster")]):
            for k in range(size // capacity):
                full.append((doc, k, k * capacity, capacity))
            left = size % capacity
            if left or not size:
                rest.append((doc, size // capacity, size - left, left, source, cluster))
        rest.sort(key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[5] or 0, x[4] or ""))
        some = [x for x in rest if x[3]]
        placed = pack([x[3] for x in some], [x[4] for x in some], [x[5] for x in some], capacity)
        rows = [(*x[:4], number + b, at) for x, (b, at) in zip(some, placed)]
        n = 1 + max((b for b, _ in placed), default=-1)
        rows += [(*x, number + n + i, 0) for i, x in enumerate(full)]
        rows += [(x[0], 0, 0, 0, None, None) for x in rest if not x[3]]
        return rows

    def run(batches):
        held, at = [], None
        for b in batches:
            if not b.num_rows:
                continue
            shard = b.column(b.schema.get_field_index("shard")).to_numpy()
            edges = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for a, e in zip(edges, edges[1:]):
                if held and shard[a] != at:
                    yield common.record(schema, *[list(c) for c in zip(*shard_rows(pa.Table.from_batches(held)))])
                    held = []
                at = shard[a]
                held.append(b.slice(a, e - a))
        if held:
            yield common.record(schema, *[list(c) for c in zip(*shard_rows(pa.Table.from_batches(held)))])

    return run


def best_fit(docs, capacity=CAPACITY, cluster_col=None, size_col=None, shard_rows=SHARD_ROWS):
    """docs(doc_id, text, source) -> doc_id, piece, start, size, bin_id, bin_offset: one row for each piece, in words or the units of size_col."""
    common.small_batches(docs.sparkSession)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source")]
    columns += [F.col(c).cast("long").alias(name) for c, name in ((cluster_col, "cluster"), (size_col, "size")) if c]
    sized = docs.select(*columns).mapInArrow(_sized(bool(cluster_col), bool(size_col)), "doc_id long, size long, source string, cluster long")
    # Equal rows become one with a number, so that copies of one row are dealt like others.
    sized = common.save(sized.groupBy("doc_id", "size", "source", "cluster").agg(F.count(F.lit(1)).alias("n")), "sized")
    rows = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-rows // shard_rows)) if shard_rows else 1
    each = sized.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")
    dealt = each.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "size", "copy"), F.lit(shards))).drop("copy")
    return dealt.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_packed(capacity), OUT)


def op5_packing(spark, sf_dir):
    return best_fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
