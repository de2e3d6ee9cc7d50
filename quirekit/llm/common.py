"""What the operators share: scratch tables, Arrow chunks, hashing, components."""

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Texts may be long; chunks() joins small batches again by bytes.
BATCH_ROWS = 256
CHUNK_BYTES = 3 << 20


def small_batches(spark, rows=BATCH_ROWS):
    """Bound what one Arrow batch of whole texts holds in executor memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def scratch_dir(spark):
    """The folder that driver and executors share. Unset, a local one is made where master is local; a cluster must name one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all share")
    own = getattr(spark, "_quirekit_scratch", None)
    if own is None:
        own = spark._quirekit_scratch = "file://" + tempfile.mkdtemp(prefix="quirekit-")
    return own


def _files(spark, path):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def save(df, name):
    """Write a table to the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/quirekit-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, files = _files(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables):
    """Delete tables of save() that nothing will read again; the rest go when the session ends."""
    for df in tables:
        where, files = _files(df.sparkSession, df._scratch)
        files.delete(where, True)


def fresh(columns, *names):
    """The names, each with underscores in front until no column is called so."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def smallest(df, keys, n, total=None):
    """The ``n`` rows of the smallest hash of ``keys``; a row takes part in the sort only if its hash can be among them.

    A hash bound drawn from one count leaves about n rows of all partitions
    together (six deviations more), so what is sorted does not grow with the table.
    """
    total = df.count() if total is None else total
    h = F.xxhash64(*keys)
    return df.where(h <= F.lit(bound(n, total))).orderBy(h, *keys).limit(n)


def bound(n, total):
    """The signed 64-bit hash that the smallest n of ``total`` hashes do not exceed, but for a chance of 1e-9."""
    share = 1.0 if total <= n else min(1.0, (n + 6 * n**0.5 + 36) / total)
    return min((1 << 63) - 1, int(-(1 << 63) + share * ((1 << 64) - 1)))


#: A key with more than one in so many rows of a table is dealt over several places.
HOT_SHARE = 4096
HOT_LEAST = 64


def salted_join(rows, items, key, counts=None, how="inner"):
    """rows joined with items on ``key``, hot keys dealt over salts.

    A key is hot if more than one in HOT_SHARE rows carry it, so there are at
    most HOT_SHARE hot keys (they are broadcast) and the copies made of their
    items are at most twice as many. ``counts``: (key, rows that carry it) if known.
    """
    rows_n, salt, copies = fresh({*rows.columns, *items.columns}, "hot_rows", "salt", "copies")
    keys = [key] if isinstance(key, str) else list(key)
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(rows_n))
    else:
        counts = counts.toDF(*keys, rows_n)
    total = counts.agg(F.sum(rows_n)).first()[0] or 0
    most = max(HOT_LEAST, total // HOT_SHARE)
    hot = counts.where(F.col(rows_n) > most).select(*keys, F.ceil(F.col(rows_n) / most).cast("int").alias(copies))
    hot = save(hot, "hot")
    if not hot.limit(1).count():
        return rows.join(items, keys, how)
    hot = F.broadcast(hot)
    left = rows.join(hot, keys, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col(copies)).cast("int"), F.lit(0))).drop(copies)
    right = items.join(hot, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(copies), F.lit(1)) - 1))).drop(copies)
    return left.join(right, [*keys, salt], how).drop(salt)


def chunks(batches, column="text", limit=CHUNK_BYTES):
    """Join record batches until their texts reach ``limit`` bytes; yields tables of one chunk per column."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        size += batch.column(batch.schema.get_field_index(column)).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def groups(batches, keys):
    """Tables of equal keys from sorted batches; a group ends where its keys change."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if held is not None:
            t = pa.concat_tables([held, t]).combine_chunks()
        k = [t.column(c).to_numpy() for c in keys]
        cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], axis=0)) + 1
        edges = [0, *cut.tolist()]
        for a, e in zip(edges, edges[1:]):
            yield t.slice(a, e - a)
        held = t.slice(edges[-1])
    if held is not None:
        yield held


def as_bytes(column):
    """Python bytes (UTF-8) of a string column, None where null."""
    return column.cast(pa.binary()).to_pylist()


def record(schema, *columns):
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema)], schema=schema)


def mix64(x):
    """Finaliser of a 64-bit hash, on a numpy uint64 array."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def crc_mod(column, n):
    return F.crc32(F.col(column).cast("string")) % n


def components(edges, a="a", b="b"):
    """Connected components of an edge table: (node, comp), comp the smallest node.

    Large-star and small-star rounds in turn; every round is a map-side
    combined minimum and an equi-join, so a hub is split like any skewed join
    key. Nothing is gathered on the driver but two sums per round.
    """
    now = save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        now = save(small, "edges")
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (row.n, row.s) == seen:
            break
        seen = (row.n, row.s)
    # At the fixed point every node points at the smallest of its component.
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
