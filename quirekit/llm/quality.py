"""Quality classifier: random Fourier features of document statistics, ridge, isotonic.

Statistics of the whole text (docstats) are standardised and mapped to
``WAVES`` random cosines, whose inner products approximate a Gaussian kernel.
Every partition of the labelled rows adds up its own normal equations; the
sums, of fixed size, are added and solved once with a ridge penalty. Scores of
rows that the fit did not see are calibrated by isotonic regression.

At most ``MAX_LABELLED`` labelled rows, those of the smallest id hashes, take
part; three in four fit the ridge, the rest calibrate. Only text is an input
of a score. Defined cases: a null text scores as an empty one; without labels
of both classes every score is the share of good labels (0.5 without any);
null ids and labels other than 0 and 1 are not learned from.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from . import common, docstats, rules

WAVES = 256
WIDTH = 2.5
RIDGE = 1e-3
MAX_LABELLED = 60_000
PARTS = 8
CUT = 0.7


class Waves:
    """Standardised statistics to random cosines."""

    def __init__(self, mean, scale, seed=11):
        rng = np.random.RandomState(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / WIDTH, (len(mean), WAVES))
        self.b = rng.uniform(0, 2 * np.pi, WAVES)

    def __call__(self, counts):
        x = np.clip((docstats.features(counts) - self.mean) / self.scale, -8, 8)
        z = np.cos(x @ self.w + self.b) * np.sqrt(2 / WAVES)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)


def isotonic(scores, labels):
    """Pool adjacent violators: increasing (score, level) points."""
    order = np.argsort(scores, kind="stable")
    blocks = []  # [sum, n, lowest score, highest score]
    for s, y in zip(scores[order].tolist(), labels[order].tolist()):
        if blocks and blocks[-1][3] == s:
            blocks[-1][0] += y
            blocks[-1][1] += 1
        else:
            blocks.append([y, 1, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            y2, n2, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y2, blocks[-1][1] + n2, blocks[-1][2], hi]
    xs, ys = [], []
    for total, n, lo, hi in blocks:
        # Half a count against certainty, so equal levels of small blocks do not claim 0 or 1.
        level = (total + 0.5 * (total > 0) * (total < n)) / n if 0 < total < n else (0.5 / (n + 1) if total == 0 else 1 - 0.5 / (n + 1))
        xs += [lo, hi] if hi > lo else [lo]
        ys += [level, level] if hi > lo else [level]
    return np.array(xs), np.maximum.accumulate(np.clip(np.array(ys), 0, 1))


class Model:
    def __init__(self, waves=None, beta=None, points=None, prior=0.5):
        self.waves, self.beta, self.points, self.prior = waves, beta, points, prior

    def raw(self, counts):
        return self.waves(counts) @ self.beta

    def score(self, counts):
        if self.beta is None:
            return np.full(len(counts), self.prior)
        return np.interp(self.raw(counts), *self.points)


def _sums(waves):
    schema = pa.schema([("sums", pa.binary())])
    size = WAVES + 1

    def run(batches):
        a, b = np.zeros((size, size)), np.zeros(size)
        for t in batches:
            if t.num_rows:
                z = waves(np.stack([t.column(c).to_numpy() for c in docstats.COUNTS], axis=1))
                a += z.T @ z
                b += z.T @ t.column("label").to_numpy().astype(np.float64)
        yield common.record(schema, [np.concatenate([a, b[:, None]], axis=1).tobytes()])

    return run


def fit(counted, labels, column="quality"):
    """The model of counted rows that carry a label."""
    spark = counted.sparkSession
    rows = common.smallest(counted.join(rules.labelled(labels, column), "doc_id"), ["doc_id", *docstats.COUNTS], MAX_LABELLED)
    rows = common.save(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4))), "labelled")
    shares = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(shares.values())
    if len(shares) < 2:
        return Model(prior=(shares.get(1, 0) + 0.5) / (total + 1) if total else 0.5)
    train = rows.where("part > 0")
    # Mean and spread of the statistics, from a fixed number of the training rows.
    some = train.orderBy(F.xxhash64("doc_id")).limit(4000).toPandas()[list(docstats.COUNTS)].to_numpy(np.int64)
    f = docstats.features(some)
    waves = Waves(f.mean(axis=0), np.maximum(f.std(axis=0), 1e-3)) if len(some) else Waves(np.zeros(len(docstats.FEATURES)), np.ones(len(docstats.FEATURES)))
    parts = train.repartition(PARTS).mapInArrow(_sums(waves), "sums binary").collect()
    sums = sum(np.frombuffer(r["sums"], np.float64).reshape(WAVES + 1, WAVES + 2) for r in parts)
    n = max(sums[-1, -2], 1)
    beta = np.linalg.solve(sums[:, :-1] + RIDGE * n / WAVES * np.eye(WAVES + 1), sums[:, -1])
    held = rows.where("part = 0").toPandas()
    model = Model(waves, beta, prior=shares.get(1, 0) / total)
    if held["label"].nunique() < 2:
        held = rows.toPandas()
    model.points = isotonic(model.raw(held[list(docstats.COUNTS)].to_numpy(np.int64)), held["label"].to_numpy())
    return model


def classify(docs, labels, learn, column="quality"):
    """docs(doc_id, text) -> doc_id, score, predicted. ``learn``: condition on doc_id of rows whose labels may be seen."""
    counted = rules.statistics(docs)
    model = docs.sparkSession.sparkContext.broadcast(fit(counted.where(learn), labels, column))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield common.record(schema, b.column("doc_id"), np.clip(model.value.score(np.stack([b.column(c).to_numpy() for c in docstats.COUNTS], axis=1)), 0, 1))

    return counted.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op2_quality(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = common.crc_mod("doc_id", 4) == 2
    out = classify(docs, labels, ~held)
    return out.select("doc_id", F.coalesce(common.crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
