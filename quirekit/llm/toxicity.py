"""Toxicity: a convolutional text classifier in numpy, thresholds by language.

A word's vector is the sum of two hashed embeddings, of the word and of its
first letters, so an unseen form of a known stem is not blank. Filters of
several widths run over the whole text; each filter's largest response is
kept (max pooling) and a logistic layer weighs them. Training is plain numpy:
only the positions that won the pooling carry a gradient.

``FOLDS`` networks are trained, each without one fold of the rows, in a task
each; a text's logit is their mean. Every row has a logit of the network that did not see it, and
on these thresholds are calibrated for each language: a logistic curve of one slope
whose place is shifted by language, shifts shrunk where a language has few
rows, so a thin language does not hang on a handful of scores. Scores are
stretched so that every language's threshold becomes ``CUT``. The language is guessed from the text
alone, by the stems' counts in the training rows of each language; labels,
lang, source and doc_id are no inputs of a score.

At most ``MAX_GOOD`` and ``MAX_BAD`` labelled rows, those of the smallest id
hashes, take part, with their whole texts up to ``MAX_WORDS`` words together. Defined cases: a null text scores
as an empty one; without rows of both labels every score is the share of
toxic ones (0 without any); with too few for folds one network learns and
calibrates on all; null ids and labels other than 0 and 1 are
not learned from.
"""

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from . import common, rules

BUCKETS = 1 << 14
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
STEM = 4
STEPS, BATCH, RATE = 600, 48, 0.03
FOLDS = 3
#: Penalty on a language's shift: so many rows' worth of doubt.
SHRINK = 0.5
#: Passes over the training rows: as many as STEPS takes, within these bounds.
EPOCHS = (6, 40)
MAX_GOOD, MAX_BAD, MAX_WORDS = 4000, 2500, 6_000_000
CUT = 0.7
CACHE_WORDS = 300_000
MARKS = b".,;:!?\"'()[]{}|*$%&#"


def hashed(word):
    """Both buckets of a word (bytes, lower case) in one number."""
    word = word.strip(MARKS)
    try:
        stem = word.decode()[:STEM].encode()
    except UnicodeDecodeError:
        stem = word[:STEM]
    return xxhash.xxh3_64_intdigest(word) % BUCKETS * BUCKETS + xxhash.xxh3_64_intdigest(b"\0" + stem) % BUCKETS


class Hasher:
    """Texts to arrays of word numbers; remembers a bounded number of words."""

    def __init__(self):
        self.known = {}

    def __call__(self, texts):
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        split = [t.lower().encode().split() if t else [] for t in texts]
        known = self.known
        for doc in split:
            for w in set(doc).difference(known):
                known[w] = hashed(w)
        return [np.fromiter(map(known.__getitem__, doc), np.int64, len(doc)) for doc in split]


class Net:
    def __init__(self, seed=5):
        rng = np.random.RandomState(seed)
        self.word = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
        self.stem = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
        self.filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = np.float32(0.0)

    def laid(self, docs):
        """Word numbers of documents one after the other, padded so that no window meets two; where each starts."""
        pad = max(WIDTHS) - 1
        sizes = np.array([len(d) for d in docs]) + pad
        starts = np.cumsum(sizes) - sizes
        flat = np.full(int(sizes.sum()) + pad, -1, np.int64)
        for d, a in zip(docs, starts):
            flat[a : a + len(d)] = d
        return flat, starts

    def embed(self, flat):
        x = self.word[flat // BUCKETS] + self.stem[flat % BUCKETS]
        x[flat < 0] = 0
        return x

    def responses(self, x, n):
        """Responses of all filters at each of the first n positions."""
        return np.concatenate([sum(x[k : n + k] @ f[k] for k in range(len(f))) for f in self.filters], axis=1) + self.bias

    def pooled(self, docs):
        flat, starts = self.laid(docs)
        n = len(flat) - max(WIDTHS) + 1
        return np.maximum(np.maximum.reduceat(self.responses(self.embed(flat), n), starts, axis=0), 0)

    def logits(self, docs):
        """One for each document, a bounded number of words at a time."""
        out, held, size = [], [], 0
        for d in docs:
            held.append(d)
            size += len(d) + 2
            if size > 60_000:
                out.append(self.pooled(held) @ self.out + self.base)
                held, size = [], 0
        if held:
            out.append(self.pooled(held) @ self.out + self.base)
        return np.concatenate(out) if out else np.zeros(0)

    def train(self, docs, labels, seed=6):
        rng = np.random.RandomState(seed)
        weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
        sums = {k: 1e-6 for k in ("word", "stem", "out", "base", "bias")} | {("f", i): 1e-6 for i in range(len(WIDTHS))}
        sums["word"], sums["stem"] = np.full(BUCKETS, 1e-6, np.float32), np.full(BUCKETS, 1e-6, np.float32)

        def rate(key, g):
            sums[key] = sums[key] + g * g
            return RATE * g / np.sqrt(sums[key])

        for _ in range(int(np.clip(STEPS * BATCH // max(1, len(docs)), *EPOCHS))):
            order = rng.permutation(len(docs))
            for a in range(0, len(order), BATCH):
                pick = order[a : a + BATCH]
                flat, starts = self.laid([docs[i] for i in pick])
                x = self.embed(flat)
                n = len(flat) - max(WIDTHS) + 1
                r = self.responses(x, n)
                ends = np.append(starts[1:], n)
                won = np.stack([s + r[s:e].argmax(axis=0) for s, e in zip(starts, ends)])
                top = np.take_along_axis(r, won, axis=0)
                h = np.maximum(top, 0)
                p = 1 / (1 + np.exp(-(h @ self.out + self.base)))
                err = ((p - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
                dh = err[:, None] * self.out * (top > 0)
                self.out -= rate("out", h.T @ err + 1e-4 * self.out)
                self.base -= rate("base", err.sum())
                dx, at = [], []
                for i, w in enumerate(WIDTHS):
                    cols = slice(i * FILTERS, (i + 1) * FILTERS)
                    g, place = dh[:, cols], won[:, cols]
                    df = np.zeros_like(self.filters[i])
                    for k in range(w):
                        df[k] = np.einsum("bfd,bf->df", x[place + k], g)
                        dx.append((g[:, :, None] * self.filters[i][k].T[None]).reshape(-1, DIM))
                        at.append((place + k).ravel())
                    self.filters[i] -= rate(("f", i), df)
                self.bias -= rate("bias", dh.sum(axis=0))
                dx, at = np.concatenate(dx), np.concatenate(at)
                numbers = flat[at]
                for name, table, rows in (("word", self.word, numbers // BUCKETS), ("stem", self.stem, numbers % BUCKETS)):
                    some = numbers >= 0
                    ids, back = np.unique(rows[some], return_inverse=True)
                    g = np.zeros((len(ids), DIM), np.float32)
                    np.add.at(g, back, dx[some])
                    sums[name][ids] += (g * g).mean(axis=1)
                    table[ids] -= RATE * g / np.sqrt(sums[name][ids])[:, None]
        return self


class Languages:
    """Guesses a language by the counts of stems in each."""

    def __init__(self, docs, langs):
        self.names = sorted({x for x in langs if x is not None})
        counts = np.full((BUCKETS, max(1, len(self.names))), 0.1)
        for d, lang in zip(docs, langs):
            if lang is not None:
                np.add.at(counts[:, self.names.index(lang)], d % BUCKETS, 1)
        self.logs = np.log(counts / counts.sum(axis=0)).astype(np.float32)

    def __call__(self, docs):
        """Index of the language of each document."""
        if len(self.names) < 2:
            return np.zeros(len(docs), np.int64)
        return np.array([int(self.logs[d % BUCKETS].sum(axis=0).argmax()) if len(d) else 0 for d in docs], np.int64)


def calibrated(z, labels, langs, n):
    """(slope, shift of each of n languages) of the logistic curve of logits z, by Newton steps."""
    w = np.concatenate([[1 / max(1e-3, float(np.std(z))), 0.0], np.zeros(n)])
    x = np.concatenate([z[:, None], np.ones((len(z), 1)), np.eye(n)[langs]], axis=1)
    penalty = np.concatenate([[1e-3, 1e-3], np.full(n, SHRINK)])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - labels) + penalty * w)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-7:
            break
    return max(1e-3, w[0]), w[1] + w[2:]


class Model:
    def __init__(self, nets=(), languages=None, slope=1.0, shifts=None, prior=0.0):
        self.nets, self.languages, self.slope, self.shifts, self.prior = nets, languages, slope, shifts, prior

    def __call__(self, docs):
        if not self.nets:
            return np.full(len(docs), self.prior)
        z = sum(net.logits(docs).astype(np.float64) for net in self.nets) / len(self.nets)
        p = 1 / (1 + np.exp(-np.clip(self.slope * z + self.shifts[self.languages(docs)], -30, 30)))
        return np.where(p < 0.5, CUT * p / 0.5, CUT + (1 - CUT) * (p - 0.5) / 0.5)


def _trained(sent):
    schema = pa.schema([("fold", pa.int64()), ("net", pa.binary()), ("logits", pa.binary())])

    def run(batches):
        texts, y, fold = sent.value
        for b in batches:
            for k in b.column(0).to_pylist():
                train, test = (np.flatnonzero(fold != k), np.flatnonzero(fold == k)) if (fold != k).any() else (np.arange(len(y)),) * 2
                net = Net().train([texts[i].astype(np.int64) for i in train], y[train])
                yield common.record(schema, [k], [pickle.dumps(vars(net))], [net.logits([texts[i].astype(np.int64) for i in test]).astype(np.float64).tobytes()])

    return run


def _numbered(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("label", pa.int32()), ("numbers", pa.binary())])
    hasher = Hasher()
    for t in common.chunks(batches):
        numbers = hasher(t.column("text").chunk(0).to_pylist())
        yield common.record(schema, t.column("doc_id").chunk(0), t.column("lang").chunk(0), t.column("label").chunk(0), [x.astype(np.int32).tobytes() for x in numbers])


def fit(docs, labels, column="toxic"):
    """The model of docs(doc_id, text, lang) that carry a label."""
    lab = rules.labelled(labels, column).join(docs.select("doc_id").distinct(), "doc_id")
    sizes = {r.label: r["count"] for r in lab.groupBy("label").count().collect()}
    ids = []
    for label, most in ((0, MAX_GOOD), (1, MAX_BAD)):
        few = common.smallest(lab.where(F.col("label") == label), ["doc_id"], most, sizes.get(label, 0)).collect()
        ids += [(r.doc_id, r.label) for r in few]
    shares = {x: sum(y == x for _, y in ids) for x in (0, 1)}
    if not all(shares.values()):
        n = sum(shares.values())
        return Model(prior=shares[1] / n if n else 0.0)
    chosen = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long, label int"))
    rows = docs.join(chosen, "doc_id").select("doc_id", "lang", "label", "text").mapInArrow(_numbered, "doc_id long, lang string, label int, numbers binary")
    rows = common.save(rows.withColumn("key", F.xxhash64("doc_id", "numbers")).withColumn("order", F.xxhash64("doc_id")), "numbered")
    # Sizes first: what is fetched is chosen before it is, so no more than MAX_WORDS words and one text reach the driver.
    held, least = 0, None
    for r in sorted(rows.select("order", "key", (F.length("numbers") / 4).alias("n")).collect()):
        if held >= MAX_WORDS:
            least = (r.order, r.key)
            break
        held += r.n
    if least is not None:
        rows = rows.where((F.col("order") < least[0]) | (F.col("order") == least[0]) & (F.col("key") < least[1]))
    rows = sorted(rows.collect(), key=lambda r: (r.order, r.key))
    texts = [np.frombuffer(r.numbers, np.int32).astype(np.int64) for r in rows]
    y = np.array([r.label for r in rows])
    spark = docs.sparkSession
    fold = np.array([r.order % FOLDS for r in rows])
    if any(len(set(y[fold != k].tolist())) < 2 for k in range(FOLDS)):
        fold[:] = 0
    folds = sorted(set(fold.tolist()))
    sent = spark.sparkContext.broadcast(([x.astype(np.int32) for x in texts], y, fold))
    done = spark.range(0, len(folds), 1, len(folds)).mapInArrow(_trained(sent), "fold long, net binary, logits binary").collect()
    sent.destroy()
    nets, z = [], np.zeros(len(y))
    for r in sorted(done, key=lambda r: r.fold):
        nets.append(Net.__new__(Net))
        vars(nets[-1]).update(pickle.loads(r.net))
        z[fold == r.fold] = np.frombuffer(r.logits, np.float64)
    languages = Languages(texts, [r.lang for r in rows])
    slope, shifts = calibrated(z, y, languages(texts), max(1, len(languages.names)))
    return Model(nets, languages, slope, shifts, shares[1] / sum(shares.values()))


def classify(docs, labels, learn, column="toxic"):
    """docs(doc_id, text, lang) -> doc_id, score, predicted. ``learn``: condition on doc_id of rows to learn from."""
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = spark.sparkContext.broadcast(fit(docs.where(learn), labels, column))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        hasher = Hasher()
        for t in common.chunks(batches):
            yield common.record(schema, t.column("doc_id").chunk(0), np.clip(model.value(hasher(t.column("text").chunk(0).to_pylist())), 0, 1))

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op3_toxicity(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = classify(docs, labels, common.crc_mod("doc_id", 3) != 1)
    return out.select("doc_id", F.coalesce(common.crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
