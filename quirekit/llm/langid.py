"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary (a SentencePiece file, a parameter)
have one probability for each language. A word's probability in a language is
the sum over all its segmentations into pieces, taken by a forward algorithm
over its letters; a text's is the product over its words. Probabilities are
learned by expectation-maximisation on word counts: a backward pass gives every
piece the expected number of its uses, summed over partitions in Spark.

The fit takes, of each language, the ``MAX_DOCS`` documents of the smallest id
hashes and all of their words; scoring reads every word of every text. Only
text is an input of a prediction. The score is the share of the predicted language among all
learned ones and none of them, which holds a text as likely as ``MARGIN`` less a letter than the
language's own training words: what is in no learned language scores below one half.

Words are runs of letters in lower case, marked at their start as the
vocabulary marks them. Defined cases: a text that is null or without a letter is ``und`` with
score 0; so is every text if nothing can be learned. Ties go to the first language in
order. Rows with a null text, lang or doc_id are not learned from.
"""

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import common

FILE = "piece_bpe_32k.model"
MAX_DOCS = 800
ROUNDS = 2
#: Log-probability of a letter outside the vocabulary, the same in all languages.
UNKNOWN = -14.0
#: Log-probability a letter by which a text of no learned language falls short of a learned one.
MARGIN = 1.5
#: Added to each expected use, so no piece is impossible in a language.
SMOOTH = 0.02
CHUNK = 4 << 20
#: Words whose log-probabilities a task remembers.
CACHE_WORDS = 300_000
#: Letters up to which a word's forward sums are kept without logarithms.
PLAIN = 36
LETTERS = re.compile(r"[^\W\d_]+")


def default_path(name=FILE):
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(path):
    """The vocabulary's pieces of letters, after the sign for a word's start; in lower case, once each."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            p = model.id_to_piece(i).lower()
            if p.strip("▁"):
                found.setdefault(p, len(found))
    return list(found)


class Lookup:
    """Ids of pieces by a hash of their letters, for whole arrays of letters."""

    def __init__(self, vocabulary):
        self.size = len(vocabulary)
        self.longest = max(map(len, vocabulary), default=0)
        self.lengths = {len(p) for p in vocabulary}
        keys = np.array([int(self._fold(np.array([[ord(c) for c in p]], np.uint64))[0]) for p in vocabulary], np.uint64)
        bits = 18
        self.shift = np.uint64(64 - bits)
        self.slots = []
        left = np.arange(len(keys))
        while len(left):
            slot = self._slot(keys[left], len(self.slots))
            _, first = np.unique(slot, return_index=True)
            table, key = np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, np.uint64)
            table[slot[first]] = left[first]
            key[slot[first]] = keys[left[first]]
            self.slots.append((table, key))
            left = np.delete(left, first)

    @staticmethod
    def _fold(letters):
        h = np.zeros(len(letters), np.uint64)
        for k in range(letters.shape[1]):
            h = (h ^ letters[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def _slot(self, keys, n):
        return ((keys * np.uint64(0xD6E8FEB86659FD93 + 2 * n * 0x1234567)) >> self.shift).astype(np.int64)

    def find(self, keys):
        """Piece ids of folded letters, -1 where there is none."""
        out = np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        for n, (table, key) in enumerate(self.slots):
            mine = keys[left]
            slot = self._slot(mine, n)
            found = table[slot]
            hit = (found >= 0) & (key[slot] == mine)
            out[left[hit]] = found[hit]
            # A piece stands in a later table only if another one has its slot in this one.
            left = left[(found >= 0) & ~hit]
            if not len(left):
                break
        return out


def laid_out(words):
    """Groups of words of similar length: (positions, letters as a matrix, sizes); the start sign stands in front."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        width = int(sizes[order[at]])
        # Words up to a quarter longer share a group.
        width = max(width, min(int(sizes[order[-1]]), width + width // 4 + 1))
        end = int(np.searchsorted(sizes[order], width, side="right"))
        end = min(end, at + max(1, (1 << 18) // width))
        part = order[at:end]
        raw = np.frombuffer("".join(["▁" + words[i] for i in part.tolist()]).encode("utf-32-le"), np.uint32)
        letters = np.zeros((len(part), int(sizes[part].max())), np.uint64)
        letters[np.arange(letters.shape[1]) < sizes[part][:, None]] = raw
        yield part, letters, sizes[part]
        at = end


def lattice(lookup, letters, sizes):
    """ids[k][:, i]: the piece of k + 1 letters that ends at letter i of each word, -1 for none."""
    n, width = letters.shape
    ids = []
    h = np.zeros((n, width), np.uint64)
    for k in range(min(lookup.longest, width)):
        # One letter more than before, from every place that has so many.
        h = (h[:, : width - k] ^ letters[:, k:]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if k + 1 not in lookup.lengths:
            ids.append(np.full((n, width), -1, np.int32))
            continue
        found = np.full((n, width), -1, np.int32)
        got = lookup.find(h.ravel()).reshape(h.shape)
        # A piece may not reach past its word.
        got[np.arange(k, width)[None, :] >= sizes[:, None]] = -1
        found[:, k:] = got
        ids.append(found)
    return ids


def forward(ids, sizes, probs):
    """Log of the forward sum up to each letter, by word and language; probs: pieces + 1 rows, the last for none."""
    n, width = ids[0].shape
    langs = probs.shape[1]
    # Short words stay far from underflow and need no logarithm at every letter.
    plain = width <= PLAIN
    alpha = np.ones((width + 1, n, langs))
    log = np.zeros((width + 1, n, langs))
    ends = [(x >= 0).any(axis=0) for x in ids]
    for i in range(width):
        total = np.zeros((n, langs))
        for k in range(min(len(ids), i + 1)):
            if not ends[k][i]:
                continue
            piece = ids[k][:, i]
            some = np.flatnonzero(piece >= 0)
            if len(some):
                before = alpha[i - k][some] if plain else np.exp(log[i - k][some] - log[i][some])
                total[some] += before * probs[piece[some]]
        alone = ids[0][:, i] < 0
        total[alone] += (alpha[i][alone] if plain else 1.0) * np.exp(UNKNOWN)
        if plain:
            alpha[i + 1] = total
        else:
            log[i + 1] = log[i] + np.log(total)
    return np.log(alpha) if plain else log


def word_logs(lookup, words, probs):
    """Log-probability of each word in each language."""
    full = np.concatenate([probs, np.zeros((1, probs.shape[1]))])
    out = np.zeros((len(words), probs.shape[1]))
    for part, letters, sizes in laid_out(words):
        out[part] = forward(lattice(lookup, letters, sizes), sizes, full)[sizes, np.arange(len(part))]
    return out


def expected(lookup, words, counts, probs):
    """Expected uses of each piece over all segmentations of words of one language, and the words' log-probability."""
    full = np.concatenate([probs, [0.0]])[:, None]
    uses, total = np.zeros(len(full)), 0.0
    for part, letters, sizes in laid_out(words):
        ids = lattice(lookup, letters, sizes)
        n, width = ids[0].shape
        rows = np.arange(n)
        log = forward(ids, sizes, full)[:, :, 0]
        last = log[sizes, rows]
        # back[i]: log of the sum over segmentations of what follows letter i.
        back = np.full((width + 1, n), -np.inf)
        back[sizes, rows] = 0.0
        weight = counts[part]
        total += float(weight @ last)
        ends = [(x >= 0).any(axis=0) for x in ids]
        for i in range(width, 0, -1):
            inside = i <= sizes
            for k in range(min(len(ids), i)):
                if not ends[k][i - 1]:
                    continue
                piece = ids[k][:, i - 1]
                some = np.flatnonzero((piece >= 0) & inside)
                if len(some):
                    step = np.log(full[piece[some], 0]) + back[i][some]
                    back[i - k - 1][some] = np.logaddexp(back[i - k - 1][some], step)
                    uses += np.bincount(piece[some], weight[some] * np.exp(log[i - k - 1][some] + step - last[some]), minlength=len(uses))
            alone = np.flatnonzero((ids[0][:, i - 1] < 0) & inside)
            back[i - 1][alone] = np.logaddexp(back[i - 1][alone], UNKNOWN + back[i][alone])
    return uses[:-1], total


def _words(texts):
    return [LETTERS.findall(t.lower()) if t else [] for t in texts]


def _counted(batches):
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
    for t in common.chunks(batches):
        seen = {}
        for lang, words in zip(t.column("lang").to_pylist(), _words(t.column("text").chunk(0).to_pylist())):
            mine = seen.setdefault(lang, {})
            for w in words:
                mine[w] = mine.get(w, 0) + 1
        for lang, mine in seen.items():
            yield common.record(schema, [lang] * len(mine), list(mine), list(mine.values()))


def _step(lookup, probs, langs):
    schema = pa.schema([("lang", pa.string()), ("piece", pa.int32()), ("uses", pa.float64())])

    def run(batches):
        total = {}
        for b in batches:
            lang = np.array(b.column("lang").to_pylist(), object)
            words, n = b.column("word").to_pylist(), b.column("n").to_numpy().astype(np.float64)
            for l in set(lang.tolist()):
                at = np.flatnonzero(lang == l)
                some = [words[i] for i in at.tolist()]
                uses, log = expected(lookup, some, n[at], probs[:, langs.index(l)])
                # Two more numbers ride along: the words' log-probability and their letters, start signs included.
                letters = float(n[at] @ np.array([len(w) + 1 for w in some]))
                total[l] = total.get(l, 0) + np.concatenate([uses, [log, letters]])
        for l, uses in total.items():
            some = np.flatnonzero(uses)
            yield common.record(schema, [l] * len(some), some.astype(np.int32), uses[some])

    return run


def fit(docs, path):
    """(languages, lookup, probabilities of pieces by language, log-probability a letter of each) of docs(doc_id, text, lang)."""
    vocabulary = pieces(path)
    lookup = Lookup(vocabulary)
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
    # Ids first, texts after: the choice reads two narrow columns, and what it sends is bounded. One pass for all
    # languages: a bound on the hash, from a language's count, leaves little more than MAX_DOCS of each to be ranked.
    pairs = known.select("doc_id", "lang").distinct()
    sizes = {r.lang: r["count"] for r in pairs.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    ids = []
    if langs:
        top = [(lang, common.bound(MAX_DOCS, n)) for lang, n in sizes.items()]
        few = pairs.join(F.broadcast(docs.sparkSession.createDataFrame(top, "lang string, top long")), "lang")
        few = few.withColumn("h", F.xxhash64("doc_id")).where("h <= top")
        rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
        ids = [(r.doc_id, r.lang) for r in few.withColumn("rank", rank).where(F.col("rank") <= MAX_DOCS).select("doc_id", "lang").collect()]
    if not ids:
        return [], lookup, None, None
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, lang string")
    some = known.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text")
    counted = some.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # Rounds are all work and little data: as many tasks as there are cores, whatever the words' bytes.
    counted = common.save(counted.repartition(max(8, docs.sparkSession.sparkContext.defaultParallelism), "word"), "words")
    # The first step takes pieces of one length as equally likely, longer ones as rarer than their letters together are.
    sizes = np.array([len(p) for p in vocabulary])
    probs = np.repeat((0.02 ** np.minimum(sizes, 3) / 10)[:, None], len(langs), axis=1)
    for _ in range(ROUNDS):
        rows = counted.mapInArrow(_step(lookup, probs, langs), "lang string, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).collect()
        uses = np.full((len(vocabulary) + 2, len(langs)), SMOOTH)
        for r in rows:
            uses[r.piece, langs.index(r.lang)] += r.uses
        probs = uses[:-2] / uses[:-2].sum(axis=0)
    common.drop(counted)
    return langs, lookup, probs, uses[-2] / uses[-1]


def predict(docs, learn, path=None):
    """docs(doc_id, text, lang) -> doc_id, lang_pred, score. ``learn``: condition on doc_id of rows to learn from."""
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = spark.sparkContext.broadcast(fit(docs.where(learn), path or default_path()))
    return docs.select("doc_id", "text").mapInArrow(scorer(model), "doc_id long, lang_pred string, score double")


class Scorer:
    """Scores texts and remembers the words it has met; the memory is bounded and never changes a result."""

    def __init__(self, model):
        self.langs, self.lookup, self.probs, self.usual = model
        self.known, self.logs = {}, np.zeros((0, len(self.langs)))

    def __call__(self, texts):
        """[(language, score)] of texts."""
        split = _words(texts)
        langs = self.langs
        if not langs or not any(split):
            return [("und", 0.0)] * len(texts)
        if len(self.known) > CACHE_WORDS:
            self.known, self.logs = {}, self.logs[:0]
        new = list(set(chain.from_iterable(split)).difference(self.known))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.logs = np.concatenate([self.logs, word_logs(self.lookup, new, self.probs)])
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        flat = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        total = np.zeros((len(split), len(langs)))
        some = np.flatnonzero(sizes)
        total[some] = np.add.reduceat(self.logs[flat], (np.cumsum(sizes) - sizes)[some])
        best = total.argmax(axis=1)
        letters = np.zeros(len(split))
        lengths = np.fromiter(map(len, chain.from_iterable(split)), np.int64, len(flat)) + 1
        letters[some] = np.add.reduceat(lengths, (np.cumsum(sizes) - sizes)[some])
        none = letters * (self.usual[best] - MARGIN)
        every = np.concatenate([total, none[:, None]], axis=1)
        top = total[np.arange(len(split)), best]
        sure = 1 / np.exp(np.minimum(every - top[:, None], 700)).sum(axis=1)
        return [(langs[best[i]], float(sure[i])) if sizes[i] else ("und", 0.0) for i in range(len(split))]


def scorer(model):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        score = Scorer(model.value)
        for t in common.chunks(batches, limit=CHUNK):
            found = score(t.column("text").chunk(0).to_pylist())
            yield common.record(schema, t.column("doc_id").chunk(0), [l for l, _ in found], [s for _, s in found])

    return run


def op4_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = common.crc_mod("doc_id", 4) == 2
    out = predict(docs, ~held)
    return out.select("doc_id", F.coalesce(common.crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
