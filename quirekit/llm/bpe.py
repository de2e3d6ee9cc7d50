"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

Leaf i of a word's tree is (rank of the pair that starts at symbol i, i), so the
root is the leftmost pair of the lowest rank. A merge changes three leaves: the
pair itself, its left neighbour and the one that vanished; each is a logarithmic
point update. The loop ends where the root holds no mergeable pair.

Words of one size class are encoded together: the trees are the rows of one
array, and each step merges one pair in every row that still has one. Words of
more than ``WIDE`` bytes get a tree of their own.

The tokenizer's file is a parameter and its special tokens are found in the
text as the tokenizers library finds them. Defined cases: a null text encodes
as the empty text; repeated rows give repeated results.
"""

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from . import common

FILE = "byte_bpe_50k.json"
WIDE = 128
#: Distinct words whose ids a task remembers; beyond that it starts afresh. Memory only, never results.
CACHE_WORDS = 250_000
NONE = np.int64(1) << np.int64(40)


def default_path(name=FILE):
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters():
    """The printable letter that stands for each byte in the vocabulary."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, extra = {}, 256
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class Bpe:
    """Tables of one tokenizer file."""

    def __init__(self, path):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        left, right, made = [], [], []
        for m in spec["model"]["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            left.append(vocab[a])
            right.append(vocab[b])
            made.append(vocab[a + b])
        keys = np.array(left, np.int64) << 20 | np.array(right, np.int64)
        order = np.argsort(keys, kind="stable")
        first = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
        self.keys, self.ranks, self.made = keys[order][first], order[first].astype(np.int64), np.array(made, np.int64)
        self.pairs = {(a, b): i for i, (a, b) in reversed(list(enumerate(zip(left, right))))}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces = [b""] * size
        for token, i in vocab.items():
            self.pieces[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        # A hashed first guess spares most binary searches: slot -> index into keys.
        self.bits = np.uint64(64 - 19)
        slots = (self.keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.bits
        self.slot = np.full(1 << 19, -1, np.int32)
        self.slot[slots[::-1].astype(np.int64)] = np.arange(len(slots) - 1, -1, -1, dtype=np.int32)
        crowded = np.zeros(1 << 19, bool)
        crowded[np.flatnonzero(np.bincount(slots.astype(np.int64), minlength=1 << 19) > 1)] = True
        self.crowded = crowded
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def rank(self, left, right):
        """Ranks of pairs, NONE where the pair has no merge."""
        key = left << np.int64(20) | right
        slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)
        at = self.slot[slot]
        hit = (at >= 0) & (self.keys[at] == key)
        out = np.where(hit, self.ranks[at], NONE)
        again = np.flatnonzero(~hit & self.crowded[slot])
        if len(again):
            k = key[again]
            at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            out[again] = np.where(self.keys[at] == k, self.ranks[at], NONE)
        return out

    def encode_words(self, words):
        """Ids (little-endian uint32 bytes) of each word given as non-empty bytes."""
        out = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(sizes > WIDE):
            out[i] = self._one(words[i])
        low = 0
        for width in (4, 8, 16, 32, 64, WIDE):
            these = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            step = max(1, (1 << 21) // width)
            for k in range(0, len(these), step):
                part = these[k : k + step]
                for i, ids in zip(part.tolist(), self._together([words[i] for i in part.tolist()], sizes[part], width)):
                    out[i] = ids
        return out

    def _together(self, words, sizes, width):
        n = len(words)
        raw = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        inside = np.arange(width) < sizes[:, None]
        ids = np.zeros((n, width + 1), np.int64)
        ids[:, :width][inside] = raw
        after = np.tile(np.arange(1, width + 2), (n, 1))  # next living symbol; its size where none
        before = np.tile(np.arange(-1, width), (n, 1))
        tree = np.full((n, 2 * width), NONE * width)
        pair = np.arange(width) < sizes[:, None] - 1
        r, c = np.nonzero(pair)
        ranks = self.rank(ids[r, c], ids[r, c + 1])
        tree[r, width + c] = np.where(ranks < NONE, ranks * width + c, NONE * width)
        level = width // 2
        while level:
            np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
            level //= 2
        alive = inside.copy()
        active = np.flatnonzero(tree[:, 1] < NONE * width)
        while len(active):
            root = tree[active, 1]
            i, rank = root % width, root // width
            j = after[active, i]
            ids[active, i] = self.made[rank]
            alive[active, j] = False
            k = after[active, j]
            after[active, i] = k
            before[active, np.minimum(k, width)] = i
            tree[active, width + j] = NONE * width
            has = k < sizes[active]
            new = np.full(len(active), NONE * width)
            a = active[has]
            got = self.rank(ids[a, i[has]], ids[a, k[has]])
            new[has] = np.where(got < NONE, got * width + i[has], NONE * width)
            tree[active, width + i] = new
            p = before[active, i]
            has = p >= 0
            a, q = active[has], p[has]
            got = self.rank(ids[a, q], ids[a, i[has]])
            tree[a, width + q] = np.where(got < NONE, got * width + q, NONE * width)
            spots = [(active, width + j), (active, width + i), (a, width + q)]
            while spots[0][1][0] > 1:
                spots = [(row, at >> 1) for row, at in spots]
                for row, at in spots:
                    tree[row, at] = np.minimum(tree[row, 2 * at], tree[row, 2 * at + 1])
            active = active[tree[active, 1] < NONE * width]
        flat = ids[:, :width][alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _one(self, word):
        """One long word with plain lists."""
        ids = [int(x) for x in self.byte_id[np.frombuffer(word, np.uint8)]]
        n = len(ids)
        width = 1 << (n - 1).bit_length()
        none, pairs, made = (1 << 60), self.pairs, self.made.tolist()
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = pairs.get((ids[i], ids[i + 1]))
            if r is not None:
                tree[width + i] = r * width + i
        for at in range(width - 1, 0, -1):
            tree[at] = min(tree[2 * at], tree[2 * at + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray(b"\1") * n

        def put(i, j):
            r = pairs.get((ids[i], ids[j])) if 0 <= i and j < n else None
            update(i, none if r is None else r * width + i)

        def update(i, value):
            at = width + i
            tree[at] = value
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                tree[at] = a if a < b else b
                at >>= 1

        while tree[1] < none:
            i, rank = tree[1] % width, tree[1] // width
            j = after[i]
            ids[i] = made[rank]
            alive[j] = 0
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            update(j, none)
            put(i, k)
            if before[i] >= 0:
                put(before[i], i)
        return np.array([x for x, a in zip(ids, alive) if a], "<u4").tobytes()

    def encode(self, texts):
        """Ids (little-endian uint32 bytes) of each text."""
        return list(self.encoder()(texts))

    def encoder(self):
        """A function from texts to ids that remembers the words it has met."""
        known = {}

        def run(texts):
            if len(known) > CACHE_WORDS:
                known.clear()
            split = []
            for text in texts:
                if self.split is not None and any(s in text for s in self.special):
                    parts = self.split.split(text)
                    split.append([w for k, p in enumerate(parts) for w in ([p] if k % 2 else self.words.findall(p))])
                    for s, i in self.special.items():
                        known[s] = np.array([i], "<u4").tobytes()
                else:
                    # A special token that is no match above cannot come out as one word: it mixes letters and signs.
                    split.append(self.words.findall(text))
            new = list({w for doc in split for w in doc} - known.keys())
            known.update(zip(new, self.encode_words([w.encode() for w in new])))
            get = known.__getitem__
            return [b"".join(map(get, doc)) for doc in split]

        return run

    def decode(self, ids):
        """Text of ids given as little-endian uint32 bytes."""
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def encode(docs, path=None, with_ids=False):
    """docs(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded where asked)."""
    common.small_batches(docs.sparkSession)
    path = path or default_path()
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    if with_ids:
        fields += [("ids", pa.list_(pa.int64())), ("decoded", pa.string())]
    schema = pa.schema(fields)

    def run(batches):
        bpe = Bpe(path)
        encoder = bpe.encoder()
        for t in common.chunks(batches):
            ids = encoder([x or "" for x in t.column("text").chunk(0).to_pylist()])
            decoded = [bpe.decode(x) for x in ids]
            columns = [t.column("doc_id").chunk(0), [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(x.encode()).hexdigest() for x in decoded]]
            if with_ids:
                columns += [[np.frombuffer(x, "<u4").tolist() for x in ids], decoded]
            yield common.record(schema, *columns)

    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, out)


def op8_bpe(spark, sf_dir):
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
