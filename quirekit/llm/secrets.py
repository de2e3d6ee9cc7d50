"""Secret scan: fixed base patterns, and formats learned by grammar inference.

Pass 1 scans every whole text once. It takes the base spans, the credentials
they label, and all other tokens. Labelled credentials of each kind then make a prefix tree over
letter classes, whose states are merged where their frequencies of ending and
of going on are compatible (Hoeffding bounds, red states first): one
probabilistic automaton a kind. Pass 2 scores all other tokens (``LEAST_LETTERS`` or more of
``[A-Za-z0-9+/_.=-]``, no base span touched) by their likelihood a letter under
each automaton against a letter-pair model of other tokens, those with digits
among them, and adds those that score like held-back credentials do.

The fit sees every distinct credential and every other token, whatever their
number and length: prefixes, letter pairs, the frequencies of the merged states
and the odds of held-back credentials (a quarter, by hash) are counted in Spark.
Only prefixes of ``LEAST_PREFIX`` credentials or more reach the driver: no test
tells a state of fewer from another, so they go on at the start state. Copies of
a credential count once, and a bare copy of a labelled one is no example of an
ordinary token; for that tasks get 8 bytes for each distinct credential.

Positions are code points of the text, ends exclusive. Defined cases: a null
text is empty and has no spans; repeated rows give repeated results; without
labelled credentials of a kind nothing is added for it.
"""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex")
#: Fewer credentials pass every test of likeness at SIGNIFICANCE.
LEAST_PREFIX = 3
#: Longer tokens are scored one by one.
LONG = 128
MIN_LABELLED = 20
SIGNIFICANCE = 0.01
#: A few bare credentials among the other tokens must not teach that model their letters.
DOUBT = 200
#: A letter at large: by its frequency, as the one before once more, or any of the alphabet.
OFTEN, AGAIN, ALPHABET = 0.85, 0.05, 69
#: Share of held-back credentials that may score below the threshold.
MISSED = 0.02
#: Least log-odds a letter of an added span, whatever the held-back ones say.
LEAST_ODDS = 0.7

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Letters of the shortest credential the base patterns take.
LEAST_LETTERS = 8
TOKEN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST_LETTERS},}}")
#: Tokens whose judgement a task remembers.
CACHE_TOKENS = 200_000
HINTS = ("passw", "secret", "token", "api")


def base_spans(text):
    """[(kind index, start, end, credential)] in order of start, then kind."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_LETTERS]
    # A maximal run that is long enough is the leftmost match of its pattern, so the bound can stand inside it.
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def other_tokens(text, spans):
    """(start, end, token) of tokens that touch no base span."""
    i, wide = 0, []
    for _, a, b, _ in sorted(spans, key=lambda s: s[1]):
        if wide and a <= wide[-1][1]:
            wide[-1][1] = max(b, wide[-1][1])
        else:
            wide.append([a, b])
    for m in TOKEN.finditer(text):
        a, b = m.span()
        while i < len(wide) and wide[i][1] <= a:
            i += 1
        if i == len(wide) or wide[i][0] >= b:
            yield a, b, m[0]


SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("token", pa.string())])
SPANS = "array<struct<kind:int,start:bigint,end:bigint,token:string>>"


SCANNED = f"base {SPANS}, ordinary array<string>"


def _scan(batches):
    schema = pa.schema([("base", pa.list_(SPAN)), ("ordinary", pa.list_(pa.string()))])
    for t in common.chunks(batches):
        base, ordinary, seen = [], [], set()
        for text in t.column("text").chunk(0).to_pylist():
            text = text or ""
            spans = base_spans(text)
            base.append([{"kind": k, "start": a, "end": b, "token": v} for k, a, b, v in spans])
            plain = {v for _, _, v in other_tokens(text, spans)} - seen
            seen |= plain
            ordinary.append(list(plain))
        yield common.record(schema, base, ordinary)


# Letter classes of the automata; a class stands for so many letters.
CLASSES = {"d": "0123456789", "x": "abcdef", "l": "ghijklmnopqrstuvwxyz", "X": "ABCDEF", "U": "GHIJKLMNOPQRSTUVWXYZ"}
CLASS_OF = {c: k for k, letters in CLASSES.items() for c in letters}
COST = {k: -math.log(len(letters)) for k, letters in CLASSES.items()}


class Automaton:
    """A probabilistic automaton inferred from strings of letter classes."""

    def __init__(self, strings, significance=SIGNIFICANCE):
        self.n, self.ends, self.go = [0], [0], [{}]
        for s in strings:
            at = 0
            self.n[0] += 1
            for c in s:
                if c not in self.go[at]:
                    self.go[at][c] = [len(self.n), 0]
                    self.n.append(0)
                    self.ends.append(0)
                    self.go.append({})
                edge = self.go[at][c]
                edge[1] += 1
                at = edge[0]
                self.n[at] += 1
            self.ends[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / significance))
        self._merge()

    @classmethod
    def of_prefixes(cls, rows):
        """From counted prefixes (node, parent, letter class, strings, strings that end there); the root is ROOT, its parent null."""
        self = cls([])
        rows = sorted(rows, key=lambda r: (r.parent is not None, r.node))
        place = {r.node: i for i, r in enumerate(rows)}
        self.n, self.ends, self.go = [r.n for r in rows], [r.ends for r in rows], [{} for _ in rows]
        for r in rows:
            if r.parent is not None:
                self.go[place[r.parent]][r.cls] = [place[r.node], r.n]
        self._merge()
        return self

    def walk(self, classes):
        """(state, class) of each step and (state, None) of the end; a class without an edge leads to the start state."""
        at = 0
        for c in classes:
            yield at, c
            at = self.go[at].get(c, (0, 0))[0]
        yield at, None

    def recount(self, rows):
        """Frequencies of all strings: rows (state, class or null at an end, count) of walk()."""
        for q in self.states:
            self.n[q], self.ends[q] = 0, 0
            for edge in self.go[q].values():
                edge[1] = 0
        for r in rows:
            self.n[r.state] += r.n
            if r.cls is None:
                self.ends[r.state] += r.n
            else:
                self.go[r.state].setdefault(r.cls, [0, 0])[1] += r.n

    def _unlike(self, f, n, g, m):
        return abs(f / n - g / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a, b):
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.n[a], self.n[b]
            if self._unlike(self.ends[a], n, self.ends[b], m):
                return False
            left, right = self.go[a], self.go[b]
            for c in {*left, *right}:
                x, y = left.get(c), right.get(c)
                if self._unlike(x[1] if x else 0, n, y[1] if y else 0, m):
                    return False
                if x and y and x[0] != y[0]:
                    todo.append((x[0], y[0]))
        return True

    def _fold(self, a, b):
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.n[a] += self.n[b]
            self.ends[a] += self.ends[b]
            for c, (to, k) in self.go[b].items():
                if c in self.go[a]:
                    self.go[a][c][1] += k
                    todo.append((self.go[a][c][0], to))
                else:
                    self.go[a][c] = [to, k]

    def _merge(self):
        red = [0]
        while True:
            known = set(red)
            blue = [(q, c, e[0]) for q in red for c, e in sorted(self.go[q].items()) if e[0] not in known]
            if not blue:
                break
            parent, c, b = max(blue, key=lambda x: (self.n[x[2]], -x[2]))
            for r in red:
                if self._compatible(r, b):
                    self.go[parent][c][0] = r
                    self._fold(r, b)
                    break
            else:
                red.append(b)
        self.states = red

    def log_likelihood(self, token):
        """Natural logarithm of the probability of a token's letters."""
        at, total = 0, 0.0
        kinds = len(CLASSES) + 7
        for ch in token:
            c = CLASS_OF.get(ch, ch)
            edge = self.go[at].get(c)
            total += math.log(((edge[1] if edge else 0) + 0.5 / kinds) / (self.n[at] + 0.5)) + COST.get(c, 0.0)
            at = edge[0] if edge else 0
        return total + math.log((self.ends[at] + 0.05) / (self.n[at] + 0.5))

    def tables(self):
        """(log-probability, next state) by state and letter, log-probability of an end by state."""
        place = {q: i for i, q in enumerate(self.states)}
        kinds = len(CLASSES) + 7
        log, then = np.zeros((len(place), LETTERS)), np.zeros((len(place), LETTERS), np.int32)
        for q, i in place.items():
            for code in range(LETTERS):
                c = CLASS_OF.get(chr(code), chr(code))
                to, k = self.go[q].get(c, (0, 0))
                log[i, code] = math.log((k + 0.5 / kinds) / (self.n[q] + 0.5)) + COST.get(c, 0.0)
                then[i, code] = place[to]
        return log, then, np.array([math.log((self.ends[q] + 0.05) / (self.n[q] + 0.5)) for q in place])


LETTERS = 128
#: Tokens that are scored at once.
TOGETHER = 1 << 15


def laid(tokens):
    """(letters as a matrix, sizes, order): longest first, so that the tokens that go on are the first ones."""
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    letters = np.zeros((len(tokens), int(sizes[0])), np.uint8)
    letters[np.arange(letters.shape[1]) < sizes[:, None]] = np.frombuffer("".join([tokens[i] for i in order.tolist()]).encode(), np.uint8)
    return letters, sizes, order


def pair_counts(tokens):
    """How often a letter follows another or a token's start, as a matrix."""
    flat = np.frombuffer(("\n" + "\n".join(tokens)).encode(), np.uint8).astype(np.int64)
    a, b = flat[:-1], flat[1:]
    keep = b != ord("\n")
    return np.bincount(a[keep] * LETTERS + b[keep], minlength=LETTERS * LETTERS).reshape(LETTERS, LETTERS)


def own(keys):
    """How often each of the keys occurs among them."""
    _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[at]


class Pairs:
    """Letter-pair model of other tokens; what a letter is followed by counts only beside ``DOUBT`` letters at large.

    A token it was made from is scored without its own letters, as one that was not.
    """

    def __init__(self, tokens, pair=None):
        """Made from tokens; with counts given, from all tokens but those whose token_hash() is in the sorted array ``tokens``."""
        self.tokens = np.asarray(tokens) if pair is not None else frozenset(tokens)
        self.counted = pair is not None
        self.pair = pair if self.counted else pair_counts(sorted(self.tokens))
        self.one, self.any, self.total = self.pair.sum(axis=1), self.pair.sum(axis=0), int(self.pair.sum())

    def has(self, tokens):
        """Which tokens the model was made from."""
        if not self.counted:
            return np.fromiter((t in self.tokens for t in tokens), bool, len(tokens))
        if not len(self.tokens):
            return np.ones(len(tokens), bool)
        h = np.fromiter(map(token_hash, tokens), np.int64, len(tokens))
        return self.tokens[np.minimum(np.searchsorted(self.tokens, h), len(self.tokens) - 1)] != h

    def log_likelihoods(self, tokens):
        """Natural logarithms of the probabilities of the tokens' letters."""
        mine = self.has(tokens)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.frombuffer(("\n" + "\n".join(tokens)).encode(), np.uint8).astype(np.int64)
        a, b = flat[:-1], flat[1:]
        row, keep = np.cumsum(a == ord("\n")) - 1, b != ord("\n")
        a, b, row = a[keep], b[keep], row[keep]
        m = mine[row]
        total = np.maximum(1, self.total - sizes * mine)[row]
        at_large = OFTEN * (self.any[b] - own(row * LETTERS + b) * m) / total + AGAIN * (a == b) + (1 - OFTEN - AGAIN) / ALPHABET
        follow = self.pair[a, b] - own((row * LETTERS + a) * LETTERS + b) * m
        return np.bincount(row, np.log((follow + DOUBT * at_large) / (self.one[a] - own(row * LETTERS + a) * m + DOUBT)), len(tokens))

    def log_likelihood(self, token):
        return float(self.log_likelihoods([token])[0])


def token_hash(token):
    return xxhash.xxh3_64_intdigest(token) - (1 << 63)


def classes_of(token):
    return [CLASS_OF.get(c, c) for c in token]


class Model:
    """Automata and thresholds of all kinds, with the model they are held against."""

    def __init__(self, credentials, ordinary):
        """Made from lists; fit() makes one from tables."""
        self.pairs = ordinary if isinstance(ordinary, Pairs) else Pairs(ordinary)
        self.kinds, self.fast = {}, None
        for k, tokens in sorted(credentials.items()):
            if len(tokens) >= MIN_LABELLED:
                held = tokens[::4]
                auto = Automaton([classes_of(t) for i, t in enumerate(tokens) if i % 4])
                odds = sorted(self.odds(auto, t) for t in held)
                self.kinds[k] = auto, max(LEAST_ODDS, odds[int(len(odds) * MISSED)])

    def odds(self, automaton, token):
        return (automaton.log_likelihood(token) - self.pairs.log_likelihood(token)) / len(token)

    def judge(self, token):
        """(kind, odds) of the best automaton that accepts a token, else None."""
        best = None
        for k, (auto, least) in self.kinds.items():
            x = self.odds(auto, token)
            if x >= least and (best is None or x > best[1]):
                best = k, x
        return best

    def judge_all(self, tokens):
        """judge() of many tokens, letter by letter for all at once; long ones one by one."""
        if not self.kinds:
            return dict.fromkeys(tokens)
        out = {t: self.judge(t) for t in tokens if len(t) > LONG}
        rest = [t for t in tokens if t not in out]
        if self.fast is None:
            self.fast = {k: auto.tables() for k, (auto, _) in self.kinds.items()}
        automata = self.fast
        for a in range(0, len(rest), TOGETHER):
            part = rest[a : a + TOGETHER]
            letters, sizes, order = laid(part)
            n = len(part)
            plain = self.pairs.log_likelihoods(part)[order]
            score = {k: np.zeros(n) for k in automata}
            at = {k: np.zeros(n, np.int32) for k in automata}
            for i in range(letters.shape[1]):
                m = int(np.searchsorted(-sizes, -i))
                c = letters[:m, i]
                for k, (log, then, _) in automata.items():
                    here = at[k][:m]
                    score[k][:m] += log[here, c]
                    at[k][:m] = then[here, c]
            odds = np.stack([(score[k] + automata[k][2][at[k]] - plain) / sizes for k in automata])
            odds[odds < np.array([self.kinds[k][1] for k in automata])[:, None]] = -np.inf
            best, names = odds.argmax(axis=0), list(automata)
            for j, place in enumerate(order.tolist()):
                x = odds[best[j], j]
                out[part[place]] = (names[best[j]], float(x)) if x > -np.inf else None
        return out


FOUND = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("odds", pa.float64())])
OUT = "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint,odds:double>>, n_base int"


def judging(model):
    """A function of tokens to their judgements, with a bounded memory of tokens met before."""
    known = {}

    def judge(tokens):
        if len(known) > CACHE_TOKENS:
            known.clear()
        known.update(model.judge_all([t for t in tokens if t not in known]))
        return known

    return judge


def _added(model):
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(FOUND)), ("n_base", pa.int32())])

    def run(batches):
        judge = judging(model.value)
        for t in common.chunks(batches):
            scanned = []
            for text in t.column("text").chunk(0).to_pylist():
                base = base_spans(text or "")
                scanned.append((base, list(other_tokens(text or "", base))))
            judged = judge({token for _, tokens in scanned for _, _, token in tokens})
            spans = []
            for base, tokens in scanned:
                found = [(a, k, KINDS[k], e, None) for k, a, e, _ in base]
                for a, e, token in tokens:
                    kind = judged[token]
                    if kind:
                        found.append((a, 3 + kind[0], "like_" + KINDS[kind[0]], e, kind[1]))
                found.sort(key=lambda x: x[:2])
                spans.append([{"kind": k, "start": a, "end": e, "odds": o} for a, _, k, e, o in found])
            yield common.record(schema, t.column("doc_id").chunk(0), spans, [len(base) for base, _ in scanned])

    return run


ROOT = 0


def _prefixes(batches):
    """(kind, node, parent, class, strings, ends) of every prefix; a node is the hash of its classes."""
    schema = pa.schema([("kind", pa.int32()), ("node", pa.int64()), ("parent", pa.int64()), ("cls", pa.string()), ("n", pa.int64()), ("ends", pa.int64())])
    for b in batches:
        n, ends = Counter(), Counter()
        for k, token in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in ("kind", "token")]):
            edge, at = (k, ROOT, None, None), ROOT
            n[edge] += 1
            for c in classes_of(token):
                to = xxhash.xxh3_64_intdigest(c, seed=at & ((1 << 64) - 1)) - (1 << 63)
                edge, at = (k, to, at, c), to
                n[edge] += 1
            ends[edge] += 1
        if n:
            yield common.record(schema, *[list(c) for c in zip(*[(*e, m, ends[e]) for e, m in n.items()])])


def _pair_counts(batches):
    total = np.zeros((LETTERS, LETTERS), np.int64)
    for b in batches:
        if b.num_rows:
            total += pair_counts(b.column(0).to_pylist())
    a, b = np.nonzero(total)
    yield common.record(pa.schema([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]), a.astype(np.int32), b.astype(np.int32), total[a, b])


def fit(scanned):
    """The model of all scanned documents: counts are made in Spark, what reaches the driver is told above."""
    spark = scanned.sparkSession
    labelled = common.save(scanned.select(F.explode("base").alias("s")).select("s.kind", "s.token").distinct(), "labelled")
    sizes = {r.kind: r["count"] for r in labelled.groupBy("kind").count().collect()}
    tokens = scanned.select(F.explode("ordinary").alias("t")).distinct().join(labelled.select(F.col("token").alias("t")), "t", "left_anti")
    pair = np.zeros((LETTERS, LETTERS), np.int64)
    for r in tokens.mapInArrow(_pair_counts, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        pair[r.a, r.b] = r.n

    def hashes(batches):
        for b in batches:
            yield common.record(pa.schema([("h", pa.int64())]), [token_hash(t) for t in b.column(0).to_pylist()])

    known = labelled.select("token").mapInArrow(hashes, "h long").distinct().toArrow().column("h").to_numpy()
    model = Model({}, Pairs(np.sort(known), pair))
    held = F.pmod(F.xxhash64("token"), F.lit(4)) == 0
    nodes = labelled.where(~held).mapInArrow(_prefixes, "kind int, node long, parent long, cls string, n long, ends long")
    nodes = nodes.groupBy("kind", "node", "parent", "cls").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    nodes = nodes.where((F.col("n") >= LEAST_PREFIX) | F.col("parent").isNull()).collect()
    automata = {k: Automaton.of_prefixes([r for r in nodes if r.kind == k]) for k in range(len(KINDS)) if sizes.get(k, 0) >= MIN_LABELLED and any(r.kind == k for r in nodes)}
    shared = spark.sparkContext.broadcast(automata)

    def steps(batches):
        n = Counter()
        for b in batches:
            for k, token in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in ("kind", "token")]):
                if k in shared.value:
                    n.update((k, *step) for step in shared.value[k].walk(classes_of(token)))
        if n:
            schema = pa.schema([("kind", pa.int32()), ("state", pa.int64()), ("cls", pa.string()), ("n", pa.int64())])
            yield common.record(schema, *[list(c) for c in zip(*[(*e, m) for e, m in n.items()])])

    counts = labelled.where(~held).mapInArrow(steps, "kind int, state long, cls string, n long")
    counts = counts.groupBy("kind", "state", "cls").agg(F.sum("n").alias("n")).collect()
    for k, auto in automata.items():
        auto.recount([r for r in counts if r.kind == k])
    model.kinds = {k: (auto, LEAST_ODDS) for k, auto in automata.items()}
    judges = spark.sparkContext.broadcast(model)

    def odds(batches):
        for b in batches:
            rows = [(k, judges.value.odds(judges.value.kinds[k][0], t)) for k, t in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in ("kind", "token")]) if k in judges.value.kinds]
            if rows:
                yield common.record(pa.schema([("kind", pa.int32()), ("odds", pa.float64())]), *[list(c) for c in zip(*rows)])

    scored = common.save(labelled.where(held).mapInArrow(odds, "kind int, odds double"), "odds")
    for r in scored.groupBy("kind").count().collect():
        rank = int(r["count"] * MISSED) + 1
        least = scored.where(F.col("kind") == r.kind).orderBy("odds").limit(rank).agg(F.max("odds")).first()[0]
        model.kinds[r.kind] = automata[r.kind], max(LEAST_ODDS, least)
    common.drop(labelled, scored)
    return model


def scan(docs):
    """docs(doc_id, text) -> doc_id, spans(kind, start, end, odds), n_base: one row for each row."""
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = spark.sparkContext.broadcast(fit(common.save(docs.select("text").mapInArrow(_scan, SCANNED), "scanned")))
    return docs.mapInArrow(_added(model), OUT)


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secrets(spark, sf_dir):
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


BASE_ORACLE = r"""
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(t, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 8)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 32)) AS BIGINT) AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""


def secrets_base(spark, sf_dir):
    """The counts of op9_secrets alone, which SQL can tell as well."""
    return op9_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def redact(docs, mark="[SECRET]"):
    """The documents with every span replaced by ``mark`` and n_chars, where there is one, counted anew.

    All columns of the documents stay, in their order. Rows are matched by
    the text itself, not by doc_id, so repeated ids lose nothing.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    plain = docs.select("text").mapInArrow(_scan, SCANNED)
    model = spark.sparkContext.broadcast(fit(common.save(plain, "scanned")))

    def run(batches):
        judge = judging(model.value)
        for b in batches:
            scanned = []
            for text in b.column("text").to_pylist():
                spans = base_spans(text) if text else []
                scanned.append((text, spans, list(other_tokens(text, spans)) if text else []))
            judged = judge({token for _, _, tokens in scanned for _, _, token in tokens})
            texts = []
            for text, spans, tokens in scanned:
                if text:
                    text = replaced(text, [(a, e) for _, a, e, _ in spans] + [(a, e) for a, e, token in tokens if judged[token]], mark)
                texts.append(text)
            i = b.schema.get_field_index("text")
            yield b.set_column(i, b.schema.field(i), pa.array(texts, b.schema.field(i).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def replaced(text, cut, mark):
    """The text with the union of the spans replaced."""
    parts, at = [], 0
    for a, e in sorted(cut):
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, e)
    return "".join([*parts, text[at:]])
