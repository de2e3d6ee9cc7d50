"""Quality rules whose cutoffs are controlled for risk.

Each rule rejects a text where one statistic lies beyond a cutoff. Cutoffs are
chosen for each stratum of text length from labelled documents that pass the
base rule: one half proposes, the other half is the holdout. The proposing half
gives each rule candidate cutoffs (quantiles of good and of bad documents) and
orders them into one path of ever tighter cutoffs for all rules together: the
next step is the one that rejects most further bad documents for each further
good one. The holdout tests the steps in that order, loosest first, and stops
at the first whose exact binomial (Clopper-Pearson) upper bound of the rate of
good documents that any rule rejects exceeds ``RISK``. As the order is fixed
before the holdout is seen, every step is tested at the full level (fixed
sequence testing); strata share ``DELTA`` equally (Bonferroni). So with
probability 1 - ``DELTA`` no stratum loses more than ``RISK`` of its good documents
to all rules together. Strata with fewer than ``LEAST_GOOD`` good holdout documents are
tested together as one, and the limit holds for them together; if even these are
too few, nothing is rejected there.

All labelled documents take part in the choice. Quantiles that propose cutoffs
are Spark's, with a rank error of 1 / ``ACCURACY``; what lies beyond a cutoff is
counted exactly, and only these sums reach the driver. Defined cases: null texts are empty and fail the base
rule (fewer than 20 words); null labels, ids or labels other than 0 and 1 are
not used; a document with several labels counts as bad if one of them is 0;
without labels of both kinds no cutoff is chosen.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from . import common, docstats

RISK, DELTA = 0.05, 0.05
#: Quantiles of the signed statistics that are tried as cutoffs, of good and of bad documents.
GOOD_LEVELS = (0.8, 0.9, 0.95, 0.97, 0.98, 0.99, 0.995, 0.999, 1.0)
BAD_LEVELS = (0.1, 0.25, 0.5, 0.75, 0.9, 0.97)
LEVELS = sorted({*GOOD_LEVELS, *BAD_LEVELS})
ACCURACY = 10_000
#: The path ends where the proposing half says that this many times RISK is spent.
FAR = 2.0
#: Upper ends of the strata, in words.
STRATA = (100, 400, 1500, float("inf"))
#: Twice the good documents that certify a cutoff which rejects none of them.
LEAST_GOOD = 2 * math.ceil(math.log(DELTA / len(STRATA)) / math.log1p(-RISK))
#: (statistic, sign): the rule rejects where sign * statistic > cutoff.
RULES = (("symbols", 1), ("repeats", 1), ("dup_lines", 1), ("upper", 1), ("marks", 1), ("distinct", -1), ("same", 1), ("word_length", 1))


def binomial_upper(k, n, delta):
    """Exact upper confidence bound of a rate after k of n, at confidence 1 - delta."""
    if n == 0 or k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]
    lo, hi = k / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        if p >= 1.0 or sum(math.exp(c + i * math.log(p) + (n - i) * math.log1p(-p)) if p > 0 else float(i == 0) for i, c in enumerate(logs)) <= delta:
            hi = p
        else:
            lo = p
    return hi


def stratum(words):
    return np.searchsorted(np.array(STRATA), words, side="left")


def certified(k, n, delta, limit):
    """Whether binomial_upper(k, n, delta) <= limit, by one sum."""
    if k >= n or k > limit * n:
        return False
    at = math.lgamma(n + 1)
    return sum(math.exp(at - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(limit) + (n - i) * math.log1p(-limit)) for i in range(k + 1)) <= delta


def cells_of(sizes):
    """The cell in which each stratum is tested: its own, or len(STRATA) for all that hold too few.

    sizes: {stratum: good holdout documents}.
    """
    return [s if sizes.get(s, 0) >= LEAST_GOOD else len(STRATA) for s in range(len(STRATA))]


def candidates(good, bad):
    """Cutoffs to try from the loosest on, of quantiles at LEVELS."""
    some = [x for x, q in zip(good, LEVELS) if q in GOOD_LEVELS] + [x for x, q in zip(bad, LEVELS) if q in BAD_LEVELS]
    return sorted(set(some), reverse=True)


def path(cuts, good, bad, n_good):
    """[(rule, cutoff)]: each step tightens one rule, by what the proposing half counts.

    cuts[r]: candidates of a rule; good[r], bad[r]: documents beyond each; n_good: good documents.
    """
    at, steps, spent = [-1] * len(cuts), [], 0
    while True:
        best = None
        for r in range(len(cuts)):
            g0, b0 = (good[r][at[r]], bad[r][at[r]]) if at[r] >= 0 else (0, 0)
            for k in range(at[r] + 1, len(cuts[r])):
                more, cost = bad[r][k] - b0, good[r][k] - g0
                if more > 0:
                    best = max(best or (-1.0,), (more / (cost + 0.5), -cost, -r, k))
        if best is None:
            return steps
        r, k = -best[2], best[3]
        spent -= best[1]
        at[r] = k
        steps.append((r, cuts[r][k]))
        if spent > FAR * RISK * n_good:
            return steps


def select(steps, good, n_good, delta):
    """How many steps are certified. good: holdout documents that each step is the first to reject."""
    lost = 0
    for t in range(len(steps)):
        lost += int(good[t])
        if not certified(lost, n_good, delta, RISK):
            return t
    return len(steps)


def first_step(values, steps):
    """The first step that rejects each row, len(steps) where none does."""
    if not steps:
        return np.zeros(len(values), np.int64)
    beyond = np.stack([values[:, r] > c for r, c in steps] + [np.ones(len(values), bool)], axis=1)
    return beyond.argmax(axis=1)


def choose(values, labels, halves, strata):
    """cutoffs[stratum][rule] of signed statistics held in memory; infinite where a rule is off.

    values: a matrix of signed statistics, a column for each rule. halves: True for the holdout.
    """
    sizes = {s: int(((strata == s) & (labels == 1) & halves).sum()) for s in range(len(STRATA))}
    place = cells_of(sizes)
    out = np.full((len(STRATA), values.shape[1]), np.inf)
    for cell in sorted(set(place)):
        at = np.isin(strata, [s for s, c in enumerate(place) if c == cell])
        near, far = (values[at & (labels == y) & ~halves] for y in (1, 0))
        held = values[at & (labels == 1) & halves]
        if not len(near) or not len(far):
            continue
        cuts = [candidates(np.quantile(near[:, r], LEVELS), np.quantile(far[:, r], LEVELS)) for r in range(values.shape[1])]
        counts = [[[int((x[:, r] > c).sum()) for c in cuts[r]] for r in range(values.shape[1])] for x in (near, far)]
        steps = path(cuts, *counts, len(near))
        hist = np.bincount(first_step(held, steps), minlength=len(steps) + 1)
        for r, c in steps[: select(steps, hist, len(held), DELTA / len(set(place)))]:
            for s in np.flatnonzero(np.array(place) == cell):
                out[s, r] = c
    return out


def labelled(labels, column):
    """One label for each doc_id: 0 if any of its labels is 0."""
    ok = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull())
    return ok.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(column).cast("int").alias("label"))


def _counted(batches):
    schema = pa.schema([("doc_id", pa.int64())] + [(c, pa.int64()) for c in docstats.COUNTS])
    for t in common.chunks(batches):
        rows = np.array([docstats.counts(x) for x in common.as_bytes(t.column("text").chunk(0))], np.int64)
        yield common.record(schema, t.column("doc_id").chunk(0), *np.ascontiguousarray(rows.T))


def statistics(docs):
    """docs(doc_id, text) -> doc_id and docstats.COUNTS, written once and read again."""
    common.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.save(docs.mapInArrow(_counted, "doc_id long, " + ", ".join(f"{c} long" for c in docstats.COUNTS)), "statistics")


def _signed(rows):
    f = docstats.features(rows)
    return np.stack([sign * f[:, docstats.FEATURES.index(name)] for name, sign in RULES], axis=1)


VALUES = [f"v{r}" for r in range(len(RULES))]


def base_failed(c):
    """Whether rows of counts fail the base rule."""
    return (c[:, 0] < 20) | (100 * c[:, 4] > 30 * c[:, 0])


def _placed(batches):
    schema = pa.schema([("stratum", pa.int32()), ("label", pa.int32()), ("held", pa.bool_())] + [(v, pa.float64()) for v in VALUES])
    for b in batches:
        if b.num_rows:
            c = np.stack([b.column(n).to_numpy() for n in docstats.COUNTS], axis=1)
            held = common.mix64(b.column("doc_id").to_numpy().view(np.uint64)) % np.uint64(2) == 1
            rows = common.record(schema, stratum(c[:, 0]).astype(np.int32), b.column("label"), held, *np.ascontiguousarray(_signed(c).T))
            yield rows.filter(pa.array(~base_failed(c)))


def _tallied(place, cuts):
    """Documents beyond each candidate, one row for each of a partition's (cell, rule, candidate)."""
    schema = pa.schema([("cell", pa.int32()), ("rule", pa.int32()), ("cut", pa.int32()), ("good", pa.int64()), ("bad", pa.int64())])

    def run(batches):
        total = {k: np.zeros((len(v), 2), np.int64) for k, v in cuts.items()}
        for b in batches:
            cell, bad = np.array(place)[b.column("stratum").to_numpy()], b.column("label").to_numpy() == 0
            for (at, r), some in cuts.items():
                v = b.column(VALUES[r]).to_numpy()
                for i, x in enumerate(some):
                    over = (v > x) & (cell == at)
                    total[at, r][i] += int((over & ~bad).sum()), int((over & bad).sum())
        rows = [(at, r, i, *n) for (at, r), t in total.items() for i, n in enumerate(t.tolist())]
        if rows:
            yield common.record(schema, *[list(c) for c in zip(*rows)])

    return run


def _stepped(place, steps):
    """Documents that each step is the first to reject, one row for each of a partition's (cell, step)."""
    schema = pa.schema([("cell", pa.int32()), ("step", pa.int32()), ("good", pa.int64()), ("bad", pa.int64())])

    def run(batches):
        total = {c: np.zeros((len(s) + 1, 2), np.int64) for c, s in steps.items()}
        for b in batches:
            cell, good = np.array(place)[b.column("stratum").to_numpy()], b.column("label").to_numpy() == 1
            values = np.stack([b.column(v).to_numpy() for v in VALUES], axis=1)
            for c, some in steps.items():
                for k, at in enumerate((cell == c) & y for y in (good, ~good)):
                    total[c][:, k] += np.bincount(first_step(values[at], some), minlength=len(some) + 1)
        rows = [(c, t, *n) for c, x in total.items() for t, n in enumerate(x.tolist())]
        if rows:
            yield common.record(schema, *[list(c) for c in zip(*rows)])

    return run


def certify(counted, labels, column="quality"):
    """(cutoffs for each stratum and rule, report): by all labelled documents that pass the base rule.

    report: for each cell tested (strata, good holdout documents, good and bad ones
    rejected, bad ones, steps certified of all).
    """
    out = np.full((len(STRATA), len(RULES)), np.inf)
    placed = counted.join(labelled(labels, column), "doc_id").select("doc_id", "label", *docstats.COUNTS)
    placed = common.save(placed.mapInArrow(_placed, "stratum int, label int, held boolean, " + ", ".join(f"{v} double" for v in VALUES)), "placed")
    sizes = {(r.stratum, r.label, r.held): r["count"] for r in placed.groupBy("stratum", "label", "held").count().collect()}
    place = cells_of({s: n for (s, label, held), n in sizes.items() if label == 1 and held})
    total = {(c, y, h): sum(n for (s, label, held), n in sizes.items() if place[s] == c and label == y and held == h) for c in set(place) for y in (0, 1) for h in (False, True)}
    cells = [c for c in sorted(set(place)) if total[c, 1, False] and total[c, 0, False]]
    if cells:
        cell = F.element_at(F.array(*map(F.lit, place)), F.col("stratum") + 1).alias("cell")
        sums = [F.percentile_approx(v, LEVELS, ACCURACY).alias(v) for v in VALUES]
        levels = {(r.cell, r.label): r for r in placed.where("NOT held").groupBy(cell, "label").agg(*sums).collect()}
        cuts = {(c, r): candidates(levels[c, 1][v], levels[c, 0][v]) for c in cells for r, v in enumerate(VALUES)}
        tallied = placed.where("NOT held").mapInArrow(_tallied(place, cuts), "cell int, rule int, cut int, good long, bad long")
        beyond = {(t.cell, t.rule, t.cut): (t.good, t.bad) for t in tallied.groupBy("cell", "rule", "cut").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()}
        steps = {}
        for c in cells:
            mine = [cuts[c, r] for r in range(len(RULES))]
            good, bad = ([[beyond[c, r, k][i] for k in range(len(mine[r]))] for r in range(len(RULES))] for i in (0, 1))
            steps[c] = path(mine, good, bad, total[c, 1, False])
        tested = placed.where("held").mapInArrow(_stepped(place, steps), "cell int, step int, good long, bad long")
        hist = {(t.cell, t.step): (t.good, t.bad) for t in tested.groupBy("cell", "step").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()}
    report = []
    for c in cells:
        first = [hist.get((c, t), (0, 0)) for t in range(len(steps[c]))]
        n = select(steps[c], [g for g, _ in first], total[c, 1, True], DELTA / len(set(place)))
        mine = [s for s in range(len(STRATA)) if place[s] == c]
        for r, x in steps[c][:n]:
            out[mine, r] = x
        report.append((mine, total[c, 1, True], sum(g for g, _ in first[:n]), sum(b for _, b in first[:n]), total[c, 0, True], n, len(steps[c])))
    common.drop(placed)
    return out, report


def fit(counted, labels, column="quality"):
    """Cutoffs for each stratum and rule."""
    return certify(counted, labels, column)[0]


def apply_rules(docs, labels, column="quality"):
    """docs(doc_id, text), labels(doc_id, quality) -> doc_id, counts, base_failed, failed (rules), kept."""
    counted = statistics(docs)
    cutoffs = docs.sparkSession.sparkContext.broadcast(fit(counted, labels, column))
    names = [n for n, _ in RULES]
    base = [c for c in docstats.COUNTS[:5]]
    schema = pa.schema([("doc_id", pa.int64())] + [(c, pa.int64()) for c in base] + [("base_failed", pa.bool_()), ("failed", pa.list_(pa.string())), ("kept", pa.bool_())])

    def run(batches):
        for b in batches:
            c = np.stack([b.column(n).to_numpy() for n in docstats.COUNTS], axis=1) if b.num_rows else np.zeros((0, len(docstats.COUNTS)), np.int64)
            beyond = _signed(c) > cutoffs.value[stratum(c[:, 0])]
            low = base_failed(c)
            failed = [[names[i] for i in np.flatnonzero(row)] for row in beyond]
            yield common.record(schema, b.column("doc_id"), *[np.ascontiguousarray(c[:, i]) for i in range(len(base))], low, failed, ~low & ~beyond.any(axis=1))

    return counted.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in base) + ", base_failed boolean, failed array<string>, kept boolean")


def op10_quality_rules(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return apply_rules(docs, labels).withColumn("failed", F.array_join("failed", ","))


BASE_ORACLE = r"""
WITH w AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
v AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS s FROM w WHERE len(w) >= 8),
x AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS k FROM v),
r AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM x WHERE k > 1) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(n, 0) > 30 * len(w) AS base_failed
FROM w LEFT JOIN r USING (doc_id)
"""


def quality_rules_base(spark, sf_dir):
    """The counts of op10_quality_rules and its base rule alone, which SQL can tell as well."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return apply_rules(docs, labels).drop("failed", "kept")
