"""Alignment of a true and a read text, and how well each class of characters was read.

Characters are code points. A browser's view that counts UTF-16 units differs
only where characters beyond U+FFFF are replaced by each other: there a pair
that shares its first unit is half right.
"""

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chars, fixed

OPS = "array<struct<op:string,gt:string,ocr:string>>"
CLASSES = ("korean", "english", "digit", "chinese")
#: Rows of the matrix between two that are kept; the ones between are made again for the way back.
_STRIDE_LEAST = 64


def _codes(text, blank_equal):
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if blank_equal:
        blank = np.array([c.isspace() or c == "\ufeff" for c in text], bool) if text else np.zeros(0, bool)
        a[blank] = -1
    return a


def _next(row, x, b, steps):
    """The matrix row after ``row``: unit costs, all columns at once."""
    new = np.empty_like(row)
    new[0] = row[0] + 1
    np.minimum(row[1:] + 1, row[:-1] + (b != x), out=new[1:])
    return np.minimum.accumulate(new - steps) + steps


def edit_script(truth, read, blank_equal=False):
    """Cheapest script from ``truth`` to ``read``: [(m|s|i|d, true character, read character)].

    Walking back from the ends, a match goes before a substitution, that
    before an insertion, that before a deletion. Memory is in proportion to
    the square root of the longer side times the other: only some rows are kept.
    """
    a, b = _codes(truth, blank_equal), _codes(read, blank_equal)
    n, m = len(a), len(b)
    steps = np.arange(m + 1, dtype=np.int32)
    stride = max(_STRIDE_LEAST, int(n**0.5) + 1)
    kept, row = {0: steps.copy()}, steps.copy()
    for i in range(1, n + 1):
        row = _next(row, a[i - 1], b, steps)
        if i % stride == 0:
            kept[i] = row
    out, i, j, block, low = [], n, m, [], n + 1
    while i > 0 or j > 0:
        if i > 0 and i - 1 < low:
            low = (i - 1) // stride * stride
            block = [kept[low]]
            for k in range(low + 1, min(n, low + stride) + 1):
                block.append(_next(block[-1], a[k - 1], b, steps))
        here = block[i - low] if i > 0 else steps
        up = block[i - 1 - low] if i > 0 else None
        if i > 0 and j > 0 and a[i - 1] == b[j - 1] and here[j] == up[j - 1]:
            out.append(("m", truth[i - 1], read[j - 1]))
            i, j = i - 1, j - 1
        elif i > 0 and j > 0 and here[j] == up[j - 1] + 1:
            out.append(("s", truth[i - 1], read[j - 1]))
            i, j = i - 1, j - 1
        elif j > 0 and here[j] == here[j - 1] + 1:
            out.append(("i", "", read[j - 1]))
            j -= 1
        else:
            out.append(("d", truth[i - 1], ""))
            i -= 1
    return out[::-1]


_KINDS = tuple((name, re.compile(f"[{inside}]")) for name, inside in (("korean", chars.HANGUL), ("english", "a-zA-Z"), ("digit", "0-9"), ("chinese", fixed.HAN)))


@functools.lru_cache(maxsize=100_000)
def _kind(c):
    """The class of one character."""
    return next((name for name, inside in _KINDS if inside.fullmatch(c)), "other")


def tally(script):
    """{class: [characters, right, wrong]} of a script.

    A character that was only read counts for the class of the next true
    character, else of the one before, else for its own.
    """
    out = {c: [0, 0, 0] for c in CLASSES}
    near, after = [None] * len(script), None
    for i in range(len(script) - 1, -1, -1):
        near[i] = after
        if script[i][0] != "i":
            after = script[i][1]
    before = None
    for (op, gt, read), then in zip(script, near):
        if op != "i":
            before, kind = gt, _kind(gt)
        else:
            kind = _kind(read)
            beside = then if then is not None else before
            if kind != "other" and beside is not None and _kind(beside) != "other":
                kind = _kind(beside)
        if kind in out:
            mine = out[kind]
            mine[0] += 1
            mine[1 if op == "m" else 2] += 1
    return out


def _scripts(blank_equal, ops=True):
    """A function of (truth, read): struct<ops, tally>; ops null if not asked for or where a text is, the tally then all 0."""
    kind = f"struct<ops:{OPS},tally:array<struct<gt_count:bigint,correct:bigint,wrong:bigint>>>"

    def one(x, y):
        if x is None or y is None:
            return {"ops": None, "tally": [dict.fromkeys(("gt_count", "correct", "wrong"), 0)] * len(CLASSES)}
        script = edit_script(x, y, blank_equal)
        counts = [dict(zip(("gt_count", "correct", "wrong"), v)) for v in tally(script).values()]
        return {"ops": [{"op": o, "gt": g, "ocr": r} for o, g, r in script] if ops else None, "tally": counts}

    @F.pandas_udf(kind)
    def scripts(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in pairs:
            yield pd.DataFrame([one(x, y) for x, y in zip(a, b)], columns=["ops", "tally"])

    return scripts


def with_script(pairs: DataFrame, truth="truth", read="extracted", out="ops", blank_equal=False) -> DataFrame:
    """Adds the edit script of each pair; null where a text is null. ``blank_equal``: any two blanks match."""
    return pairs.withColumn(out, _scripts(blank_equal)(F.col(truth), F.col(read))["ops"])


def rates(tallies="tally"):
    """For each class a struct of accuracy, correct, wrong and gt_count, from the counts beside a script."""
    def of(i):
        t = F.col(tallies)[i]
        accuracy = F.when(t["gt_count"] > 0, F.bround(t["correct"] / t["gt_count"] * 100, 1))
        return F.struct(accuracy.alias("accuracy"), t["correct"].alias("correct"), t["wrong"].alias("wrong"), t["gt_count"].alias("gt_count"))

    return [of(i).alias(c) for i, c in enumerate(CLASSES)]


def recognition_rates(pairs: DataFrame, key, truth="truth", read="extracted", blank_equal=False) -> DataFrame:
    """key, and for each class a struct of accuracy, correct, wrong and gt_count: one row for each pair, counted where its script is made."""
    keys = [key] if isinstance(key, str) else list(key)
    made = pairs.select(*keys, _scripts(blank_equal, ops=False)(F.col(truth), F.col(read))["tally"].alias("tally"))
    return made.select(*keys, *rates())


def report(rates: DataFrame, out="report") -> DataFrame:
    """Adds a line for each class, or that the truth holds none of it."""
    rows = []
    for name, label in fixed.CLASS_LABELS:
        r = F.col(name)
        rows.append(F.when(r["gt_count"] > 0, F.concat(F.lit(f"{label}: "), r["accuracy"].cast("string"), F.lit("% (맞음 "), r["correct"].cast("string"), F.lit("자 / 틀림 "), r["wrong"].cast("string"), F.lit("자 / 원본 "), r["gt_count"].cast("string"), F.lit("자)"))).otherwise(f"{label}: 원본에 {label} 없음 (N/A)"))
    return rates.withColumn(out, F.concat_ws("\n", *rows))


def escaped(x):
    c = F.replace(x, F.lit("&"), F.lit("&amp;"))
    for sign, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def diff_html(ops="ops"):
    """The read text as HTML with its differences marked."""

    def part(o):
        gt, ocr = escaped(o["gt"]), escaped(o["ocr"])
        wrong = F.when(chars.char_class(o["gt"]) == "korean", "diff-wrong-kr").otherwise("diff-wrong")
        return (
            F.when(o["op"] == "m", ocr)
            .when(o["op"] == "s", F.concat(F.lit('<span class="diff-col"><span class="diff-original-line">'), gt, F.lit('</span><span class="diff-extracted-line '), wrong, F.lit('">'), ocr, F.lit("</span></span>")))
            .when(o["op"] == "i", F.concat(F.lit('<span class="diff-extracted-line diff-ins">'), ocr, F.lit("</span>")))
            .otherwise(F.concat(F.lit('<span class="diff-col diff-del-wrap"><span class="diff-original-line">'), gt, F.lit('</span><span class="diff-extracted-line">·</span></span>')))
        )

    return F.array_join(F.transform(ops, part), "")


def copy_text(truth, read, report_col):
    """Truth, reading and rates as one text to copy."""
    return F.concat_ws("\n", F.lit("=== OCR 비교 데이터 (AI 보완용) ==="), F.lit(""), F.lit("[원본]"), F.col(truth), F.lit(""), F.lit("[추출]"), F.col(read), F.lit(""), F.lit("[OCR 인식률]"), F.col(report_col), F.lit(""), F.lit("---"))


def truth_of_page(truth, page):
    """The page's part of a truth that blank lines part; the whole truth if it has too few parts."""
    whole = chars.strip(truth)
    parts = F.filter(F.transform(F.split(whole, "\n\n+", -1), chars.strip), lambda p: p != "")
    return F.when((F.col(page) >= 1) & (F.size(parts) >= F.col(page)) & (F.size(parts) > 0), F.try_element_at(parts, F.greatest(F.col(page), F.lit(1)).cast("int"))).otherwise(whole)


def compare(pages: DataFrame, truths: DataFrame, key="doc_id", page="page", text="text", truth="truth") -> DataFrame:
    """Pages beside their truth: rates, report and HTML. A blank truth gives an error and nothing else."""
    rows = pages.join(truths.select(key, truth), key)
    rows = rows.withColumn("truth_part", truth_of_page(truth, page)).withColumn("error", F.when(F.coalesce(chars.is_blank(truth), F.lit(True)), "no truth"))
    read = F.when(F.col("error").isNull(), F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumn("_s", _scripts(True)(F.col("truth_part"), read))
    rows = rows.withColumn("tally", F.col("_s.tally")).withColumn("html", diff_html("_s.ops")).drop("_s")
    fine = F.col("error").isNull()
    rows = rows.select("*", *[F.when(fine, x).alias(c) for x, c in zip(rates(), CLASSES)])
    return report(rows).withColumn("report", F.when(fine, F.col("report"))).drop("tally")
