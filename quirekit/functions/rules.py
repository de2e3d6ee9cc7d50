"""Text repair as ordered column rules.

A rule is a function Column -> Column with an id and a description. The
pipeline applies them in order, one projection each, so that no expression is
evaluated more often than it is written; logs and flags are columns of the
same plan and cost nothing where they are not selected.
"""

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import chars, fixed
from .chars import WS, col

S, K = fixed.SPACE, fixed.SYLLABLE


@dataclass(frozen=True)
class Rule:
    rule_id: str
    description: str
    condition: str
    example: str
    apply: Callable[[Column], Column]


# First stage: patterns.


def lines(x):
    """Lines as str.splitlines has them."""
    c = F.regexp_replace(col(x), r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]", "\n")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(c, r"\n\z", ""), "\n", -1))


def drop_noise_lines(x):
    """Without lines of rules and bars; blank lines stay."""
    return F.array_join(F.filter(lines(x), lambda s: chars.is_blank(s) | ~chars.strip(s).rlike(rf"\A[{fixed.NOISE}]+\z")), "\n")


def join_syllables(x):
    """Syllables parted by a line break or wide gap belong together, unless they are the same."""
    gap = rf"(?:\n|{WS}{{2,}})"
    return F.regexp_replace(col(x), rf"([{K}])(?:({gap}\1)|{gap}([{K}]))", "$1$2$3")


def fix_digits(x):
    """O and I between digits; 7. at a line's start."""
    c = F.regexp_replace(col(x), r"(?<=\p{Nd})O(?=\p{Nd})", "0")
    c = F.regexp_replace(c, r"(?<=\p{Nd})I(?=\p{Nd})", "1")
    return F.regexp_replace(c, r"(?dm)^7\.", "1.")


def first_stage(x):
    return fix_digits(join_syllables(drop_noise_lines(x)))


def by_length(typos):
    """Longest wrong spelling first, ties in the order given."""
    return sorted(typos, key=lambda p: -len(p[0]))


def fix_typos(x, typos=fixed.TYPOS):
    """Every pair in order; later pairs see what earlier ones wrote."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), by_length(typos), col(x))


def prohibited_lines(x, patterns):
    """Lines that match one of the patterns, cut for the log."""
    if not patterns:
        return F.array().cast("array<string>")
    hit = lambda s: reduce(lambda a, b: a | b, [s.rlike(p) for p in patterns])
    most = fixed.HIT_LETTERS
    return F.transform(F.filter(lines(x), hit), lambda s: F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("..."))).otherwise(s))


# The rules of the normaliser.


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode NFC; Spark has no such function."""
    return texts.str.normalize("NFC")


def middle_dots(x):
    """A middle dot between words was a space."""
    return F.regexp_replace(col(x), rf"([{K}A-Za-z0-9]){WS}*[·∙]{WS}*(?=[{K}A-Za-z0-9])", "$1 ")


def bullet_lines(x):
    """Lines of one bullet go."""
    return F.array_join(F.filter(F.split(col(x), "\n", -1), lambda s: ~s.rlike(rf"\A{WS}*[·∙•]{WS}*\z")), "\n")


def _around(x, pattern, fix):
    """Replace every match of a pattern by a function of its text."""
    outside = F.split(col(x), pattern, -1)
    inside = fix(F.regexp_extract_all(col(x), F.lit(f"({pattern})"), F.lit(1)))
    return F.array_join(F.zip_with(outside, inside, lambda o, i: F.concat(o, F.coalesce(i, F.lit("")))), "")


def short_lines(x):
    """Runs of lines with one or two syllables are one word."""
    w = f"[{S}&&[^\n]]*+"
    piece = f"[{K}]{{1,2}}+{w}(?![^\n])"
    run = f"(?<![^\n]){w}{piece}(?:\n{w}{piece})++"
    return _around(x, run, lambda found: F.transform(found, lambda s: F.regexp_replace(s, f"{WS}+", "")))


def english_breaks(x):
    """A line break inside English goes, with the white space around it."""
    return F.regexp_replace(col(x), rf"(?<=[A-Za-z])(?=[{S}&&[^\n]]*+\n){WS}++(?=[A-Za-z])", "")


def english_gaps(x):
    """A short or small-lettered English token joins the one before."""
    return F.regexp_replace(col(x), rf"(?<![^{S}])([A-Za-z\-]*[A-Za-z]){WS}+(?=(?:[A-Za-z\-]{{1,3}}|[a-z][A-Za-z\-]*)(?![^{S}]))", "$1")


def _lookup(table, x):
    pairs = F.create_map(*[F.lit(v) for p in table.items() for v in p])
    return F.coalesce(F.try_element_at(pairs, x), x)


def parentheses(x):
    """Inside parentheses: no white space, look-alikes, acronyms, capitals."""

    def fix(found):
        found = F.transform(found, lambda s: F.regexp_replace(F.substring(s, F.lit(2), F.length(s) - 2), f"{WS}+", ""))
        found = F.transform(found, lambda s: F.regexp_replace(F.replace(s, F.lit("|"), F.lit("I")), "0(?=[A-Za-z])", "O"))
        found = F.transform(found, lambda s: _lookup(fixed.PAREN_ACRONYMS, F.regexp_replace(s, "(?<=[A-Za-z])0", "O")))
        capital = lambda s: s.rlike(r"\A[A-Za-z]{3,}\z") & (F.length(F.regexp_replace(s, "[A-Z]", "")) <= 1)
        return F.transform(found, lambda s: F.concat(F.lit("("), F.when(capital(s), F.upper(s)).otherwise(s), F.lit(")")))

    return _around(x, r"\([^()]*\)", fix)


def bar_for_ai(x):
    return F.regexp_replace(col(x), rf":{WS}*\|({WS}*모델)", ": AI$1")


def english_tokens(x):
    """Per token: look-alikes where letters and digits prevail; one space between tokens."""

    def fix(t):
        # Most tokens hold neither sign and need no closer look.
        return F.when(t.rlike("[·|]") & chars.alnum_gate(t), F.regexp_replace(F.replace(t, F.lit("·"), F.lit("")), r"(?<=[A-Za-z])\|(?=[A-Za-z])", "I")).otherwise(t)

    return F.array_join(F.transform(F.split(col(x), "\n", -1), lambda s: F.array_join(F.transform(chars.words(s), fix), " ")), "\n")


RULES = (
    Rule("nfc", "compose Unicode characters", "always", "decomposed syllables become whole ones", nfc),
    Rule("space_dot_fix", "middle dot between words becomes a space", "a word character on both sides", "A·B -> A B", middle_dots),
    Rule("bullet_remove", "drop lines of a lone bullet", "nothing else on the line", "· -> (nothing)", bullet_lines),
    Rule("kr_kr_merge", "join runs of one- and two-syllable lines", "two or more such lines in a row", "스 / 스로 -> 스스로", short_lines),
    Rule("en_en_break_merge", "drop line breaks inside English", "an ASCII letter on both sides", "L / L / M -> LLM", english_breaks),
    Rule("en_en_space_merge", "join split English words", "a token of at most three letters, or a small letter first", "Sel f -> Self", english_gaps),
    Rule("paren_fix", "repair what stands in parentheses", "innermost parentheses", "(Ll m) -> (LLM)", parentheses),
    Rule("pipe_to_ai", "a bar after a colon was AI", "before the word for model", ": | 모델 -> : AI 모델", bar_for_ai),
    Rule("ocr_similar_en", "look-alikes in tokens, one space between them", "letters and digits make 60 %", "P|I -> PII", english_tokens),
)


def catalogue(spark, rules=RULES):
    """The rules as a table, in their order."""
    rows = [(i, r.rule_id, r.description, r.condition, r.example) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "position int, rule_id string, description string, condition string, example string")


def change_count(a, b):
    """Characters that differ by place, and the difference of lengths."""
    a, b = col(a), col(b)
    differ = F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.isNotNull() & y.isNotNull() & (x != y)), lambda x: x)
    both = F.when((a == "") | (b == ""), 0).otherwise(F.size(differ))
    return both + F.abs(F.length(a) - F.length(b))


def guardrail(before, after):
    """array<struct<line, ratio>> of lines, matched by place, that changed beyond the limit."""
    old, new = F.split(col(before), "\n", -1), F.split(col(after), "\n", -1)
    pairs = F.slice(F.arrays_zip(old.alias("o"), new.alias("n")), F.lit(1), F.least(F.size(old), F.size(new)))
    rated = F.transform(pairs, lambda p, i: F.struct(i.alias("line"), F.when((p["o"] == p["n"]) | chars.is_blank(p["o"]), 0.0).otherwise(change_count(p["o"], p["n"]) / F.length(p["o"])).alias("ratio")))
    return F.filter(rated, lambda p: p["ratio"] > fixed.CHANGE_LIMIT)


def normalise(df: DataFrame, text="text", rules=RULES, out="normalised", log=False, prefix="_r") -> DataFrame:
    """Adds ``out`` (the text), ``out``_flags, ``out``_changed (lines beyond the limit) and, with ``log``, ``out``_log.

    A null or blank text comes back as it is, without flags or log. A blank
    text is kept out of every rule by the final choice, not by a filter, so
    rows keep their order and number.
    """
    names = df.columns
    at = lambda i: f"{prefix}{i}"
    df = df.withColumn(at(0), col(text))
    for i, rule in enumerate(rules):
        df = df.withColumn(at(i + 1), rule.apply(F.col(at(i))))
    last = F.col(at(len(rules)))
    blank = F.coalesce(chars.is_blank(text), F.lit(True))
    changed = guardrail(at(0), at(len(rules)))
    none = F.array().cast("array<string>")
    df = df.withColumn(f"{out}_changed", F.when(blank, F.array().cast("array<struct<line:int,ratio:double>>")).otherwise(changed))
    messages = F.transform(f"{out}_changed", lambda p: F.concat(F.lit("line_"), p["line"].cast("string"), F.lit(": change_ratio="), F.format_string("%.2f", F.bround(p["ratio"] * 100, 2)), F.lit(f"% > {fixed.CHANGE_LIMIT}")))
    moved = F.size(F.split(last, "\n", -1)) != F.size(F.split(F.col(at(0)), "\n", -1))
    flags = F.concat(messages, F.when(moved, F.array(F.lit("guardrail: line_count_changed"))).otherwise(none))
    more = [F.when(blank, none).otherwise(flags).alias(f"{out}_flags")]
    if log:
        kept = fixed.LOG_LETTERS
        entries = [F.when(F.col(at(i)) != F.col(at(i + 1)), F.struct(F.lit(r.rule_id).alias("rule_id"), F.substring(at(i), 1, kept).alias("before"), F.substring(at(i + 1), 1, kept).alias("after"))) for i, r in enumerate(rules)]
        empty = F.array().cast("array<struct<rule_id:string,before:string,after:string>>")
        more.append(F.when(blank, empty).otherwise(F.array_compact(F.array(*entries))).alias(f"{out}_log"))
    return df.select(*names, F.when(blank, col(text)).otherwise(chars.strip(last)).alias(out), f"{out}_changed", *more)


def correct(df: DataFrame, text="text", typos=fixed.TYPOS, prohibited=(), out="corrected", rules=RULES) -> DataFrame:
    """The whole repair: patterns, dictionary, prohibited lines (``out``_prohibited), normaliser."""
    names = df.columns
    stage = f"_{out}_stage"
    df = df.withColumn(f"{stage}1", drop_noise_lines(text)).withColumn(f"{stage}2", join_syllables(f"{stage}1"))
    df = df.withColumn(stage, fix_typos(fix_digits(f"{stage}2"), typos))
    df = normalise(df, stage, rules, out=f"{out}_n")
    blank = F.coalesce(chars.is_blank(text), F.lit(True))
    return df.select(
        *names,
        F.when(blank, col(text)).otherwise(F.col(f"{out}_n")).alias(out),
        F.when(blank, F.array().cast("array<string>")).otherwise(prohibited_lines(stage, prohibited)).alias(f"{out}_prohibited"),
        F.when(blank, F.array().cast("array<string>")).otherwise(F.col(f"{out}_n_flags")).alias(f"{out}_flags"),
    )
