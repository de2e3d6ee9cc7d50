"""Rules and pipeline against the known cases and a small independent statement in Python."""

import random
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from quirekit.functions import chars, english, fixed, rules
from quirekit.sources import config

CASES = [
    ("", ""),
    ("   \n  ", "   \n  "),
    ("초거대 언어 모델(L\nL\ne\nM\nm\n)", "초거대 언어 모델(LLM)"),
    ("초거대 언어 모델(Lem)", "초거대 언어 모델(LLM)"),
    ("알고리즘 투명성 및 편향 감사: | 모델의 의사결정", "알고리즘 투명성 및 편향 감사: AI 모델의 의사결정"),
    ("Sel f-Ref lective Reliability", "Self-Reflective Reliability"),
    ("스\n스로", "스스로"),
    ("기\n억", "기억"),
    ("차\n단", "차단"),
    ("문장 앞부분.\n·\n문장 뒷부분.", "문장 앞부분.\n문장 뒷부분."),
    ("(Sel f-Ref lective Reliability)", "(Self-ReflectiveReliability)"),
    ("가\n·\n나", "가 나"),
    ("가\n가\n나", "가가나"),
    ("가·나·다", "가 나 다"),
    ("()", "()"),
    ("((a b) c)", "((ab) c)"),
    ("각 x y", "각 xy"),
]


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, text string")


def test_known_cases(spark):
    out = rules.normalise(texts(spark, [a for a, _ in CASES] + [None]), log=True).orderBy("i").collect()
    for (_, want), r in zip(CASES, out):
        assert r.normalised == unicodedata.normalize("NFC", want)
    assert out[0].normalised_flags == [] and out[0].normalised_log == []
    assert out[1].normalised_log == [] and out[-1].normalised is None
    assert [e.rule_id for e in out[6].normalised_log] == ["kr_kr_merge"]
    assert "guardrail: line_count_changed" in out[6].normalised_flags


def test_whole_repair(spark):
    values = ["가\n·\n나", "규청과 목순", "=—=\n7. 5O5 1I1\n\n  끝", "", None, "가\n나\n다", "(Lem) 먼어", "위반 있음\r\nok"]
    out = rules.correct(texts(spark, values), prohibited=("위반",)).orderBy("i").collect()
    assert [r.corrected for r in out] == ["가나", "규정과 목적", "1. 505 111\n\n끝", "", None, "가나다", "(LLM) 언어", "위반 있음\nok"]
    assert out[-1].corrected_prohibited == ["위반 있음"]


# An independent statement of single rules, character by character where that is short.

SP = str.isspace
HAN = lambda c: "가" <= c <= "힣"
AZ = lambda c: c.isascii() and c.isalpha()


def py_joined(t):
    out, i = "", 0
    while i < len(t):
        out += t[i]
        if HAN(t[i]):
            j = i + 1
            while j < len(t) and SP(t[j]):
                j += 1
            gap = t[i + 1 : j]
            if (gap == "\n" or len(gap) >= 2) and j < len(t) and HAN(t[j]):
                out += (gap if t[i] == t[j] else "") + t[j]
                i = j
        i += 1
    return out


def py_runs(t):
    lines, out = t.split("\n"), []
    short = lambda s: 1 <= len(s.strip()) <= 2 and all(map(HAN, s.strip()))
    run = []
    for s in [*lines, None]:
        if s is not None and short(s):
            run.append(s)
            continue
        out += ["".join(x.strip() for x in run)] if len(run) > 1 else run
        run = []
        if s is not None:
            out.append(s)
    return "\n".join(out)


def py_dots(t):
    word = lambda c: HAN(c) or (c.isascii() and c.isalnum())
    while True:
        for i, c in enumerate(t):
            if c in "·∙":
                a, b = t[:i].rstrip(), t[i + 1 :].lstrip()
                if a and b and word(a[-1]) and word(b[0]):
                    t = a + " " + b
                    break
        else:
            return t


def py_breaks(t):
    parts = re.split(r"(\s+)", t)
    for i in range(1, len(parts) - 1, 2):
        if "\n" in parts[i] and parts[i - 1] and parts[i + 1] and AZ(parts[i - 1][-1]) and AZ(parts[i + 1][0]):
            parts[i] = ""
    return "".join(parts)


def py_gaps(t):
    parts = re.split(r"(\s+)", t)
    en = lambda s: s != "" and all(AZ(c) or c == "-" for c in s)
    for i in range(1, len(parts) - 1, 2):
        a, b = parts[i - 1], parts[i + 1]
        if en(a) and en(b) and a[-1] != "-" and (len(b) <= 3 or b[0].islower()):
            parts[i] = ""
    return "".join(parts)


def py_tokens(t):
    def fix(w):
        if sum(map(str.isalnum, w)) / len(w) < 0.6:
            return w
        w = w.replace("·", "")
        return "".join("I" if c == "|" and 0 < i < len(w) - 1 and AZ(w[i - 1]) and AZ(w[i + 1]) else c for i, c in enumerate(w))

    return "\n".join(" ".join(map(fix, s.split())) for s in t.split("\n"))


def py_noise(t):
    return "\n".join(s for s in t.splitlines() if not s.strip() or set(s.strip()) - set("=—|-· \t"))


def py_bullets(t):
    return "\n".join(s for s in t.split("\n") if s.strip() not in ("·", "∙", "•"))


@pytest.mark.parametrize(
    "rule, statement",
    [(rules.join_syllables, py_joined), (rules.short_lines, py_runs), (rules.middle_dots, py_dots), (rules.english_breaks, py_breaks), (rules.english_gaps, py_gaps), (rules.english_tokens, py_tokens), (rules.drop_noise_lines, py_noise), (rules.bullet_lines, py_bullets)],
)
def test_rule_equals_statement(spark, rule, statement):
    rng = random.Random(rule.__name__)
    letters = ["가", "나", "다", "스로", "a", "b", "The", "-", "|", "·", "∙", "•", " ", "  ", "\n", "\n", "\t", "=", "—", "1", "0", "O", ".", "(", ")", " ", "　", "\x85", "\r\n", "\x1c"]
    values = ["".join(rng.choices(letters, k=rng.randrange(25))) for _ in range(1500)]
    got = texts(spark, values).select("i", rule(F.col("text")).alias("out")).orderBy("i").collect()
    for v, r in zip(values, got):
        assert r.out == statement(v), repr(v)


def test_change_count(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choices("ab가🙂", k=rng.randrange(6))), "".join(rng.choices("ab가🙂", k=rng.randrange(6)))) for _ in range(300)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", rules.change_count("a", "b").alias("n"))
    for (a, b), r in zip(pairs, df.orderBy("i").collect()):
        assert r.n == sum(x != y for x, y in zip(a, b)) + abs(len(a) - len(b))


def test_english(spark):
    cases = [("P0II", "PII"), ("Al", "AI"), ("P|I", "PII"), ("0!!", "PII"), ("LLeMm", "LLM"), ("Lem", "LLM"), ("", ""), ("   ", "   "), (" CO0L ", "COOL"), ("P1I", "PII")]
    got = texts(spark, [a for a, _ in cases]).select("i", english.repaired("text").alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [b for _, b in cases]
    cases = [("PII", True), ("AI", True), ("Self-Reflective", True), ("가나다", False), ("PII한글", False), ("123", False), ("1!", False), ("", False), (None, False), ("é漢", True)]
    got = texts(spark, [a for a, _ in cases]).select("i", english.valid("text").alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [b for _, b in cases]
    cases = [("P0II", "PII"), ("Al", "AI"), ("한글", None), ("", None), (None, None)]
    got = texts(spark, [a for a, _ in cases]).select("i", english.classified("text").alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [b for _, b in cases]


def test_suspects_and_predicates(spark):
    cases = [("", False), ("가1", False), ("(),", False), ("ㄹㅇ", False), ("a1", True), ("(x", True), ("ㄹa", True), ("LLM", False), (None, False)]
    got = texts(spark, [a for a, _ in cases]).select("i", chars.english_suspect("text").alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [b for _, b in cases]
    got = texts(spark, ["의", "의사들", "a"]).select("i", chars.retry_word(F.lit(90), "text").alias("t"), chars.retry_mode("text").alias("m")).orderBy("i").collect()
    assert [(r.t, r.m) for r in got] == [(True, 10), (False, 8), (False, 10)]


def test_catalogue_of_rules(spark):
    rows = rules.catalogue(spark).orderBy("position").collect()
    assert len(rows) == 9 and all(r.rule_id and r.description and r.condition and r.example for r in rows)


def test_config_tables(spark, tmp_path):
    (tmp_path / "typos.txt").write_text("# c\n\nab\tx\nabc\ty z\n\tq\nno tab\ncd\t w\n", encoding="utf-8")
    assert config.typo_map(spark, str(tmp_path / "typos.txt")) == (("abc", "y z"), ("ab", "x"), ("cd", "w"))
    (tmp_path / "bad.txt").write_text("^a+$\n(\n# x\nb\n", encoding="utf-8")
    assert config.prohibited_patterns(spark, str(tmp_path / "bad.txt")) == ("^a+$", "b")
    assert rules.by_length(fixed.TYPOS)[0] == ("Self-ReflectiveReliability", "Self-Reflective Reliability")


def test_long_white_space_is_looked_at_once(spark):
    n = 400_000
    values = ["a" + " " * n + "b", " " * n, "x" + "\n" * n + ".", "x" + "\n" * n + "y", " \n" * n + "z"]
    began = time.time()
    df = texts(spark, values).select("i", chars.strip("text").alias("s"), rules.english_breaks("text").alias("b")).select("i", F.length("s").alias("s"), F.length("b").alias("b"))
    got = {r.i: (r.s, r.b) for r in df.collect()}
    assert got == {0: (n + 2, n + 2), 1: (0, n), 2: (n + 2, n + 2), 3: (n + 2, 2), 4: (1, 2 * n + 1)}
    assert time.time() - began < 30
