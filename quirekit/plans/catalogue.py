"""Named queries and their DuckDB statements.

The driver's tables hold no Hangul and few reading errors, so most queries
first write errors into the whole texts, in Spark and in SQL alike.
"""

from pyspark.sql import functions as F

from ..functions import chars, english, fixed, geometry, rules
from ..operators import align, images, pages, words

QUERIES = {}
ORACLES = {}


def query(name, oracle=None):
    """Register a ``(spark, sf_dir) -> DataFrame`` under ``name``."""

    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def noted(*changes):
    """The texts with (old, new) replacements."""
    column = F.col("text")
    for old, new in changes:
        column = F.replace(column, F.lit(old), F.lit(new))
    return column


def noted_sql(*changes):
    """The same in SQL."""
    sql = "text"
    for old, new in changes:
        quoted = [s.replace("'", "''").replace("\n", "' || chr(10) || '") for s in (old, new)]
        sql = f"replace({sql}, '{quoted[0]}', '{quoted[1]}')"
    return f"({sql})"


def text_query(name, changes, apply, oracle):
    """A query of doc_id, length and MD5 of each whole text after ``apply``. ``oracle``: SQL of the text with {t} for the changed one."""
    sql = oracle.replace("{t}", noted_sql(*changes))

    @query(name, f"SELECT doc_id, CAST(length(t) AS BIGINT) AS n, md5(t) AS digest FROM (SELECT doc_id, {sql} AS t FROM documents)")
    def run(spark, sf_dir):
        out = documents(spark, sf_dir).select("doc_id", noted(*changes).alias("c")).select("doc_id", apply(F.col("c")).alias("t"))
        return out.select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


# Characters and predicates.


@query(
    "char_class_profile",
    """
    SELECT lang, count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars,
           sum(length(regexp_replace(text, '[^a-zA-Z]', '', 'g')))::BIGINT AS n_english,
           sum(length(regexp_replace(text, '[^0-9]', '', 'g')))::BIGINT AS n_digit,
           sum(length(regexp_replace(text, '[^가-힣ᄀ-ᇿ㄰-㆏]', '', 'g')))::BIGINT AS n_korean,
           sum(length(regexp_replace(text, '[^一-鿿㐀-䶿]', '', 'g')))::BIGINT AS n_chinese,
           sum(length(regexp_replace(text, '[a-zA-Z0-9가-힣ᄀ-ᇿ㄰-㆏一-鿿㐀-䶿]', '', 'g')))::BIGINT AS n_other
    FROM documents GROUP BY lang
    """,
)
def char_class_profile(spark, sf_dir):
    docs = documents(spark, sf_dir).select("lang", F.length("text").alias("n"), chars.class_counts("text").alias("c"))
    total = [F.sum(f"c.{k}").alias(f"n_{k}") for k in ("english", "digit", "korean", "chinese", "other")]
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_chars"), *total)


@query(
    "page_routing",
    r"""
    SELECT doc_id, use_ocr, CASE WHEN use_ocr THEN 'ocr' ELSE 'direct' END AS method, CASE WHEN use_ocr THEN 300 END AS dpi
    FROM (SELECT doc_id, source = 'src0' OR len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) < 10 AS use_ocr FROM documents)
    """,
)
def page_routing(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("force_ocr", F.when(F.col("source") == "src0", "Yes"))
    out = pages.routed(docs, "text").withColumn("method", F.when(F.col("use_ocr"), "ocr").otherwise("direct"))
    return out.select("doc_id", "use_ocr", "method", F.when(F.col("use_ocr"), fixed.DPI).alias("dpi"))


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')"


@query(
    "english_suspects",
    rf"""
    SELECT doc_id, len(w)::BIGINT AS n_words, len(list_filter(w, lambda x: regexp_matches(x, '[0-9|\\/\[\]()+\-!<>]')
           AND NOT regexp_full_match(x, '[|\\/\[\]()+\-!<>.,;:]+')))::BIGINT AS n_suspect
    FROM (SELECT doc_id, {_WORDS} AS w FROM documents)
    """,
)
def english_suspects(spark, sf_dir):
    out = documents(spark, sf_dir).select("doc_id", chars.words(F.coalesce("text", F.lit(""))).alias("w"))
    return out.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.filter("w", chars.english_suspect)).cast("long").alias("n_suspect"))


@query(
    "ascii_shares",
    """
    SELECT doc_id, CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^a-zA-Z0-9]', '', 'g')) / length(text) ELSE 0.0 END AS share,
           regexp_matches(text, '[a-zA-Z]') AS has_letter FROM documents
    """,
)
def ascii_shares(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", chars.ascii_ratio("text").alias("share"), chars.has_letter("text").alias("has_letter"))


@query(
    "valid_english_words",
    rf"""
    SELECT doc_id, len(list_filter(w, lambda x: length(x) >= 2 AND NOT regexp_full_match(x, '[0-9]+')
             AND length(regexp_replace(x, '[^\p{{L}}]', '', 'g')) / length(x) >= 0.5
             AND NOT (length(x) <= 3 AND regexp_matches(x, '[0-9!@#$%^&*]'))))::BIGINT AS n_valid,
           len(list_filter(w, lambda x: length(regexp_replace(x, '[^\p{{L}}\p{{N}}]', '', 'g')) / length(x) >= 0.6))::BIGINT AS n_gate
    FROM (SELECT doc_id, {_WORDS} AS w FROM documents)
    """,
)
def valid_english_words(spark, sf_dir):
    out = documents(spark, sf_dir).select("doc_id", chars.words(F.coalesce("text", F.lit(""))).alias("w"))
    return out.select("doc_id", F.size(F.filter("w", english.valid)).cast("long").alias("n_valid"), F.size(F.filter("w", lambda w: chars.alnum_gate(w))).cast("long").alias("n_gate"))


@query(
    "force_flags",
    """
    SELECT c_custkey, coalesce(lower(v) IN ('1', 'true', 'yes', 'on'), false) AS forced
    FROM (SELECT c_custkey, ['1', 'TRUE', 'yes', 'off', NULL, ' on', 'On', ''][1 + c_custkey % 8] AS v FROM customer)
    """,
)
def force_flags(spark, sf_dir):
    values = F.array(*[F.lit(v) for v in ("1", "TRUE", "yes", "off", None, " on", "On", "")])
    customers = table(spark, sf_dir, "customer")
    return customers.select("c_custkey", chars.truthy(F.element_at(values, (F.col("c_custkey") % 8 + 1).cast("int"))).alias("forced"))


@query(
    "upload_checks",
    """
    SELECT page_id, CASE WHEN NOT lower(path) LIKE '%.pdf' THEN 'not a PDF' WHEN length(content) = 0 THEN 'empty file' END AS reject
    FROM (SELECT page_id, url || ['.pdf', '.PDF', '.txt'][1 + page_id % 3] AS path, CASE WHEN page_id % 5 = 0 THEN '' ELSE html END AS content FROM pages)
    """,
)
def upload_checks(spark, sf_dir):
    endings = F.array(*[F.lit(v) for v in (".pdf", ".PDF", ".txt")])
    path = F.concat("url", F.element_at(endings, (F.col("page_id") % 3 + 1).cast("int")))
    files = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.when(F.col("page_id") % 5 == 0, "").otherwise(F.col("html")).alias("content"))
    return pages.accepted_uploads(files).select("page_id", "reject")


# Text rules, one query for each.

_NOISE = r"array_to_string(list_filter(string_split(regexp_replace({t}, '\n$', ''), chr(10)), lambda s: NOT regexp_full_match(s, '\s*[=—|\-· \t]+\s*') OR regexp_full_match(s, '\s*')), chr(10))"
text_query("noise_lines", [(". ", ".\n=—|\n  - · -\n\n")], rules.drop_noise_lines, _NOISE)
# Equal syllables stay apart: their break is set aside before the others are joined.
_JOIN = r"replace(regexp_replace(replace({t}, '스' || chr(10) || '스', '스§스'), '([가-힣])(?:\n|\s{2,})([가-힣])', '\1\2', 'g'), '스§스', '스' || chr(10) || '스')"
text_query("broken_syllables", [(" the ", " 경\n우  를 "), (". ", ". 스\n스 둘   셋 "), (", ", ", 하나\n  둘 ")], rules.join_syllables, _JOIN)
_DIGITS = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '([0-9])O([0-9])', '\10\2', 'g'), '([0-9])O([0-9])', '\10\2', 'g'), '([0-9])I([0-9])', '\11\2', 'g'), '([0-9])I([0-9])', '\11\2', 'g'), '(?m)^7\.', '1.', 'g')"
)
text_query("digit_fixes", [("555", "5O5I5"), (". ", ".\n7.")], rules.fix_digits, _DIGITS)


def _typo_sql(t):
    for wrong, right in rules.by_length(fixed.TYPOS):
        t = "replace({}, '{}', '{}')".format(t, wrong.replace("'", "''"), right.replace("'", "''"))
    return t


text_query("typo_dictionary", [(" the ", " 표순만 허깅폐이스깨400!ㅁ09 "), (" and ", " Token'Sㅁ' ㄴㄴ M ")], rules.fix_typos, _typo_sql("{t}"))
text_query("composed_characters", [("é", "é"), (" the ", " 한글 "), ("ü", "ü")], rules.nfc, "nfc_normalize({t})")

_DOTS = r"regexp_replace({}, '([가-힣A-Za-z0-9])\s*[·∙]\s*([가-힣A-Za-z0-9])', '\1 \2', 'g')"
text_query("middle_dots", [(" and ", " · "), (" a ", "∙a\n· ")], rules.middle_dots, _DOTS.format(_DOTS.format("{t}")))
_BULLETS = r"array_to_string(list_filter(string_split({t}, chr(10)), lambda s: NOT regexp_full_match(s, '\s*[·∙•]\s*')), chr(10))"
text_query("bullet_lines", [(". ", ".\n • \n∙\n• x\n")], rules.bullet_lines, _BULLETS)
_SHORT = r"""(SELECT array_to_string(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN i = 1 OR f[i - 1] AND f[i] THEN '' ELSE chr(10) END
    || CASE WHEN f[i] AND (coalesce(f[i - 1], false) OR coalesce(f[i + 1], false)) THEN regexp_replace(l[i], '\s+', '', 'g') ELSE l[i] END), '')
    FROM (SELECT l, list_transform(l, lambda s: regexp_full_match(s, '\s*[가-힣]{1,2}\s*')) AS f FROM (SELECT string_split({t}, chr(10)) AS l)))"""
text_query("short_line_runs", [(". ", ".\n스\n 스로 \n기억\n"), (", ", ",\n가나\n둘셋넷\n다\n "), (" and ", "\n라\n\n마\n바\n")], rules.short_lines, _SHORT)

_BREAKS = r"regexp_replace({}, '([A-Za-z])\s*\n\s*([A-Za-z])', '\1\2', 'g')"
text_query("english_breaks", [(" a ", " \n a\nb\n "), (".\n", "\n")], rules.english_breaks, _BREAKS.format(_BREAKS.format("{t}")))
_GAPS = (
    r"""(SELECT array_to_string(list_transform(range(1, len(tok) + 1), lambda i: CASE WHEN i = 1 THEN tok[1]
        WHEN regexp_full_match(tok[i - 1], '[A-Za-z\-]*[A-Za-z]') AND regexp_full_match(tok[i], '[A-Za-z\-]{1,3}|[a-z][A-Za-z\-]*') THEN tok[i]
        ELSE sep[i - 1] || tok[i] END), '') FROM (SELECT string_split_regex({t}, '\s+') AS tok, regexp_extract_all({t}, '\s+') AS sep))"""
)
text_query("english_gaps", [], rules.english_gaps, _GAPS)
_ACRONYM = "CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in fixed.PAREN_ACRONYMS.items()) + " ELSE {x} END"
_INNER = r"regexp_replace(regexp_replace(replace(regexp_replace(substr(x, 2, length(x) - 2), '\s+', '', 'g'), '|', 'I'), '0([A-Za-z])', 'O\1', 'g'), '([A-Za-z])0', '\1O', 'g')"
_PARENS = (
    r"""(SELECT array_to_string(list_transform(range(1, len(o) + 1), lambda i: o[i] || coalesce(n[i], '')), '') FROM (SELECT o,
        list_transform(list_transform(list_transform(v, lambda x: """
    + _INNER
    + "), lambda x: "
    + _ACRONYM.replace("{x}", "x")
    + r"""), lambda x: '(' || CASE WHEN regexp_full_match(x, '[A-Za-z]{3,}') AND length(regexp_replace(x, '[A-Z]', '', 'g')) <= 1 THEN upper(x) ELSE x END || ')') AS n
        FROM (SELECT string_split_regex({t}, '\([^()]*\)') AS o, regexp_extract_all({t}, '\([^()]*\)') AS v)))"""
)
text_query("parentheses", [(" the ", " (L\nL e\nMm) "), (" and ", " (P|0 I) (c0 de (Abc) ")], rules.parentheses, _PARENS)
_BAR = r"regexp_replace({t}, ':\s*\|(\s*모델)', ': AI\1', 'g')"
text_query("bar_for_ai", [(". ", ": | 모델. "), (", ", ":\n|모델, ")], rules.bar_for_ai, _BAR)
_TOKEN = r"CASE WHEN length(regexp_replace(w, '[^\p{L}\p{N}]', '', 'g')) / length(w) >= 0.6 THEN regexp_replace(regexp_replace(replace(w, '·', ''), '([A-Za-z])\|([A-Za-z])', '\1I\2', 'g'), '([A-Za-z])\|([A-Za-z])', '\1I\2', 'g') ELSE w END"
_TOKENS = r"array_to_string(list_transform(string_split({t}, chr(10)), lambda s: array_to_string(list_transform(list_filter(string_split_regex(s, '\s+'), lambda w: w <> ''), lambda w: " + _TOKEN + "), ' ')), chr(10))"
text_query("english_tokens", [("th", "t|h"), ("in", "i·n")], rules.english_tokens, _TOKENS)


# The whole chain. The statement goes through it rule by rule, in the order and with the ids that are fixed.

_CHAIN = (
    ("nfc", "nfc_normalize({t})"),
    ("space_dot_fix", _DOTS.replace("{}", _DOTS.replace("{}", "{t}"))),
    ("bullet_remove", _BULLETS),
    ("kr_kr_merge", _SHORT),
    ("en_en_break_merge", _BREAKS.replace("{}", _BREAKS.replace("{}", "{t}"))),
    ("en_en_space_merge", _GAPS),
    ("paren_fix", _PARENS),
    ("pipe_to_ai", _BAR),
    ("ocr_similar_en", _TOKENS),
)
_STRIP = r"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def steps_sql(source, steps, first="c0", prefix="c"):
    """CTEs s1, s2, ... that add a column for each step's text; ``source`` has the column ``first``."""
    out, at, column = [], source, first
    for i, sql in enumerate(steps, 1):
        out.append(f"{prefix}s{i} AS (SELECT *, {sql.replace('{t}', column)} AS {prefix}{i} FROM {at})")
        at, column = f"{prefix}s{i}", f"{prefix}{i}"
    return ",\n".join(out), at, column


def flags_sql(old, new):
    """The flags of lines that changed too much, and of lines won or lost."""
    differ = "len(list_filter(list_zip(string_split(o[i], ''), string_split(n[i], '')), lambda z: z[1] <> z[2]))"
    rated = f"CASE WHEN o[i] = n[i] OR trim(o[i]) = '' THEN 0.0 ELSE (CASE WHEN n[i] = '' THEN 0 ELSE {differ} END + abs(length(o[i]) - length(n[i]))) / length(o[i]) END"
    lines = f"list_filter(list_transform(range(1, least(len(o), len(n)) + 1), lambda i: {{'line': i - 1, 'ratio': {rated}}}), lambda x: x.ratio > 0.05)"
    told = f"list_transform({lines}, lambda x: 'line_' || x.line || ': change_ratio=' || printf('%.2f', x.ratio * 100) || '% > 0.05')"
    return f"(SELECT {told} || CASE WHEN len(o) <> len(n) THEN ['guardrail: line_count_changed'] ELSE [] END FROM (SELECT string_split({old}, chr(10)) AS o, string_split({new}, chr(10)) AS n))"


def repair_sql(source, first="c0", prefix="r"):
    """CTEs of the whole repair of a column: patterns, dictionary, rules."""
    return steps_sql(source, [_NOISE, _JOIN, _DIGITS, _typo_sql("{t}"), *[sql for _, sql in _CHAIN]], first, prefix)


@query(
    "rule_catalogue",
    "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{name}')" for i, (name, _) in enumerate(_CHAIN)) + ") AS v(position, rule_id)",
)
def rule_catalogue(spark, sf_dir):
    return rules.catalogue(spark).select("position", "rule_id")


_NOISY = [(" the ", " 경\n우\n"), (" and ", " · "), (". ", ".\n • \n(L\nL e\nMm) "), ("é", "é"), (", ", ": | 모델 ")]
_NORMALISED, _LAST, _TEXT = steps_sql("base", [sql for _, sql in _CHAIN])


@query(
    "normalised_documents",
    f"""
    WITH base AS (SELECT doc_id, {noted_sql(*_NOISY)} AS c0 FROM documents),
    {_NORMALISED},
    done AS (SELECT doc_id, NOT regexp_matches(c0, '\\S') AS blank, c0, {_STRIP.replace("{t}", _TEXT)} AS t, {flags_sql("c0", _TEXT)} AS flags,
      list_filter([{", ".join(f"CASE WHEN c{i} <> c{i + 1} THEN '{name}' || substr(c{i}, 1, 200) || substr(c{i + 1}, 1, 200) END" for i, (name, _) in enumerate(_CHAIN))}], lambda x: x IS NOT NULL) AS log FROM {_LAST})
    SELECT doc_id, md5(CASE WHEN blank THEN c0 ELSE t END) AS digest, CASE WHEN blank THEN 0 ELSE len(flags) END::INTEGER AS n_flags, md5(CASE WHEN blank THEN '' ELSE array_to_string(flags, chr(10)) END) AS flags,
           CASE WHEN blank THEN 0 ELSE len(log) END::INTEGER AS n_log, md5(CASE WHEN blank THEN '' ELSE array_to_string(log, chr(10)) END) AS log
    FROM done
    """,
)
def normalised_documents(spark, sf_dir):
    out = rules.normalise(documents(spark, sf_dir).select("doc_id", noted(*_NOISY).alias("text")), log=True)
    log = F.transform("normalised_log", lambda e: F.concat(e["rule_id"], e["before"], e["after"]))
    return out.select(
        "doc_id",
        F.md5("normalised").alias("digest"),
        F.size("normalised_flags").alias("n_flags"),
        F.md5(F.array_join("normalised_flags", "\n")).alias("flags"),
        F.size("normalised_log").alias("n_log"),
        F.md5(F.array_join(log, "\n")).alias("log"),
    )


_WRONG = [(" the ", " 표순만\n스\n스로 "), (". ", ".\n=—=\n7. 5O5 (Lem) 규청  과 "), (" and ", " Token'Sㅁ' ")]
_REPAIRED, _LAST_R, _TEXT_R = repair_sql("base")


@query(
    "corrected_documents",
    f"""
    WITH base AS (SELECT doc_id, {noted_sql(*_WRONG)} AS c0 FROM documents),
    {_REPAIRED},
    done AS (SELECT doc_id, NOT regexp_matches(c0, '\\S') AS blank, c0, {_STRIP.replace("{t}", _TEXT_R)} AS t, {flags_sql("r4", _TEXT_R)} AS flags,
      list_transform(list_filter(string_split(r4, chr(10)), lambda s: regexp_matches(s, 'stupid|trash')), lambda s: CASE WHEN length(s) > 80 THEN substr(s, 1, 80) || '...' ELSE s END) AS hits FROM {_LAST_R})
    SELECT doc_id, md5(CASE WHEN blank THEN c0 ELSE t END) AS digest, CASE WHEN blank THEN 0 ELSE len(hits) END::INTEGER AS n_prohibited, md5(CASE WHEN blank THEN '' ELSE array_to_string(hits, chr(10)) END) AS prohibited,
           md5(CASE WHEN blank THEN '' ELSE array_to_string(flags, chr(10)) END) AS flags
    FROM done
    """,
)
def corrected_documents(spark, sf_dir):
    out = rules.correct(documents(spark, sf_dir).select("doc_id", noted(*_WRONG).alias("text")), prohibited=("stupid|trash",))
    hits = F.size("corrected_prohibited").alias("n_prohibited"), F.md5(F.array_join("corrected_prohibited", "\n")).alias("prohibited")
    return out.select("doc_id", F.md5("corrected").alias("digest"), *hits, F.md5(F.array_join("corrected_flags", "\n")).alias("flags"))


@query(
    "changed_lines",
    """
    SELECT doc_id, CAST(len(r) AS INTEGER) AS n_lines, list_max(r) AS worst FROM (
      SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: CASE WHEN trim(s) = '' THEN 0.0
             ELSE CAST((length(s) - length(replace(s, 'the', ''))) // 3 AS DOUBLE) / length(s) END), lambda x: x > 0.05) AS r FROM documents)
    """,
)
def changed_lines(spark, sf_dir):
    column = noted(("the", "tha"))
    changed = documents(spark, sf_dir).select("doc_id", "text", column.alias("after")).select("doc_id", rules.guardrail("text", "after").alias("r"))
    return changed.select("doc_id", F.size("r").alias("n_lines"), F.array_max(F.transform("r", lambda p: p["ratio"])).alias("worst"))


@query(
    "prohibited_lines",
    """
    SELECT doc_id, len(l)::INTEGER AS n_lines, md5(array_to_string(l, chr(10))) AS digest FROM (
      SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[Ss]tupid|tras?h')),
             lambda s: CASE WHEN length(s) > 80 THEN substr(s, 1, 80) || '...' ELSE s END) AS l FROM documents)
    """,
)
def prohibited_lines(spark, sf_dir):
    out = documents(spark, sf_dir).select("doc_id", rules.prohibited_lines("text", ("[Ss]tupid", "tras?h")).alias("l"))
    return out.select("doc_id", F.size("l").alias("n_lines"), F.md5(F.array_join("l", "\n")).alias("digest"))


# English readings.

_SIMILAR = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '([A-Za-z])\|([A-Za-z])', '\1I\2', 'g'), '([A-Za-z])\|([A-Za-z])', '\1I\2', 'g'), '([A-Z])1([A-Z])', '\1I\2', 'g'), '([A-Z])1([A-Z])', '\1I\2', 'g'), '([A-Za-z])0([A-Za-z])', '\1O\2', 'g'), '([A-Za-z])0([A-Za-z])', '\1O\2', 'g')"
_FIX = "CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in fixed.TOKEN_ACRONYMS.items()) + " ELSE {y} END"


@query(
    "english_readings",
    r"""
    WITH w AS (SELECT DISTINCT unnest(list_filter(string_split_regex(replace(replace(text, 'o', '0'), 'i', '|'), '\s+'), lambda x: x <> '')) AS word FROM documents),
    s AS (SELECT word, """
    + _SIMILAR.format("word")
    + """ AS y FROM w),
    r AS (SELECT word, """
    + _FIX.format(x="word", y="(" + _FIX.format(x="y", y="y") + ")")
    + r""" AS repaired FROM s)
    SELECT word, repaired, CASE WHEN length(repaired) >= 2 AND NOT regexp_matches(repaired, '[가-힣ᄀ-ᇿ㄰-㆏]') AND NOT regexp_full_match(repaired, '[0-9]+')
           AND length(regexp_replace(repaired, '[^\p{L}]', '', 'g')) / length(repaired) >= 0.5
           AND NOT (length(repaired) <= 3 AND regexp_matches(repaired, '[0-9!@#$%^&*]')) THEN repaired END AS accepted
    FROM r
    """,
)
def english_readings(spark, sf_dir):
    column = noted(("o", "0"), ("i", "|"))
    found = documents(spark, sf_dir).select(F.explode(F.array_distinct(chars.words(column))).alias("word")).distinct()
    return found.select("word", english.repaired("word").alias("repaired"), english.classified("word").alias("accepted"))


_READ = "replace(w, 'o|n', 'on')"


@query(
    "two_stage_text",
    r"""
    WITH t AS (SELECT item_id, string_split_regex(x, '\s+') AS tok, regexp_extract_all(x, '\s+') AS sep
        FROM (SELECT item_id, regexp_replace(replace(text, 'on', 'o|n'), '^\s+|\s+$', '', 'g') AS x FROM benchmark)),
    w AS (SELECT item_id, i, tok[i] AS w FROM (SELECT item_id, tok, unnest(range(1, len(tok) + 1)) AS i FROM t)),
    c AS (SELECT item_id, i, w, """
    + _READ
    + r""" AS x FROM w WHERE regexp_matches(w, '[0-9|\\/\[\]()+\-!<>]') AND NOT regexp_full_match(w, '[|\\/\[\]()+\-!<>.,;:]+')),
    s AS (SELECT *, """
    + _SIMILAR.format("x")
    + """ AS y FROM c),
    r AS (SELECT *, """
    + _FIX.format(x="x", y="(" + _FIX.format(x="y", y="y") + ")")
    + r""" AS n FROM s),
    g AS (SELECT item_id, i, n, row_number() OVER (PARTITION BY item_id ORDER BY i) AS k FROM r
        WHERE length(n) >= 2 AND NOT regexp_full_match(n, '[0-9]+') AND length(regexp_replace(n, '[^\p{L}]', '', 'g')) / length(n) >= 0.5
          AND NOT (length(n) <= 3 AND regexp_matches(n, '[0-9!@#$%^&*]')) AND length(regexp_replace(n, '[^a-zA-Z0-9]', '', 'g')) / length(n) >= 0.5 AND regexp_matches(n, '[a-zA-Z]')),
    p AS (SELECT w.item_id, string_agg(coalesce(g.n, w.w) || coalesce(t.sep[w.i], ''), '' ORDER BY w.i) AS read_text
        FROM w JOIN t USING (item_id) LEFT JOIN g ON g.item_id = w.item_id AND g.i = w.i AND g.k <= 20 GROUP BY w.item_id)
    SELECT p.item_id, (SELECT count(*) FROM c WHERE c.item_id = p.item_id)::INTEGER AS n_candidates, read_text FROM p
    """,
)
def two_stage_text(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.replace("text", F.lit("on"), F.lit("o|n")).alias("text"))
    fields = lambda w, i: F.concat_ws("\t", *[F.lit(x) for x in ("5", "1", "1")], i.cast("string"), *[F.lit(x) for x in ("0", "0", "10", "10", "40", "12", "90")], w)
    tsv = F.concat_ws("\n", F.lit("header"), F.array_join(F.transform(chars.words("text"), fields), "\n"))
    made = words.candidates(items.withColumn("tsv", tsv).withColumn("base_text", F.col("text")))
    made = made.withColumn("first_readings", F.transform("candidates", lambda w: F.replace(w["text"], F.lit("o|n"), F.lit("on")))).withColumn("second_readings", F.lit(None).cast("array<string>"))
    return words.two_stage(made, out="read_text").select("item_id", F.size("candidates").alias("n_candidates"), "read_text")


@query(
    "domain_containment",
    "SELECT doc_id, "
    + " OR ".join(f"contains(lower(text), '{w.lower()}') OR contains('{w.lower()}', lower(text))" for w in fixed.DOMAIN_WORDS)
    + " AS in_domain FROM documents",
)
def domain_containment(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", english.in_domain("text").alias("in_domain"))


# Word tables.


def word_tables(spark, sf_dir):
    """Word tables made of the benchmark's texts: eight words a line, some with a confidence that is no integer."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text", chars.words("text").alias("w"))

    def line(w, i):
        confidence = F.when(i % 11 == 3, "96.5").when(i % 7 == 2, "-1").otherwise((i * 37 % 101).cast("string"))
        fields = [F.lit("5"), F.lit("1"), F.floor(i / 8).cast("string"), (i % 8).cast("string"), F.lit("0"), F.lit("0"), (i * 10).cast("string"), F.lit("5"), (i % 9).cast("string"), F.lit("12"), confidence, w]
        return F.concat_ws("\t", *fields)

    header = F.lit("level\tpage\tblock\tpar\tline\tword\tleft\ttop\twidth\theight\tconf\ttext")
    return items.withColumn("tsv", F.concat_ws("\n", header, F.array_join(F.transform("w", line), "\n"))).drop("w")


@query(
    "word_table_rows",
    r"""
    SELECT item_id, CAST(i // 8 AS INTEGER) AS line_num, CAST(i % 8 AS INTEGER) AS word_num, CAST(i * 10 AS INTEGER) AS "left", CAST(i % 9 AS INTEGER) AS width,
           CAST(CASE WHEN i % 7 = 2 THEN 0 ELSE i * 37 % 101 END AS INTEGER) AS conf, w[i + 1] AS word_text
    FROM (SELECT item_id, w, unnest(range(0, len(w))) AS i FROM (SELECT item_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM benchmark))
    WHERE i % 11 <> 3
    """,
)
def word_table_rows(spark, sf_dir):
    parsed = word_tables(spark, sf_dir).select("item_id", words.in_reading_order(words.finest(words.parse("tsv"))).alias("words"))
    return words.exploded(parsed).select("item_id", "line_num", "word_num", "left", "width", "conf", F.col("text").alias("word_text"))


@query(
    "two_pass_text",
    r"""
    WITH k AS (SELECT item_id, i, i // 8 AS l, CASE WHEN w[i + 1] IS NULL THEN '' WHEN (CASE WHEN i % 7 = 2 THEN 0 ELSE i * 37 % 101 END < 70) AND i % 9 >= 2 AND i % 3 = 0 THEN w[i + 1] || '!' ELSE w[i + 1] END AS x
      FROM (SELECT item_id, w, unnest(range(0, len(w))) AS i FROM (SELECT item_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM benchmark))
      WHERE i % 11 <> 3),
    li AS (SELECT item_id, l, string_agg(x, ' ' ORDER BY i) AS s FROM k GROUP BY item_id, l)
    SELECT item_id, string_agg(s, chr(10) ORDER BY l) AS read_text FROM li GROUP BY item_id
    """,
)
def two_pass_text(spark, sf_dir):
    found = F.filter(words.parse("tsv"), lambda w: w["level"] == 5)
    read = F.transform(words.in_reading_order(found), lambda w: F.when(w["left"] % 30 == 0, F.concat(w["text"], F.lit("!"))))
    made = word_tables(spark, sf_dir).withColumn("readings", read).withColumn("whole_text", F.lit(""))
    return words.two_pass(made, out="read_text").select("item_id", "read_text")


_BOX = """
    SELECT l_orderkey, l_linenumber, x AS "left", y AS top, least(greatest(4, CAST(trunc((w + 16) / 1.5) AS INTEGER)), 2480 - x) AS width,
           least(greatest(4, CAST(trunc((h + 16) / 1.5) AS INTEGER)), 3508 - y) AS height
    FROM (SELECT *, least(greatest(0, CAST(trunc((a - 18) / 1.5) AS INTEGER)), 2476) AS x, least(greatest(0, CAST(trunc((b - 18) / 1.5) AS INTEGER)), 3504) AS y
      FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey * 7 % 4000 AS INTEGER) AS a, CAST(l_suppkey * 13 % 6000 AS INTEGER) AS b, CAST(l_quantity AS INTEGER) AS w, CAST(l_linenumber AS INTEGER) AS h FROM lineitem))
"""


@query("original_boxes", _BOX)
def original_boxes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") * 7 % 4000).cast("int").alias("a"), (F.col("l_suppkey") * 13 % 6000).cast("int").alias("b"), F.col("l_quantity").cast("int").alias("w"), F.col("l_linenumber").cast("int").alias("h")
    )
    box = geometry.to_original("a", "b", "w", "h", F.lit(1.5), F.lit(10), F.lit(2480), F.lit(3508))
    return rows.select("l_orderkey", "l_linenumber", box.alias("box")).select("l_orderkey", "l_linenumber", "box.*")


@query(
    "padded_boxes",
    """
    SELECT l_orderkey, l_linenumber, greatest(0, a - 8) AS "left", greatest(0, b - 8) AS top, least(2500, a + w + 8) - greatest(0, a - 8) AS width, least(3528, b + h + 8) - greatest(0, b - 8) AS height
    FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey * 7 % 2500 AS INTEGER) AS a, CAST(l_suppkey * 13 % 3500 AS INTEGER) AS b, CAST(l_quantity AS INTEGER) AS w, CAST(l_linenumber AS INTEGER) AS h FROM lineitem)
    """,
)
def padded_boxes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") * 7 % 2500).cast("int").alias("a"), (F.col("l_suppkey") * 13 % 3500).cast("int").alias("b"), F.col("l_quantity").cast("int").alias("w"), F.col("l_linenumber").cast("int").alias("h")
    )
    return rows.select("l_orderkey", "l_linenumber", geometry.padded("a", "b", "w", "h", F.lit(2500), F.lit(3528)).alias("box")).select("l_orderkey", "l_linenumber", "box.*")


@query(
    "hangul_blocks",
    f"""
    SELECT n, chr(44032 + n) AS syllable, substr('{fixed.INITIALS}', 1 + n // 588, 1) AS initial, substr('{fixed.MEDIALS}', 1 + n // 28 % 21, 1) AS medial,
           substr('{fixed.FINALS}', 1 + n % 28, 1) AS final, chr(44032 + n) AS joined
    FROM (SELECT DISTINCT CAST(l_partkey * 31 % 11172 AS INTEGER) AS n FROM lineitem)
    """,
)
def hangul_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 31 % 11172).cast("int").alias("n")).distinct()
    rows = rows.withColumn("syllable", chars.code_point(fixed.BLOCK + F.col("n"))).withColumn("s", chars.split_syllable("syllable"))
    return rows.select("n", "syllable", "s.*", chars.join_syllable("s.initial", "s.medial", "s.final").alias("joined"))


# Alignment.


# Edits stand at least two characters apart, so that no other script is as cheap.
_EDITS = [("whes", "wh7es"), ("tion", "tio"), ("sh ", "sh7 "), ("가나다", "가다다"), ("어휘", "어휘x휘")]
_TRUTH = [(". ", ". 가나다 둘어휘 ")]


@query(
    "recognition_rates",
    f"""
    WITH t AS (SELECT item_id, {noted_sql(*_TRUTH)} AS truth FROM benchmark),
    c AS (SELECT item_id, length(regexp_replace(truth, '[^a-zA-Z]', '', 'g')) AS letters, length(regexp_replace(truth, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(truth, '[^가-힣]', '', 'g')) AS hangul,
      length(truth) - length(replace(truth, 'whes', '123')) AS a, length(truth) - length(replace(truth, 'tion', '123')) AS d, length(truth) - length(replace(truth, 'sh ', '12')) AS o,
      length(truth) - length(replace(truth, '가나다', '12')) AS k FROM t)
    SELECT item_id, letters - d AS correct, a + d AS wrong, letters + a AS gt_count, CASE WHEN letters + a > 0 THEN round_even((letters - d) / (letters + a) * 100, 1) END AS accuracy,
      digits AS digit_correct, o AS digit_wrong, hangul - k AS korean_correct, k * 3 AS korean_wrong, hangul + 2 * k AS korean_count
    FROM c
    """,
)
def recognition_rates(spark, sf_dir):
    """Inserted, lost and wrong characters in English, digits and Hangul: an inserted one counts for the class beside it."""
    truth = noted(*_TRUTH)
    read = truth
    for old, new in _EDITS:
        read = F.replace(read, F.lit(old), F.lit(new))
    pairs = table(spark, sf_dir, "benchmark").select("item_id", truth.alias("truth"), read.alias("extracted"))
    found = align.recognition_rates(pairs, "item_id").select("item_id", "english.*", "digit", "korean")
    return found.select("item_id", "correct", "wrong", "gt_count", "accuracy", F.col("digit.correct").alias("digit_correct"), F.col("digit.wrong").alias("digit_wrong"), F.col("korean.correct").alias("korean_correct"), F.col("korean.wrong").alias("korean_wrong"), F.col("korean.gt_count").alias("korean_count"))


_MARKED = '<span class="diff-col"><span class="diff-original-line">h</span><span class="diff-extracted-line diff-wrong">b</span></span>'


def _report_sql(label, count, wrong):
    told = f"'{label}: ' || round_even(({count} - {wrong}) / {count} * 100, 1) || '% (맞음 ' || ({count} - {wrong}) || '자 / 틀림 ' || {wrong} || '자 / 원본 ' || {count} || '자)'"
    return f"CASE WHEN {count} > 0 THEN {told} ELSE '{label}: 원본에 {label} 없음 (N/A)' END"


@query(
    "page_comparison",
    f"""
    WITH i AS (SELECT CAST(item_id // 4 AS BIGINT) AS doc_id, CAST(item_id % 4 + 1 AS INTEGER) AS page, text, length(text) - length(replace(text, 'th', 't')) AS w,
      length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS e, length(regexp_replace(text, '[^0-9]', '', 'g')) AS d FROM benchmark)
    SELECT doc_id, page, CASE WHEN e > 0 THEN round_even((e - w) / e * 100, 1) END AS accuracy,
      '한글: 원본에 한글 없음 (N/A)' || chr(10) || {_report_sql("영어", "e", "w")} || chr(10) || {_report_sql("숫자", "d", "0")} || chr(10) || '한자: 원본에 한자 없음 (N/A)' AS report,
      replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), 'th', 't{_MARKED}') AS html, CAST(NULL AS VARCHAR) AS error
    FROM i
    """,
)
def page_comparison(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").withColumn("doc_id", F.floor(F.col("item_id") / 4)).withColumn("page", (F.col("item_id") % 4 + 1).cast("int"))
    truths = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("t")).select("doc_id", F.array_join(F.transform("t", lambda p: p["text"]), "\n\n").alias("truth"))
    read = items.select("doc_id", "page", F.replace("text", F.lit("th"), F.lit("tb")).alias("text"))
    return align.compare(read, truths).select("doc_id", "page", "english.accuracy", "report", "html", "error")


@query(
    "truth_parts",
    r"""
    SELECT doc_id, md5(CASE WHEN len(p) >= 2 THEN p[2] ELSE whole END) AS digest FROM (
      SELECT doc_id, whole, list_filter(list_transform(string_split_regex(whole, '\n\n+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS p
      FROM (SELECT doc_id, regexp_replace(replace(text, chr(10), chr(10) || chr(10) || ' ' || chr(10)), '^\s+|\s+$', '', 'g') AS whole FROM documents))
    """,
)
def truth_parts(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n \n")).alias("truth"), F.lit(2).alias("page"))
    return docs.select("doc_id", F.md5(align.truth_of_page("truth", "page")).alias("digest"))


# Pages and events.


@query(
    "document_texts",
    """
    SELECT book, CAST(count(*) AS INTEGER) AS total, md5(string_agg(trim(text), chr(10) || chr(10) ORDER BY page)) AS digest, md5(string_agg('p' || page || ':direct', ',' ORDER BY page)) AS methods
    FROM (SELECT doc_id // 50 AS book, text, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) AS page FROM documents) GROUP BY book
    """,
)
def document_texts(spark, sf_dir):
    """Fifty neighbouring ids stand for the pages of one document, so that a document stays bounded."""
    from pyspark.sql import Window

    rows = documents(spark, sf_dir).withColumn("book", F.floor(F.col("doc_id") / 50))
    rows = rows.withColumn("page", F.row_number().over(Window.partitionBy("book").orderBy("doc_id")))
    rows = rows.select("book", "page", F.trim("text").alias("text"), F.lit("direct").alias("method"))
    return pages.documents(rows, "book").select("book", "total", F.md5("text").alias("digest"), F.md5(F.array_join("methods", ",")).alias("methods"))


_CONVERSED, _LAST_E, _TEXT_E = repair_sql("base")


@query(
    "page_events",
    f"""
    WITH base AS (SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page, text, text || '\n=—=\n표순만 (Lem) P|I' AS c0, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) >= 10 AS direct,
      turn % 5 = 3 AS bad FROM conversations),
    {_CONVERSED},
    e AS (SELECT doc_id, page, CASE WHEN bad THEN 'error' WHEN direct THEN 'direct' ELSE 'ocr' END AS method, CASE WHEN bad THEN '' WHEN direct THEN {_STRIP.replace("{t}", "text")} ELSE {_STRIP.replace("{t}", _TEXT_E)} END AS t,
      CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS total, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page) AS INTEGER) AS i FROM {_LAST_E})
    SELECT doc_id, 0 AS seq, CAST(json_object('page', 0, 'total', total, 'method', 'started', 'dpi', 300, 'psm', 6) AS VARCHAR) AS event FROM e WHERE i = 1
    UNION ALL SELECT doc_id, 2 * i - 1, CAST(json_object('page', page, 'total', total, 'method', 'started') AS VARCHAR) FROM e
    UNION ALL SELECT doc_id, 2 * i, CAST(CASE WHEN method = 'error' THEN json_object('page', page, 'total', total, 'method', method, 'error', 'cannot render', 'text', '')
      ELSE json_object('page', page, 'total', total, 'method', method, 'dpi', CASE WHEN method = 'ocr' THEN 300 END, 'text', t) END AS VARCHAR) FROM e
    UNION ALL SELECT doc_id, 2 * max(total) + 1, CAST(json_object('done', true, 'total', max(total), 'text', string_agg(t, chr(10) || chr(10) ORDER BY page), 'methods', list('p' || page || ':' || method ORDER BY page)) AS VARCHAR) FROM e GROUP BY doc_id
    """,
)
def page_events(spark, sf_dir):
    items = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), F.col("text").alias("layer_text"), F.when(F.col("turn") % 5 == 3, "cannot render").alias("error"))
    read = pages.extracted(items.withColumn("force_ocr", F.lit(None).cast("string")), recognised=lambda p: p.withColumn("text", F.concat("layer_text", F.lit("\n=—=\n표순만 (Lem) P|I"))))
    return pages.events(read)


@query(
    "progress_figures",
    """
    SELECT l_orderkey, l_linenumber, CAST(floor(l_linenumber / 7 * 100 + 0.5) AS INTEGER) AS percent,
           lpad(CAST(s // 60 AS VARCHAR), CAST(greatest(2, length(CAST(s // 60 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock
    FROM (SELECT *, CAST(l_partkey * l_linenumber % 9000 AS BIGINT) AS s FROM lineitem)
    """,
)
def progress_figures(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("ms", F.col("l_partkey") * F.col("l_linenumber") % 9000 * 1000 + 999)
    return rows.select("l_orderkey", "l_linenumber", pages.progress("l_linenumber", F.lit(7)).alias("percent"), pages.minutes_seconds("ms").alias("clock"))


@query("prepared_images")
def prepared_images(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x * 400 + 128)))).alias("v"))
    # Rows of eight; what a vector lacks to a whole column is black.
    columns = F.ceil(F.size("v") / 8).cast("int")
    pixels = F.unhex(F.rpad(F.array_join(F.transform("v", lambda x: F.lpad(F.hex(x), 2, "0")), ""), columns * 16, F.lit("0")))
    image = F.struct(F.lit(8).alias("height"), columns.alias("width"), F.lit(1).alias("channels"), pixels.alias("data"))
    made = images.prepare(vectors.where("size(v) > 0").select("vec_id", image.alias("image")))
    return made.select("vec_id", "image.height", "image.width", F.md5("image.data").alias("digest"))
