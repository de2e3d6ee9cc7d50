"""Columns over characters and words: classes, ratios, predicates, Hangul blocks."""

from pyspark.sql import functions as F

from . import fixed

WS = f"[{fixed.SPACE}]"
NOT_WS = f"[^{fixed.SPACE}]"
HANGUL = fixed.SYLLABLE + fixed.JAMO


def col(x):
    return F.col(x) if isinstance(x, str) else x


def strip(x):
    """Without white space at both ends, as Unicode has it. A run inside is looked at once, from its start."""
    return F.regexp_replace(col(x), rf"\A{WS}++|(?<!{WS}){WS}++\z", "")


def is_blank(x):
    return ~col(x).rlike(NOT_WS)


def words(x):
    """Words between white space; no empty ones."""
    return F.filter(F.split(col(x), f"{WS}+"), lambda w: w != "")


def count_class(x, inside):
    """Characters of a class; 0 for the empty text."""
    return F.length(F.regexp_replace(col(x), f"[^{inside}]", ""))


def char_class(x):
    """korean, english, digit, chinese or other, of one character."""
    c = col(x)
    return (
        F.when(c.rlike(f"^[{HANGUL}]$"), "korean")
        .when(c.rlike("^[a-zA-Z]$"), "english")
        .when(c.rlike("^[0-9]$"), "digit")
        .when(c.rlike(f"^[{fixed.HAN}]$"), "chinese")
        .otherwise("other")
    )


def class_counts(x):
    """A struct with the number of characters of each class in a text."""
    c = col(x)
    known = {"korean": HANGUL, "english": "a-zA-Z", "digit": "0-9", "chinese": fixed.HAN}
    counts = [count_class(c, inside).alias(k) for k, inside in known.items()]
    return F.struct(*counts, F.length(F.regexp_replace(c, f"[{''.join(known.values())}]", "")).alias("other"))


def has_syllable(x):
    return F.coalesce(col(x).rlike(f"[{fixed.SYLLABLE}]"), F.lit(False))


def has_letter(x):
    return F.coalesce(col(x).rlike("[a-zA-Z]"), F.lit(False))


def has_korean(x):
    return F.coalesce(col(x).rlike(f"[{HANGUL}]"), F.lit(False))


def ascii_ratio(x):
    """Share of ASCII letters and digits; 0.0 for a null or empty text."""
    c = col(x)
    return F.when(F.length(c) > 0, count_class(c, "a-zA-Z0-9") / F.length(c)).otherwise(0.0)


def english_suspect(x):
    """A word worth a second, English reading: no whole syllable, not marks or jamo alone, but a digit, sign or jamo."""
    c = col(x)
    return (
        F.when(c.isNull() | (c == "") | has_syllable(c), False)
        .when(c.rlike(f"^[{fixed.PURE_MARK}]+$") | c.rlike(f"^[{fixed.JAMO}]+$"), False)
        .otherwise(c.rlike(f"[0-9{fixed.SYMBOL}{fixed.JAMO}]"))
    )


def alnum_gate(x, least=0.6):
    """Whether letters and digits make up enough of what is not white space."""
    c = F.regexp_replace(col(x), f"{WS}+", "")
    return (F.length(c) > 0) & (count_class(c, r"\p{L}\p{N}") / F.length(c) >= least)


def digital_page(x):
    """A text layer with enough words to be taken as it is."""
    return F.coalesce(F.size(words(x)) >= fixed.DIRECT_WORDS, F.lit(False))


def retry_word(confidence, x):
    """A word to be read again: low confidence, or short with a suspicious letter."""
    c = col(x)
    return (col(confidence) < fixed.CONFIDENCE) | c.rlike(f"[{fixed.SUSPICIOUS}]") & (F.length(c) <= 2)


def retry_mode(x):
    """Page mode of that second reading: one character or one word."""
    return F.when(F.length(col(x)) <= 1, 10).otherwise(8)


def truthy(x):
    """1, true, yes or on in any case; anything else is false."""
    return F.coalesce(F.lower(col(x)).isin("1", "true", "yes", "on"), F.lit(False))


# Hangul syllable blocks.


def code_point(n):
    """The character of a code point below U+10000."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")


def is_syllable(x):
    return F.coalesce((F.length(col(x)) == 1) & col(x).rlike(f"^[{fixed.SYLLABLE}]$"), F.lit(False))


def split_syllable(x):
    """struct(initial, medial, final) of one syllable, null for anything else; a space where there is no final."""
    n = F.ascii(col(x)) - fixed.BLOCK
    part = lambda letters, at: F.substring(F.lit(letters), (at + 1).cast("int"), F.lit(1))
    return F.when(
        is_syllable(x),
        F.struct(
            part(fixed.INITIALS, F.floor(n / 588)).alias("initial"),
            part(fixed.MEDIALS, F.floor(n / 28) % 21).alias("medial"),
            part(fixed.FINALS, n % 28).alias("final"),
        ),
    )


def join_syllable(initial, medial, final):
    """The syllable of three letters; an empty or blank final is none; '' for what is no letter of its place."""
    def at(letters, x):
        return F.when(F.length(col(x)) == 1, F.instr(F.lit(letters), col(x)) - 1).otherwise(-1)

    i, m = at(fixed.INITIALS, initial), at(fixed.MEDIALS, medial)
    f = F.when(F.coalesce(col(final), F.lit("")) == "", 0).otherwise(at(fixed.FINALS, final))
    return F.when((i >= 0) & (m >= 0) & (f >= 0), code_point(fixed.BLOCK + i * 588 + m * 28 + f)).otherwise("")
