"""Word tables of a recogniser: parsing, reading order, second readings, text.

Pages are rows; a page's words are an ordered array of structs, so that a
page's text is put together without a shuffle. Readings that need an engine
come in as columns (see quirekit.operators.recognise).
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chars, english, fixed, geometry
from ..functions.chars import col

WORD = "array<struct<block_num:int,line_num:int,word_num:int,ord:int,level:int,left:int,top:int,width:int,height:int,conf:int,text:string>>"


def parse(tsv, with_confidence=True):
    """Words of a tab-separated word table: an array of WORD structs in file order.

    The header goes; lines with under 12 fields or a number that is no integer are skipped.
    Levels 4 and 5 stay, level 4 with a null confidence. A confidence of -1 is 0.
    """
    rows = F.split(chars.strip(tsv), "\n", -1)
    rows = F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))
    numbered = F.transform(rows, lambda r, i: F.struct(F.split(r, "\t", -1).alias("f"), i.alias("ord")))
    numbered = F.filter(numbered, lambda r: F.size(r["f"]) >= 12)

    def whole(s):
        # As Python's int: white space around, a sign, digits with single underscores between.
        s = chars.strip(s)
        return F.when(s.rlike(r"\A[+-]?[0-9]+(?:_[0-9]+)*\z"), F.replace(s, F.lit("_"), F.lit("")).try_cast("int"))

    def word(r):
        f, names = r["f"], ("block_num", "line_num", "word_num")
        confidence = F.when(f[10] == "-1", 0).otherwise(whole(f[10])) if with_confidence else F.lit(None).cast("int")
        return F.struct(
            *[whole(f[i + 1]).alias(n) for i, n in enumerate(names)],
            r["ord"].alias("ord"),
            whole(f[0]).alias("level"),
            *[whole(f[i + 6]).alias(n) for i, n in enumerate(("left", "top", "width", "height"))],
            confidence.alias("conf"),
            chars.strip(f[11]).alias("text"),
        )

    def complete(w):
        ok = w["level"].isin(4, 5)
        for n in ("block_num", "line_num", "word_num", "left", "top", "width", "height"):
            ok = ok & w[n].isNotNull()
        return ok & (w["conf"].isNotNull() | (w["level"] == 4)) if with_confidence else ok

    return F.filter(F.transform(numbered, word), lambda w: F.coalesce(complete(w), F.lit(False)))


def finest(words):
    """Words of level 5, or those of level 4 if there are none."""
    five = F.filter(words, lambda w: w["level"] == 5)
    return F.when(F.size(five) > 0, five).otherwise(F.filter(words, lambda w: w["level"] == 4))


def in_reading_order(words):
    """By block, line and word; ties stay in file order, which the struct's next field is."""
    return F.array_sort(words)


def exploded(pages: DataFrame, words="words") -> DataFrame:
    """One row for each word, the page's other columns beside it."""
    return pages.select(*[c for c in pages.columns if c != words], F.posexplode(words).alias("place", "word")).select("*", "word.*").drop("word")


def spliced(base, replacements):
    """The base text with ordered (old, new) replacements, each at or after the end of the one before."""
    start = F.struct(col(base).alias("text"), F.lit(1).alias("pos"))

    def step(state, r):
        at = F.when(F.length(r["old"]) > 0, F.position(r["old"], state["text"], state["pos"])).otherwise(state["pos"])
        text = F.concat(F.substring(state["text"], F.lit(1), at - 1), r["new"], F.substring(state["text"], at + F.length(r["old"]), F.length(state["text"])))
        return F.struct(F.when(at > 0, text).otherwise(state["text"]).alias("text"), F.when(at > 0, at + F.length(r["new"])).otherwise(state["pos"]).cast("int").alias("pos"))

    return F.aggregate(col(replacements), start, step)["text"]


def candidates(pages: DataFrame, tsv="tsv") -> DataFrame:
    """Adds words, and candidates: the suspects that are wide and high enough, in reading order."""
    pages = pages.withColumn("words", in_reading_order(finest(parse(tsv, False))))
    keep = F.filter("words", lambda w: chars.english_suspect(w["text"]) & geometry.at_least(w["width"], w["height"], 4))
    return pages.withColumn("candidates", keep)


def two_stage(pages: DataFrame, base="base_text", found="candidates", first="first_readings", second="second_readings", most=fixed.REPLACEMENTS_MOST, least=fixed.ASCII_LEAST, out="text") -> DataFrame:
    """The base text with accepted English readings put in place.

    ``first`` and ``second``: arrays of readings beside the candidates (from
    the original and the prepared image); null arrays count as empty readings.
    The first ``most`` accepted ones are used, however many were read before.
    """
    empty = F.transform(F.col(found), lambda w: F.lit(""))
    one, two = F.coalesce(F.col(first), empty), F.coalesce(F.col(second), empty)
    zipped = F.arrays_zip(F.transform(found, lambda w: w["text"]).alias("old"), one.alias("one"), two.alias("two"))
    read = F.transform(zipped, lambda z: F.struct(z["old"].alias("old"), english.classified(english.better(F.coalesce(z["one"], F.lit("")), F.coalesce(z["two"], F.lit("")), least)).alias("new")))
    accepted = F.slice(F.filter(read, lambda r: english.good(r["new"], least)), F.lit(1), F.lit(most))
    text = F.when(F.col(base).isNull(), "").when(F.col(found).isNull() | (F.size(found) == 0), chars.strip(base)).otherwise(chars.strip(spliced(base, "_accepted")))
    return pages.withColumn("_accepted", accepted).withColumn(out, text).drop("_accepted")


def retried(words, readings):
    """Words with a second reading where one is called for, sizes allow it and it is not empty."""
    pairs = F.arrays_zip(words.alias("w"), readings.alias("r"))

    def pick(p):
        w = p["w"]
        again = chars.retry_word(w["conf"], w["text"]) & geometry.at_least(w["width"], w["height"], 2) & (F.coalesce(p["r"], F.lit("")) != "")
        return F.struct(w["block_num"].alias("block_num"), w["line_num"].alias("line_num"), F.when(again, p["r"]).otherwise(w["text"]).alias("text"))

    return F.transform(pairs, pick)


def laid_out(words):
    """Text of ordered words: a line break where block or line changes, a space between words of a line.

    Empty words write nothing but do count as the word before.
    """
    w = col(words)
    broken = F.transform(
        F.sequence(F.lit(1), F.size(w)),
        lambda i: F.struct(
            ((i > 1) & ((F.element_at(w, i)["block_num"] != F.element_at(w, F.greatest(i - 1, F.lit(1)))["block_num"]) | (F.element_at(w, i)["line_num"] != F.element_at(w, F.greatest(i - 1, F.lit(1)))["line_num"]))).alias("new"),
            F.element_at(w, i)["text"].alias("text"),
        ),
    )
    # A break only counts once something has been written on the line.
    marked = F.array_join(F.transform(broken, lambda b: F.concat(F.when(b["new"], "\x01").otherwise(""), F.when(F.coalesce(b["text"], F.lit("")) != "", F.concat(F.lit("\x00"), b["text"])).otherwise(""))), "")
    one_break = F.regexp_replace(F.regexp_replace(marked, "\x01+", "\x01"), "(\\A|\x01)\x00", "$1")
    return F.when(F.size(w) == 0, "").otherwise(chars.strip(F.translate(one_break, "\x00\x01", " \n")))


def two_pass(pages: DataFrame, tsv="tsv", readings="readings", whole="whole_text", out="text") -> DataFrame:
    """Text of level-5 words with second readings; the whole-page text where there are no words.

    ``readings``: an array beside the words in reading order; null means none was made.
    """
    five = F.filter(parse(tsv), lambda w: w["level"] == 5)
    pages = pages.withColumn("_words", in_reading_order(five))
    none = F.transform(F.col("_words"), lambda w: F.lit(""))
    pages = pages.withColumn("_lines", retried(F.col("_words"), F.coalesce(F.col(readings), none)))
    text = F.when(F.coalesce(F.size("_words"), F.lit(0)) > 0, laid_out("_lines")).otherwise(chars.strip(F.coalesce(F.col(whole), F.lit(""))))
    return pages.withColumn(out, text).drop("_words", "_lines")


def fallback(two_stage_text, two_pass_text, whole_text, two_pass_on=False):
    """The first reading that did not fail (null is a failure; the empty text is a result), else ''."""
    middle = [col(two_pass_text)] if two_pass_on else []
    return F.coalesce(col(two_stage_text), *middle, col(whole_text), F.lit(""))
