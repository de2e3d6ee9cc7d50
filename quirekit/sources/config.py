"""Editable tables: spellings, prohibited patterns, domain words.

Files are read by Spark, so any store will do; the results are small lists that
become literals of the plan.
"""

import logging

from pyspark.sql import functions as F

from ..functions import chars

#: Lines of a table that are read; a longer one is refused, as it would no longer make a literal.
MOST_LINES = 20_000


def entries(spark, path):
    """Stripped lines of a text file, in order, without blank ones and comments."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.split("value", "\r\n|[\n\r\x0b\x0c]", -1)).alias("line_no", "raw"))
    rows = rows.select("line_no", chars.strip("raw").alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    found = rows.orderBy("line_no").limit(MOST_LINES + 1).collect()
    if len(found) > MOST_LINES:
        raise ValueError(f"{path}: more than {MOST_LINES} entries")
    return [r.line for r in found]


def typo_map(spark, path):
    """(wrong, right) pairs of tab-separated lines; the longest wrong spelling first, ties in file order."""
    pairs = [line.split("\t", 1) for line in entries(spark, path) if "\t" in line]
    return tuple(sorted(((a.strip(), b.strip()) for a, b in pairs if a and b), key=lambda p: -len(p[0])))


def prohibited_patterns(spark, path):
    """Patterns that compile for the engine that will run them; others are logged and left out."""
    compile_ = spark.sparkContext._jvm.java.util.regex.Pattern.compile
    good = []
    for line in entries(spark, path):
        try:
            compile_(line)
            good.append(line)
        except Exception:  # the bridge wraps Java's PatternSyntaxException
            logging.getLogger(__name__).warning("pattern left out: %s", line[:50])
    return tuple(good)


def domain_words(spark, path):
    return tuple(entries(spark, path))
