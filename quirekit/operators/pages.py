"""Pages: which way a page's text is taken, and the events that tell of it."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chars, fixed, rules
from ..functions.chars import col

EVENT = "page int, total int, method string, dpi int, psm int, text string, error string, done boolean, methods array<string>"


def accepted_uploads(files: DataFrame) -> DataFrame:
    """Adds reject: why a file is refused, null where it is taken."""
    named = F.coalesce(F.lower("path").endswith(".pdf"), F.lit(False))
    size = F.coalesce(F.length("content"), F.lit(0))
    return files.withColumn("reject", F.when(~named, "not a PDF").when(size == 0, "empty file"))


def routed(pages: DataFrame, layer="layer_text", force="force_ocr") -> DataFrame:
    """Adds use_ocr: forced, or too few words in the text layer."""
    return pages.withColumn("use_ocr", chars.truthy(force) | ~chars.digital_page(layer))


def extracted(pages: DataFrame, recognised=None, layer="layer_text", error="error") -> DataFrame:
    """Pages with text, method and dpi.

    ``recognised``: a function of the pages that need an engine, giving them a
    text column; only they reach it. Pages with an error keep it, cut to 200
    characters, and have no text. Read texts are corrected, text layers are not.
    """
    names = pages.columns
    pages = pages if error in names else pages.withColumn(error, F.lit(None).cast("string"))
    pages = routed(pages)
    # One pass over what needs no engine; only the rest reaches it.
    bad = F.col(error).isNotNull()
    out = pages.where(bad | ~F.col("use_ocr"))
    out = out.withColumn("text", F.when(bad, "").otherwise(chars.strip(F.coalesce(F.col(layer), F.lit(""))))).withColumn("method", F.when(bad, "error").otherwise("direct"))
    if recognised is not None:
        read = recognised(pages.where(~bad & F.col("use_ocr"))).withColumnRenamed("text", "_raw")
        read = rules.correct(read, "_raw").withColumn("text", F.coalesce("corrected", F.lit(""))).withColumn("method", F.lit("ocr"))
        out = out.unionByName(read.select(*out.columns))
    return out.withColumn(error, F.substring(error, 1, fixed.LOG_LETTERS)).withColumn("dpi", F.when(F.col("method") == "ocr", fixed.DPI))


def page_event(page="page", total="total"):
    """JSON of a page's result or error; nulls are written where the result says so."""
    good = F.to_json(F.struct(col(page).alias("page"), col(total).alias("total"), "method", "dpi", "text"), {"ignoreNullFields": "false"})
    bad = F.to_json(F.struct(col(page).alias("page"), col(total).alias("total"), "method", "error", "text"), {"ignoreNullFields": "false"})
    return F.when(F.col("method") == "error", bad).otherwise(good)


def documents(pages: DataFrame, key="doc_id", page="page") -> DataFrame:
    """key, total, text, methods of whole documents: page texts in order with a blank line between, empty ones too."""
    rows = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(page, F.coalesce("text", F.lit("")).alias("text"), "method"))).alias("p"))
    return rows.select(
        key,
        F.size("p").alias("total"),
        F.array_join(F.transform("p", lambda p: p["text"]), "\n\n").alias("text"),
        F.transform("p", lambda p: F.concat(F.lit("p"), p[page].cast("string"), F.lit(":"), p["method"])).alias("methods"),
    )


def done_event():
    """JSON of a document's last event."""
    return F.to_json(F.struct(F.lit(True).alias("done"), "total", "text", "methods"))


def events(pages: DataFrame, key="doc_id", page="page") -> DataFrame:
    """key, seq, event: all events of documents as JSON, seq their order within a document.

    A start, then for each page a start and a result or error, then done.
    """
    place = Window.partitionBy(key).orderBy(page, F.coalesce("text", F.lit("")), "method", "dpi", "error")
    totals = pages.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("total"))
    # Pages are ranked, not gathered: an event needs its own page and the document's count.
    each = pages.select(key, page, F.coalesce("text", F.lit("")).alias("text"), "method", "dpi", "error", F.row_number().over(place).alias("i")).join(totals, key)
    start = F.to_json(F.struct(F.lit(0).alias("page"), "total", F.lit("started").alias("method"), F.lit(fixed.DPI).alias("dpi"), F.lit(fixed.PAGE_MODE).alias("psm")))
    begin = F.to_json(F.struct(F.col(page).alias("page"), "total", F.lit("started").alias("method")))

    def event(seq, made):
        return F.struct(seq.cast("int").alias("seq"), made.alias("event"))

    pair = F.array(event(F.col("i") * 2 - 1, begin), event(F.col("i") * 2, page_event(page)))
    some = F.when(F.col("i") == 1, F.concat(F.array(event(F.lit(0), start)), pair)).otherwise(pair)
    last = documents(pages, key, page).select(key, (F.col("total") * 2 + 1).alias("seq"), done_event().alias("event"))
    return each.select(key, F.inline(some)).unionAll(last)


def progress(page="page", total="total"):
    """Per cent of pages, half up; 0 without a total."""
    return F.when(col(total) > 0, F.floor(col(page) / col(total) * 100 + 0.5)).otherwise(0).cast("int")


def status(received, method, started):
    """What a page shows: done-direct, done, error, working or waiting."""
    return (
        F.when(col(received) & (col(method) == "direct"), "done-direct")
        .when(col(received) & (col(method) == "error"), "error")
        .when(col(received), "done")
        .when(col(started), "working")
        .otherwise("waiting")
    )


def method_label(method):
    m = col(method)
    return F.when(m == "direct", "직접").when(m == "ocr", "OCR").when(m == "error", "오류").otherwise(F.coalesce(m, F.lit("")))


def minutes_seconds(milliseconds):
    """mm:ss of a duration; hours stay minutes."""
    s = F.floor(col(milliseconds) / 1000)
    two = lambda n: F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))
    return F.concat(two(F.floor(s / 60)), F.lit(":"), two(s % 60))


def mean_per_page(elapsed, received):
    """Whole milliseconds a page, half up; null before the first."""
    return F.when(col(received) > 0, F.floor(col(elapsed) / col(received) + 0.5).cast("long"))
