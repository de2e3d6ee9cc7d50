"""The corpus pipeline: documents in, packed training sequences out.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; run() writes each
result as Parquet in the shared folder and reads it again as the next one's
docs. All stages but the last return the columns of documents.
"""

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from quirekit.llm import common, langid, neardup, packing, passages, secrets

#: A language is accepted at this score; und, and what none explains, goes.
LANGUAGE_SCORE = 0.5
#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5


def language(spark, docs, sf_dir):
    """Keep documents of a language that was learned.

    A text that is null, empty or without a letter has none and goes, as does one
    that no learned language explains; if no row has a lang, nothing is learned
    and all go. Repeated rows are judged alike; all columns stay.
    """
    common.small_batches(spark)
    names = docs.columns
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = spark.sparkContext.broadcast(langid.fit(plain, langid.default_path()))

    def run(batches):
        score = langid.Scorer(model.value)
        for b in batches:
            found = score(b.column(b.schema.get_field_index("text")).to_pylist())
            yield b.filter(pa.array([lang != "und" and s >= LANGUAGE_SCORE for lang, s in found]))

    return docs.mapInArrow(run, docs.schema).select(*names)


def near_duplicates(spark, docs, sf_dir):
    """Keep one document, that of the smallest doc_id, of each group of near copies.

    Rows are judged by doc_id and text together, so a doc_id that repeats with
    another text loses nothing; of rows of one doc_id that are near copies the
    one of the smallest text hash stays, and of rows equal in doc_id and text one.
    Rows without a word or doc_id stay as they are.
    """
    found = common.save(neardup.near_duplicates(docs, words=SHINGLE), "groups")
    stay = found.where("kept AND group IS NOT NULL")
    twins = common.save(stay.groupBy("group").agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("most")).where("least < most").select("group", "least"), "twins")
    twins = common.salted_join(stay, twins, "group").where("text_hash > least")
    ident, code, number = common.fresh(docs.columns, "ident", "code", "number")
    gone = found.where("NOT kept").select("doc_id", "text_hash").union(twins.select("doc_id", "text_hash")).distinct().toDF(ident, code)
    gone = common.save(gone, "gone")
    again = common.save(stay.groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash").toDF(ident, code), "again")
    same = (F.col("doc_id").cast("long") == F.col(ident)) & (F.xxhash64(F.col("text").cast("string")) == F.col(code))
    out = docs.join(passages.small(gone), same, "left_anti")
    if again.limit(1).count():
        # One of equal rows: Spark keeps the first of each partition before it shuffles them.
        order = [c for c in docs.columns if docs.schema[c].dataType.simpleString().split("<")[0] not in ("map", "variant")]
        rows = out.join(passages.small(again), same, "left_semi")
        rows = rows.withColumn(number, F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(F.xxhash64(*order)))).where(F.col(number) == 1)
        out = out.join(passages.small(again), same, "left_anti").union(rows.drop(number))
    return out.select(*docs.columns)


def repeated_passages(spark, docs, sf_dir):
    """Take out every passage that an earlier document holds.

    Earlier is the smaller doc_id; rows of one doc_id are not held against each
    other. A document left without a word goes, null and empty texts and rows
    without a doc_id stay as they are; n_chars is counted anew, all other columns stay.
    """
    return passages.without_repeats(docs)


def redact_secrets(spark, docs, sf_dir):
    """Replace every secret. Null and empty texts stay as they are; repeated rows are treated alike; n_chars is counted anew."""
    return secrets.redact(docs)


def pack(spark, docs, sf_dir):
    """Pack the documents into sequences: a row for each piece; a text without a word has one with size 0 and no bin."""
    return packing.best_fit(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: No stage but the last could be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
