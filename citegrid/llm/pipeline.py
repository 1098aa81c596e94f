"""A corpus made ready for training: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_folder, read_table, written
from .decontaminate import find_leaks
from .near import near_components
from .packing import pack
from .quality import fit_quality, keep_quality
from .secrets import redact_secrets

# The rule ensemble, the sketches and the packing have no form in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier does not reject.

    Null and empty texts are scored as empty ones, rows that repeat or have no id each for
    themselves; without labels the base rate of 0.5 keeps all; an empty table stays empty.
    """
    return keep_quality(docs, fit_quality(docs, read_table(spark, sf_dir, "labels")))


def with_row(docs: DataFrame) -> DataFrame:
    """(_row, _doc): all columns in a struct, beside whose name no column of theirs can clash, and the hash of doc_id and text
    by which decisions reach rows with and without an id; equal rows share it."""
    row = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    return docs.select(row.alias("_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the smallest doc_id, of each class of near copies, and one of the rows that repeat a doc_id and text.

    Rows without an id are documents of their own text, and go where their class has a row with an id.
    Further columns stay, whatever their names.
    """
    docs = with_row(docs)
    near = near_components(docs.select(F.col("_row").alias("doc_id"), F.col("_doc.text").alias("text")), k=5, num=8, den=10).select(F.col("doc_id").alias("_row"), "component_id").distinct()
    ids = docs.groupBy("_row").agg(F.first("_doc.doc_id").alias("doc_id"), F.count("*").alias("_n"))
    # only keys and ids are shuffled here; a class is reduced to its least row by partial aggregates, so a large one is no hot key
    rows = written(near.join(ids, "_row"), "rows")
    least = rows.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_row")).select("_row", F.lit(True).alias("_least"))
    marked = written(rows.join(least, "_row", "left").filter("_least is null or _n > 1").select("_row", F.col("_least").isNotNull().alias("_again")), "marked")
    met = docs.join(marked, "_row", "left")
    return met.filter("_again is null").unionByName(met.filter("_again").dropDuplicates(["_row"])).select("_doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item, also those without an id.

    Null and empty texts hold none; all rows that repeat a leaking document go; an empty table, or
    no items, changes nothing. Further columns stay, whatever their names.
    """
    docs = with_row(docs)
    leaks = find_leaks(docs.select(F.col("_row").alias("doc_id"), F.col("_doc.text").alias("text")), read_table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_row")).distinct()
    # written first: a table of known size is joined without a shuffle of the texts while it is small
    leaks = written(leaks, "leaks")
    return docs.join(leaks, "_row", "left_anti").select("_doc.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; all rows stay, null texts as they are."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places each document in a batch of its length bucket: doc_id, n_tokens and places, a row for each row.

    Rows without text or id, and rows that repeat, have places of their own; an empty table gives no rows.
    """
    return pack(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over all documents; what each stage keeps is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    folder = own_folder(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
