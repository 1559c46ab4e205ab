"""The corpus pipeline: stages over ``documents``, each on what the one before it kept.

Decisions are taken and applied by row, not by ``doc_id``: the stages number the rows
they get by their places in the files, and drop rows by their number. So every row is judged by its
own text, whatever ids it shares or lacks.

Defined cases: null and empty texts are texts without words, which the classifier scores like
any other, and of which the exact stage keeps one; of rows that repeat an id and a text one
stays; rows with equal or null ids and other texts are judged apart, a null id being the
smallest; an empty table gives an empty table; other columns, whatever their names, are passed
on by all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import decontaminate, exact_dedup, packing, quality, simhash
from termloom.llm.common import materialize, table
from termloom.llm.entries import tokenizer_file
from termloom.plans.storage import new_path, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
ROW = "__termloom_row"


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own that does not change with how they are read: the file's
    place among the table's files and the row's in the file. Rows that are not read from files as
    they are, as in tests, are written down with numbers first."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "pipeline-rows")
    # one name and one row a file; no column is read for it
    names = [r["name"] for r in docs.select(F.col("_metadata.file_path").alias("name")).distinct().collect()]
    files = docs.sparkSession.createDataFrame(list(enumerate(sorted(names))), "__place long, __file string")
    placed = docs.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__index"))
    placed = placed.join(F.broadcast(files), F.col("__path") == F.col("__file"), "left")
    place = F.coalesce("__place", F.raise_error(F.concat(F.lit("unknown file "), "__path")).cast("long"))
    return placed.select(*docs.columns, F.shiftleft(place, 40).bitwiseOR(F.col("__index")).alias(ROW))


def _without(numbered: DataFrame, decide: Callable[[], DataFrame]) -> DataFrame:
    """The rows that ``decide`` does not list by their numbers. Its list is written down, and the
    tables that led to it are dropped."""
    spark = numbered.sparkSession
    path = new_path(spark, "pipeline-dropped")
    with scratch():
        decide().select(ROW).distinct().write.parquet(path)
    return numbered.join(spark.read.parquet(path), ROW, "left_anti").drop(ROW)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    rows = _numbered(docs)
    return _without(rows, lambda: quality.rejected(rows, table(spark, sf_dir, "labels"), ROW))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row with the largest doc_id."""
    rows = _numbered(docs)

    def copies() -> DataFrame:
        # the number makes ids distinct, and decides among equal ones
        found = exact_dedup.exact_duplicates(rows.select(F.struct("doc_id", ROW).alias("doc_id"), "text"))
        return found.where("not kept").select(F.col("doc_id")[ROW].alias(ROW))

    return _without(rows, copies)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents of similar five-word shingles (0.8 or more), the smallest doc_id."""
    rows = _numbered(docs)

    def copies() -> DataFrame:
        found = materialize(simhash.similar_documents(rows.select(F.col(ROW).alias("row"), "text")), "pipeline-groups")
        shared = found.where("row <> group").select("group").distinct()
        members = found.join(shared, "group", "left_semi").join(rows.select(F.col(ROW).alias("row"), "doc_id"), "row")
        order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
        stays = members.groupBy("group").agg(F.min(order).alias("first")).select("group", F.col("first")["row"].alias("first"))
        return members.join(stays, "group").where("row <> first").select(F.col("row").alias(ROW))

    return _without(rows, copies)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark windows."""
    rows = _numbered(docs)

    def leaks() -> DataFrame:
        found = decontaminate.contamination(rows.select(F.col(ROW).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
        return found.where("contaminated").select(F.col("doc_id").alias(ROW))

    return _without(rows, leaks)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of the documents that are left."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), "spaced", 2)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with scratch():
            # a stage's own tables go when its result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Models and tokenizers can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
