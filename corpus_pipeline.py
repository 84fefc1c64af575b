"""The corpus pipeline: quality rules, near duplicates, repeated lines, source mix, BPE ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import encoding, lines, mixing, quality, queries, shingles
from plumbline.llm.store import folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.kept_documents(docs.select(*COLUMNS))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five words, similarity of 0.8 or more) the document with the smallest id. Rows are told apart by id and text."""
    dropped = shingles.jaccard_classes(docs, words=5, threshold=0.8).where("NOT kept").select(F.col("doc_id").alias("id"), "mark").distinct()
    rows = docs.select(F.struct(*COLUMNS).alias("row"), "doc_id", F.xxhash64("text").alias("of"))
    return rows.join(dropped, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("of") == F.col("mark")), "left_anti").select("row.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines and sentences that stand earlier; a document that loses all its words goes."""
    left = lines.line_dedup(docs.select(*COLUMNS), unit="sentence", least_words=5)
    left = left.where(F.col("n_removed").eqNullSafe(0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs.select(*COLUMNS), weights=(5, 2, 1), epochs=1.5, most=2.0)


def bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the ids of the whole text."""
    coded = encoding.encode(docs.select("doc_id", "lang", "source", "text"), queries.vocabulary("byte_bpe_50k.json"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", without_repeated_lines),
    ("source mix", source_mix),
    ("BPE ids", bpe_ids),
]

#: The join and the ids cannot be written in SQL; a test holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over the whole table `documents`; the others' are written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = f"{folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{home}/{k}")
            docs = spark.read.parquet(f"{home}/{k}")
            if k:  # what the next stages do not read goes
                last = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/{k - 1}")
                last.getFileSystem(spark._jsc.hadoopConfiguration()).delete(last, True)
    return docs
