"""From raw documents to packed sequences: five stages, each written and read again.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns the columns of documents; the last returns the packed pieces. A stage's
operator states what nulls, empty texts, repeated rows and empty tables give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, line_dedup, packing, quality_rules, similar
from palimpsest.llm.common import documents, scratch
from palimpsest.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's record reject go."""
    ship(spark)
    return quality_rules.judge(docs).filter("kept").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; n_chars follows the text."""
    ship(spark)
    out = line_dedup.dedup_lines(docs)
    return out.select([F.length("text").cast(kind).alias(c) if c == "n_chars" else F.col(c) for c, kind in docs.dtypes])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies (five-word shingles, similarity 0.8 and more) one document stays."""
    ship(spark)
    return similar.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a test item go."""
    ship(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their sequence and place."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash", near_duplicates), ("decontaminate", benchmark), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        at = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs


#: SimHash, alignment and tokens have no SQL form; tests compare run() with a plain version.
ORACLE_SQL = None
