"""A stream of revisions (an extension): the log of many authors, without repeats, in windows.

The log's rows have doc_id, rev_id, kind, author and ts. State is bounded by the
watermark: a revision that comes again within it is dropped, later ones are late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each revision of a document once."""
    return log.withWatermark("ts", late).dropDuplicatesWithinWatermark(["doc_id", "rev_id"])


def activity(log: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Revisions by document, kind and window of time."""
    return log.withWatermark("ts", late).groupBy("doc_id", "kind", F.window("ts", window)).agg(F.count(F.lit(1)).alias("n")).select("doc_id", "kind", F.col("window.start").alias("since"), "n")


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of one author's revisions of a document with no longer pause than the gap."""
    return log.withWatermark("ts", late).groupBy("doc_id", "author", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n")).select("doc_id", "author", F.col("session_window.start").alias("since"), F.col("session_window.end").alias("until"), "n")
