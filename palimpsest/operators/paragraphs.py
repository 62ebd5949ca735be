"""Paragraph tables: scans, offsets, search, carried labels, rendering.

A paragraph table has doc_id, para_id (0-based, dense, in document order) and text.
Everything is keyed by doc_id, so a plan shuffles at most once, on doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def in_order(*partition: str) -> Window:
    return Window.partitionBy(*(partition or ("doc_id",))).orderBy("para_id")


def split_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """One paragraph a line of a text document."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("para_id", "text"))


def with_offsets(paras: DataFrame) -> DataFrame:
    """start and end of each paragraph in its document's text, joined by newlines."""
    before = F.coalesce(F.sum(F.length("text") + 1).over(in_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return paras.withColumn("start", before).withColumn("end", F.col("start") + F.length("text"))


def find_paragraphs(paras: DataFrame, contains: str | None = None, regex: str | None = None, style: str | None = None, startswith: str | None = None, ignore_case: bool = False) -> DataFrame:
    """Paragraphs that meet all conditions given; a start is looked for behind leading white space."""
    text = F.lower("text") if ignore_case else F.col("text")
    case = str.lower if ignore_case else str
    out = paras
    if contains is not None:
        out = out.filter(text.contains(case(contains)))
    if startswith is not None:
        out = out.filter(F.regexp_replace(text, r"(?U)^\s+", "").startswith(case(startswith)))
    if style is not None:
        out = out.filter(F.col("style") == style)
    if regex is not None:
        out = out.filter(F.col("text").rlike(("(?iU)" if ignore_case else "(?U)") + regex))
    return out


def find_text(paras: DataFrame, needle: str, ignore_case: bool = False, overlapping: bool = False, limit: int | None = None) -> DataFrame:
    """A row a match: doc_id, para_id, start, end; the limit takes the first in document order."""
    text, want = (F.lower("text"), needle.lower()) if ignore_case else (F.col("text"), needle)
    found = paras.filter(text.contains(want)).select("doc_id", "para_id", F.explode(X.hits(text, want, overlapping)).alias("start"))
    found = found.withColumn("end", F.col("start") + F.lit(len(needle)))
    return found if limit is None else found.orderBy("doc_id", "para_id", "start").limit(limit)


def document_text(paras: DataFrame, text: str | Column = "text", name: str = "text") -> DataFrame:
    """Paragraphs' texts joined by newlines, in order."""
    rows = F.array_sort(F.collect_list(F.struct("para_id", (F.col(text) if isinstance(text, str) else text).alias("t"))))
    return paras.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n").alias(name))


def fingerprints(paras: DataFrame) -> DataFrame:
    """What a plan was made for: 16 digits of the SHA-256 of a document's text."""
    return document_text(paras).select("doc_id", X.fingerprint(F.col("text")).alias("fingerprint"))


def stale(paras: DataFrame, plans: DataFrame) -> DataFrame:
    """Plans (doc_id, fingerprint) whose document is another one now."""
    now = fingerprints(paras).withColumnRenamed("fingerprint", "now")
    return plans.join(now, "doc_id", "left").filter(~F.col("fingerprint").eqNullSafe(F.col("now")))


def with_labels(paras: DataFrame) -> DataFrame:
    """clause: the label of the paragraph itself or of the last numbered one before it."""
    own = X.label(F.col("text"))
    return paras.withColumn("clause", F.last(own, ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, 0)))


def manifest(paras: DataFrame) -> DataFrame:
    """A row a clause: its label, first and last paragraph, and title."""
    labelled = with_labels(paras).filter("clause IS NOT NULL")
    own = X.label(F.col("text"))
    title = F.when(own.isNotNull(), X.title(F.col("text"), X.label_end(F.col("text"))))
    return labelled.groupBy("doc_id", F.col("clause").alias("label")).agg(F.min("para_id").alias("first_para"), F.max("para_id").alias("last_para"), F.min_by(title, F.when(own.isNotNull(), F.col("para_id"))).alias("title"))


def render(paras: DataFrame) -> DataFrame:
    """Reading text of each document: `[id] text` lines, a heading wherever the clause changes, blank ones left out."""
    shown = with_labels(paras).filter(~X.is_blank(F.col("text")))
    changed = ~F.col("clause").eqNullSafe(F.lag("clause").over(in_order())) & F.col("clause").isNotNull()
    line = F.concat(F.when(changed, F.concat(F.lit("<<clause "), "clause", F.lit(">>\n"))).otherwise(""), F.lit("["), F.col("para_id").cast("string"), F.lit("] "), F.col("text"))
    return document_text(shown.withColumn("line", line), "line", "rendered")


#: Ways in which the rows of one text are dealt out, and its first row repeated.
SALTS = 8


def duplicates(paras: DataFrame) -> DataFrame:
    """Paragraphs whose normalised text an earlier one (by document, place) has: doc_id, para_id, and the first's.

    A text is two hashes (128 bits). Its first row is a pre-aggregated minimum, which is
    joined only where there are more; the rows of a text meet it in SALTS tasks.
    """
    filled = paras.filter(~X.is_blank(F.col("text"))).withColumn("_t", X.normalised(F.col("text")))
    keyed = filled.select("doc_id", "para_id", F.xxhash64("_t").alias("h1"), F.xxhash64(F.lit(7), "_t").alias("h2"))
    firsts = keyed.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "para_id")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    spread = firsts.select("h1", "h2", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "para_id"), F.lit(SALTS)).cast("int"))
    met = salted.join(spread, ["h1", "h2", "salt"]).filter((F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.para_id") != F.col("para_id")))
    return met.select("doc_id", "para_id", F.col("first.doc_id").alias("first_doc"), F.col("first.para_id").alias("first_para"))
