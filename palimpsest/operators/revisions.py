"""Revision tables: counts, selectors, widening, accepting and rejecting.

A revision table has doc_id, seq (in document order), rev_id, kind, author, date,
text, move_name. A piece table has doc_id, para_id, seq, text and kind ('' for plain
text, else ins, del, move-from, move-to), with rev_id where it is revised.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .paragraphs import in_order

ADDED, REMOVED = ("ins", "move-to"), ("del", "move-from")


def counts(revisions: DataFrame) -> DataFrame:
    """Revisions of each document by kind and by author: dimension, value, n."""
    grouped = revisions.groupingSets([("doc_id", "kind"), ("doc_id", "author")], "doc_id", "kind", "author").agg(F.grouping("author").alias("by_kind"), F.count(F.lit(1)).alias("n"))
    return grouped.select("doc_id", F.when(F.col("by_kind") == 1, "kind").otherwise("author").alias("dimension"), F.when(F.col("by_kind") == 1, F.col("kind")).otherwise(F.col("author")).alias("value"), "n")


def kind_is(kind: Column, wanted: str) -> Column:
    """Whether a kind is the wanted one or of its family."""
    families = {"format": kind.startswith("format:"), "move": kind.startswith("move-"), "insert-any": kind.endswith("insert"), "delete-any": kind.endswith("delete")}
    return (kind == wanted) | families.get(wanted, F.lit(False))


def selector(ids: Iterable | None = None, authors: Iterable[str] | None = None, kinds: Iterable[str] | None = None, where: Column | None = None) -> Column | None:
    """Any of the values within a list, all of the lists; None, which selects all, where nothing is given."""
    listed = lambda x: [x] if isinstance(x, (str, int)) else list(x)
    parts = []
    if ids is not None:
        parts.append(F.col("rev_id").isin([str(i) for i in listed(ids)]))
    if authors is not None:
        parts.append(F.col("author").isin(listed(authors)))
    if kinds is not None:
        any_kind = F.lit(False)
        for k in listed(kinds):
            any_kind = any_kind | kind_is(F.col("kind"), k)
        parts.append(any_kind)
    if where is not None:
        parts.append(where)
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


def selected(revisions: DataFrame, select: Column | None = None) -> DataFrame:
    """The selected revisions and the other half of each selected move; marks aren't pulled in by their content."""
    if select is None:
        return revisions
    chosen = revisions.filter(select)
    names = chosen.filter("move_name IS NOT NULL").select("doc_id", "move_name").distinct()
    pulled = revisions.filter(~F.coalesce(select, F.lit(False)) & F.col("move_name").isNotNull()).join(names, ["doc_id", "move_name"], "left_semi")
    return chosen.unionByName(pulled.select(chosen.columns))


def resolve(pieces: DataFrame, keep_added: bool, chosen: DataFrame | None = None) -> DataFrame:
    """Accept (keep_added) or reject the chosen revisions (doc_id, rev_id; all if None): pieces go or become plain."""
    out = pieces
    if chosen is None:
        picked = F.col("kind") != ""
    else:
        marked = chosen.select("doc_id", "rev_id").distinct().withColumn("_picked", F.lit(True))
        out = pieces.join(marked, ["doc_id", "rev_id"], "left")
        picked = (F.col("kind") != "") & F.coalesce("_picked", F.lit(False))
    goes = F.col("kind").isin(*(REMOVED if keep_added else ADDED))
    kept = out.filter(~(picked & goes))
    return kept.withColumn("kind", F.when(picked, "").otherwise(F.col("kind"))).select(pieces.columns)


def text_of(pieces: DataFrame) -> DataFrame:
    """Current text of each paragraph that has pieces: what isn't struck, in order."""
    shown = F.when(~F.col("kind").isin(*REMOVED), F.col("text")).otherwise("")
    rows = F.array_sort(F.collect_list(F.struct("seq", shown.alias("t"))))
    return pieces.groupBy("doc_id", "para_id").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "").alias("text"))


def merge_marks(paras: DataFrame, removed: Column) -> DataFrame:
    """Paragraphs after marks are removed: one that loses its mark runs into the next that keeps its own.

    Groups end with a kept mark, so they are islands of a running count from the end;
    the group's paragraph is its last. Trailing paragraphs without a kept mark go if
    they are empty and stay as one if not.
    """
    back = Window.partitionBy("doc_id").orderBy(F.desc("para_id")).rowsBetween(Window.unboundedPreceding, 0)
    grouped = paras.withColumn("_kept", F.when(removed, 0).otherwise(1)).withColumn("_group", F.sum("_kept").over(back))
    rows = F.array_sort(F.collect_list(F.struct("para_id", "text")))
    out = grouped.groupBy("doc_id", "_group").agg(F.max("para_id").alias("para_id"), F.array_join(F.transform(rows, lambda r: r["text"]), "").alias("text"), F.max("_kept").alias("_kept"))
    return out.filter("_kept = 1 OR text <> ''").select("doc_id", "para_id", "text")


def next_ids(revisions: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """rev_id for new revisions of each document: above the largest number in use, in order."""
    top = revisions.groupBy("doc_id").agg(F.max(F.expr("try_cast(rev_id AS BIGINT)")).alias("_top"))
    ranked = new.join(top, "doc_id", "left").withColumn("rev_id", (F.coalesce("_top", F.lit(0)) + F.row_number().over(Window.partitionBy("doc_id").orderBy(order))).cast("string"))
    return ranked.drop("_top")


def move_cover(starts: DataFrame, ends: DataFrame, paras: DataFrame) -> DataFrame:
    """Names of the moved ranges that cover each paragraph, by an interval join within a document."""
    ranges = starts.select("doc_id", "move_name", F.col("para_id").alias("lo")).join(ends.select("doc_id", "move_name", F.col("para_id").alias("hi")), ["doc_id", "move_name"])
    hit = paras.join(ranges, "doc_id").filter("para_id BETWEEN lo AND hi")
    return hit.groupBy("doc_id", "para_id").agg(F.array_sort(F.collect_set("move_name")).alias("moves"))


def preceding(paras: DataFrame) -> DataFrame:
    """The paragraph before each one, as an anchor for insertions."""
    return paras.withColumn("anchor_id", F.lag("para_id").over(in_order()))
