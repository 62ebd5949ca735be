"""Clause trees: numbering, parents, renumbering, cross-references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X


def parse(paras: DataFrame) -> DataFrame:
    """Numbered paragraphs: label, level, number, title, body. Paragraphs whose mark goes away don't count."""
    if "mark" in paras.columns:
        paras = paras.filter(~F.coalesce(F.col("mark"), F.lit("")).isin("del", "moveFrom"))
    label, after = X.label(F.col("text")), X.label_end(F.col("text"))
    out = paras.withColumn("label", label).filter("label IS NOT NULL")
    return out.withColumns({"number": X.number(F.col("label")), "level": F.size(F.split("label", r"\.")), "title": X.title(F.col("text"), after), "body": X.body(F.col("text"), after)})


def with_ancestors(clauses: DataFrame, *carry: str) -> DataFrame:
    """Adds above: para_id and the carried columns of each clause's ancestors, from the top, however deep.

    A clause's parent is the nearest earlier one of fewer components. So a clause asks at
    each level above its own for the last clause there, by one running value in the order
    of level and place; of the answers, from the top level on, those that stand behind
    all before are the ancestors. All of it is sorts within a document, after one
    shuffle on doc_id at most.
    """
    others = [c for c in clauses.columns if c not in ("doc_id", "para_id")]
    own = F.col("_at") == F.col("level")
    asked = clauses.withColumn("_at", F.explode(F.sequence(F.lit(1), F.col("level"))))
    # The clause itself is the row that asks nothing; the others leave its columns behind.
    asked = asked.select("doc_id", "para_id", "_at", F.when(own, F.struct(*others)).alias("_row"), F.when(own, F.struct(F.col("_at").alias("level"), "para_id", *carry)).alias("_own"))
    earlier = Window.partitionBy("doc_id").orderBy("_at", "para_id").rowsBetween(Window.unboundedPreceding, -1)
    last = asked.withColumn("_last", F.last("_own", ignorenulls=True).over(earlier))
    answer = F.when(F.col("_own").isNull() & (F.col("_last.level") == F.col("_at")), F.col("_last"))
    # doc_id and para_id stay the columns that the rows are dealt by, so that what follows needs no shuffle.
    whole = last.groupBy("doc_id", "para_id").agg(F.first("_row", ignorenulls=True).alias("_row"), F.sort_array(F.collect_list(answer)).alias("_all"))
    before = F.transform("_all", lambda x, i: F.struct(x.alias("x"), F.array_max(F.transform(F.slice("_all", F.lit(1), i), lambda y: y["para_id"])).alias("high")))
    above = F.transform(F.filter(before, lambda y: y["high"].isNull() | (y["x"]["para_id"] > y["high"])), lambda y: y["x"].dropFields("level"))
    return whole.select(*(F.col(c) if c in ("doc_id", "para_id") else F.col(f"_row.{c}") for c in clauses.columns), above.alias("above"))


def tree(clauses: DataFrame) -> DataFrame:
    """Adds parent_id (para_id) and parent (label): the nearest earlier clause of fewer components."""
    parent = F.try_element_at("above", F.lit(-1))
    return with_ancestors(clauses, "label").select(*clauses.columns, parent["para_id"].alias("parent_id"), parent["label"].alias("parent"))


def duplicate_labels(clauses: DataFrame) -> DataFrame:
    return clauses.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def siblings(tree_: DataFrame) -> DataFrame:
    """Adds place, the 1-based position among the children of the same parent."""
    return tree_.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "parent_id").orderBy("para_id")))


def gaps(tree_: DataFrame) -> DataFrame:
    """Clauses whose last component isn't their place among their siblings."""
    return siblings(tree_).filter(F.element_at("number", -1) != F.col("place"))


def renumber(clauses: DataFrame) -> DataFrame:
    """Adds new_label: the places of a clause and its ancestors, from the top, among the clauses given."""
    clauses = clauses.drop("parent_id", "parent")
    placed = siblings(tree(clauses)).select(*clauses.columns, "place")
    path = F.concat(F.transform("above", lambda x: x["place"]), F.array("place"))
    return with_ancestors(placed, "place").select(*placed.columns, F.array_join(F.transform(path, lambda x: x.cast("string")), ".").alias("new_label"))


def mapping(renumbered: DataFrame) -> DataFrame:
    """Old label to new, of those that change; of equal old labels the last counts."""
    return renumbered.filter("label <> new_label").groupBy("doc_id", F.col("label").alias("old_label")).agg(F.max_by("new_label", "para_id").alias("new_label"))


def references(paras: DataFrame) -> DataFrame:
    """A row a cross-reference: doc_id, para_id, start, end, number, keyword."""
    return paras.select("doc_id", "para_id", F.explode(X.references(F.col("text"))).alias("r")).select("doc_id", "para_id", "r.*")


def rewrite_references(refs: DataFrame, mapping_: DataFrame, removed: DataFrame) -> DataFrame:
    """Each reference's fate: dangling if its clause is removed, else rewritten if it has a new label."""
    gone = removed.select("doc_id", F.col("label").alias("number"), F.lit(True).alias("gone")).distinct()
    new = mapping_.withColumnRenamed("old_label", "number")
    joined = refs.join(gone, ["doc_id", "number"], "left").join(new, ["doc_id", "number"], "left")
    fate = F.when(F.col("gone"), "dangling").when(F.col("new_label") != F.col("number"), "rewritten").otherwise("kept")
    return joined.select(*refs.columns, fate.alias("fate"), F.when(fate == "rewritten", F.col("new_label")).alias("new_number"))


def broken_references(refs: DataFrame, clauses: DataFrame) -> DataFrame:
    """References to numbers that no clause of the document has."""
    return refs.join(clauses.select("doc_id", F.col("label").alias("number")).distinct(), ["doc_id", "number"], "left_anti")


def outline(clauses: DataFrame, chars: int = S.OUTLINE_CHARS) -> DataFrame:
    return clauses.select("doc_id", "para_id", "label", "level", "title", F.substring("body", 1, chars).alias("body"))


def render_outline(clauses: DataFrame, chars: int = S.RENDER_CHARS) -> DataFrame:
    """Outline text of each document: indented by level, `label  body`."""
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), "label", F.lit("  "), F.substring("body", 1, chars))
    rows = F.array_sort(F.collect_list(F.struct("para_id", line.alias("line"))))
    return clauses.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("outline"))


def subtree(clauses: DataFrame, roots: DataFrame) -> DataFrame:
    """Clauses at or below given ones (doc_id, label): a clause and its ancestors are looked up in one join."""
    wanted = roots.select("doc_id", F.col("label").alias("_label")).distinct()
    line = F.concat(F.transform("above", lambda x: x["label"]), F.array("label"))
    lines = with_ancestors(clauses, "label").select("doc_id", "para_id", F.explode(line).alias("_label"))
    found = lines.join(wanted, ["doc_id", "_label"], "left_semi").select("doc_id", "para_id").distinct()
    return clauses.join(found, ["doc_id", "para_id"], "left_semi")
