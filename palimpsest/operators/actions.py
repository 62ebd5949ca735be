"""Action plans as tables: problems, order, cap, dedupe, preflight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X


def given(name: str) -> Column:
    """Whether an action's field has a value; an empty text has none."""
    kind = S.ACTION[name].dataType.typeName()
    c = F.col(name)
    return c.isNotNull() & ((c != "") if kind == "string" else (F.size(c) > 0) if kind == "array" else F.lit(True))


def problems(actions: DataFrame) -> DataFrame:
    """A row a problem: doc_id, seq, problem. One pass over the plan; ids are counted by document.

    Fields that the table lacks are taken as not given.
    """
    for f in S.ACTION:
        if f.name not in actions.columns:
            actions = actions.withColumn(f.name, F.lit(None).cast(f.dataType))
    kind = F.col("type")
    found = [F.when(~given("id"), "missing id"), F.when(~given("rationale"), "missing rationale")]
    found.append(F.when(kind.isin(*S.DERIVED_ACTIONS), F.concat(F.lit("derived type "), kind)).when(kind.isNull() | ~kind.isin(*S.ACTIONS), F.concat(F.lit("unknown type "), F.coalesce(kind, F.lit("null")))))
    found.append(F.when(F.col("severity").isNull() | ~F.col("severity").isin(*S.SEVERITIES), "bad severity"))
    for f in S.ACTION:
        if f.name in S.ACTION_COMMON:
            continue
        needs = [t for t, (req, _, _) in S.ACTIONS.items() if f.name in req]
        takes = [t for t, (req, opt, _) in S.ACTIONS.items() if f.name in (*req, *opt)]
        if needs:
            found.append(F.when(kind.isin(*needs) & ~given(f.name), f"missing {f.name}"))
        found.append(F.when(kind.isin(*S.ACTIONS) & ~kind.isin(*takes) & given(f.name), f"unexpected {f.name}"))
    for t, names in S.PLACEMENTS.items():
        any_given = F.lit(False)
        for n in names:
            any_given = any_given | given(n)
        found.append(F.when((kind == t) & ~any_given, "missing placement"))
    order = F.col("order")
    found.append(F.when((kind == "reorder_clauses") & given("order") & (F.size(order) < 2), "order too short"))
    found.append(F.when((kind == "reorder_clauses") & given("order") & (F.size(F.array_distinct(order)) < F.size(order)), "order repeats"))
    found.append(F.when(given("id") & (F.row_number().over(Window.partitionBy("doc_id", "id").orderBy("seq")) > 1), "duplicate id"))
    return actions.withColumn("_p", F.array_compact(F.array(*found))).select("doc_id", "seq", F.explode("_p").alias("problem"))


def _lookup(key: Column, table: dict, otherwise) -> Column:
    out = F.lit(otherwise)
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def phase(kind: Column) -> Column:
    return _lookup(kind, {t: ("content", "structural", "annotation").index(p) for t, (_, _, p) in S.ACTIONS.items()}, 0)


def position(label: Column) -> Column:
    """A label as numbers, which sort by document order; one that isn't a label sorts last."""
    return F.when(label.rlike(r"^\d+(\.\d+)*$"), X.number(label)).otherwise(F.array(F.lit(9999)))


def target(actions: DataFrame) -> Column:
    """The label that places an action in its document: its clause or section; an anchor beside it doesn't."""
    names = [n for n in ("clause", "section") if n in actions.columns]
    return F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names), F.lit(""))


def execution_order(actions: DataFrame) -> DataFrame:
    """Adds place: content, structural by fixed order of types, annotations; then document order; then arrival."""
    rank = _lookup(F.col("type"), {t: i for i, t in enumerate(S.STRUCTURAL_ORDER)}, 0)
    where = position(target(actions))
    return actions.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(phase(F.col("type")), rank, where, "seq")))


def cap(actions: DataFrame, most: int) -> DataFrame:
    """Adds outcome: the most severe `most` of each document stay, then the earliest in it; the rest is capped."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(X.severity_rank(F.col("severity")).desc(), position(target(actions)), "seq"))
    return actions.withColumn("outcome", F.when(rank <= most, "kept").otherwise("capped"))


def identity(actions: DataFrame) -> Column:
    """What makes two actions the same: all that is given but id, rationale, severity and note."""
    names = sorted(f.name for f in S.ACTION if f.name in actions.columns and f.name not in ("id", "rationale", "severity", "note"))
    return F.sha2(F.to_json(F.struct(*names)).cast("binary"), 256)


def dedupe(actions: DataFrame) -> DataFrame:
    """Adds winner: the seq of the first identical action; an action that is its own winner stays."""
    return actions.withColumn("winner", F.min("seq").over(Window.partitionBy("doc_id", identity(actions))))


TARGETS = ("clause", "section", "after_clause", "before_clause", "into_section", "after_section", "before_section")


def preflight(actions: DataFrame, clauses: DataFrame, paras: DataFrame) -> DataFrame:
    """Adds problem: the first check that fails against the untouched document, or null.

    All clauses and sections that are named must exist; a quote must be in its clause,
    or, with no clause, in exactly one paragraph unless `all`; patterns aren't looked up.
    A quote without a clause meets all paragraphs of its document, as it must.
    """
    own = clauses.select("doc_id", F.col("label").alias("clause"), F.col("text").alias("_text")).dropDuplicates(["doc_id", "clause"])
    named = F.array_compact(F.array(*(F.nullif(F.col(n), F.lit("")) for n in TARGETS if n in actions.columns)))
    missing = actions.select("doc_id", "seq", F.explode(named).alias("clause")).join(own, ["doc_id", "clause"], "left_anti").select("doc_id", "seq").distinct().withColumn("_missing", F.lit(True))
    quoted = actions.filter("find IS NOT NULL AND find <> '' AND (clause IS NULL OR clause = '') AND NOT coalesce(regex, false)").select("doc_id", "seq", "find")
    hits = quoted.join(paras.select("doc_id", "para_id", "text"), "doc_id").filter(F.col("text").contains(F.col("find"))).groupBy("doc_id", "seq").agg(F.count(F.lit(1)).alias("_hits"))
    joined = actions.join(own, ["doc_id", "clause"], "left").join(missing, ["doc_id", "seq"], "left").join(hits, ["doc_id", "seq"], "left")
    of_clause, quote = given("clause"), given("find") & ~F.coalesce("regex", F.lit(False))
    n = F.coalesce("_hits", F.lit(0))
    problem = (
        F.when(F.col("_missing"), "no such clause")
        .when(of_clause & quote & ~F.col("_text").contains(F.col("find")), "quote not in clause")
        .when(~of_clause & quote & (n == 0), "quote not found")
        .when(~of_clause & quote & (n > 1) & ~F.coalesce("all", F.lit(False)), "quote in several paragraphs")
    )
    return joined.select(*actions.columns, problem.alias("problem"))


def severity_counts(actions: DataFrame) -> DataFrame:
    """A row for each document and each of the four severities, with zeros."""
    every = actions.select("doc_id").distinct().withColumn("severity", F.explode(F.array(*map(F.lit, S.SEVERITIES))))
    return every.join(actions.groupBy("doc_id", "severity").count(), ["doc_id", "severity"], "left").select("doc_id", "severity", F.coalesce("count", F.lit(0)).alias("n"))
