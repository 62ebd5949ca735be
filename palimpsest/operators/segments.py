"""Heading levels, reading strategy, units, and packing into segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from .paragraphs import in_order


def guessed_level(bold=None):
    """1 for a short line that doesn't end like a sentence and is all bold or all capitals."""
    text = X.strip(F.col("text"))
    short = F.length(text).between(1, S.TITLE_CHARS) & ~text.rlike("[.;:,]$")
    capitals = (F.upper(text) == text) & text.rlike(r"\p{L}")
    return F.when(short & (capitals if bold is None else capitals | bold), 1).otherwise(0)


def with_levels(paras: DataFrame) -> DataFrame:
    """level: the clause number's, else an explicit one of the document (column heading), else a guess where no paragraph has one."""
    explicit = F.col("heading").cast("int") if "heading" in paras.columns else F.lit(None).cast("int")
    bold = F.col("bold") if "bold" in paras.columns else None
    any_explicit = F.max(explicit.isNotNull()).over(Window.partitionBy("doc_id"))
    heading = F.when(any_explicit, F.coalesce(explicit, F.lit(0))).otherwise(guessed_level(bold))
    label = X.label(F.col("text"))
    depth = F.when(F.col("label").isNotNull(), F.size(F.split("label", r"\.")))
    shallowest = F.min(depth).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    # A section is a clause with no parent: none before it has fewer components.
    section = depth.isNotNull() & (shallowest.isNull() | (shallowest >= depth))
    return paras.withColumn("heading_level", heading).withColumn("label", label).withColumns({"level": F.coalesce(depth, F.col("heading_level")), "section": section})


def strategies(levelled: DataFrame) -> DataFrame:
    """How each document is read: clauses, headings or windows."""
    sections = F.count_if("section")
    numbered, headings, filled = F.count_if(F.col("label").isNotNull()), F.count_if(F.col("heading_level") > 0), F.count_if(~X.is_blank(F.col("text")))
    chosen = F.when((F.col("sections") >= S.MIN_SECTIONS) & (F.col("filled") > 0) & (F.col("numbered") >= S.MIN_NUMBERED_SHARE * F.col("filled")), "clauses").when(F.col("headings") >= S.MIN_HEADINGS, "headings").otherwise("windows")
    return levelled.groupBy("doc_id").agg(sections.alias("sections"), numbered.alias("numbered"), headings.alias("headings"), filled.alias("filled")).withColumn("strategy", chosen)


def units(levelled: DataFrame, strategies_: DataFrame) -> DataFrame:
    """unit: a new one starts at each paragraph of the shallowest level; of windows, at each paragraph."""
    joined = levelled.join(strategies_.select("doc_id", "strategy"), "doc_id")
    top = F.min(F.when(F.col("level") > 0, F.col("level"))).over(Window.partitionBy("doc_id"))
    starts = (F.col("strategy") == "windows") | (F.coalesce(F.col("level") == F.col("_top"), F.lit(False)))
    count = F.sum(F.when(starts, 1).otherwise(0)).over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    first = F.min("_count").over(Window.partitionBy("doc_id"))
    return joined.withColumn("_top", top).withColumn("_count", count).withColumn("unit", F.col("_count") - first).drop("_top", "_count")


def pack_units(units_: DataFrame, budget_tokens: int = S.SEGMENT_TOKENS) -> DataFrame:
    """Segments by greedy packing of a document's units: doc_id, unit, chars, segment.

    A segment is closed when it has something and the next unit would pass the
    budget. The fold runs over one document's units in an array.
    """
    sized = units_.groupBy("doc_id", "unit").agg(F.sum(F.length("text")).cast("long").alias("chars"))
    listed = sized.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("unit", "chars"))).alias("u"))
    budget = budget_tokens * S.CHARS_PER_TOKEN
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(False).alias("some"), F.lit(0).alias("seg"), F.array().cast("array<int>").alias("out"))

    def step(s, x):
        close = s["some"] & (s["used"] + x["chars"] > budget)
        seg = F.when(close, s["seg"] + 1).otherwise(s["seg"])
        return F.struct((F.when(close, F.lit(0)).otherwise(s["used"]) + x["chars"]).alias("used"), F.lit(True).alias("some"), seg.alias("seg"), F.concat(s["out"], F.array(seg)).alias("out"))

    packed = listed.select("doc_id", F.explode(F.arrays_zip("u", F.aggregate("u", start, step, lambda s: s["out"]).alias("segment"))).alias("z"))
    return packed.select("doc_id", F.col("z.u.unit").alias("unit"), F.col("z.u.chars").alias("chars"), F.col("z.segment").alias("segment"))


def segments(units_: DataFrame, budget_tokens: int = S.SEGMENT_TOKENS) -> DataFrame:
    """A row a segment: seg_id, first and last paragraph, chars, tokens, title, risk families."""
    packed = pack_units(units_, budget_tokens).select("doc_id", "unit", "segment")
    rows = units_.join(packed, ["doc_id", "unit"])
    text = F.when(~X.is_blank(F.col("text")), F.substring(X.strip(F.col("text")), 1, S.TITLE_CHARS))
    title = F.coalesce(F.min_by(text, F.when((F.col("level") > 0) & text.isNotNull(), F.col("para_id"))), F.min_by(text, F.when(text.isNotNull(), F.col("para_id"))))
    out = rows.groupBy("doc_id", "segment").agg(F.min("para_id").alias("first_para"), F.max("para_id").alias("last_para"), F.sum(F.length("text")).cast("long").alias("chars"), title.alias("title"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(X.risks(F.col("text")))))).alias("risks"))
    return out.withColumn("tokens", X.approx_tokens(F.col("chars"))).withColumn("seg_id", F.format_string("S%02d", "segment"))


def triage(segments_: DataFrame, chosen: DataFrame, min_coverage: float = 0.35) -> DataFrame:
    """Priorities with their floors, then promotions until the deep share is met.

    chosen: doc_id, seg_id, priority. Segments that aren't mentioned are scanned, and
    so is a skipped one of two risk families or more; then the riskiest, longest ones
    become deep until deep tokens reach min_coverage of all.
    """
    n_risks = F.size("risks")
    priority = F.when((F.coalesce("priority", F.lit("scan")) == "skip") & (n_risks >= 2), "scan").otherwise(F.coalesce("priority", F.lit("scan")))
    floored = segments_.join(chosen.select("doc_id", "seg_id", "priority"), ["doc_id", "seg_id"], "left").withColumn("priority", priority).withColumn("n_risks", n_risks)
    doc = Window.partitionBy("doc_id")
    deep = F.sum(F.when(F.col("priority") == "deep", F.col("tokens")).otherwise(0)).over(doc)
    rest = F.when(F.col("priority") == "deep", 0).otherwise(F.col("tokens"))
    order = doc.orderBy(F.desc("n_risks"), F.desc("tokens"), "seg_id").rowsBetween(Window.unboundedPreceding, -1)
    reached = deep + F.coalesce(F.sum(rest).over(order), F.lit(0))
    promote = (F.col("priority") != "deep") & (reached < min_coverage * F.sum("tokens").over(doc))
    return floored.withColumn("final", F.when(promote, "deep").otherwise(F.col("priority")))
