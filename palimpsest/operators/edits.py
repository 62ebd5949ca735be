"""Quoted edits: where they belong, which collide, and the text they make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import plain
from ..functions import text as X


def locate(edits: DataFrame, paras: DataFrame) -> DataFrame:
    """Each edit (doc_id, seq, para_id, target, occurrence) with its spans or the first reason against it, and the paragraph's text.

    paras may have all_text, the text with what is struck. Folding is translate(), so
    that all of it is built-in; the occurrence 0 stands for every hit.
    """
    whole = F.col("all_text") if "all_text" in paras.columns else F.col("text")
    found = paras.select("doc_id", "para_id", F.col("text").alias("paragraph"), X.folded(F.col("text")).alias("_text"), X.folded(whole).alias("_all"))
    joined = edits.drop("paragraph", "spans", "rejection").join(found, ["doc_id", "para_id"], "left").withColumn("_needle", X.folded(F.col("target")))
    joined = joined.withColumn("_hits", F.when(F.col("_text").isNotNull() & (F.col("_needle") != ""), X.hits(F.col("_text"), F.col("_needle"))).otherwise(F.array().cast("array<int>")))
    n, size = F.size("_hits"), F.length("_needle")
    reason = (
        F.when(X.is_blank(F.col("target")), "empty_target")
        .when(F.col("_text").isNull(), "paragraph_not_found")
        .when((n == 0) & F.col("_all").contains(F.col("_needle")), "target_already_struck")
        .when((n == 0) | (F.col("occurrence") > n), "target_not_found")
        .when((F.col("occurrence") == 1) & (n > 1) & (size < S.AMBIGUITY_CHARS), "target_ambiguous")
    )
    one = F.slice("_hits", F.greatest("occurrence", F.lit(1)), 1)
    starts = F.when(reason.isNotNull(), F.array().cast("array<int>")).when(F.col("occurrence") == 0, F.col("_hits")).otherwise(one)
    spans = F.transform(starts, lambda s: F.struct(s.alias("start"), (s + size).alias("end")))
    return joined.select(*(c for c in edits.columns if c not in ("paragraph", "spans", "rejection")), "paragraph", spans.alias("spans"), reason.alias("rejection"))


def overlaps(spans: DataFrame) -> DataFrame:
    """Pairs of spans (doc_id, para_id, seq, start, end) that overlap, the earlier first.

    Equi-joined on the paragraph, so a pair is only looked at within one; what comes out
    is as many rows as there are pairs that overlap.
    """
    a = spans.select("doc_id", "para_id", F.col("seq").alias("first"), F.col("start").alias("s1"), F.col("end").alias("e1"))
    b = spans.select("doc_id", "para_id", F.col("seq").alias("second"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    return a.join(b, ["doc_id", "para_id"]).filter("first < second AND s1 < e2 AND s2 < e1").select("doc_id", "para_id", "first", "second")


def apply(located: DataFrame) -> DataFrame:
    """Paragraphs after their edits: claims go to the first come, all spans are rewritten at once.

    located: of locate(), with replacement, so that no text is looked up again. A row a paragraph with an edit: its text, the
    text after accepting all, the edits applied and those that met an earlier claim. Two
    folds over what is asked of one paragraph: one in order of arrival, for the claims,
    one from the last span to the first, for the text.
    """
    good = located.filter("rejection IS NULL")
    edit = F.struct(F.col("seq").cast("long").alias("seq"), "spans", F.coalesce("replacement", F.lit("")).alias("new"))
    asked = good.groupBy("doc_id", "para_id").agg(F.array_sort(F.collect_list(edit)).alias("edits"), F.first("paragraph").alias("text"))
    ids, spans = F.array().cast("array<bigint>"), F.array().cast("array<struct<start:int,end:int,new:string>>")
    start = F.struct(spans.alias("claims"), ids.alias("applied"), ids.alias("conflicts"))

    def claim(s, e):
        clash = F.exists(e["spans"], lambda x: F.exists(s["claims"], lambda c: (x["start"] < c["end"]) & (c["start"] < x["end"])))
        own = F.transform(e["spans"], lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), e["new"].alias("new")))
        return F.when(clash, F.struct(s["claims"].alias("claims"), s["applied"].alias("applied"), F.concat(s["conflicts"], F.array(e["seq"])).alias("conflicts"))).otherwise(F.struct(F.concat(s["claims"], own).alias("claims"), F.concat(s["applied"], F.array(e["seq"])).alias("applied"), s["conflicts"].alias("conflicts")))

    def put(t, c):
        return F.concat(F.substring(t, F.lit(1), c["start"]), c["new"], F.substring(t, c["end"] + 1, F.length(t)))

    staged = asked.withColumn("r", F.aggregate("edits", start, claim))
    accepted = F.aggregate(F.reverse(F.array_sort(F.col("r.claims"))), F.col("text"), put)
    return staged.select("doc_id", "para_id", "text", accepted.alias("accepted"), "r.applied", "r.conflicts")


def explain(rejection: str) -> str:
    """A sentence for each reason."""
    return {
        "empty_target": "the quoted text is empty",
        "paragraph_not_found": "the document has no paragraph of that number",
        "target_already_struck": "the quoted text is only in a deletion that is tracked already",
        "target_not_found": "the paragraph doesn't hold the quoted text; quote it again, literally",
        "target_ambiguous": f"the quoted text occurs more than once and has under {S.AMBIGUITY_CHARS} characters; quote more, or say which occurrence",
        "span_conflict": "an earlier edit has claimed an overlapping span",
    }[rejection]


def check_edits(items: list[dict]) -> list[str]:
    """Problems of edits as they come from outside; none if they can be read."""
    out = []
    for i, x in enumerate(items):
        if not isinstance(x, dict):
            out.append(f"item {i}: not an object")
            continue
        note = "body" in x
        for key, kind in (("para_id", int), ("target", str), ("body" if note else "replacement", str)):
            if not isinstance(x.get(key), kind) or isinstance(x.get(key), bool):
                out.append(f"item {i}: {key} must be {kind.__name__}")
        if x.get("severity", "medium") not in S.SEVERITIES:
            out.append(f"item {i}: unknown severity {x['severity']!r}")
        if not isinstance(x.get("occurrence", 1), int) or x.get("occurrence", 1) < 0:
            out.append(f"item {i}: occurrence must be 0 or more")
    return out


find_all = plain.find_all
