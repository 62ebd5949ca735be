"""Reconciling what was proposed for a document's segments independently.

The order of steps: items out of their segment go, identical ones are one, conflicts
fall to the more severe, what doesn't resolve against the untouched document goes,
the rest is put in the order in which it runs, capped, and numbered. Each item that
doesn't survive is in the ledger with its reason, so that
proposed = kept + dropped + conflicts + unresolved.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from .. import schema as S
from ..operators.document import Document, Table
from ..operators.planner import check_actions

TARGETS = ("clause", "section", "after_clause", "before_clause", "into_section", "after_section", "before_section")
STRUCTURAL = tuple(t for t, (_, _, phase) in S.ACTIONS.items() if phase == "structural")


def severity(item: dict) -> int:
    return S.SEVERITIES.index(item["severity"]) if item.get("severity") in S.SEVERITIES else 1


def identity(item: dict) -> tuple:
    plain = lambda v: tuple(v) if isinstance(v, list) else v
    return tuple(sorted((k, plain(v)) for k, v in item.items() if k not in ("id", "rationale", "severity", "note")))


def inside(label: str | None, others: set[str]) -> bool:
    return label is not None and any(label == o or label.startswith(f"{o}.") for o in others)


def position(item: dict) -> tuple[int, ...]:
    """Of its clause or section; what has but an anchor beside it, or none, comes last."""
    label = str(item.get("clause") or item.get("section") or "")
    return tuple(map(int, label.split("."))) if label and all(x.isdigit() for x in label.split(".")) else (9999,)


def allowed(strategy: str) -> tuple[str, ...]:
    """Without clause numbers there is nothing to restructure by."""
    return tuple(S.ACTIONS) if strategy == "clauses" else tuple(t for t in S.ACTIONS if t not in STRUCTURAL)


@dataclass
class Report:
    proposed: int = 0
    kept: list[dict] = field(default_factory=list)
    ledger: list[dict] = field(default_factory=list)  # outcome, reason, item, winner

    def drop(self, outcome: str, item: dict, reason: str, winner: dict | None = None) -> None:
        self.ledger.append({"outcome": outcome, "reason": reason, "item": item, "winner": winner and winner.get("id")})

    def counts(self) -> dict:
        found = Counter(x["outcome"] for x in self.ledger)
        return {"proposed": self.proposed, "kept": len(self.kept), **{k: found[k] for k in ("dropped", "conflict", "unresolved")}}

    def by_severity(self) -> dict:
        found = Counter(x.get("severity") for x in self.kept)
        return {s: found[s] for s in S.SEVERITIES}

    def format(self) -> str:
        return ", ".join(f"{n} {k}" for k, n in self.counts().items())


def stage(results: list[dict], report: Report, known: set[str]) -> list[dict]:
    """Items of all segments in order, without disallowed types and what another segment owns."""
    out = []
    for r in sorted(results, key=lambda r: r["index"]):
        owned = set(r.get("labels") or ())
        for item in r["items"]:
            report.proposed += 1
            claimed = {item[k] for k in TARGETS if item.get(k)} & known
            if item.get("type") not in allowed(r.get("strategy", "clauses")):
                report.drop("dropped", item, "type isn't allowed for this segment")
            elif owned and claimed and not claimed & owned:
                report.drop("dropped", item, "target is in another segment")
            else:
                out.append(item)
    return out


def dedupe(items: list[dict], report: Report) -> list[dict]:
    first: dict[tuple, dict] = {}
    out = []
    for x in items:
        key = identity(x)
        if key in first:
            report.drop("dropped", x, "same as an earlier item", first[key])
        else:
            first[key] = x
            out.append(x)
    return out


def conflicts(items: list[dict], report: Report) -> list[dict]:
    """Claims in the order of severity, then arrival; survivors come back in arrival order."""
    claims: dict[tuple, dict] = {}  # what is claimed, by whom
    deleted: dict[str, dict] = {}
    quotes: dict[str, list[dict]] = {}
    kept: set[int] = set()

    def against(x: dict) -> tuple[dict | None, str]:
        """Whose claim an item meets, and why that excludes it."""
        kind, own = x["type"], x.get("clause") or x.get("section")
        targets = [x[k] for k in TARGETS if x.get(k)]
        for t in targets:
            for d, by in deleted.items():
                if inside(t, {d}):
                    return by, "target is in a clause that is deleted"
        if kind in STRUCTURAL:
            taken = next((claims["structure", t] for t in targets if ("structure", t) in claims), None)
            return taken, "another structural action has this target"
        if S.ACTIONS[kind][2] == "annotation":
            return None, ""
        if own and ("rewrite", own) in claims:
            return claims["rewrite", own], "the clause is rewritten as a whole"
        if kind == "insert_text":
            return claims.get(place(x)), "another insertion has this place"
        if kind in ("replace_text", "delete_text") and own and x.get("find"):
            clash = next((o for o in quotes.get(own, ()) if o["find"] in x["find"] or x["find"] in o["find"]), None)
            return clash, "its quote overlaps another's"
        return None, ""

    def place(x: dict) -> tuple:
        return ("insert", x.get("clause"), x.get("anchor"), x.get("position") or "after")

    for i in sorted(range(len(items)), key=lambda i: (-severity(items[i]), i)):
        x = items[i]
        winner, why = against(x)
        if winner is not None:
            report.drop("conflict", x, why, winner)
            continue
        kept.add(i)
        kind, own = x["type"], x.get("clause") or x.get("section")
        if kind in STRUCTURAL:
            claims |= {("structure", x[k]): x for k in TARGETS if x.get(k)}
            if kind in ("delete_clause", "delete_section"):
                deleted[own] = x
        elif kind == "rewrite_clause":
            claims["rewrite", own] = x
        elif kind == "insert_text":
            claims[place(x)] = x
        elif kind in ("replace_text", "delete_text") and own and x.get("find"):
            quotes.setdefault(own, []).append(x)
    return [x for i, x in enumerate(items) if i in kept]


def unresolved(doc: Document, x: dict) -> str | None:
    """The first thing of an item that the untouched document doesn't have."""
    clauses = {c.label: c for c in reversed(doc.all_clauses())}
    for key in TARGETS:
        if x.get(key) and x[key] not in clauses:
            return f"no clause {x[key]}"
    for quote in () if x.get("regex") else filter(None, (x.get("find"), x.get("anchor"))):
        if x.get("clause"):
            if quote not in clauses[x["clause"]].paragraph.text:
                return "quote isn't in the clause"
        else:
            n = sum(quote in p.text for p in doc.paragraphs())
            if n == 0:
                return "quote isn't in the document"
            if n > 1 and not x.get("all"):
                return "quote is in several paragraphs"
    if x["type"] == "reorder_clauses":
        own = {c.label for c in clauses[x["section"]].children}
        if not set(x["order"]) <= own:
            return "order lists clauses of another section"
    if x.get("table") is not None:
        tables = [b for b in doc.body if isinstance(b, Table)]
        if not 0 <= x["table"] < len(tables):
            return "no such table"
        if x.get("row") is not None and x["type"] != "insert_row" and not 0 <= x["row"] < len(tables[x["table"]].rows):
            return "no such row"
    return None


def ordered(items: list[dict]) -> list[dict]:
    phases = ("content", "structural", "annotation")
    rank = lambda x: (phases.index(S.ACTIONS[x["type"]][2]), S.STRUCTURAL_ORDER.index(x["type"]) if x["type"] in S.STRUCTURAL_ORDER else 0, position(x))
    return sorted(items, key=rank)


def cap(items: list[dict], most: int | None, report: Report) -> list[dict]:
    if most is None or len(items) <= most:
        return items
    best = sorted(range(len(items)), key=lambda i: (-severity(items[i]), position(items[i]), i))
    keep = set(best[:most])
    for i in best[most:]:
        report.drop("dropped", items[i], f"over the limit of {most}")
    return [x for i, x in enumerate(items) if i in keep]


def reduce_segments(doc: Document, results: list[dict], max_actions: int | None = None) -> Report:
    """results: index, items, labels and strategy of each segment."""
    report = Report()
    items = dedupe(stage(results, report, {c.label for c in doc.all_clauses()}), report)
    resolved = []
    for x in conflicts(items, report):
        why = unresolved(doc, x)
        if why:
            report.drop("unresolved", x, why)
        else:
            resolved.append(x)
    kept = cap(ordered(resolved), max_actions, report)
    report.kept = [{**x, "id": f"AI-{i:04d}", "note": x.get("id")} for i, x in enumerate(kept, 1)]
    bad = check_actions([{k: v for k, v in x.items() if v is not None} for x in report.kept])
    if bad:
        raise ValueError("; ".join(bad))
    return report


def resolve_conflicts(actions: DataFrame) -> DataFrame:
    """The conflict rules over many documents' plans (doc_id, seq, type, severity, targets, find, ...).

    Claims depend on the order, so a document's plan is one group; plans are short.
    """
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        items = [{k: v for k, v in r.items() if v is not None and v == v} for r in rows.sort_values("seq").to_dict("records")]
        report = Report()
        kept = {x["seq"] for x in conflicts(items, report)}
        lost = {x["item"]["seq"]: x for x in report.ledger}
        out = [(key[0], x["seq"], "kept" if x["seq"] in kept else "conflict", lost.get(x["seq"], {}).get("reason")) for x in items]
        return pd.DataFrame(out, columns=["doc_id", "seq", "outcome", "reason"])

    return actions.groupBy("doc_id").applyInPandas(run, "doc_id long, seq int, outcome string, reason string")
