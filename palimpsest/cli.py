"""Command line: compare, apply, pipeline (or full), accept, reject, summary, validate, doctor."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from . import schema as S
from .operators.compare import compare_into
from .operators.document import EditError
from .operators.planner import apply_ops, check_actions
from .plans.engines import doctor
from .plans.pipeline import inline_actions, inline_comments, load_plan, revise
from .plans.review import REVIEWERS, Cache, get_engine, get_reviewer
from .sources import ooxml


def _csv(values: list[str] | None) -> list[str] | None:
    return [x for v in values for x in v.split(",") if x] if values else None


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="palimpsest", description=__doc__)
    out.add_argument("--author", default="Editor")
    out.add_argument("--date")
    sub = out.add_subparsers(dest="command", required=True)

    def add(name: str, *paths: str):
        p = sub.add_parser(name)
        for x in paths:
            p.add_argument(x, type=Path)
        return p

    add("compare", "original", "revised", "output")
    add("apply", "source", "plan", "output").add_argument("--lenient", action="store_true")
    for name in ("pipeline", "full"):  # the second takes anything together, a comparison and comments too
        p = add(name, "source", "output")
        p.add_argument("--actions", type=Path)
        p.add_argument("--action", action="append", default=[], metavar="JSON")
        p.add_argument("--comment", action="append", default=[], metavar="CLAUSE=TEXT", help="or find=PHRASE=TEXT")
        p.add_argument("--comments-file", type=Path)
        p.add_argument("--revised", type=Path)
        p.add_argument("--similarity", type=float, default=S.SIMILARITY_FLOOR)
        p.add_argument("--reviewer", choices=sorted(REVIEWERS))
        p.add_argument("--engine", metavar="NAME", help="of the chunked reviewer: a registered engine, or module:factory")
        p.add_argument("--model")
        p.add_argument("--brief", default="")
        p.add_argument("--segment-tokens", type=int, default=S.SEGMENT_TOKENS)
        p.add_argument("--concurrency", type=int, default=6)
        p.add_argument("--min-coverage", type=float, default=0.35)
        p.add_argument("--max-actions", type=int)
        for flag in ("--no-triage", "--no-cache", "--refresh", "--no-renumber", "--strict", "--no-explain"):
            p.add_argument(flag, action="store_true")
        p.add_argument("--cache-dir")
        p.add_argument("--merge-report", type=Path)
        p.add_argument("--report", type=Path)
    for name in ("accept", "reject"):
        p = add(name, "source", "output")
        for flag in ("--id", "--by", "--kind"):
            p.add_argument(flag, action="append")
    add("summary", "source").add_argument("--limit", type=int)
    add("validate", "plan")
    p = add("doctor")
    p.add_argument("--engine", required=True, metavar="NAME")
    p.add_argument("--model")
    return out


def reviewer_of(a: argparse.Namespace):
    """The reviewer that the flags describe."""
    if not a.reviewer:
        return None
    if REVIEWERS[a.reviewer] is REVIEWERS["rules"]:
        return get_reviewer(a.reviewer)
    if not a.engine:
        raise EditError(f"the reviewer {a.reviewer} needs --engine")
    engine = get_engine(a.engine, **({"model": a.model} if a.model else {}))
    if REVIEWERS[a.reviewer] is not REVIEWERS["chunked"]:
        return get_reviewer(a.reviewer, engine=engine)
    say = lambda *x: print("  ", *x, file=sys.stderr, flush=True)
    return get_reviewer(
        a.reviewer, engine=engine, segment_tokens=a.segment_tokens, concurrency=a.concurrency, triage=not a.no_triage, min_coverage=a.min_coverage, max_actions=a.max_actions,
        cache=Cache(a.cache_dir, not a.no_cache, a.refresh), on_progress=lambda phase, n, of: say(f"{phase} {n}/{of}"), on_alive=lambda seg, s, n: say(f"{seg}: {s:.0f} s, {n} events"),
    )


def run_pipeline(a: argparse.Namespace, how: dict) -> int:
    actions = (load_plan(a.actions.read_text()) if a.actions else []) + inline_actions(a.action)
    comments = inline_comments(a.comment, a.comments_file.read_text() if a.comments_file else None)
    r = revise(a.source.read_bytes(), actions=actions, comments=comments, revised=a.revised.read_bytes() if a.revised else None, reviewer=reviewer_of(a), brief=a.brief, renumber=not a.no_renumber, strict=a.strict, explain=not a.no_explain, similarity=a.similarity, **how)
    a.output.write_bytes(r.content)
    if a.report:
        a.report.write_text(r.to_json())
    if a.merge_report:
        a.merge_report.write_text(json.dumps(r.ledger, default=str))
    print(r.format())
    return int(not r.ok)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    how = {"author": a.author, "date": a.date}
    try:
        if a.command == "validate":
            bad = check_actions(load_plan(a.plan.read_text()))
            print("\n".join(bad) or "ok")
            return int(bool(bad))
        if a.command == "doctor":
            print(doctor(get_engine(a.engine, **({"model": a.model} if a.model else {}))))
            return 0
        if a.command == "summary":
            print(ooxml.read(a.source.read_bytes()).summary(a.limit))
            return 0
        if a.command in ("pipeline", "full"):
            return run_pipeline(a, how)
        if a.command == "compare":
            doc = ooxml.read(a.original.read_bytes(), **how)
            print(compare_into(doc, ooxml.read(a.revised.read_bytes())).format())
        else:
            doc = ooxml.read(a.source.read_bytes(), **how)
            if a.command == "apply":
                apply_ops(doc, load_plan(a.plan.read_text()), strict=not a.lenient)
            else:
                (doc.accept if a.command == "accept" else doc.reject)(ids=_csv(a.id), authors=_csv(a.by), kinds=_csv(a.kind))
        a.output.write_bytes(ooxml.write(doc))
        return 0
    except (EditError, OSError, RuntimeError, ValueError) as why:
        print(f"error: {why}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
