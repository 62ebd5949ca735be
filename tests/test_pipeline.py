import json

import pytest
from pyspark.sql import functions as F

from palimpsest import cli
from palimpsest.operators.document import EditError, from_texts
from palimpsest.plans import merge, review
from palimpsest.plans.pipeline import REVISED, revise, revise_all
from palimpsest.session import ship
from palimpsest.sources import ooxml, packages
from palimpsest.streaming import revision_log

from .test_document import AGREEMENT, STAMP


def item(id_, type_, severity="medium", **more):
    return {"id": id_, "type": type_, "severity": severity, "rationale": "r", **more}


def test_merge_accounts_for_everything():
    doc = from_texts(AGREEMENT)
    results = [
        {"index": 0, "labels": ["2", "2.1", "2.2", "2.3"], "strategy": "clauses", "items": [item("a", "replace_text", clause="2.2", find="twenty (20) weeks", replace="x"), item("b", "replace_text", "high", clause="2.2", find="twenty", replace="y"), item("c", "delete_clause", "critical", clause="2.3"), item("d", "rewrite_clause", clause="2.3", text="n"), item("e", "comment", text="t", clause="4.1"), item("f", "replace_text", clause="2.1", find="nothing", replace="z")]},
        {"index": 1, "labels": ["4", "4.1"], "strategy": "clauses", "items": [item("g", "comment", text="t", clause="4.1"), item("h", "comment", "low", text="t", clause="4.1"), item("i", "bogus")]},
    ]
    r = merge.reduce_segments(doc, results)
    c = r.counts()
    assert c == {"proposed": 9, "kept": 3, "dropped": 3, "conflict": 2, "unresolved": 1}
    assert [x["note"] for x in r.kept] == ["b", "c", "g"] and [x["id"] for x in r.kept] == ["AI-0001", "AI-0002", "AI-0003"]
    assert merge.reduce_segments(doc, results, 1).counts()["kept"] == 1


class Engine:
    model = "scripted"

    def __init__(self, script):
        self.script, self.calls = list(script), 0

    def emit(self, prompt, max_tokens):
        self.calls += 1
        step = self.script.pop(0) if self.script else []
        if isinstance(step, Exception):
            raise step
        return step


def big_tree():
    return from_texts([t for k in range(1, 9) for t in [f"{k}. Section {k}", *(f"{k}.{j}  Clause. Liability and indemnity text." for j in range(1, 6))]])


def test_segments_and_triage():
    doc = big_tree()
    segments = review.segment(doc, 100)
    assert sum(len(s.blocks) for s in segments) == len(doc.body) and segments[0].strategy == "clauses"
    assert review.segment(from_texts([f"Plain prose number {i}." for i in range(20)]), 10)[0].strategy == "windows"
    skip = {s.seg_id: "skip" for s in segments}
    assert "skip" not in review.triage(segments, skip).values()  # two risk families are never skipped
    assert set(review.triage(segments, None).values()) == {"deep"}
    assert len(review.build_index(segments, max_tokens=40)) < len(review.build_index(segments))


def test_chunked_review_retries_splits_and_caches():
    doc = big_tree()
    engine = Engine([[item("a", "comment", clause="1.1", text="t")], review.Truncated("cut"), review.Truncated("cut"), [], [], RuntimeError("busy")])
    reviewer = review.Reviewer(engine, segment_tokens=100, backoff=0, concurrency=1)
    report, done = reviewer.propose(doc, "brief")
    assert report.counts()["kept"] == 1 and {r["status"] for r in done} == {"ok"}
    calls = engine.calls
    _, done = reviewer.propose(doc, "brief")
    assert {r["status"] for r in done} <= {"cached", "ok"} and engine.calls - calls <= 3  # only what was split is asked again
    with pytest.raises(RuntimeError):
        review.Reviewer(Engine([RuntimeError("down")] * 99), segment_tokens=100, backoff=0).propose(doc, "b")


def test_revise_verifies_itself():
    content = ooxml.write(from_texts(AGREEMENT))
    actions = [item("a", "move_clause", clause="4.1", after_clause="3.1"), item("b", "replace_text", find="twenty (20)", replace="forty (40)")]
    r = revise(content, actions=actions, comments=[{"text": "hm", "clause": "2.1"}], date=STAMP)
    assert r.ok and len(r.checks) == 7, r.format()
    assert revise(content, reviewer=review.get_reviewer("rules")).ok
    assert revise(content, revised=ooxml.write(from_texts(AGREEMENT[:-1]))).ok
    with pytest.raises(EditError):
        revise(content)
    with pytest.raises(EditError):
        revise(content, actions=[item("a", "bogus")])


def test_packages_in_spark(spark, tmp_path):
    ship(spark)
    for i in range(3):
        (tmp_path / f"{i}.docx").write_bytes(ooxml.write(from_texts([*AGREEMENT, f"Copy {i}."])))
    files = packages.packages(spark, f"file://{tmp_path}")
    paras = packages.paragraphs(files)
    assert paras.count() == 3 * 16 and paras.filter("text LIKE 'Copy%'").count() == 3
    plans = files.select("doc_id", F.lit(json.dumps([item("a", "delete_clause", clause="2.2")])).alias("plan"))
    out = revise_all(files, plans, date=STAMP)
    rows = out.collect()
    assert len(rows) == 3 and all(r["ok"] for r in rows) and out.columns == [c.split()[0] for c in REVISED.split(", ")]
    changed = spark.createDataFrame([(r["doc_id"], bytes(r["content"])) for r in rows], "doc_id long, content binary")
    assert packages.revisions(changed).count() > 0
    assert packages.revisions(packages.resolve(changed, False)).count() == 0
    packages.save(changed, f"file://{tmp_path}/out")
    assert len(list((tmp_path / "out").glob("*.docx"))) == 3


def test_cli(tmp_path, capsys):
    a, b, out = tmp_path / "a.docx", tmp_path / "b.docx", tmp_path / "out.docx"
    a.write_bytes(ooxml.write(from_texts(AGREEMENT)))
    b.write_bytes(ooxml.write(from_texts([t.replace("twenty", "forty") for t in AGREEMENT])))
    assert cli.main(["compare", str(a), str(b), str(out)]) == 0
    assert cli.main(["summary", str(out)]) == 0 and "tracked changes" in capsys.readouterr().out
    assert cli.main(["reject", str(out), str(out)]) == 0 and ooxml.read(out.read_bytes()).texts() == AGREEMENT
    plan = tmp_path / "plan.json"
    plan.write_text(json.dumps([{"op": "delete_text", "match": "nowhere"}]))
    assert cli.main(["apply", str(a), str(plan), str(out)]) == 2
    plan.write_text(json.dumps({"action_items": [item("a", "delete_clause", clause="2.2")]}))
    assert cli.main(["validate", str(plan)]) == 0 and cli.main(["pipeline", str(a), str(out), "--actions", str(plan)]) == 0


class Deciding(Engine):
    def decide(self, prompt, schema, max_tokens):
        assert "S00" in prompt and schema["required"] == ["selections", "notes"]
        if self.calls < 0:
            raise RuntimeError("away")
        return {"notes": "Mostly alike.", "selections": [{"segment": "S00", "priority": "deep"}, {"segment": "S01", "priority": "skip"}, {"segment": "S02", "priority": "maybe"}]}

    def emit(self, prompt, max_tokens, on_event=None):
        for _ in range(3):
            on_event()
        return super().emit(prompt, max_tokens)


def test_an_engine_chooses_and_shows_that_it_lives():
    doc = from_texts([t for k in range(1, 7) for t in [f"{k}. Section {k}", *(f"{k}.{j}  Plain words of a clause." for j in range(1, 6))]])
    alive = []
    reviewer = review.Reviewer(Deciding([[item("a", "comment", "high", clause="1.1", text="t")]]), segment_tokens=60, on_alive=lambda *x: alive.append(x), min_coverage=0.0)
    report, done = reviewer.propose(doc, "brief")
    assert [r["status"] for r in done][1] == "skipped" and done[2]["status"] == "ok"
    assert reviewer.summary(report, done) == f"{len(done) - 1} of {len(done)} segments read, 1 items kept (1 high). Mostly alike."
    assert len(alive) == len(done) - 1 and all(n == 1 for *_, n in alive) and (reviewer.engine_name, reviewer.model) == ("deciding", "scripted")
    lost = review.Reviewer(Deciding([]), segment_tokens=60, on_alive=lambda *x: None)
    lost.engine.calls = -99
    _, done = lost.propose(doc, "brief")
    assert {r["status"] for r in done} == {"ok"} and "away" in lost.notes


def test_heartbeats_are_rare():
    told = []
    beat = review.Heartbeat(lambda *x: told.append(x), "S01", every=1000)
    for _ in range(50):
        beat("event")
    assert len(told) == 1 and told[0][0] == "S01" and beat.events == 50


def scripted(model=None):
    return Engine([[item("a", "comment", clause="1.1", text="t")]])


def test_flags_of_the_command_line(tmp_path, capsys):
    a, out, plan, notes, merged = (tmp_path / x for x in ("a.docx", "out.docx", "plan.json", "notes.json", "merge.json"))
    a.write_bytes(ooxml.write(from_texts(AGREEMENT)))
    plan.write_text(json.dumps([item("p", "delete_clause", clause="1.1")]))
    notes.write_text(json.dumps({"comments": [{"clause": "3.1", "text": "From a file."}]}))
    assert cli.main(["full", str(a), str(out), "--actions", str(plan), "--action", '{"type": "replace_text", "find": "Utrecht", "replace": "Delft"}', "--comment", "4.2=On paper?", "--comment", "find=keeper owes=Who?", "--comments-file", str(notes), "--no-explain"]) == 0
    doc = ooxml.read(out.read_bytes())
    assert sorted(c["text"] for c in doc.comments) == ["From a file.", "On paper?", "Who?"]
    doc.accept()
    assert "Courts of Delft" in doc.text() and "Hives" not in doc.text()
    assert cli.main(["full", str(a), str(out), "--comment", "no text"]) == 2 and cli.main(["full", str(a), str(out), "--action", "[1]"]) == 2 and cli.main(["full", str(a), str(out), "--action", "{"]) == 2
    assert cli.main(["full", str(a), str(out), "--reviewer", "chunked"]) == 2
    review.register_engine("scripted", scripted, "tiny")
    assert review.default_model("scripted") == "tiny" and review.default_model("rules") is None
    for engine in ("scripted", "tests.test_pipeline:scripted"):
        assert cli.main(["full", str(a), str(out), "--reviewer", "chunked", "--engine", engine, "--segment-tokens", "60", "--cache-dir", str(tmp_path / "c"), "--refresh", "--max-actions", "3", "--brief", "b", "--merge-report", str(merged)]) == 0
    assert "segments read" in capsys.readouterr().out and json.loads(merged.read_text()) == []
    assert cli.main(["full", str(a), str(out), "--reviewer", "long", "--engine", "nobody"]) == 2
    assert cli.main(["full", str(a), str(out), "--reviewer", "whole", "--engine", "scripted"]) == 0
    assert cli.main(["doctor", "--engine", "scripted", "--model", "m"]) == 0 and "1 items in" in capsys.readouterr().out


PLAN = {"summary": "s", "action_items": [{**item("a", "comment", clause="1.1", text="t"), "find": None}]}


@pytest.mark.parametrize("kind", ["tool", "text"])
def test_engines_ask_and_read_in_both_dialects(kind):
    from palimpsest.plans import engines

    asked = []

    def good(payload):
        if kind == "tool":
            return {"content": [{"type": "text", "text": "so"}, {"type": "tool_use", "input": payload}], "stop_reason": "tool_use", "usage": {"input_tokens": 7, "output_tokens": 2}}
        return {"status": "completed", "output": [{"content": [{"type": "output_text", "text": json.dumps(payload)}]}], "usage": {"input_tokens": 7, "input_tokens_details": {"cached_tokens": 3}}}

    def send(request):
        asked.append(request)
        found = replies.pop(0)
        if isinstance(found, Exception):
            raise found
        return found

    make = engines.ToolEngine if kind == "tool" else engines.TextEngine
    engine, replies = make(send, "m"), [good(PLAN), good({"notes": "n", "selections": []}), good(PLAN)]
    assert engine.emit("p", 99) == [item("a", "comment", clause="1.1", text="t")]
    assert engine.decide("p", {"type": "object"}, 9) == {"notes": "n", "selections": []}
    assert engine.usage["input"] == 14 and asked[0]["model"] == "m" and "emit_plan" in json.dumps(asked[0])
    doc = from_texts(AGREEMENT)
    assert engines.WholeReviewer(engine).propose(doc, "brief")[0]["clause"] == "1.1" and "Hives" in json.dumps(asked[-1])
    cut = {"content": [], "stop_reason": "max_tokens"} if kind == "tool" else {"status": "incomplete", "incomplete_details": {"reason": "max_output_tokens"}}
    refused = {"content": [], "stop_reason": "refusal"} if kind == "tool" else {"output": [{"content": [{"type": "refusal", "refusal": "no"}]}]}
    odd = {"content": []} if kind == "tool" else {"output": [{"content": [{"type": "output_text", "text": "{"}]}]}
    for reply, error in ((cut, review.Truncated), (refused, RuntimeError), (odd, RuntimeError), ({}, RuntimeError), (good({}), RuntimeError), (ConnectionResetError("x"), review.Interrupted), (OSError("HTTP 500"), RuntimeError), (OSError("HTTP 401"), engines.Credentials), (PermissionError("who"), engines.Credentials)):
        replies[:] = [reply]
        with pytest.raises(error):
            engine.emit("p", 9)
    replies[:] = [PermissionError("who")]
    with pytest.raises(engines.Credentials):  # it isn't tried again, nor taken for a segment's failure
        review.Reviewer(engine, backoff=0).propose(doc, "b")
    replies[:] = [good(PLAN)]
    assert "1 items in" in engines.doctor(engine) and not replies


def test_repeated_numbers_are_told():
    from palimpsest.operators.planner import apply_actions

    p = apply_actions(from_texts([*AGREEMENT, "4.3  Twice. Another one."]), [item("a", "delete_clause", clause="2.2")])
    assert any("4.3" in w for w in p.warnings)


def test_streams(spark, tmp_path):
    log = spark.sql("SELECT 1L AS doc_id, CAST(id % 5 AS STRING) AS rev_id, 'insert' AS kind, 'Ann' AS author, timestamp_seconds(1700000000 + id) AS ts FROM range(10)")
    log.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    q = revision_log.once(stream).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("once").count() == 5
    assert revision_log.activity(log).collect()[0]["n"] == 10
    assert revision_log.sessions(log).collect()[0]["n"] == 10


def test_html_shows_changes():
    from palimpsest.plans.render import to_html

    doc = from_texts(["A <b> text.", "", [["x", "y"]], "Gone."], date=STAMP)
    doc.replace_text("text", "word")
    doc.delete_paragraph(doc.paragraphs()[-1])
    doc.comment(doc.paragraphs()[0], 'Say "why"')
    html = to_html(doc)
    assert '<span class="del" title="Editor, 2026-01-01T00:00:00Z">text</span>' in html and "A &lt;b&gt; " in html
    assert html.count("<p") == 4 and 'class="changed mark-del"' in html and "&quot;why&quot;" in html and "<td><p>x</p></td>" in html


def test_engine_schema():
    from palimpsest.schema import action_json_schema, output_form

    schema = action_json_schema()
    assert output_form("plan", "d", schema)["input_schema"] is schema and output_form("plan", "d", schema, "text")["format"]["schema"] is schema

    inline = action_json_schema()["properties"]["action_items"]["items"]
    assert len(inline["properties"]) == 33 and inline["required"] == list(inline["properties"])
    assert inline["properties"]["clause"]["type"] == ["string", "null"] and inline["properties"]["id"]["type"] == "string"
    assert action_json_schema("anyOf")["properties"]["action_items"]["items"]["properties"]["order"]["anyOf"][1] == {"type": "null"}
