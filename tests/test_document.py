from copy import deepcopy
from itertools import permutations

import pytest

from palimpsest.operators.compare import compare_into
from palimpsest.operators.document import ClauseError, EditError, StalePlan, from_texts
from palimpsest.operators.planner import apply_actions, apply_ops, check_actions, check_ops
from palimpsest.sources import ooxml

STAMP = "2026-01-01T00:00:00Z"
AGREEMENT = [
    "1. Meanings", '1.1  "Hives" are the ones on the north field.', '1.2  "Season Form" is the sheet signed each spring.',
    "2. Rent and Honey", "2.1  Rent. The keeper owes the rent on the Season Form.", "2.2  Delivery. Jars are brought within twenty (20) weeks.", "2.3  Levies. The rent leaves out local levies.",
    "3. Length and End", "3.1  Length. This lease lasts one season at a time.", "3.2  Another season. It goes on by itself.",
    "4. Other Things", "4.1  Courts. Courts of Utrecht decide, as said in Section 2.2.", "4.2  Letters. Letters are to be on paper.", "4.3  Passing on. Nobody passes this lease on alone.",
    "Annex A. A keeper goes on per Section 3.2 and Sections 2.2 and 2.3.",
]


def both_ways(change, texts=AGREEMENT, through_package=True):
    """Accepting gives the new text, rejecting the old, both without a change left."""
    doc = from_texts(texts, date=STAMP)
    out = change(doc)
    again = ooxml.read(ooxml.write(doc)) if through_package else doc
    accepted, rejected = deepcopy(again), deepcopy(again)
    accepted.accept()
    rejected.reject()
    flat = from_texts(texts).texts()
    assert rejected.texts() == flat
    assert not accepted.revisions() and not rejected.revisions()
    return doc, accepted, out


@pytest.mark.parametrize("change,has", [
    (lambda d: d.replace_text("twenty (20)", "forty (40)"), "within forty (40) weeks"),
    (lambda d: d.insert_relative("Rent. ", "All ", before=False), "Rent. All The keeper"),
    (lambda d: d.delete_matching(" by itself"), "It goes on."),
    (lambda d: d.append_text(d.paragraphs()[0], " and Terms"), "1. Meanings and Terms"),
    (lambda d: d.set_text(d.paragraphs()[12], "4.2  Letters. Letters may be sent by post."), "may be sent by post"),
    (lambda d: d.insert_paragraph(d.paragraphs()[6], "2.4  New."), "2.4  New."),
    (lambda d: d.replace_text(r"(\w+) Form", r"Form of \1", regex=True, count=None), "Form of Season"),
    (lambda d: d.replace_text("Letters", "Notes", count=2, insertion_first=True), "Notes. Notes are"),
])
def test_edits_resolve_both_ways(change, has):
    assert has in both_ways(change)[1].text()


def test_paragraph_marks():
    _, accepted, _ = both_ways(lambda d: d.delete_paragraphs(d.paragraphs()[1:3]))
    assert accepted.texts() == AGREEMENT[:1] + AGREEMENT[3:]
    _, accepted, _ = both_ways(lambda d: d.append_paragraph("Last."))
    assert accepted.texts()[-1] == "Last."


def test_moves_are_pairs_and_edited_ones_are_not():
    doc, accepted, out = both_ways(lambda d: d.move_paragraph(d.paragraphs()[11], after=d.paragraphs()[8]))
    assert out[1] and accepted.texts()[9] == AGREEMENT[11]
    assert sorted(r.kind for r in doc.revisions()) == ["move-from"] * 2 + ["move-to"] * 2
    picked = deepcopy(doc)
    picked.accept(ids=[doc.revisions()[0].id])  # either half takes the other along
    assert not picked.revisions()

    def edited(d):
        d.replace_text("Utrecht", "Delft")
        return d.move_paragraph(d.paragraphs()[11], after=d.paragraphs()[8])

    doc, accepted, out = both_ways(edited)
    assert not out[1] and "Courts of Delft" in accepted.texts()[9]


def test_selective_review_in_any_order():
    doc = from_texts(AGREEMENT, date=STAMP)
    doc.replace_text("twenty (20)", "forty (40)")
    doc.author = "Other"
    doc.insert_paragraph(doc.paragraphs()[3], "An insertion.")
    ids = [r.id for r in doc.revisions()]
    assert len(ids) == 4
    whole = deepcopy(doc)
    whole.accept()
    for order in permutations(ids):
        one = deepcopy(doc)
        for i in order:
            one.accept(ids=i)
        assert one.texts() == whole.texts()
    mine = deepcopy(doc)
    mine.reject(authors="Other")
    assert {r.author for r in mine.revisions()} == {"Editor"} and len(mine.paragraphs()) == len(AGREEMENT)
    kinds = deepcopy(doc)
    kinds.accept(kinds="insert-any", where=lambda r: r.author == "Editor")
    assert sorted(r.kind for r in kinds.revisions()) == ["delete", "insert", "paragraph-mark-insert"]


def test_formats_tables_and_comments():
    texts = ["Before.", [["Tier", "Users"], ["Standard", "50"]], "After."]

    def change(d):
        table = d.tables()[0]
        d.insert_row(table, 1, ["Premium"])
        d.set_cell(table.rows[2].cells[1], "60")
        d.delete_table_row(table, 0)
        d.format_matching("Before", bold=True, color="C00000")
        d.format_paragraph(d.paragraphs()[-1], alignment="CENTER", space_after=6)
        d.comment(d.paragraphs()[0], "Why?", author="Ann Lee")

    doc, accepted, _ = both_ways(change, texts)
    assert accepted.tables()[0].text == "Premium | \nStandard | 60"
    assert any(x.fmt.get("bold") for x in accepted.paragraphs()[0].pieces)
    again = ooxml.read(ooxml.write(doc))
    assert again.comments[0]["text"] == "Why?" and again.comments[0]["initials"] == "AL"
    assert [r.kind for r in again.revisions()] == [r.kind for r in doc.revisions()]
    with pytest.raises(EditError):
        doc.format_paragraph(doc.paragraphs()[0], colour="red")
    with pytest.raises(EditError):
        doc.delete_table_row(doc.tables()[0], 9)


def test_quoted_edits():
    doc = from_texts(AGREEMENT, date=STAMP)
    stamp = doc.fingerprint()
    items = [
        {"para_id": 5, "target": "twenty (20) weeks", "replacement": "fifty (50) weeks"}, {"para_id": 5, "target": "(20)", "replacement": "x"},
        {"para_id": 99, "target": "a", "replacement": "b"}, {"para_id": 4, "target": " ", "replacement": "b"}, {"para_id": 4, "target": "e", "replacement": "b"},
        {"para_id": 6, "target": "levies", "body": "Which?"}, {"para_id": 9, "target": "nothing", "body": "Hm."},
    ]
    out = doc.apply_edits(items, stamp)
    assert [r["rejection"] for r in out] == [None, "span_conflict", "paragraph_not_found", "empty_target", "target_ambiguous", None, "target_not_found"]
    assert "fifty (50) weeks" in doc.text() and len(doc.comments) == 2
    with pytest.raises(StalePlan):
        doc.apply_edits([], stamp)


def plan(*items):
    listed = [{"id": f"A{i}", "rationale": "r", "severity": "low", **x} for i, x in enumerate(items)]
    return both_ways(lambda d: apply_actions(d, listed))[1:]


def test_golden_renumberings():
    accepted, p = plan({"type": "move_clause", "clause": "4.1", "after_clause": "3.1"})
    assert p.mapping == {"4.1": "3.2", "3.2": "3.3", "4.2": "4.1", "4.3": "4.2"} and p.references == [{"part": "body", "old": "3.2", "new": "3.3"}]
    accepted, p = plan({"type": "insert_clause", "after_clause": "2.1", "title": "Late", "text": "Fees apply."})
    assert p.mapping == {"2.2": "2.3", "2.3": "2.4"} and accepted.texts()[5] == "2.2  Late. Fees apply."
    accepted, p = plan({"type": "delete_clause", "clause": "2.2"})
    assert p.mapping == {"2.3": "2.2"} and [d["number"] for d in p.dangling] == ["2.2", "2.2"]


def test_every_reordering_is_what_was_asked_with_fewest_moves():
    for order in permutations(["4.1", "4.2", "4.3"]):
        accepted, p = plan({"type": "reorder_clauses", "section": "4", "order": list(order)})
        assert [t.split("  ")[1][:6] for t in accepted.texts()[11:14]] == [AGREEMENT[10 + int(x[-1])].split("  ")[1][:6] for x in order]
        assert p.results[0]["edits"] <= 2


def test_plans_fail_where_they_must():
    assert check_actions([{"id": "x", "type": "renumber_clause", "rationale": "r", "severity": "low"}])
    assert check_actions([{"id": "x", "type": "replace_text", "find": "a", "replace": "", "rationale": "r", "severity": "low"}]) == ["x: missing replace"]
    assert check_actions([{"id": "x", "type": "move_clause", "clause": "1", "rationale": "r", "severity": "low"}]) == ["x: missing placement"]
    _, p = plan({"type": "replace_text", "find": "the", "replace": "a"}, {"type": "delete_clause", "clause": "9.9"}, {"type": "comment", "clause": "4.1", "text": "c"})
    assert [r["status"] for r in p.results] == ["failed", "failed", "applied"]
    doc = from_texts(AGREEMENT)
    with pytest.raises(ClauseError):
        apply_actions(doc, [{"id": "x", "type": "delete_clause", "clause": "9.9", "rationale": "r", "severity": "low"}], strict=True)


def test_ops():
    assert check_ops([{"op": "insert_text", "match": "a"}, {"op": "bogus"}])

    def run(d):
        return apply_ops(d, [{"op": "replace_text", "old": "twenty", "new": "forty"}, {"op": "insert_paragraph", "match": "Annex", "text": "Annex 0.", "where": "before"}, {"op": "delete_paragraph", "match": "4.2"}, {"op": "move_paragraph", "match": "1.2", "after": "1. Mean"}, {"op": "format_text", "match": "Utrecht", "props": {"bold": True}}, {"op": "comment", "match": "Levies", "text": "c"}])

    _, accepted, _ = both_ways(run)
    assert accepted.texts()[1].startswith("1.2") and "Annex 0." in accepted.texts()
    with pytest.raises(EditError):
        apply_ops(from_texts(AGREEMENT), [{"op": "delete_text", "match": "nowhere"}])


def test_compare():
    revised = [t.replace("twenty (20)", "forty (40)") for t in AGREEMENT] + ["Annex B. New."]
    del revised[6]
    _, accepted, stats = both_ways(lambda d: compare_into(d, from_texts(revised)))
    assert accepted.texts() == revised and (stats.paragraphs_changed, stats.paragraphs_deleted, stats.paragraphs_inserted) == (1, 1, 1)
    texts, other = ["x", [["a", "b"], ["c", "d"]]], ["x", [["a", "b"], ["c", "e"]]]
    _, accepted, stats = both_ways(lambda d: compare_into(d, from_texts(other)), texts)
    assert stats.cells_changed == 1 and accepted.tables()[0].text == "a | b\nc | e"


def test_headers_and_notes_are_stories():
    doc = ooxml.read(ooxml.write(from_texts(AGREEMENT)))
    parts, places = doc.package
    parts["word/header1.xml"] = f'<w:hdr xmlns:w="{ooxml.W}"><w:p><w:r><w:t>Draft of Section 2.2</w:t></w:r></w:p></w:hdr>'.encode()
    parts["word/footnotes.xml"] = f'<w:footnotes xmlns:w="{ooxml.W}"><w:footnote w:id="2"><w:p><w:r><w:t>A note.</w:t></w:r></w:p></w:footnote></w:footnotes>'.encode()
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, d in parts.items():
            z.writestr(n, d)
    doc = ooxml.read(out.getvalue())
    assert doc.replace_text("Draft", "Final") == 1 and doc.replace_text("A note", "The note") == 1
    again = ooxml.read(ooxml.write(doc))
    again.accept()
    assert [p.text for part, p, _, _ in again.walk() if part != "body"] == ["Final of Section 2.2", "The note."]
    narrow = ooxml.read(out.getvalue(), scope=("body",))
    assert narrow.replace_text("Draft", "Final") == 0


def test_styles_by_any_name():
    doc = from_texts(AGREEMENT, date=STAMP)
    doc.styles = {"Heading1": "heading 1", "BodyText": "Body Text"}
    doc.apply_style(doc.paragraphs()[0], "Heading-1")
    assert doc.paragraphs()[0].props["style"] == "Heading1" and doc.style_names() == ["Body Text", "heading 1"]
    doc.reject()
    assert "style" not in doc.paragraphs()[0].props
    with pytest.raises(EditError):
        doc.apply_style(doc.paragraphs()[0], "Fancy")


# -- packages keep what wasn't edited -----------------------------------------------------

W14 = "http://schemas.microsoft.com/office/word/2010/wordml"
RUN_PROPS = (
    '<w:rStyle w:val="Emph"/><w:rFonts w:ascii="Arial" w:hAnsi="Arial" w:eastAsia="SimSun" w:cs="Times"/><w:b/><w:bCs/><w:i/><w:iCs/><w:caps/><w:strike/><w:outline/><w:noProof/><w:color w:val="112233" w:themeColor="accent1"/>'
    '<w:spacing w:val="8"/><w:w w:val="90"/><w:kern w:val="2"/><w:position w:val="3"/><w:sz w:val="21"/><w:szCs w:val="23"/><w:highlight w:val="yellow"/><w:u w:val="double" w:color="FF0000"/><w:shd w:val="clear" w:fill="EEEEEE"/><w:vertAlign w:val="superscript"/><w:lang w:val="nl-NL"/>'
)
PARAGRAPH_PROPS = (
    '<w:pStyle w:val="Body"/><w:keepNext/><w:keepLines/><w:widowControl w:val="0"/><w:numPr><w:ilvl w:val="1"/><w:numId w:val="4"/></w:numPr><w:pBdr><w:top w:val="single" w:sz="4"/></w:pBdr><w:shd w:val="clear" w:fill="DDDDDD"/><w:tabs><w:tab w:val="left" w:pos="720"/></w:tabs>'
    '<w:spacing w:before="120" w:after="60" w:line="300" w:lineRule="exact"/><w:ind w:left="720" w:hanging="360"/><w:contextualSpacing/><w:jc w:val="both"/><w:outlineLvl w:val="2"/><w:rPr><w:b/><w:color w:val="00AA00"/></w:rPr>'
)


def rich_package(body):
    import io
    import zipfile

    doc = ooxml.read(ooxml.write(from_texts(["x"])))
    parts = dict(doc.package[0])
    spaces = f'xmlns:w="{ooxml.W}" xmlns:w14="{W14}" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:odd="urn:odd" mc:Ignorable="w14 odd" xmlns:r="{ooxml.OFFICE_REL}"'
    parts["word/document.xml"] = f'<?xml version="1.0" encoding="UTF-8"?><w:document {spaces}><w:body>{body}<w:sectPr><w:pgSz w:w="11906" w:h="16838"/></w:sectPr></w:body></w:document>'.encode()
    parts["word/comments.xml"] = f'<w:comments xmlns:w="{ooxml.W}"><w:comment w:id="3" w:author="Bo" w:initials="B"><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>Why here?</w:t></w:r></w:p></w:comment></w:comments>'.encode()
    parts["word/styles.xml"] = f'<w:styles xmlns:w="{ooxml.W}"><w:style w:type="paragraph" w:default="1" w:styleId="Std"><w:name w:val="Normal"/></w:style><w:style w:type="paragraph" w:styleId="Body"><w:name w:val="Body Text"/></w:style><w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'.encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, d in parts.items():
            z.writestr(n, d)
    return out.getvalue()


RICH = (
    f'<w:p w14:paraId="1A2B"><w:pPr>{PARAGRAPH_PROPS}</w:pPr><w:bookmarkStart w:id="7" w:name="here"/><w:r><w:rPr>{RUN_PROPS}</w:rPr><w:t xml:space="preserve">Rich text of a run. </w:t></w:r><w:bookmarkEnd w:id="7"/><w:hyperlink r:id="rId9"><w:r><w:t>a link</w:t></w:r></w:hyperlink><w:r><w:footnoteReference w:id="2"/></w:r></w:p>'
    '<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t xml:space="preserve">The </w:t></w:r><w:commentRangeStart w:id="3"/><w:r><w:t>word</w:t></w:r><w:commentRangeEnd w:id="3"/><w:r><w:rPr><w:rStyle w:val="CommentReference"/></w:rPr><w:commentReference w:id="3"/></w:r><w:r><w:t xml:space="preserve"> that matters.</w:t></w:r></w:p>'
    '<w:sdt><w:sdtPr><w:tag w:val="box"/></w:sdtPr><w:sdtContent><w:p><w:r><w:t>In a control.</w:t></w:r></w:p></w:sdtContent></w:sdt>'
    '<w:tbl><w:tblPr><w:tblStyle w:val="Grid"/></w:tblPr><w:tblGrid><w:gridCol w:w="100"/></w:tblGrid><w:tr><w:trPr><w:cantSplit/></w:trPr><w:tc><w:tcPr><w:tcW w:w="100" w:type="dxa"/></w:tcPr><w:p><w:r><w:t>Cell.</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    '<w:p><w:pPr><w:sectPr><w:type w:val="nextPage"/></w:sectPr></w:pPr><w:r><w:t>Last of a section.</w:t></w:r></w:p>'
)


def body_of(content):
    import io
    import zipfile
    from xml.etree import ElementTree as ET

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return ET.fromstring(z.read("word/document.xml")).find(ooxml.q("body")), z.read("word/document.xml")


def xml(el):
    from xml.etree import ElementTree as ET

    return ET.canonicalize(ET.tostring(el, "unicode"))


def test_a_package_without_an_edit_keeps_its_bytes():
    content = rich_package(RICH)
    assert body_of(ooxml.write(ooxml.read(content)))[1] == body_of(content)[1]


def test_an_edit_changes_its_paragraph_alone_and_of_it_what_it_says():
    content = rich_package(RICH)
    doc = ooxml.read(content, date=STAMP)
    assert doc.replace_text("text", "words") == 1
    doc.format_paragraph(doc.paragraphs()[0], alignment="LEFT", space_after=9, left_indent=10)
    doc.insert_paragraph(doc.paragraphs()[-1], "After the section.")
    doc.insert_row(doc.tables()[0], 1, ["New cell."])
    out = ooxml.write(doc)
    (old, _), (new, raw) = body_of(content), body_of(out)
    for i in (1, 2):
        assert xml(new[i]) == xml(old[i])
    assert b'mc:Ignorable="w14 odd"' in raw and b'xmlns:odd="urn:odd"' in raw and new[0].get(f"{{{W14}}}paraId") == "1A2B"
    ppr, runs = new[0].find(ooxml.q("pPr")), list(new[0].iter(ooxml.q("r")))
    names = [ooxml.local(x) for x in ppr]
    assert names == sorted(names, key=ooxml.PARAGRAPH_ORDER.index) and "pPrChange" in names
    spacing, indent = ppr.find(ooxml.q("spacing")), ppr.find(ooxml.q("ind"))
    assert spacing.get(ooxml.q("line")) == "300" and spacing.get(ooxml.q("lineRule")) == "exact" and spacing.get(ooxml.q("after")) == "180" and indent.get(ooxml.q("left")) == "200" and indent.get(ooxml.q("hanging")) == "360"
    assert xml(ppr.find(f"{ooxml.q('pPrChange')}/{ooxml.q('pPr')}")) == xml(ooxml._without(old[0].find(ooxml.q("pPr")), ("rPr",)))
    want = xml(old[0].find(f"{ooxml.q('r')}/{ooxml.q('rPr')}"))
    assert [xml(r.find(ooxml.q("rPr"))) for r in runs[:4]] == [want] * 4  # before, struck, put in, behind
    assert [ooxml.local(x) for x in new[0] if ooxml.local(x) in ("bookmarkStart", "bookmarkEnd", "hyperlink")] == ["bookmarkStart", "bookmarkEnd", "hyperlink"]
    assert new[0].find(ooxml.q("hyperlink")).get(f"{{{ooxml.OFFICE_REL}}}id") == "rId9"
    rows = new[3].findall(ooxml.q("tr"))
    assert xml(rows[0]) == xml(old[3].find(ooxml.q("tr"))) and [ooxml.local(x) for x in rows[1].find(ooxml.q("trPr"))] == ["cantSplit", "ins"] and rows[1].find(f"{ooxml.q('tc')}/{ooxml.q('tcPr')}") is not None
    assert len(list(new.iter(ooxml.q("sectPr")))) == 2  # a copied paragraph doesn't end a section
    again = ooxml.read(out)
    again.reject()
    assert again.texts() == ooxml.read(content).texts()
    assert xml(body_of(ooxml.write(again))[0][0].find(ooxml.q("pPr"))) == xml(old[0].find(ooxml.q("pPr")))


def test_every_run_property_is_written_in_order():
    doc = ooxml.read(rich_package(f"<w:p><w:r><w:rPr>{RUN_PROPS}</w:rPr><w:t>All of it</w:t></w:r></w:p>"), date=STAMP)
    doc.format_text(doc.paragraphs()[0], bold=False, underline=False, size=15, font="Courier", color="FF00FF", highlight=None)
    rpr = next(body_of(ooxml.write(doc))[0].iter(ooxml.q("rPr")))
    names = [ooxml.local(x) for x in rpr]
    assert names == sorted(names, key=ooxml.RUN_ORDER.index) and "highlight" not in names and names[-1] == "rPrChange"
    fonts = rpr.find(ooxml.q("rFonts"))
    assert fonts.get(ooxml.q("ascii")) == "Courier" and fonts.get(ooxml.q("eastAsia")) == "SimSun" and rpr.find(ooxml.q("u")).get(ooxml.q("val")) == "none" and rpr.find(ooxml.q("b")).get(ooxml.q("val")) == "0"


def test_comments_keep_their_anchors_spans_and_ids():
    content = rich_package(RICH)
    doc = ooxml.read(content, date=STAMP)
    (was,) = doc.comments
    assert (was["id"], was["start"], was["end"]) == (3, 4, 8) and was["paragraph"] is doc.paragraphs()[1]
    assert doc.comment(doc.paragraphs()[1], "And this?", 4, 8)["id"] == 4 and doc.comment(doc.paragraphs()[2], "All of it")["id"] == 5
    doc.insert_text(doc.paragraphs()[1], 0, "Here: ")
    out = ooxml.write(doc)
    again = ooxml.read(out)
    assert [(c["id"], c["start"], c["end"], c["text"]) for c in again.comments] == [(3, 10, 14, "Why here?"), (4, 10, 14, "And this?"), (5, 0, 13, "All of it")]
    import io
    import zipfile

    with zipfile.ZipFile(io.BytesIO(out)) as z:
        assert b"<w:b" in z.read("word/comments.xml")  # a comment that was there keeps its form


def test_styles_are_found_by_name():
    doc = ooxml.read(rich_package(RICH))
    assert [p.text[:4] for p in doc.find_paragraphs(style="Heading 1")] == ["The "] and [p.text[:4] for p in doc.find_paragraphs(style="Body Text")] == ["Rich"]
    assert len(doc.find_paragraphs(style="Normal")) == 3 and not doc.find_paragraphs(style="H1")
