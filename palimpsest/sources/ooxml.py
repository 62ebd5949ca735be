"""Word packages to documents and back, with the standard library alone.

Writing goes through the parts that were read and changes what the document has
changed: a part without a change keeps its bytes, a paragraph without one its element.
Of a changed paragraph, the properties' elements are kept and only those that an edit
sets are written, in the schema's order; links and controls around its runs, range
ends and what isn't text stay where they are.
"""

from __future__ import annotations

import io
import zipfile
from copy import deepcopy
from functools import lru_cache
from xml.etree import ElementTree as ET

from ..operators.document import Anchor, Document, Paragraph, Piece, Rev, Row, Table, Wrap

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
REL = "http://schemas.openxmlformats.org/package/2006/relationships"
OFFICE_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
XML_SPACE = "{http://www.w3.org/XML/1998/namespace}space"
for _prefix, _uri in (("w", W), ("r", OFFICE_REL), ("wp", "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"), ("a", "http://schemas.openxmlformats.org/drawingml/2006/main"), ("mc", "http://schemas.openxmlformats.org/markup-compatibility/2006"), ("w14", "http://schemas.microsoft.com/office/word/2010/wordml")):
    ET.register_namespace(_prefix, _uri)
#: Elements around runs that are the paragraph's own, and around blocks.
WRAPPERS = ("hyperlink", "smartTag", "sdt", "sdtContent", "customXml", "bdo", "dir")
AROUND_BLOCKS = ("sdt", "sdtContent", "customXml", "ins", "moveTo")
REVISED = ("ins", "del", "moveFrom", "moveTo")
RANGES = ("commentRangeStart", "commentRangeEnd", "bookmarkStart", "bookmarkEnd", "permStart", "permEnd")
#: Order of a run's and a paragraph's properties (fixed values of the format's schema).
RUN_ORDER = (
    "ins del moveFrom moveTo rStyle rFonts b bCs i iCs caps smallCaps strike dstrike outline shadow emboss imprint noProof snapToGrid vanish webHidden color spacing w kern position "
    "sz szCs highlight u effect bdr shd fitText vertAlign rtl cs em lang eastAsianLayout specVanish oMath rPrChange"
).split()
PARAGRAPH_ORDER = (
    "pStyle keepNext keepLines pageBreakBefore framePr widowControl numPr suppressLineNumbers pBdr shd tabs suppressAutoHyphens kinsoku wordWrap overflowPunct topLinePunct autoSpaceDE autoSpaceDN "
    "bidi adjustRightInd snapToGrid spacing ind contextualSpacing mirrorIndents suppressOverlap jc textDirection textAlignment textboxTightWrap outlineLvl divId cnfStyle rPr sectPr pPrChange"
).split()
FLAGS = {"b": "bold", "i": "italic", "strike": "strike"}
#: Points a property's unit: element, attribute, twentieths.
LENGTHS = {"space_before": ("spacing", "before"), "space_after": ("spacing", "after"), "left_indent": ("ind", "left"), "right_indent": ("ind", "right")}


def q(name: str) -> str:
    return f"{{{W}}}{name}"


P_TAG, PPR_TAG, RUN_TAG, TEXT_TAG, STRUCK_TAG = map(q, ("p", "pPr", "r", "t", "delText"))
ID, AUTHOR, DATE = map(q, ("id", "author", "date"))
REVISED_TAGS = {q(kind): kind for kind in REVISED}


def local(el: ET.Element) -> str:
    return el.tag.rpartition("}")[2] if isinstance(el.tag, str) else ""


def _value(el: ET.Element, name: str = "val") -> str | None:
    return el.get(q(name))


def _on(el: ET.Element) -> bool:
    return _value(el) not in ("0", "false", "off", "none")


def _rev(el: ET.Element, kind: str, move: str | None = None) -> Rev:
    return Rev(kind, el.get(ID) or "", el.get(AUTHOR) or "", el.get(DATE) or "", move)


# -- properties ------------------------------------------------------------------------


def known_run_props(rpr: ET.Element) -> dict:
    """What the model knows of a run's properties."""
    out: dict = {}
    for el in rpr:
        name = local(el)
        if name in FLAGS:
            out[FLAGS[name]] = _on(el)
        elif name == "u":
            out["underline"] = _value(el) not in (None, "none")
        elif name in ("color", "highlight"):
            out[name] = _value(el)
        elif name == "sz":
            out["size"] = int(_value(el) or 0) / 2
        elif name == "rFonts" and _value(el, "ascii"):
            out["font"] = _value(el, "ascii")
    return out


def read_run_props(rpr: ET.Element | None) -> dict:
    """The known properties, and the element itself without its record of a change."""
    if rpr is None:
        return {}
    whole = _without(rpr, ("rPrChange", *REVISED))
    return {**known_run_props(whole), "_xml": ET.tostring(whole, "unicode")} if len(whole) else {}


def _without(el: ET.Element, names: tuple[str, ...]) -> ET.Element:
    out = ET.Element(el.tag, el.attrib)
    out.extend(x for x in el if local(x) not in names)
    return out


def known_paragraph_props(ppr: ET.Element) -> dict:
    out: dict = {}
    for el in ppr:
        name = local(el)
        if name == "pStyle":
            out["style"] = _value(el)
        elif name == "jc":
            out["alignment"] = {"both": "JUSTIFY", "start": "LEFT", "end": "RIGHT"}.get(_value(el) or "", (_value(el) or "").upper())
        elif name == "keepNext":
            out["keep_with_next"] = _on(el)
        elif name in ("spacing", "ind"):
            for key, (tag, attr) in LENGTHS.items():
                at = _value(el, attr) or _value(el, {"left": "start", "right": "end"}.get(attr, attr))
                if tag == name and at is not None and at.lstrip("-").isdigit():
                    out[key] = int(at) / 20
            if name == "spacing" and (_value(el, "line") or "").isdigit() and _value(el, "lineRule") in (None, "auto"):
                out["line_spacing"] = int(_value(el, "line")) / 240
            first, hanging = _value(el, "firstLine") or "", _value(el, "hanging") or ""
            if name == "ind" and (first + hanging).isdigit():
                out["first_line_indent"] = -int(hanging) / 20 if hanging else int(first) / 20
    return out


def read_paragraph_props(ppr: ET.Element | None) -> dict:
    """The known properties, a section's end, and the element itself without it, changes and the mark's revisions."""
    if ppr is None:
        return {}
    whole, out = _without(ppr, ("pPrChange", "sectPr", "rPr")), {}
    mark = ppr.find(q("rPr"))
    if mark is not None and len(kept := _without(mark, REVISED)):
        whole.append(kept)
    if len(whole):
        out = {**known_paragraph_props(whole), "_xml": ET.tostring(whole, "unicode")}
    section = ppr.find(q("sectPr"))
    if section is not None:
        out["_section"] = ET.tostring(section, "unicode")
    return out


def _put(parent: ET.Element, child: ET.Element, order: list[str]) -> ET.Element:
    """In the place of the same element, or where the schema wants it."""
    place = {n: i for i, n in enumerate(order)}
    mine = place.get(local(child), len(order))
    for i, x in enumerate(parent):
        if x.tag == child.tag:
            parent[i] = child
            return child
        if place.get(local(x), len(order)) > mine:
            parent.insert(i, child)
            return child
    parent.append(child)
    return child


def _drop(parent: ET.Element, name: str) -> None:
    for x in parent.findall(q(name)):
        parent.remove(x)


def _own(parent: ET.Element, name: str) -> ET.Element:
    """A copy of the parent's element of that name, or a new one."""
    found = parent.find(q(name))
    return deepcopy(found) if found is not None else _el(name)


def _el(tag: str, /, **attrs) -> ET.Element:
    out = ET.Element(q(tag))
    for k, v in attrs.items():
        if v is not None:
            out.set(q(k), str(v))
    return out


def _stamp(name: str, rev: Rev) -> ET.Element:
    return ET.Element(q(name), {k: str(v) for k, v in ((ID, rev.id), (AUTHOR, rev.author), (DATE, rev.date)) if v is not None})


def run_props(fmt: dict, old: dict | None = None, rev: Rev | None = None) -> ET.Element | None:
    """The element as it was read, with what the format says otherwise."""
    if not fmt and rev is None:
        return None
    out = ET.fromstring(fmt["_xml"]) if fmt.get("_xml") else _el("rPr")
    was = known_run_props(out)
    tags = {v: k for k, v in FLAGS.items()} | {"underline": "u", "color": "color", "highlight": "highlight", "size": "sz", "font": "rFonts"}
    for key, tag in tags.items():
        value = fmt.get(key)
        if value == was.get(key):
            continue
        if value is None or value == "":
            _drop(out, tag)
        elif key == "font":
            fonts = _own(out, tag)
            for attr in ("ascii", "hAnsi"):
                fonts.set(q(attr), value)
            _put(out, fonts, RUN_ORDER)
        elif key == "underline":
            _put(out, _el(tag, val="single" if value else "none"), RUN_ORDER)
        elif key == "size":
            _put(out, _el(tag, val=round(value * 2)), RUN_ORDER)
        elif key in ("color", "highlight"):
            _put(out, _el(tag, val=value), RUN_ORDER)
        else:
            _put(out, _el(tag) if value else _el(tag, val="0"), RUN_ORDER)
    if rev is not None:
        change = _stamp("rPrChange", rev)
        before = run_props(old or {})
        change.append(before if before is not None else _el("rPr"))
        out.append(change)
    return out if len(out) else None


def _basic_props(props: dict) -> ET.Element:
    out = ET.fromstring(props["_xml"]) if props.get("_xml") else _el("pPr")
    was = known_paragraph_props(out)
    changed = lambda k: props.get(k) != was.get(k)
    if changed("style"):
        _put(out, _el("pStyle", val=props["style"]), PARAGRAPH_ORDER) if props.get("style") else _drop(out, "pStyle")
    if changed("keep_with_next"):
        value = props.get("keep_with_next")
        _drop(out, "keepNext") if value is None else _put(out, _el("keepNext") if value else _el("keepNext", val="0"), PARAGRAPH_ORDER)
    for key, (tag, attr) in LENGTHS.items():
        if changed(key):
            _attribute(out, tag, attr, None if props.get(key) is None else round(props[key] * 20))
    if changed("line_spacing"):
        value = props.get("line_spacing")
        _attribute(out, "spacing", "line", None if value is None else round(value * 240))
        _attribute(out, "spacing", "lineRule", None if value is None else "auto")
    if changed("first_line_indent"):
        value = props.get("first_line_indent")
        _attribute(out, "ind", "firstLine", None if value is None or value < 0 else round(value * 20))
        _attribute(out, "ind", "hanging", None if value is None or value >= 0 else round(-value * 20))
    if changed("alignment"):
        value = str(props.get("alignment") or "")
        _put(out, _el("jc", val={"JUSTIFY": "both"}.get(value.upper(), value.lower())), PARAGRAPH_ORDER) if value else _drop(out, "jc")
    return out


def _attribute(parent: ET.Element, tag: str, attr: str, value) -> None:
    """Set or take an attribute of a property that has several."""
    el = _own(parent, tag)
    el.attrib.pop(q(attr), None)
    el.attrib.pop(q({"left": "start", "right": "end"}.get(attr, attr)), None)
    if value is not None:
        el.set(q(attr), str(value))
    if el.attrib:
        _put(parent, el, PARAGRAPH_ORDER)
    else:
        _drop(parent, tag)


def paragraph_props(p: Paragraph) -> ET.Element | None:
    if not (p.props or p.mark or p.prop_rev):
        return None
    out = _basic_props(p.props)
    if p.mark:
        rpr = _put(out, _own(out, "rPr"), PARAGRAPH_ORDER)
        rpr[:0] = [_stamp(r.kind, r) for r in p.mark]
    if p.props.get("_section"):
        _put(out, ET.fromstring(p.props["_section"]), PARAGRAPH_ORDER)
    if p.prop_rev:
        change = _stamp("pPrChange", p.prop_rev)
        change.append(_without(_basic_props(p.old_props or {}), ("rPr",)))
        out.append(change)
    return out if len(out) else None


# -- reading ------------------------------------------------------------------------


def _heading(ppr: ET.Element | None) -> int | None:
    """Outline level + 1, else a heading style's number, else list level + 1."""
    import re

    if ppr is None:
        return None
    outline, style, numbered = (ppr.find(q(n)) for n in ("outlineLvl", "pStyle", "numPr"))
    if outline is not None and (_value(outline) or "").isdigit():
        return int(_value(outline)) + 1
    m = re.fullmatch("heading([1-9])", (_value(style) or "").lower().replace(" ", "").replace("-", "")) if style is not None else None
    if m:
        return int(m[1])
    if numbered is not None:
        level = numbered.find(q("ilvl"))
        return int(_value(level) or 0) + 1 if level is not None else 1
    return None


def _run_text(run: ET.Element) -> str:
    out = []
    for el in run:
        name = local(el)
        if name in ("t", "delText", "instrText"):
            out.append(el.text or "")
        elif name == "tab":
            out.append("\t")
        elif name in ("br", "cr"):
            out.append("\n")
        elif name == "noBreakHyphen":
            out.append("-")
    return "".join(out)


def state_of(p: Paragraph) -> object:
    """All of a paragraph that is written; of plain text and its revisions without a detour."""
    if p.props or p.mark or p.old_props or p.prop_rev:
        return repr((p.pieces, p.props, p.mark, p.old_props, p.prop_rev))
    out: list = []
    for x in p.pieces:
        if x.fmt or x.old_fmt is not None or x.fmt_rev or x.opaque is not None or x.wraps:
            return repr((p.pieces, p.props, p.mark, p.old_props, p.prop_rev))
        out.append((x.text, [(r.kind, r.id, r.author, r.date, r.move) for r in x.revs]) if x.revs else x.text)
    return out


def _shell(el: ET.Element) -> str:
    """A wrapper without what it wraps."""
    out = ET.Element(el.tag, el.attrib)
    out.extend(x for x in el if local(x).endswith("Pr"))
    return ET.tostring(out, "unicode")


def _plain_pieces(el: ET.Element, moves: dict) -> list[Piece] | None:
    """The pieces of a paragraph of runs with one text each, by themselves or in one revision; None if it has anything else."""
    out = []
    for x in el:
        tag = x.tag
        if tag == RUN_TAG:
            if len(x) != 1 or (t := x[0]).tag != TEXT_TAG and t.tag != STRUCK_TAG:
                return None
            if t.text:
                out.append(Piece(t.text))
        elif tag in REVISED_TAGS:
            revs = (_rev(x, REVISED_TAGS[tag], moves.get("now")),)
            for run in x:
                if run.tag != RUN_TAG or len(run) != 1 or (t := run[0]).tag != TEXT_TAG and t.tag != STRUCK_TAG:
                    return None
                if t.text:
                    out.append(Piece(t.text, revs))
        elif tag != PPR_TAG:
            return None
    return out


def read_paragraph(el: ET.Element, moves: dict) -> Paragraph:
    ppr = el.find(PPR_TAG)
    p = Paragraph(source=dict(el.attrib))
    if ppr is not None:
        p.props, p.heading = read_paragraph_props(ppr), _heading(ppr)
        for kind in REVISED:
            for mark in ppr.findall(f"{q('rPr')}/{q(kind)}"):
                p.mark = (*p.mark, _rev(mark, kind, moves.get("now")))
        change = ppr.find(q("pPrChange"))
        if change is not None:
            # A record of properties has neither the mark's own nor the section's end.
            before = _without(change.find(q("pPr")), ()) if change.find(q("pPr")) is not None else _el("pPr")
            before.extend(x for x in ppr if local(x) in ("rPr", "sectPr"))
            p.old_props, p.prop_rev = read_paragraph_props(before), _rev(change, "pPrChange")

    plain = _plain_pieces(el, moves)
    if plain is None:
        _read_pieces(el, p, moves)
    else:
        p.pieces = plain
    p.state = state_of(p)
    return p


def _read_pieces(el: ET.Element, p: Paragraph, moves: dict) -> None:
    """The pieces of any paragraph."""
    def inner(node: ET.Element, revs: tuple, wraps: tuple) -> None:
        for x in node:
            name = local(x)
            if name == "r":
                rpr = x.find(q("rPr"))
                fmt, text = read_run_props(rpr), _run_text(x)
                others = [c for c in x if local(c) not in ("t", "delText", "instrText", "tab", "br", "cr", "noBreakHyphen", "rPr", "lastRenderedPageBreak")]
                if text:
                    piece = Piece(text, revs, fmt, wraps=wraps)
                    change = rpr.find(q("rPrChange")) if rpr is not None else None
                    if change is not None:
                        piece.old_fmt, piece.fmt_rev = read_run_props(change.find(q("rPr"))), _rev(change, "rPrChange")
                    p.pieces.append(piece)
                for c in others:
                    if local(c) == "commentReference":
                        p.pieces.append(Piece("", revs, fmt, opaque=Anchor("commentReference", int(_value(c, "id") or 0)), wraps=wraps))
                if kept := [ET.tostring(c, "unicode") for c in others if local(c) != "commentReference"]:
                    p.pieces.append(Piece("", revs, fmt, opaque=kept, wraps=wraps))
            elif name in REVISED:
                inner(x, (*revs, _rev(x, name, moves.get("now"))), wraps)
            elif name in ("moveFromRangeStart", "moveToRangeStart"):
                moves["now"] = _value(x, "name")
            elif name in ("moveFromRangeEnd", "moveToRangeEnd"):
                moves["now"] = None
            elif name in WRAPPERS:
                inner(x, revs, (*wraps, Wrap(_shell(x))))
            elif name.startswith("commentRange"):
                p.pieces.append(Piece("", revs, opaque=Anchor(name, int(_value(x, "id") or 0)), wraps=wraps))
                if name.endswith("Start"):
                    p.comments.append(int(_value(x, "id") or 0))
            elif name in RANGES:
                p.pieces.append(Piece("", revs, opaque=Anchor(name, xml=ET.tostring(x, "unicode")), wraps=wraps))
            elif name not in ("pPr", "proofErr") and not name.endswith("Pr"):
                p.pieces.append(Piece("", revs, {}, opaque=[ET.tostring(x, "unicode")], wraps=wraps))

    inner(el, (), ())


def block_elements(home: ET.Element):
    """The paragraphs and tables of a home with their parents, through what may stand around blocks; range marks too."""
    for el in home:
        if el.tag == P_TAG:
            yield el, home
            continue
        name = local(el)
        if name in ("p", "tbl") or name.endswith(("RangeStart", "RangeEnd")):
            yield el, home
        elif name in AROUND_BLOCKS:
            yield from block_elements(el)


def _row_mark(tr: ET.Element) -> Rev | None:
    return next((_rev(m, k) for k in ("ins", "del") for m in tr.findall(f"{q('trPr')}/{q(k)}")), None)


def read_blocks(home: ET.Element, moves: dict | None = None, path: tuple = ()) -> list:
    """The blocks of a home; path, with a block's number, says where it stands in the package."""
    moves = {} if moves is None else moves
    out: list = []
    for el, _ in block_elements(home):
        name, origin = local(el), (*path, len(out))
        if name == "p":
            out.append(read_paragraph(el, moves))
        elif name == "tbl":
            rows = []
            for r, tr in enumerate(el.findall(q("tr"))):
                cells, trpr = tr.findall(q("tc")), tr.find(q("trPr"))
                row = Row([read_blocks(tc, moves, (*origin, r, c)) for c, tc in enumerate(cells)], _row_mark(tr), origin=(*origin, r))
                row.props = [ET.tostring(x, "unicode") for x in (trpr if trpr is not None else ()) if local(x) not in ("ins", "del", "trPrChange")]
                row.cell_props = [ET.tostring(tc.find(q("tcPr")), "unicode") if tc.find(q("tcPr")) is not None else None for tc in cells]
                rows.append(row)
            out.append(Table(rows, [ET.tostring(x, "unicode") for x in el if local(x) in ("tblPr", "tblGrid")]))
        else:
            if name in ("moveFromRangeStart", "moveToRangeStart"):
                moves["now"] = _value(el, "name")
            elif name in ("moveFromRangeEnd", "moveToRangeEnd"):
                moves["now"] = None
            continue
        out[-1].origin = origin
    return out


def _home(root: ET.Element, story: str) -> ET.Element:
    """The element that holds a story's blocks."""
    if story == "body":
        return root.find(q("body"))
    return next(n for n in root if _value(n, "id") == story.partition(":")[2]) if ":" in story else root


def read(content: bytes, **how) -> Document:
    """A document of a package's bytes."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    places = {"body": "word/document.xml"}
    for name in sorted(parts, key=lambda n: (n.endswith("notes.xml"), n.endswith("endnotes.xml"), n)):  # headers and footers, then notes
        base = name.removeprefix("word/").removesuffix(".xml")
        if name.startswith("word/") and base.rstrip("0123456789") in ("header", "footer"):
            places[base] = name
        elif name in ("word/footnotes.xml", "word/endnotes.xml"):
            for note in ET.fromstring(parts[name]):
                if _value(note, "type") not in ("separator", "continuationSeparator"):
                    places[f"{base}:{_value(note, 'id')}"] = name
    roots = {name: ET.fromstring(parts[name]) for name in set(places.values())}
    doc = Document({story: read_blocks(_home(roots[name], story), path=(story,)) for story, name in places.items()}, package=(parts, places), **how)
    if "word/styles.xml" in parts:
        for el in ET.fromstring(parts["word/styles.xml"]).findall(q("style")):
            name = el.find(q("name"))
            if _value(el, "type") == "paragraph" and _value(el, "styleId"):
                doc.styles[_value(el, "styleId")] = (_value(name) if name is not None else None) or _value(el, "styleId")
                if _value(el, "default") in ("1", "true"):
                    doc.default_style = _value(el, "styleId")
    if "word/comments.xml" in parts:
        spans = _comment_spans(doc)
        for c in ET.fromstring(parts["word/comments.xml"]):
            number = int(_value(c, "id") or 0)
            p, start, end = spans.get(number, (None, None, None))
            doc.comments.append({"id": number, "paragraph": p, "start": start, "end": end, "author": _value(c, "author"), "initials": _value(c, "initials"), "date": _value(c, "date"), "text": "\n".join(p.text for p in read_blocks(c))})
    return doc


def _comment_spans(doc: Document) -> dict[int, tuple]:
    """Paragraph and offsets where each comment begins and ends; no end if that is in another paragraph."""
    found: dict[int, tuple] = {}
    for _, p, _, _ in doc.walk(doc.stories):
        at = 0
        for x in p.pieces:
            if isinstance(x.opaque, Anchor) and x.opaque.id is not None:
                old = found.get(x.opaque.id)
                if x.opaque.kind == "commentRangeStart":
                    found[x.opaque.id] = (p, at, None)
                elif x.opaque.kind == "commentRangeEnd" and old and old[0] is p:
                    found[x.opaque.id] = (p, old[1], at)
                elif x.opaque.kind == "commentReference" and old is None:
                    found[x.opaque.id] = (p, None, None)
            at += len(x.text) if x.shown else 0
    return found


# -- writing -------------------------------------------------------------------------


def _text_run(text: str, struck: bool, rpr: ET.Element | None) -> ET.Element:
    run = ET.Element(RUN_TAG)
    if rpr is not None:
        run.append(rpr)
    for k, line in enumerate(text.split("\n")):
        if k:
            run.append(_el("br"))
        for i, part in enumerate(line.split("\t")):
            if i:
                run.append(_el("tab"))
            if part:
                t = ET.SubElement(run, STRUCK_TAG if struck else TEXT_TAG)
                t.text = part
                if part != part.strip() or "  " in part:
                    t.set(XML_SPACE, "preserve")
    return run


def _anchor(x: Piece) -> ET.Element:
    if x.opaque.xml is not None:
        return ET.fromstring(x.opaque.xml)
    if x.opaque.kind != "commentReference":
        return _el(x.opaque.kind, id=x.opaque.id)
    run, rpr = _el("r"), run_props(x.fmt)
    if rpr is not None:
        run.append(rpr)
    run.append(_el("commentReference", id=x.opaque.id))
    return run


def write_paragraph(p: Paragraph) -> ET.Element:
    el = _el("p")
    el.attrib.update(p.source or {})
    ppr = paragraph_props(p)
    if ppr is not None:
        el.append(ppr)
    move = next((r for x in p.pieces for r in x.revs if r.move), None)
    if move:
        kind = "moveFrom" if move.kind == "moveFrom" else "moveTo"
        el.append(_el(f"{kind}RangeStart", id=f"9{move.id}", name=move.move, author=move.author, date=move.date))
    open_: list[tuple[object, ET.Element]] = []
    for x in p.pieces:
        around, depth = (*x.wraps, *x.revs), 0
        while depth < min(len(open_), len(around)) and open_[depth][0] is around[depth]:
            depth += 1
        del open_[depth:]
        for one in around[depth:]:
            wrapper = ET.fromstring(one.xml) if isinstance(one, Wrap) else _stamp(one.kind, one)
            (open_[-1][1] if open_ else el).append(wrapper)
            open_.append((one, wrapper))
        home = open_[-1][1] if open_ else el
        if isinstance(x.opaque, Anchor):
            home.append(_anchor(x))
            continue
        rpr = run_props(x.fmt, x.old_fmt, x.fmt_rev)
        if x.opaque:
            kept = [ET.fromstring(o) for o in x.opaque]
            if all(local(k).endswith(("Start", "End")) for k in kept):
                home.extend(kept)
            else:
                run = _el("r")
                if rpr is not None:
                    run.append(rpr)
                run.extend(kept)
                home.append(run)
        elif x.text:
            home.append(_text_run(x.text, any(r.kind == "del" for r in x.revs), rpr))
    if move:
        el.append(_el(f"{kind}RangeEnd", id=f"9{move.id}"))
    return el


def _is_plain(p: Paragraph, state: object) -> bool:
    """Whether plain_markup() can say it: pieces of one line of text, and revisions that aren't moves."""
    if isinstance(state, str):
        return False
    for x in p.pieces:
        if not x.text or "\t" in x.text or "\n" in x.text:
            return False
        for r in x.revs:
            if r.move:
                return False
    return True


def plain_markup(p: Paragraph, w: str) -> str:
    """What a plain paragraph's element holds, as write_paragraph() has it; w is the prefix with its colon."""
    out: list[str] = []
    open_: tuple = ()
    for x in p.pieces:
        if x.revs != open_:
            depth = 0
            while depth < min(len(open_), len(x.revs)) and open_[depth] is x.revs[depth]:
                depth += 1
            out += [f"</{w}{r.kind}>" for r in reversed(open_[depth:])]
            for r in x.revs[depth:]:
                out.append(f"<{w}{r.kind}" + "".join([f' {w}{k}="{_quoted(str(v))}"' for k, v in (("id", r.id), ("author", r.author), ("date", r.date)) if v is not None]) + ">")
            open_ = x.revs
        text, tag = x.text, "t"
        for r in open_:
            if r.kind == "del":
                tag = "delText"
        space = ' xml:space="preserve"' if text != text.strip() or "  " in text else ""
        out.append(f"<{w}r><{w}{tag}{space}>{_escaped(text)}</{w}{tag}></{w}r>")
    out += [f"</{w}{r.kind}>" for r in reversed(open_)]
    return "".join(out)


def _mark_row(tr: ET.Element, mark: Rev | None) -> None:
    """Let a row's properties have this revision, and no other."""
    trpr = tr.find(q("trPr"))
    if trpr is None:
        trpr = _el("trPr")
        tr.insert(0, trpr)
    for k in ("ins", "del"):
        _drop(trpr, k)
    if mark:
        change = trpr.find(q("trPrChange"))
        trpr.insert(len(trpr) if change is None else list(trpr).index(change), _stamp(mark.kind, mark))
    if not len(trpr):
        tr.remove(trpr)


def write_row(row: Row) -> ET.Element:
    tr = _el("tr")
    if row.props:
        trpr = _el("trPr")
        trpr.extend(map(ET.fromstring, row.props))
        tr.append(trpr)
    _mark_row(tr, row.mark)
    for c, cell in enumerate(row.cells):
        tc = _el("tc")
        if c < len(row.cell_props) and row.cell_props[c]:
            tc.append(ET.fromstring(row.cell_props[c]))
        tc.extend(map(write_block, cell or [Paragraph()]))
        tr.append(tc)
    return tr


def write_block(block: Paragraph | Table) -> ET.Element:
    if isinstance(block, Paragraph):
        return write_paragraph(block)
    tbl = _el("tbl")
    tbl.extend(map(ET.fromstring, block.props or ()))
    tbl.extend(map(write_row, block.rows))
    return tbl


def _after(parent: ET.Element, el: ET.Element | None, new: ET.Element, first: tuple[str, ...] = ()) -> None:
    """Put an element behind another one, or behind the properties that come first."""
    if el is not None and parent[-1] is el:
        parent.append(new)
        return
    at = list(parent).index(el) + 1 if el is not None else sum(local(x) in first for x in parent)
    parent.insert(at, new)


def update_blocks(home: ET.Element, blocks: list, path: tuple, plain: dict) -> bool:
    """Bring a home's elements to the blocks; whether anything had to change.

    Of a plain paragraph the element has the attributes alone, and `plain` gets what it holds.
    """
    def written(b: Paragraph | Table, state: object) -> ET.Element:
        if isinstance(b, Paragraph) and _is_plain(b, state):
            el = ET.Element(P_TAG, b.source or {})
            if b.pieces:
                plain[el] = b
            return el
        return write_block(b)

    here = [(el, parent) for el, parent in block_elements(home) if el.tag == P_TAG or local(el) in ("p", "tbl")]
    there = {(*path, i): x for i, x in enumerate(here)}
    kept = {b.origin for b in blocks}
    changed, parent, last, at = False, home, None, 0
    for origin in [o for o in there if o not in kept]:
        el, around = there.pop(origin)
        around.remove(el)
        changed = True
    for b in blocks:
        found = there.pop(b.origin, None)
        if found is None:
            new = written(b, state_of(b) if isinstance(b, Paragraph) else None)
            _after(parent, last, new, ("tcPr",))
            last, changed = new, True
            continue
        el, parent = found
        if isinstance(b, Table):
            changed |= update_table(el, b, plain)
        elif (state := state_of(b)) != b.state:
            new = written(b, state)
            new.tail = el.tail
            while at < len(parent) and parent[at] is not el:  # mostly behind the last one that was replaced
                at += 1
            at = at if at < len(parent) else list(parent).index(el)
            parent[at] = new
            el, changed = new, True
        last = el
    if local(home) == "tc" and not home.findall(q("p")):
        home.append(_el("p"))
        changed = True
    return changed


def update_table(tbl: ET.Element, table: Table, plain: dict) -> bool:
    there = {(*table.origin, r): tr for r, tr in enumerate(tbl.findall(q("tr")))}
    kept = {r.origin for r in table.rows}
    changed, last = False, None
    for origin in [o for o in there if o not in kept]:
        tbl.remove(there.pop(origin))
        changed = True
    for row in table.rows:
        tr = there.pop(row.origin, None)
        if tr is None:
            tr = write_row(row)
            _after(tbl, last, tr, ("tblPr", "tblGrid"))
            changed = True
        else:
            was = _row_mark(tr)
            if repr(was) != repr(row.mark):
                _mark_row(tr, row.mark)
                changed = True
            for c, (tc, cell) in enumerate(zip(tr.findall(q("tc")), row.cells)):
                changed |= update_blocks(tc, cell, (*row.origin, c), plain)
        last = tr
    return changed


def _blank_package() -> tuple[dict, dict]:
    empty = f'<w:document xmlns:w="{W}"><w:body/></w:document>'
    kinds = f'<Types xmlns="{TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
    rels = f'<Relationships xmlns="{REL}"><Relationship Id="rId1" Type="{OFFICE_REL}/officeDocument" Target="word/document.xml"/></Relationships>'
    return {"[Content_Types].xml": kinds.encode(), "_rels/.rels": rels.encode(), "word/document.xml": empty.encode()}, {"body": "word/document.xml"}


def _spaces(part: bytes) -> dict[str, str]:
    """The prefixes that a part declares, by reading no more than the first element if no other declares any."""
    pull, found = ET.XMLPullParser(("start-ns", "start")), []
    for at, end in ((0, 256), (256, 4096)):
        pull.feed(part[at:end])
        for event, x in pull.read_events():
            if event == "start":
                if found and part.count(b"xmlns") == len(found):
                    return dict(found)
                break
            found.append(x)
    return dict(x for _, x in ET.iterparse(io.BytesIO(part), ("start-ns",)))


def _escaped(text: str) -> str:
    if "&" in text:
        text = text.replace("&", "&amp;")
    if "<" in text:
        text = text.replace("<", "&lt;")
    return text.replace(">", "&gt;") if ">" in text else text


def _quoted(value: str) -> str:
    value = _escaped(value)
    if '"' in value:
        value = value.replace('"', "&quot;")
    if not value.isprintable():
        value = value.replace("\r", "&#13;").replace("\n", "&#10;").replace("\t", "&#09;")
    return value


def serialised(root: ET.Element, plain: dict | None = None) -> bytes:
    """What the library's tostring() gives for elements and text, in one pass; plain: what some paragraphs hold."""
    names: dict[str, str] = {}
    spaces: dict[str, str] = {}
    known = ET._namespace_map  # where register_namespace() keeps them

    def name(tag: str) -> str:
        uri, brace, rest = tag[1:].rpartition("}") if tag[:1] == "{" else ("", "", tag)
        names[tag] = rest
        if brace:
            prefix = spaces.get(uri)
            if prefix is None:
                prefix = known.get(uri)
                if prefix is None:
                    prefix = f"ns{len(spaces)}"
                if prefix != "xml":
                    spaces[uri] = prefix
            names[tag] = f"{prefix}:{rest}" if prefix else rest
        return names[tag]

    out: list[str] = []
    tag = name(root.tag)
    own = _attributes(root, names, name)
    _content(root, out.append, names, name, plain or {})
    declared = "".join([f' xmlns{":" + k if k else ""}="{_quoted(v)}"' for v, k in sorted(spaces.items(), key=lambda x: x[1])])
    inside = "".join(out)
    whole = f"<{tag}{declared}{own}>{inside}</{tag}>" if inside else f"<{tag}{declared}{own} />"
    return f"<?xml version='1.0' encoding='UTF-8'?>\n{whole}".encode("utf-8", "xmlcharrefreplace")


def _attributes(el: ET.Element, names: dict, name) -> str:
    return "".join([f' {names.get(k) or name(k)}="{_quoted(v)}"' for k, v in el.attrib.items()])


def _content(el: ET.Element, write, names: dict, name, plain: dict) -> None:
    if el.text:
        write(_escaped(el.text))
    for x in el:
        tag = names.get(x.tag) or name(x.tag)
        own = _attributes(x, names, name) if x.attrib else ""
        if x in plain:
            inside = plain_markup(plain[x], tag[:-1])
            write(f"<{tag}{own}>{inside}</{tag}>" if inside else f"<{tag}{own} />")
        elif len(x):
            write(f"<{tag}{own}>")
            _content(x, write, names, name, plain)
            write(f"</{tag}>")
        elif x.text:
            write(f"<{tag}{own}>{_escaped(x.text)}</{tag}>")
        else:
            write(f"<{tag}{own} />")
        if x.tail:
            write(_escaped(x.tail))


def _part(root: ET.Element, before: bytes = b"", plain: dict | None = None) -> bytes:
    """A part's bytes with the prefixes it had; attributes name prefixes too, so none that was declared may go."""
    spaces = _spaces(before) if before else {}
    for prefix, uri in spaces.items():
        try:
            ET.register_namespace(prefix, uri)
        except ValueError:  # a prefix that the library keeps for itself
            pass
    out = serialised(root, plain)
    start = out.index(b"<", out.index(b"?>"))
    end = next(i for i in range(start, len(out)) if out[i : i + 1] in (b" ", b">", b"/"))
    head = out[start : out.index(b">", start)]
    missing = [(p, u) for p, u in spaces.items() if p and f"xmlns:{p}=".encode() not in head]
    return out[:end] + "".join(f' xmlns:{p}="{u}"' for p, u in missing).encode() + out[end:]


def write(doc: Document) -> bytes:
    """A package's bytes: the document's own, with its stories and comments as they are now."""
    parts, places = doc.package or _blank_package()
    parts = dict(parts)
    roots: dict[str, ET.Element] = {}
    changed: set[str] = set()
    plain: dict[ET.Element, Paragraph] = {}
    for story, blocks in doc.stories.items():
        name = places.get(story)
        if name is None:
            continue
        if name not in roots:
            roots[name] = ET.fromstring(parts[name])
        root = roots[name]
        if update_blocks(_home(root, story), blocks, (story,), plain):
            changed.add(name)
    for name in changed:
        parts[name] = _part(roots[name], parts[name], plain)
    if doc.comments:
        _write_comments(doc, parts)
    if doc.track:
        _track(parts)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _relate(parts: dict, kind: str, target: str, content_type: str) -> None:
    """Declare a part that the package didn't have."""
    name = "word/_rels/document.xml.rels"
    rels = ET.fromstring(parts.get(name, f'<Relationships xmlns="{REL}"/>'.encode()))
    if not any(r.get("Target") == target for r in rels):
        ET.SubElement(rels, f"{{{REL}}}Relationship", {"Id": f"rIdP{len(rels) + 1}", "Type": f"{OFFICE_REL}/{kind}", "Target": target})
        parts[name] = _plain(rels, REL)
    kinds = ET.fromstring(parts["[Content_Types].xml"])
    if not any(k.get("PartName") == f"/word/{target}" for k in kinds):
        ET.SubElement(kinds, f"{{{TYPES}}}Override", {"PartName": f"/word/{target}", "ContentType": content_type})
        parts["[Content_Types].xml"] = _plain(kinds, TYPES)


def _plain(root: ET.Element, uri: str) -> bytes:
    """Serialised with the part's own namespace as the default one; attributes have none."""
    for el in root.iter():
        el.tag = el.tag.removeprefix(f"{{{uri}}}")
    root.set("xmlns", uri)
    return ET.tostring(root, encoding="UTF-8", xml_declaration=True)


def _write_comments(doc: Document, parts: dict) -> None:
    """Add the comments that the package doesn't have yet; its own stay as they are."""
    name = "word/comments.xml"
    root = ET.fromstring(parts[name]) if name in parts else _el("comments")
    there = {int(_value(c, "id") or 0) for c in root}
    new = [c for c in doc.comments if c["id"] not in there]
    for c in new:
        el = _el("comment", id=c["id"], author=c["author"], initials=c["initials"], date=c["date"])
        for line in (c["text"] or "").split("\n"):
            el.append(write_paragraph(Paragraph([Piece(line)] if line else [])))
        root.append(el)
    if new:
        parts[name] = _part(root, parts.get(name, b""))
        _relate(parts, "comments", "comments.xml", "application/vnd.openxmlformats-officedocument.wordprocessingml.comments+xml")


#: What comes before trackRevisions among the settings (fixed values of the format's schema).
BEFORE_TRACKING = (
    "writeProtection view zoom removePersonalInformation removeDateAndTime doNotDisplayPageBoundaries displayBackgroundShape printPostScriptOverText printFractionalCharacterWidth printFormsData "
    "embedTrueTypeFonts embedSystemFonts saveSubsetFonts saveFormsData mirrorMargins alignBordersAndEdges bordersDoNotSurroundHeader bordersDoNotSurroundFooter gutterAtTop hideSpellingErrors "
    "hideGrammaticalErrors activeWritingStyle proofState formsDesign attachedTemplate linkStyles stylePaneFormatFilter stylePaneSortMethod documentType mailMerge revisionView"
).split()


def _track(parts: dict) -> None:
    names = ("word/settings.xml", "word/_rels/document.xml.rels", "[Content_Types].xml")
    parts |= {n: data for n, data in zip(names, _tracked(names, *map(parts.get, names))) if data is not None}


@lru_cache(maxsize=16)
def _tracked(names: tuple, *was: bytes | None) -> tuple:
    """These parts with tracking on; packages made by one program often have the same ones."""
    parts = {n: data for n, data in zip(names, was) if data is not None}
    root = ET.fromstring(parts.get("word/settings.xml", f'<w:settings xmlns:w="{W}"/>'.encode()))
    if root.find(q("trackRevisions")) is None:
        _after(root, None, _el("trackRevisions"), tuple(BEFORE_TRACKING))
        parts["word/settings.xml"] = _part(root, parts.get("word/settings.xml", b""))
        _relate(parts, "settings", "settings.xml", "application/vnd.openxmlformats-officedocument.wordprocessingml.settings+xml")
    return tuple(map(parts.get, names))
