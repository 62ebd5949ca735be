"""Documents with their changes as HTML."""

from __future__ import annotations

from html import escape

from ..operators.document import Document, Paragraph, Piece, Row, Table


def state(piece: Piece) -> str:
    """What a piece is to a reader: '', ins, del, moved-away, moved-here; the innermost change says."""
    return {"ins": "ins", "del": "del", "moveFrom": "moved-away", "moveTo": "moved-here"}[piece.revs[-1].kind] if piece.revs else ""


def piece_html(piece: Piece) -> str:
    text = escape(piece.text).replace("\n", "<br>").replace("\t", "&emsp;")
    for key, tag in (("bold", "b"), ("italic", "i"), ("underline", "u")):
        if piece.fmt.get(key):
            text = f"<{tag}>{text}</{tag}>"
    classes = [c for c in (state(piece), "formatted" if piece.fmt_rev else "") if c]
    if not classes:
        return text
    rev = piece.revs[-1] if piece.revs else piece.fmt_rev
    title = escape(f"{rev.author}, {rev.date}", quote=True)
    return f'<span class="{" ".join(classes)}" title="{title}">{text}</span>'


def changed(p: Paragraph) -> bool:
    return bool(p.mark or p.prop_rev or any(x.revs or x.fmt_rev for x in p.pieces))


def paragraph_html(p: Paragraph, comments: dict[int, dict] | None = None) -> str:
    marks = {"ins": "mark-ins", "del": "mark-del", "moveFrom": "mark-moved-away", "moveTo": "mark-moved-here"}
    classes = (["changed"] if changed(p) else []) + [marks[r.kind] for r in p.mark]
    notes = "".join(f'<sup title="{escape((comments or {}).get(i, {}).get("text", ""), quote=True)}">{i + 1}</sup>' for i in p.comments)
    attribute = f' class="{" ".join(classes)}"' if classes else ""
    return f"<p{attribute}>{''.join(map(piece_html, p.pieces))}{notes}</p>"


def row_html(row: Row, comments: dict[int, dict] | None = None) -> str:
    attribute = f' class="row-{row.mark.kind}"' if row.mark else ""
    return f"<tr{attribute}>{''.join(f'<td>{"".join(paragraph_html(p, comments) for p in cell)}</td>' for cell in row.cells)}</tr>"


def table_html(table: Table, comments: dict[int, dict] | None = None) -> str:
    return f"<table>{''.join(row_html(r, comments) for r in table.rows)}</table>"


def to_html(doc: Document) -> str:
    """The body's blocks; paragraphs that are empty and unchanged aren't shown."""
    comments = {c["id"]: c for c in doc.comments}
    out = []
    for b in doc.body:
        if isinstance(b, Table):
            out.append(table_html(b, comments))
        elif changed(b) or any(x.text.strip() for x in b.pieces):
            out.append(paragraph_html(b, comments))
    return "\n".join(out)
