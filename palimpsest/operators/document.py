"""One document as a table of pieces, with tracked changes.

A paragraph is an ordered list of pieces; a piece is text of one format under a stack
of revisions, the outermost first. Current text is what no deletion covers. Editing
splits and rewrites one paragraph's list; accepting and rejecting read the stacks from
the inside out. Grouped maps run these over many documents, one at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from copy import copy, deepcopy
from dataclasses import dataclass, field
from datetime import UTC, datetime

from .. import schema as S
from ..functions import plain

ADDED, REMOVED = ("ins", "moveTo"), ("del", "moveFrom")
CHARACTER_PROPS = ("bold", "italic", "underline", "strike", "color", "highlight", "font", "size")
PARAGRAPH_PROPS = ("alignment", "style", "space_before", "space_after", "left_indent", "right_indent", "first_line_indent", "keep_with_next", "line_spacing")
ALIGNMENTS = ("LEFT", "CENTER", "RIGHT", "JUSTIFY")
HIGHLIGHTS = ("yellow", "green", "cyan", "magenta", "blue", "red", "darkBlue", "darkCyan", "darkGreen", "darkMagenta", "darkRed", "darkYellow", "darkGray", "lightGray", "black", "white", "none")


class EditError(ValueError):
    """An edit that can't be made."""


class ClauseError(EditError):
    """A clause that isn't there, or can't be treated so."""


class StalePlan(EditError):
    """A plan made for another state of the document."""


@dataclass(eq=False, slots=True)
class Rev:
    """One tracked change; pieces share it, so it is compared by identity."""

    kind: str
    id: str
    author: str
    date: str
    move: str | None = None


@dataclass(eq=False)
class Wrap:
    """An element around pieces (a link, a control), without what it holds; pieces share it."""

    xml: str


@dataclass(frozen=True)
class Anchor:
    """One end of a range over the text, as a comment's; what is copied or struck leaves it where it is."""

    kind: str
    id: int | None = None
    xml: str | None = None


@dataclass(slots=True)
class Piece:
    text: str
    revs: tuple[Rev, ...] = ()
    fmt: dict = field(default_factory=dict)
    old_fmt: dict | None = None
    fmt_rev: Rev | None = None
    opaque: object = None  # what isn't text: an Anchor, or kept as it is
    wraps: tuple[Wrap, ...] = ()

    @property
    def shown(self) -> bool:
        for r in self.revs:
            if r.kind in REMOVED:
                return False
        return True

    def part(self, start: int, end: int | None = None) -> Piece:
        """A piece of some of its text, all else the same."""
        return Piece(self.text[start:end], self.revs, dict(self.fmt), self.old_fmt, self.fmt_rev, self.opaque, self.wraps)


@dataclass(eq=False, slots=True)
class Paragraph:
    pieces: list[Piece] = field(default_factory=list)
    props: dict = field(default_factory=dict)
    mark: tuple[Rev, ...] = ()
    old_props: dict | None = None
    prop_rev: Rev | None = None
    heading: int | None = None
    comments: list[int] = field(default_factory=list)
    origin: tuple | None = None  # its place in the package, its element's attributes, and all of it as it was read
    source: dict | None = None
    state: object = None

    @property
    def text(self) -> str:
        return "".join([p.text for p in self.pieces if not p.revs or p.shown])

    @property
    def all_text(self) -> str:
        """With what is struck; breaks and tabs as one blank."""
        return "".join(re.sub(r"[\t\n]", " ", p.text) for p in self.pieces)

    @property
    def revised(self) -> bool:
        return any(p.revs for p in self.pieces)

    @property
    def going(self) -> bool:
        return bool(self.mark) and any(r.kind in REMOVED for r in self.mark)


@dataclass(eq=False)
class Row:
    cells: list[list[Paragraph]]
    mark: Rev | None = None
    props: list[str] = field(default_factory=list)
    cell_props: list[str | None] = field(default_factory=list)
    origin: tuple | None = None

    @property
    def texts(self) -> list[str]:
        return ["\n".join(p.text for p in cell) for cell in self.cells]


@dataclass(eq=False)
class Table:
    rows: list[Row]
    props: object = None
    origin: tuple | None = None

    @property
    def text(self) -> str:
        return "\n".join(" | ".join(r.texts) for r in self.rows)


@dataclass(slots=True)
class Revision:
    kind: str
    author: str
    date: str
    text: str
    location: int
    id: str
    part: str
    move: str | None = None
    rev: Rev | None = None


@dataclass
class Clause:
    paragraph: Paragraph
    label: str
    span: tuple[int, int]
    title: str
    inserted: bool = False
    moved: bool = False
    parent: Clause | None = None
    children: list[Clause] = field(default_factory=list)

    @property
    def number(self) -> tuple[int, ...]:
        return tuple(map(int, self.label.split(".")))

    def walk(self) -> Iterator[Clause]:
        yield self
        for c in self.children:
            yield from c.walk()

    @property
    def last(self) -> Paragraph:
        return list(self.walk())[-1].paragraph


def copied(props: dict) -> dict:
    """Paragraph properties for a new paragraph: a section's end stays where it is."""
    return deepcopy({k: v for k, v in props.items() if k != "_section"})


def utc_stamp(when=None) -> str:
    if isinstance(when, str):
        return when
    when = when or datetime.now(UTC)
    return (when.astimezone(UTC) if when.tzinfo else when).strftime("%Y-%m-%dT%H:%M:%SZ")


class Document:
    """A document's stories (part name to blocks), comments, and who edits it when."""

    def __init__(self, stories: dict[str, list], author: str = "Editor", initials: str | None = None, date=None, scope: Iterable[str] = ("body", "headers", "footers", "notes"), package: object = None) -> None:
        self.stories, self.author, self.initials = stories, author, initials or plain.initials(author)
        self.date, self.scope, self.package = utc_stamp(date), tuple(scope), package
        self.comments: list[dict] = []
        self.styles: dict[str, str] = {}  # paragraph styles: id to name
        self.default_style: str | None = None
        self.track = True
        self.next_id = 1 + max((int(r.id) for r in self._revs() if r.id.isdigit()), default=0)
        self.moves = 0

    # -- scans ---------------------------------------------------------------

    @property
    def body(self) -> list:
        return self.stories["body"]

    def _kind(self, part: str) -> str:
        return "body" if part == "body" else "headers" if part.startswith("header") else "footers" if part.startswith("footer") else "notes"

    def _lists(self, parts: Iterable[str] | None = None) -> Iterator[tuple[str, list]]:
        """All lists that hold blocks, cells' too, in order."""
        for part, blocks in self.stories.items():
            if parts is None and self._kind(part) not in self.scope or parts is not None and part not in parts:
                continue
            stack = [blocks]
            yield part, blocks
            while stack:
                for b in stack.pop():
                    if isinstance(b, Table):
                        for row in b.rows:
                            for cell in row.cells:
                                yield part, cell
                                stack.append(cell)

    def walk(self, parts: Iterable[str] | None = None) -> Iterator[tuple[str, Paragraph, Table | None, Row | None]]:
        """Paragraphs in document order, with their part, and the table and row they stand in."""
        def inner(part, blocks, table, row):
            for b in blocks:
                if isinstance(b, Paragraph):
                    yield part, b, table, row
                else:
                    for r in b.rows:
                        for cell in r.cells:
                            yield from inner(part, cell, b, r)

        for part, blocks in self.stories.items():
            if (self._kind(part) in self.scope) if parts is None else part in parts:
                yield from inner(part, blocks, None, None)

    def paragraphs(self, include_tables: bool = True, parts: Iterable[str] | None = None) -> list[Paragraph]:
        gone = lambda row: row is not None and row.mark is not None and row.mark.kind == "del"
        return [p for _, p, table, row in self.walk(parts) if not gone(row) and (include_tables or table is None)]

    def tables(self) -> list[Table]:
        out = []

        def inner(blocks):
            for b in blocks:
                if isinstance(b, Table):
                    out.append(b)
                    for r in b.rows:
                        for cell in r.cells:
                            inner(cell)

        for part, blocks in self.stories.items():
            if self._kind(part) in self.scope:
                inner(blocks)
        return out

    def _home(self, p) -> tuple[list, int]:
        for _, blocks in self._lists():
            for i, b in enumerate(blocks):
                if b is p:
                    return blocks, i
        raise EditError("the paragraph isn't in the document any more")

    def text(self) -> str:
        return "\n".join(p.text for _, p, _, _ in self.walk(("body",)))

    def texts(self) -> list[str]:
        return [p.text for _, p, _, _ in self.walk(("body",))]

    def copy(self) -> Document:
        """The same document to be changed by itself; what is never changed in place (revisions, the package) is shared."""
        own: dict[int, Paragraph] = {}

        def block(b):
            if isinstance(b, Table):
                return Table([Row([list(map(block, cell)) for cell in r.cells], r.mark, list(r.props), list(r.cell_props), r.origin) for r in b.rows], b.props, b.origin)
            pieces = [Piece(x.text, x.revs, dict(x.fmt), x.old_fmt and dict(x.old_fmt), x.fmt_rev, x.opaque, x.wraps) for x in b.pieces]
            own[id(b)] = new = Paragraph(pieces, dict(b.props), b.mark, b.old_props and dict(b.old_props), b.prop_rev, b.heading, list(b.comments), b.origin, b.source, b.state)
            return new

        out = copy(self)
        out.stories = {part: list(map(block, blocks)) for part, blocks in self.stories.items()}
        out.comments = [c | {"paragraph": own.get(id(c["paragraph"]), c["paragraph"])} for c in self.comments]
        out.styles = dict(self.styles)
        own.clear()  # block() refers to itself, so what it holds waits for the collector
        return out

    # -- search --------------------------------------------------------------

    def find_paragraphs(self, contains=None, regex=None, style=None, startswith=None, ignore_case=False, include_tables=True) -> list[Paragraph]:
        low = str.lower if ignore_case else str
        pattern = re.compile(regex, re.IGNORECASE if ignore_case else 0) if regex is not None else None
        return [p for p in self.paragraphs(include_tables) if (contains is None or low(contains) in low(p.text)) and (startswith is None or low(p.text).lstrip().startswith(low(startswith))) and (style is None or self.style_name(p) == style) and (pattern is None or pattern.search(p.text))]

    def find_paragraph(self, *args, **kw) -> Paragraph:
        found = self.find_paragraphs(*args, **kw)
        if not found:
            raise EditError("no paragraph matches")
        return found[0]

    def find_text(self, needle: str, regex=False, ignore_case=False, limit=None, within: list[Paragraph] | None = None) -> list[tuple[Paragraph, int, int, re.Match]]:
        pattern = re.compile(needle if regex else re.escape(needle), re.IGNORECASE if ignore_case else 0)
        out = []
        for p in self.paragraphs() if within is None else within:
            for m in pattern.finditer(p.text):
                if m.end() > m.start():
                    out.append((p, *m.span(), m))
                    if limit is not None and len(out) >= limit:
                        return out
        return out

    # -- revisions' making ----------------------------------------------------

    def _rev(self, kind: str, move: str | None = None) -> Rev:
        self.next_id += 1
        return Rev(kind, str(self.next_id - 1), self.author, self.date, move)

    def _revs(self) -> Iterator[Rev]:
        for _, p, _, row in self.walk(self.stories):
            if row is not None and row.mark is not None:
                yield row.mark
            yield from p.mark
            if p.prop_rev:
                yield p.prop_rev
            for x in p.pieces:
                yield from x.revs
                if x.fmt_rev:
                    yield x.fmt_rev

    @staticmethod
    def split(p: Paragraph, at: int) -> int:
        """Make a boundary at an offset of the current text; the index of the piece behind it."""
        seen = 0
        for i, x in enumerate(p.pieces):
            if not x.shown:
                continue
            if seen == at:
                return i
            if seen < at < seen + len(x.text):
                k = at - seen
                p.pieces[i : i + 1] = [x.part(0, k), x.part(k)]
                return i + 1
            seen += len(x.text)
        if at == seen:
            return len(p.pieces)
        raise EditError(f"offset {at} is outside of the paragraph's {seen} characters")

    def _between(self, p: Paragraph, start: int, end: int) -> list[Piece]:
        if not 0 <= start <= end <= len(p.text):
            raise EditError(f"span {start}..{end} is outside of the paragraph")
        a = self.split(p, start)
        b = self.split(p, end)
        a = self.split(p, start)
        return [x for x in p.pieces[a:b] if x.shown and x.text]

    def _strike(self, pieces: list[Piece], p: Paragraph) -> None:
        """Neighbours under the same stack share one deletion."""
        rev, last = None, None
        for x in pieces:
            here = next(i for i, y in enumerate(p.pieces) if y is x)
            if rev is None or last is None or here != last[0] + 1 or x.revs != last[1]:
                rev = self._rev("del")
            last = (here, x.revs)
            x.revs = (*x.revs, rev)

    def clamp(self, p: Paragraph, offset: int) -> int:
        n = len(p.text)
        return max(0, min(n, offset + n if offset < 0 else offset))

    def _format_at(self, p: Paragraph, offset: int) -> dict:
        """Format of the piece that ends at or behind an offset."""
        seen, last = 0, {}
        for x in p.pieces:
            if x.shown and x.opaque is None:
                seen, last = seen + len(x.text), x.fmt
                if seen >= offset:
                    break
        return dict(last)

    # -- text edits ------------------------------------------------------------

    def insert_text(self, p: Paragraph, offset: int, text: str, fmt: dict | None = None) -> None:
        if not text:
            return
        offset = self.clamp(p, offset)
        fmt = self._format_at(p, offset) if fmt is None else fmt
        at = self.split(p, offset)
        p.pieces.insert(at, Piece(text, (self._rev("ins"),), fmt))

    def delete_text(self, p: Paragraph, start: int, end: int) -> None:
        self._strike(self._between(p, start, end), p)

    def replace_range(self, p: Paragraph, start: int, end: int, text: str, insertion_first: bool = False) -> None:
        fmt = self._format_at(p, start + 1)
        if insertion_first:
            self.insert_text(p, start, text, fmt)
            self.delete_text(p, start + len(text), end + len(text))
            return
        self.delete_text(p, start, end)
        if text:
            # Behind what is struck now: at the offset, but after the pieces that are hidden there.
            at, seen = len(p.pieces), 0
            for i, x in enumerate(p.pieces):
                if x.shown:
                    if seen == start and x.text:
                        at = i
                        break
                    seen += len(x.text)
            p.pieces.insert(at, Piece(text, (self._rev("ins"),), fmt))

    def replace_in_place(self, p: Paragraph, start: int, end: int, text: str) -> None:
        """Overwrite inside a revision, untracked."""
        own = self._between(p, start, end)
        if own:
            own[0].text = text
            for x in own[1:]:
                x.text = ""

    def append_text(self, p: Paragraph, text: str) -> None:
        self.insert_text(p, len(p.text), text)

    def _each(self, needle: str, regex: bool, ignore_case: bool, count: int | None):
        found = self.find_text(needle, regex, ignore_case, count)
        return found[::-1]  # from the right, so that offsets stay

    def insert_relative(self, needle: str, text: str, before: bool, count: int | None = 1, regex=False, ignore_case=False) -> int:
        found = self._each(needle, regex, ignore_case, count)
        for p, s, e, _ in found:
            self.insert_text(p, s if before else e, text)
        return len(found)

    def delete_matching(self, needle: str, regex=False, ignore_case=False, count=None) -> int:
        found = self._each(needle, regex, ignore_case, count)
        for p, s, e, _ in found:
            self.delete_text(p, s, e)
        return len(found)

    def replace_text(self, old: str, new: str, regex=False, ignore_case=False, count: int | None = 1, insertion_first=False) -> int:
        found = self._each(old, regex, ignore_case, count)
        for p, s, e, m in found:
            self.replace_range(p, s, e, m.expand(new) if regex else new, insertion_first)
        return len(found)

    def set_text(self, p: Paragraph, new: str, ignore_case: bool = False) -> int:
        """Rewrite by words; the number of changes."""
        ops = plain.diff(p.text, new, ignore_case)
        for kind, s, e, text in reversed(ops):
            self.insert_text(p, s, text) if kind == "insert" else self.replace_range(p, s, e, text)
        return len(ops)

    # -- paragraphs ---------------------------------------------------------------

    def insert_paragraph(self, near: Paragraph, text: str = "", style: str | None = None, copy_format: bool = True, after: bool = True) -> Paragraph:
        blocks, i = self._home(near)
        fmt = dict(near.pieces[0].fmt) if copy_format and near.pieces else {}
        props = copied(near.props) if copy_format else {}
        if style:
            props["style"] = style
        new = Paragraph([Piece(text, (self._rev("ins"),), fmt)] if text else [], props, (self._rev("ins"),))
        blocks.insert(i + after, new)
        return new

    def append_paragraph(self, text: str, style: str | None = None) -> Paragraph:
        new = Paragraph([Piece(text, (self._rev("ins"),))] if text else [], {"style": style} if style else {}, (self._rev("ins"),))
        self.body.append(new)
        return new

    def delete_paragraph(self, p: Paragraph) -> None:
        self._strike([x for x in p.pieces if x.shown and not isinstance(x.opaque, Anchor)], p)
        if not p.going:
            p.mark = (*p.mark, self._rev("del"))

    def delete_paragraphs(self, ps: Iterable[Paragraph]) -> int:
        return sum(1 for p in list(ps) if self.delete_paragraph(p) is None)

    def move_paragraph(self, source: Paragraph, after: Paragraph | None = None, before: Paragraph | None = None) -> tuple[Paragraph, bool]:
        """The paragraph at its new place, and whether it is a true move.

        An edited paragraph can't be a move of one piece: it is struck, and what it reads
        now is inserted.
        """
        target = after if after is not None else before
        if target is source:
            raise EditError("a paragraph can't move beside itself")
        blocks, i = self._home(target)
        clean = not source.revised and not source.mark
        copy = Paragraph([Piece(x.text, (), dict(x.fmt), opaque=x.opaque, wraps=x.wraps) for x in source.pieces if x.shown and not isinstance(x.opaque, Anchor)], copied(source.props), heading=source.heading)
        if not clean and not copy.text:
            raise EditError("nothing of the paragraph is left to move")
        if clean:
            self.moves += 1
            name = f"move{self.moves}"
            gone, come, gone_mark, come_mark = (self._rev(k, name) for k in ("moveFrom", "moveTo", "moveFrom", "moveTo"))
            for x in source.pieces:
                if not isinstance(x.opaque, Anchor):
                    x.revs = (gone,)
            source.mark = (gone_mark,)
        else:
            self.delete_paragraph(source)
            come, come_mark = self._rev("ins"), self._rev("ins")
        for x in copy.pieces:
            x.revs = (come,)
        copy.mark = (come_mark,)
        blocks.insert(i + (after is not None), copy)
        return copy, clean

    # -- tables -------------------------------------------------------------------

    def _row(self, table: Table, index: int) -> Row:
        if not -len(table.rows) <= index < len(table.rows):
            raise EditError(f"row {index} is out of range")
        return table.rows[index]

    def insert_row(self, table: Table, index: int | None = None, values: list[str] | None = None) -> Row:
        index = len(table.rows) if index is None else index
        like = table.rows[min(index, len(table.rows) - 1)]
        values = list(values or [])
        cells = []
        for k, cell in enumerate(like.cells):
            text = values[k] if k < len(values) else ""
            fmt = next((dict(x.fmt) for p in cell for x in p.pieces), {})
            cells.append([Paragraph([Piece(text, (self._rev("ins"),), fmt)] if text else [], copied(cell[0].props) if cell else {}, (self._rev("ins"),))])
        row = Row(cells, self._rev("ins"), list(like.props), list(like.cell_props))
        table.rows.insert(index, row)
        return row

    def delete_row(self, row: Row) -> None:
        for cell in row.cells:
            self.delete_paragraphs(cell)
        row.mark = self._rev("del")

    def delete_table_row(self, table: Table, index: int) -> None:
        self.delete_row(self._row(table, index))

    def set_cell(self, cell: list[Paragraph], text: str) -> None:
        self.set_text(cell[0], text)
        self.delete_paragraphs(cell[1:])

    # -- formatting -----------------------------------------------------------------

    def _format(self, pieces: list[Piece], props: dict) -> None:
        unknown = set(props) - set(CHARACTER_PROPS)
        if unknown:
            raise EditError(f"unknown character properties: {', '.join(sorted(unknown))}")
        if props.get("highlight") and str(props["highlight"]) not in HIGHLIGHTS:
            raise EditError(f"unknown highlight {props['highlight']!r}; one of {', '.join(HIGHLIGHTS)}")
        for x in pieces:
            if x.old_fmt is None:
                x.old_fmt, x.fmt_rev = dict(x.fmt), self._rev("rPrChange")
            x.fmt = {**x.fmt, **props}

    def format_text(self, p: Paragraph, start: int | None = None, end: int | None = None, **props) -> None:
        self._format(self._between(p, 0 if start is None else start, len(p.text) if end is None else end), props)

    def format_matching(self, needle: str, regex=False, count=None, **props) -> int:
        found = self._each(needle, regex, False, count)
        for p, s, e, _ in found:
            self.format_text(p, s, e, **props)
        return len(found)

    def format_paragraph(self, p: Paragraph, **props) -> None:
        unknown = set(props) - set(PARAGRAPH_PROPS)
        if unknown:
            raise EditError(f"unknown paragraph properties: {', '.join(sorted(unknown))}")
        if "alignment" in props and str(props["alignment"]).upper() not in ALIGNMENTS:
            raise EditError(f"unknown alignment {props['alignment']!r}")
        if p.old_props is None:
            p.old_props, p.prop_rev = dict(p.props), self._rev("pPrChange")
        p.props = {**p.props, **props}

    def style_names(self) -> list[str]:
        return sorted(self.styles.values())

    def style_id(self, name: str) -> str:
        """A style by its id or name, without regard to case, blanks and hyphens."""
        key = lambda x: x.replace(" ", "").replace("-", "").lower()
        for i, n in self.styles.items():
            if key(name) in (key(i), key(n)):
                return i
        raise EditError(f"there is no style {name!r}; one of {', '.join(self.style_names())}")

    def style_name(self, p: Paragraph) -> str | None:
        """The name of a paragraph's style, as it is shown; without one, the default's."""
        own = p.props.get("style")
        if own is None or self.styles and own not in self.styles:
            own = self.default_style
        name = self.styles.get(own, own)
        return name[0].upper() + name[1:] if name and re.fullmatch("heading [1-9]|caption|header|footer", name) else name

    def apply_style(self, p: Paragraph, name: str) -> None:
        self.format_paragraph(p, style=self.style_id(name))

    # -- comments -----------------------------------------------------------------

    def comment(self, p: Paragraph, text: str, start: int | None = None, end: int | None = None, author: str | None = None, initials: str | None = None) -> dict:
        name = author or self.author
        row = {"id": max((c["id"] for c in self.comments), default=-1) + 1, "paragraph": p, "start": start, "end": end, "author": name, "initials": initials or plain.initials(name), "date": self.date, "text": text}
        first, last = (0, len(p.pieces)) if start is None else (self.split(p, start), None)
        if last is None:
            last = self.split(p, len(p.text) if end is None else end)
            first = self.split(p, start)
        p.pieces[last:last] = [Piece("", opaque=Anchor("commentRangeEnd", row["id"])), Piece("", opaque=Anchor("commentReference", row["id"]))]
        p.pieces.insert(first, Piece("", opaque=Anchor("commentRangeStart", row["id"])))
        self.comments.append(row)
        p.comments.append(row["id"])
        return row

    # -- what is tracked ------------------------------------------------------------

    def _listed(self) -> list[Revision]:
        """All revisions in document order: of a paragraph its mark, its properties, its text."""
        out, place, seen = [], -1, set()

        def add(rev, kind, text, part, n):
            if id(rev) not in seen:
                seen.add(id(rev))
                out.append(Revision(kind, rev.author, rev.date, text, n, rev.id, part, rev.move, rev))

        rows = set()
        for part, p, _, row in self.walk(self.stories):
            place += 1
            if row is not None and row.mark is not None and id(row) not in rows:
                rows.add(id(row))
                add(row.mark, f"row-{'insert' if row.mark.kind == 'ins' else 'delete'}", " | ".join(row.texts), part, place)
            for rev in p.mark:
                add(rev, {"ins": "paragraph-mark-insert", "del": "paragraph-mark-delete", "moveFrom": "move-from", "moveTo": "move-to"}[rev.kind], "", part, place)
            if p.prop_rev:
                add(p.prop_rev, "format:pPrChange", p.text, part, place)
            texts: dict[int, str] = {}
            changed = [x for x in p.pieces if x.revs or x.fmt_rev]
            for x in changed:
                for rev in x.revs:
                    texts[id(rev)] = texts.get(id(rev), "") + x.text
            for x in changed:
                for rev in x.revs:
                    add(rev, {"ins": "insert", "del": "delete", "moveFrom": "move-from", "moveTo": "move-to"}[rev.kind], texts[id(rev)], part, place)
                if x.fmt_rev:
                    add(x.fmt_rev, "format:rPrChange", x.text, part, place)
        return out

    def revisions(self) -> list[Revision]:
        return [r for r in self._listed() if self._kind(r.part) in self.scope]

    def summary(self, limit: int | None = None) -> str:
        rows = self.revisions()
        kinds, authors = Counter(r.kind for r in rows), Counter(r.author for r in rows)
        lines = [f"{len(rows)} tracked changes", *(f"  {k}: {n}" for k, n in sorted(kinds.items())), *(f"  by {a}: {n}" for a, n in sorted(authors.items()))]
        shown = rows if limit is None else rows[:limit]
        lines += [f"  [{r.kind}] {r.text if len(r.text) <= 90 else r.text[:87] + '...'}" for r in shown]
        return "\n".join(lines + ([f"  ... and {len(rows) - len(shown)} more"] if len(shown) < len(rows) else []))

    # -- accepting and rejecting ----------------------------------------------------

    def _chosen(self, ids=None, authors=None, kinds=None, where: Callable[[Revision], bool] | None = None) -> set[int] | None:
        """Identities of the selected changes, both halves of a move; None selects all."""
        if ids is None and authors is None and kinds is None and where is None:
            return None
        many = lambda x: None if x is None else {str(x)} if isinstance(x, (str, int)) else {str(v) for v in x}
        ids, authors, kinds = many(ids), many(authors), many(kinds)
        family = {"format": lambda k: k.startswith("format:"), "move": lambda k: k.startswith("move-"), "insert-any": lambda k: k.endswith("insert"), "delete-any": lambda k: k.endswith("delete")}
        rows = self.revisions()
        picked = [r for r in rows if (ids is None or r.id in ids) and (authors is None or r.author in authors) and (kinds is None or any(r.kind == k or family.get(k, lambda _: False)(r.kind) for k in kinds)) and (where is None or where(r))]
        names = {r.move for r in picked if r.move}
        return {id(r.rev) for r in picked} | {id(r.rev) for r in rows if r.move in names}

    def accept(self, **select) -> None:
        self._resolve(True, self._chosen(**select))

    def reject(self, **select) -> None:
        self._resolve(False, self._chosen(**select))

    def _resolve(self, keep: bool, chosen: set[int] | None) -> None:
        """Properties, content, rows, and paragraph marks, in this order."""
        mine = lambda rev: rev is not None and (chosen is None or id(rev) in chosen)
        stays = lambda rev: (rev.kind in ADDED) == keep
        parts = [part for part in self.stories if self._kind(part) in self.scope]
        for _, p, _, _ in self.walk(parts):
            if mine(p.prop_rev):
                p.props, p.old_props, p.prop_rev = (p.props if keep else p.old_props), None, None
            kept = []
            for x in p.pieces:
                if not x.revs and x.fmt_rev is None:
                    kept.append(x)
                    continue
                if mine(x.fmt_rev):
                    x.fmt, x.old_fmt, x.fmt_rev = (x.fmt if keep else x.old_fmt), None, None
                revs, gone = [], False
                for rev in reversed(x.revs):  # the innermost first
                    if not mine(rev):
                        revs.append(rev)
                    elif not stays(rev):
                        gone = True
                        break
                if not gone:
                    x.revs = tuple(reversed(revs))
                    kept.append(x)
            p.pieces = kept
        for table in self.tables():
            table.rows = [r for r in table.rows if not (mine(r.mark) and not stays(r.mark))]
            for r in table.rows:
                if mine(r.mark):
                    r.mark = None
        for part, blocks in list(self._lists(parts)):
            blocks[:] = [b for b in blocks if not (isinstance(b, Table) and not b.rows)]
            self._resolve_marks(blocks, keep, mine, stays)

    @staticmethod
    def _resolve_marks(blocks: list, keep: bool, mine, stays) -> None:
        i = 0
        while i < len(blocks):
            p = blocks[i]
            if not isinstance(p, Paragraph) or not any(mine(r) for r in p.mark):
                i += 1
                continue
            lost = [r for r in p.mark if mine(r) and not stays(r)]
            p.mark = tuple(r for r in p.mark if not mine(r))
            if not lost:
                i += 1
                continue
            following = blocks[i + 1] if i + 1 < len(blocks) else None
            previous = blocks[i - 1] if i else None
            if isinstance(following, Paragraph):  # the content runs into the next one, which keeps its own properties
                following.pieces[:0] = p.pieces
                del blocks[i]
            elif not keep and lost[0].kind in ADDED and isinstance(previous, Paragraph):
                previous.pieces += p.pieces
                del blocks[i]
            elif not p.pieces and len(blocks) > 1:
                del blocks[i]
            else:
                i += 1

    # -- clauses ------------------------------------------------------------------------

    def clauses(self) -> list[Clause]:
        """The tree's sections; paragraphs whose mark goes away don't count."""
        roots, stack = [], []
        for _, p, _, _ in self.walk(("body",)):
            text = "" if p.going else p.text
            found = plain.parse_label(text)
            if not found:
                continue
            label, s, e, end = found
            c = Clause(p, label, (s, e), plain.title_of(text, end), any(r.kind == "ins" for r in p.mark), any(r.kind == "moveTo" for r in p.mark))
            depth = label.count(".")
            while stack and stack[-1][0] >= depth:
                stack.pop()
            if stack:
                c.parent = stack[-1][1]
                c.parent.children.append(c)
            else:
                roots.append(c)
            stack.append((depth, c))
        return roots

    def all_clauses(self) -> list[Clause]:
        return [c for root in self.clauses() for c in root.walk()]

    def clause(self, label: str) -> Clause:
        """The clause of a label; of several, one that was there before."""
        found = [c for c in self.all_clauses() if c.label == label]
        if not found:
            raise ClauseError(f"there is no clause {label}")
        return min(found, key=lambda c: c.inserted or c.moved)

    # -- quoted edits -----------------------------------------------------------------------

    def fingerprint(self) -> str:
        import hashlib

        return hashlib.sha256("\n".join(p.text for p in self.paragraphs()).encode()).hexdigest()[:16]

    def apply_edits(self, items: list[dict], fingerprint: str | None = None) -> list[dict]:
        """Locate all, claim first come first served, then write from the right; notes last.

        items: para_id, target, replacement (an edit) or body (a note), occurrence.
        A result each, in order: item, applied, rejection, spans.
        """
        if fingerprint is not None and fingerprint != self.fingerprint():
            raise StalePlan("the document has changed since the edits were made for it")
        paras = self.paragraphs()
        at = lambda i: paras[i] if 0 <= i < len(paras) else None
        claimed: dict[int, list] = {}
        out, writes = [], []
        for x in items:
            row = {"item": x, "applied": False, "rejection": None, "spans": []}
            out.append(row)
            if "body" in x:
                continue
            p = at(x["para_id"])
            spans, why = plain.locate(p and p.text, p.all_text if p else "", x["target"], x.get("occurrence", 1))
            own = claimed.setdefault(x["para_id"], [])
            if not why and any(s < hi and lo < e for s, e in spans for lo, hi in own):
                why = "span_conflict"
            if why:
                row["rejection"] = why
                continue
            own += spans
            row |= {"applied": True, "spans": spans}
            writes += [(x["para_id"], s, e, x) for s, e in spans]
        for para_id, s, e, x in sorted(writes, key=lambda w: w[:2], reverse=True):
            self.replace_range(paras[para_id], s, e, x["replacement"], x.get("insertion_first", False))
        for row in out:
            x = row["item"]
            if "body" not in x:
                continue
            p = at(x["para_id"])
            if p is None:
                row["rejection"] = "paragraph_not_found"
                continue
            spans, why = plain.locate(p.text, p.all_text, x.get("target") or "", x.get("occurrence", 1))
            row |= {"applied": True, "rejection": why, "spans": spans}  # with a reason, it hangs on the paragraph
            for s, e in spans or [(None, None)]:
                self.comment(p, x["body"], s, e, author=x.get("agent"))
        return out


def from_texts(texts: Iterable[str | list[list[str]]], **how) -> Document:
    """A document of plain paragraphs; a list of rows is a table."""
    def block(x):
        if isinstance(x, str):
            return Paragraph([Piece(x)] if x else [])
        return Table([Row([[Paragraph([Piece(c)] if c else [])] for c in row]) for row in x])

    return Document({"body": [block(x) for x in texts]}, **how)


OP_KEYS = S.OPS
