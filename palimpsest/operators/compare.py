"""Comparing two documents, and writing the difference as tracked changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import deepcopy
from dataclasses import asdict, dataclass
from difflib import SequenceMatcher
from itertools import zip_longest

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import plain
from .document import Anchor, Document, Paragraph, Row, Table, copied


@dataclass
class Stats:
    paragraphs_inserted: int = 0
    paragraphs_deleted: int = 0
    paragraphs_changed: int = 0
    rows_inserted: int = 0
    rows_deleted: int = 0
    cells_changed: int = 0

    def format(self) -> str:
        return ", ".join(f"{n.replace('_', ' ')}: {v}" for n, v in asdict(self).items())


def side_by_side(old: list, new: list, key: Callable, alike: Callable) -> Iterator[tuple[str, int | None, int | None]]:
    """Places of two lists in one order: equal, change and unlike (pairs), delete and insert (of one list alone).

    Between the longest common parts by key, what is left is paired in order; a pair that
    isn't alike is no change, but one thing for another.
    """
    for tag, i1, i2, j1, j2 in SequenceMatcher(None, list(map(key, old)), list(map(key, new)), autojunk=False).get_opcodes():
        for i, j in zip_longest(range(i1, i2), range(j1, j2)):
            if i is None or j is None:
                yield "insert" if i is None else "delete", i, j
            else:
                yield tag if tag == "equal" else "change" if alike(old[i], new[j]) else "unlike", i, j


def block_key(block: Paragraph | Table) -> str:
    """Text without regard to blanks; of a table only how many rows it has, as its rows are compared next."""
    return f"P:{plain.normalise(block.text)}" if isinstance(block, Paragraph) else f"T:{len(block.rows)}"


def row_key(row: Row) -> str:
    return " | ".join(map(plain.normalise, row.texts))


class Comparison:
    """Turns `doc` into `revised`: each list of blocks and rows is built anew from both, side by side."""

    def __init__(self, doc: Document, floor: float = S.SIMILARITY_FLOOR) -> None:
        self.doc, self.floor, self.stats = doc, floor, Stats()

    def run(self, revised: Document) -> Stats:
        self.doc.body[:] = self.merged(self.doc.body, revised.body, block_key)
        return self.stats

    def merged(self, old: list, new: list, key: Callable) -> list:
        out = []
        for kind, i, j in side_by_side(old, new, key, self.alike):
            if kind in ("equal", "change"):
                self.bring(old[i], new[j], kind == "change")
            elif i is not None:
                self.strike(old[i])
            if i is not None:
                out.append(old[i])
            if i is None or kind == "unlike":
                out.append(self.copy(new[j]))
        return out

    def alike(self, x, y) -> bool:
        """Whether one can be rewritten as the other: rows and tables always, paragraphs from the floor on."""
        if type(x) is not type(y):
            return False
        return not isinstance(x, Paragraph) or plain.similarity(x.text, y.text) >= self.floor

    def bring(self, x, y, changed: bool) -> None:
        if isinstance(x, Table):  # equal ones too, as their keys say little
            x.rows[:] = self.merged(x.rows, y.rows, row_key)
        elif isinstance(x, Paragraph):
            self.stats.paragraphs_changed += changed and bool(self.doc.set_text(x, y.text))
        elif changed:
            for cell, other in zip(x.cells, y.cells):
                was, now = ("\n".join(p.text for p in c) for c in (cell, other))
                if plain.normalise(was) != plain.normalise(now):
                    self.doc.set_cell(cell, now)
                    self.stats.cells_changed += 1

    def strike(self, x) -> None:
        if isinstance(x, Paragraph):
            self.doc.delete_paragraph(x)
            self.stats.paragraphs_deleted += 1
            return
        for row in x.rows if isinstance(x, Table) else [x]:
            self.doc.delete_row(row)
            self.stats.rows_deleted += 1

    def copy(self, x):
        """A copy that is tracked as put in."""
        if isinstance(x, Paragraph):
            self.stats.paragraphs_inserted += 1
            return self._paragraph(x)
        if isinstance(x, Table):
            return Table([self.copy(r) for r in x.rows], deepcopy(x.props))
        self.stats.rows_inserted += 1
        return Row([[self._paragraph(p) for p in cell] for cell in x.cells], self.doc._rev("ins"), list(x.props), list(x.cell_props))

    def _paragraph(self, p: Paragraph) -> Paragraph:
        new = Paragraph(deepcopy([x for x in p.pieces if x.shown and not isinstance(x.opaque, Anchor)]), copied(p.props), (self.doc._rev("ins"),), heading=p.heading)
        rev = self.doc._rev("ins")
        for x in new.pieces:
            x.revs, x.old_fmt, x.fmt_rev = (rev,), None, None
        return new


def compare_into(doc: Document, revised: Document, floor: float = S.SIMILARITY_FLOOR) -> Stats:
    return Comparison(doc, floor).run(revised)


ALIGNED = "pair_id long, kind string, old_id int, new_id int, similarity double"


def align(old: DataFrame, new: DataFrame, floor: float = S.SIMILARITY_FLOOR) -> DataFrame:
    """Paragraphs of two versions (pair_id, para_id, text) side by side.

    Both versions of a pair meet in one group, as an alignment needs all their keys in
    order; pairs spread over the cluster.
    """
    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("para_id"), b.sort_values("para_id")
        x, y = a["text"].tolist(), b["text"].tolist()
        p, q = a["para_id"].tolist(), b["para_id"].tolist()
        rows, same = [], {}

        def alike(u: str, v: str) -> bool:
            same["now"] = plain.similarity(u, v)
            return same["now"] >= floor

        for kind, i, j in side_by_side(x, y, plain.normalise, alike):
            left, right = (None if k is None else ids[k] for k, ids in ((i, p), (j, q)))
            if kind == "unlike":
                rows += [(key[0], "delete", left, None, same["now"]), (key[0], "insert", None, right, same["now"])]
            else:
                rows.append((key[0], kind, left, right, {"equal": 1.0, "change": same.get("now")}.get(kind)))
        return pd.DataFrame(rows, columns=["pair_id", "kind", "old_id", "new_id", "similarity"]).astype({"old_id": "Int32", "new_id": "Int32"})

    # New names' columns are new ones, so that two versions of one table can meet.
    cols = [F.col("pair_id").alias("p"), F.col("para_id").cast("int").alias("i"), F.coalesce("text", F.lit("")).alias("t")]
    # Little data, but much to do with it: a number of partitions of its own isn't merged by size.
    n = 2 * int(old.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (x.select(cols).toDF("pair_id", "para_id", "text").repartition(n, "pair_id") for x in (old, new))
    return left.groupBy("pair_id").cogroup(right.groupBy("pair_id")).applyInPandas(run, ALIGNED)
