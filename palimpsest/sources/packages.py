"""Tables of document packages: read many, change each, write them again."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schema as S
from ..operators.document import Document, Table
from . import ooxml


def packages(spark: SparkSession, path: str) -> DataFrame:
    """path, content, doc_id of the packages below a path; any file system that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content", F.xxhash64("path").alias("doc_id"))


def paragraph_rows(doc: Document, doc_id: int) -> Iterator[dict]:
    """Rows of a document's paragraphs with their pieces, in order over all stories."""
    tables = {id(t): i for i, t in enumerate(doc.tables())}
    for n, (part, p, table, row) in enumerate(doc.walk()):
        at = (None, None)
        if isinstance(table, Table) and row is not None:
            at = (next(i for i, r in enumerate(table.rows) if r is row), next(i for i, cell in enumerate(row.cells) if any(x is p for x in cell)))
        pieces = [{"seq": k, "text": x.text, "rev_stack": [{"kind": r.kind, "id": r.id, "author": r.author, "date": r.date, "move_name": r.move} for r in x.revs], "bold": x.fmt.get("bold"), "italic": x.fmt.get("italic"), "underline": x.fmt.get("underline"), "color": x.fmt.get("color"), "highlight": x.fmt.get("highlight"), "fmt_old": None if x.old_fmt is None else repr(x.old_fmt)} for k, x in enumerate(p.pieces)]
        yield {"doc_id": doc_id, "part": part, "para_id": n, "text": p.text, "style": doc.style_name(p), "level": p.heading, "table_index": tables.get(id(table)), "row": at[0], "col": at[1], "mark": p.mark[-1].kind if p.mark else None, "pieces": pieces}


def paragraphs(files: DataFrame) -> DataFrame:
    """The paragraph table of a table of packages; a package at a time is in memory."""
    arrow = to_arrow_schema(S.PARAGRAPHS)

    def run(batches):
        for batch in batches:
            for doc_id, content in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist()):
                yield pa.RecordBatch.from_pylist(list(paragraph_rows(ooxml.read(content), doc_id)), schema=arrow)

    return files.select("doc_id", "content").mapInArrow(run, S.PARAGRAPHS)


REVISIONS = "doc_id long, seq int, rev_id string, kind string, author string, date string, text string, move_name string, part string"


def revisions(files: DataFrame) -> DataFrame:
    """The revision table of a table of packages."""
    schema = pa.schema([("doc_id", pa.int64()), ("seq", pa.int32()), *((n, pa.string()) for n in ("rev_id", "kind", "author", "date", "text", "move_name", "part"))])

    def run(batches):
        for batch in batches:
            for doc_id, content in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist()):
                rows = [{"doc_id": doc_id, "seq": i, "rev_id": r.id, "kind": r.kind, "author": r.author, "date": r.date, "text": r.text, "move_name": r.move, "part": r.part} for i, r in enumerate(ooxml.read(content).revisions())]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("doc_id", "content").mapInArrow(run, REVISIONS)


def changed(files: DataFrame, change: Callable[[Document, int], None], **how) -> DataFrame:
    """doc_id, content of each package after `change` has had its document; error where it failed."""
    schema = pa.schema([("doc_id", pa.int64()), ("content", pa.binary()), ("error", pa.string())])

    def run(batches):
        for batch in batches:
            for doc_id, content in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist()):
                try:
                    doc = ooxml.read(content, **how)
                    change(doc, doc_id)
                    row = {"doc_id": doc_id, "content": ooxml.write(doc), "error": None}
                except ValueError as why:  # an edit that this document doesn't admit; the others go on
                    row = {"doc_id": doc_id, "content": content, "error": str(why)}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return files.select("doc_id", "content").mapInArrow(run, "doc_id long, content binary, error string")


def save(files: DataFrame, uri: str) -> None:
    """Write each package to <uri>/<doc_id>.docx, a file at a time, by rename."""
    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for doc_id, content in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist()):
                own = f"{base}/_{doc_id}-{uuid.uuid4().hex[:12]}.part"  # of this attempt alone
                with store.open_output_stream(own) as out:
                    out.write(content)
                store.move(own, f"{base}/{doc_id}.docx")
        yield pa.RecordBatch.from_pylist([], schema=pa.schema([("n", pa.int64())]))

    files.select("doc_id", "content").mapInArrow(run, "n long").count()


def resolve(files: DataFrame, accept: bool, **select) -> DataFrame:
    """Packages after their selected changes are accepted, or rejected."""
    return changed(files, lambda doc, _: (doc.accept if accept else doc.reject)(**select))
