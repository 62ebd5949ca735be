"""Token ids in Arrow files of fixed-size lists.

Documents in id order make one stream of ids. It is dealt to shards by ranges of
ids, and each shard cuts its part into sequences of `length` ids, the last one
padded. A shard is one Arrow file (the random-access format): each record batch
has `rows` sequences as fixed-size lists of ids and of mask bits, so the i-th
sequence is found by arithmetic, and both are views of the memory-mapped file, the
mask of its packed bits. Where documents begin stands in a second Arrow file of the
shard (doc_id, start, n_tokens, counted from the shard's first id). Neither holds more
than one shard in memory: batches are written as they fill.

A task writes a shard's two files under one name of its own attempt and returns it;
only the names of attempts that succeeded reach the driver, which publishes them in
one manifest. What repeated, speculative or lost attempts leave is in no manifest.

Defined results: a null or empty text is its end id alone; repeated ids stand next
to each other, by hash of the text and text; rows without an id come first; an empty
table makes no shard and an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, partitions_of, rows_of, scratch
from .tokens import encoder, vocabulary

LENGTH, ROWS = 2048, 256
END_ID = 2
SHARD = "shard int, name string, n_docs long, n_tokens long"
MANIFEST = "manifest.json"


def filesystem(uri: str):
    """The file system of a URI that Spark knows, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@dataclass
class ShardWriter:
    """Writes a shard: ids come document by document, batches leave as they fill."""

    uri: str
    shard: int
    dtype: str
    length: int = LENGTH
    rows: int = ROWS

    def __post_init__(self) -> None:
        import uuid

        self.fs, base = filesystem(self.uri)
        self.fs.create_dir(base, recursive=True)
        if self.length % 8:
            raise ValueError("a sequence's length must be a multiple of 8, so that its mask begins at a byte")
        self.name = f"{self.shard:06d}-{uuid.uuid4().hex[:12]}"
        ids = pa.list_(pa.from_numpy_dtype(np.dtype(self.dtype)), self.length)
        self.schema = pa.schema([("ids", ids), ("mask", pa.list_(pa.bool_(), self.length))])
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = {kind: self.fs.open_output_stream(f"{base}/{self.name}.{kind}.arrow") for kind in ("tokens", "docs")}
        self.tokens = pa.ipc.new_file(self.sinks["tokens"], self.schema)
        self.index = pa.ipc.new_file(self.sinks["docs"], self.docs_schema)
        self.block, self.filled, self.total, self.docs, self.n_docs = np.zeros(self.rows * self.length, self.dtype), 0, 0, [], 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.total, len(ids)))
        self.n_docs += 1
        self.total += len(ids)
        while len(ids):
            n = min(len(ids), len(self.block) - self.filled)
            self.block[self.filled : self.filled + n] = ids[:n]
            self.filled, ids = self.filled + n, ids[n:]
            if self.filled == len(self.block):
                self._flush()
        if len(self.docs) >= 10_000:
            self._flush_docs()

    def _flush(self) -> None:
        rows = -(-self.filled // self.length)
        n = rows * self.length
        self.block[self.filled : n] = 0
        mask = pa.array(np.arange(n) < self.filled)
        lists = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(self.block[:n]), mask)]
        self.tokens.write_batch(pa.record_batch(lists, schema=self.schema))
        self.filled = 0

    def _flush_docs(self) -> None:
        columns = zip(*self.docs) if self.docs else ((), (), ())
        self.index.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in columns], schema=self.docs_schema))
        self.docs = []

    def close(self) -> tuple[int, str, int, int]:
        if self.filled:
            self._flush()
        self._flush_docs()
        self.tokens.close()
        self.index.close()
        for sink in self.sinks.values():
            sink.close()
        return self.shard, self.name, self.n_docs, self.total


class TokenShard:
    """Random access to a shard's sequences; on a local file nothing is copied."""

    def __init__(self, uri: str, name: str) -> None:
        fs, base = filesystem(uri)
        local = fs.type_name == "local"
        opened = [pa.memory_map(x) if local else fs.open_input_file(x) for x in (f"{base}/{name}.tokens.arrow", f"{base}/{name}.docs.arrow")]
        self.tokens, self.docs = (pa.ipc.open_file(x) for x in opened)
        self.length = self.tokens.schema.field("ids").type.list_size
        self.rows = self.tokens.get_batch(0).num_rows if self.tokens.num_record_batches else 1

    def __len__(self) -> int:
        n = self.tokens.num_record_batches
        return (n - 1) * self.rows + self.tokens.get_batch(n - 1).num_rows if n else 0

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and packed mask bits (least first; see `unpacked`) of the i-th sequence, both views of the file."""
        batch, k = self.tokens.get_batch(i // self.rows), i % self.rows
        bits = np.frombuffer(batch.column("mask").values.buffers()[1], np.uint8)
        ids = batch.column("ids").values.to_numpy(zero_copy_only=True)
        return ids[k * self.length : (k + 1) * self.length], bits[k * self.length // 8 : (k + 1) * self.length // 8]

    def stream(self, start: int, n: int) -> np.ndarray:
        """`n` ids of the shard's stream from `start` on, over batch ends."""
        parts, size = [], self.rows * self.length
        while n:
            values = self.tokens.get_batch(start // size).column("ids").values.to_numpy(zero_copy_only=True)
            parts.append(values[start % size : start % size + n])
            start, n = start + len(parts[-1]), n - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint32)

    def documents(self) -> Iterator[tuple[int, int, int]]:
        for i in range(self.docs.num_record_batches):
            yield from rows_of([self.docs.get_batch(i)], "doc_id", "start", "n_tokens")


def unpacked(bits: np.ndarray) -> np.ndarray:
    """A sequence's mask as booleans."""
    return np.unpackbits(bits, bitorder="little").view(bool)


def manifest(uri: str) -> list[tuple[int, str, int, int]]:
    """What `write_tokens` has published: (shard, name, n_docs, n_tokens) of each shard, in order."""
    fs, base = filesystem(uri)
    with fs.open_input_stream(f"{base}/{MANIFEST}") as f:
        return [tuple(x) for x in json.loads(f.read())]


def write_tokens(docs: DataFrame, uri: str, path: str, cut: str = "space", end_id: int = END_ID, length: int = LENGTH, rows: int = ROWS, shards: int | None = None) -> list[tuple[int, str, int, int]]:
    """Write the ids of (doc_id, text) in id order and publish the manifest, a few bytes a shard, which is returned.

    Ranges of ids make the shards, so no task holds more than its range and their
    order is the ids' order.
    """
    ranged = docs.select("doc_id", "text").repartitionByRange(shards or partitions_of(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def write(batches):
        from pyspark import TaskContext

        enc, out = encoder(path, cut), None
        dtype = "<u2" if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            out = out or ShardWriter(uri, TaskContext.get().partitionId(), dtype, length, rows)
            out.add(doc_id, np.append(enc.encode(text), np.uint32(end_id)))
        done = [out.close()] if out else []
        yield pa.RecordBatch.from_pylist([dict(zip(("shard", "name", "n_docs", "n_tokens"), x)) for x in done], schema=pa.schema([("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    done = sorted(tuple(r) for r in ranged.mapInArrow(write, SHARD).collect())
    fs, base = filesystem(uri)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/{MANIFEST}") as f:
        f.write(json.dumps(done).encode())
    return done


def read_tokens(spark: SparkSession, uri: str) -> DataFrame:
    """A row for each document, read from the published files: doc_id, start in the whole stream, n_tokens, ids_crc32."""
    before, rows = 0, []
    for _, name, _, n_tokens in manifest(uri):
        rows.append((len(rows), name, before))
        before += n_tokens
    out_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        for name, before in rows_of(batches, "name", "before"):
            file, found = TokenShard(uri, name), []
            for doc_id, start, n in file.documents():
                found.append((doc_id, before + start, n, zlib.crc32(file.stream(start, n).astype("<u4").tobytes())))
                if len(found) == 10_000:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], schema=out_schema)
                    found = []
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], schema=out_schema)

    plan = spark.createDataFrame(rows, "place int, name string, before long").repartitionById(max(1, len(rows)), "place")
    return plan.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = scratch(spark, "tokens")
    write_tokens(documents(spark, sf_dir), uri, vocabulary("byte_bpe_50k.json"))
    return read_tokens(spark, uri)
