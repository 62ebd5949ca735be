"""Interpolated modified Kneser-Ney bigram model in memory-mapped sorted arrays.

Counting, in Spark, over all training texts:

1. Words are hashed (XXH64); tasks sum their words, and buckets by the hash's top
   bits sum those. Each bucket is written as a sorted hash array with counts; a
   word's id is its place in all buckets.
2. Pairs of neighbouring ids are packed in 64 bits and mixed by a bijection, so that
   buckets by the top bits are even however hot a word is, and the pair can be read
   back. Each bucket is summed and written as a sorted array with counts.
3. From a bucket's distinct pairs come, by word, what it is followed by (count, pairs
   met once, twice, more often) and how many words it follows. These are summed by
   ranges of ids and written as plain arrays by id.

What moves between the steps are runs: sorted keys and their sums as binary
columns, for each bucket and some million tokens, so shuffles carry a few bytes a
distinct key. A row has some thousand keys at most: the JVM lays larger arrays apart,
which makes its heap grow. The driver gets a few numbers a bucket.

Scoring maps the arrays into memory (a store that isn't a local file system is read
bucket by bucket) and looks a batch's tokens up in sorted order.

P(w|v) = max(c(vw) - D, 0)/c(v) + gamma(v) P1(w); P1 is the same over the numbers of
words that w follows, down to the uniform 1/(V+1), so unknown words have a share. A
text is its lower-cased (A-Z) words between a start, which is only a context, and an
end, which is a token.

The order is two. Of the check's tables, trigrams would take some 75 M entries beside
45 M pairs; with the counts' shuffle that is more disk than the input four times.

Defined results: a null or empty text is its end alone; repeated rows count as often
as they occur; with nothing to learn from, both scores are 0; an empty table gives an
empty result; other columns are ignored. More than 2**32 - 4 words are an error.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold, partitions_of, rows_of, scratch

SEED = 42
#: Hashes of what no word can be.
END, START = b"\n", b" "
#: Tokens a task gathers before it gives its sums away; tokens that are looked up at once.
GATHER, LOOK_UP = 4_000_000, 1_000_000
#: Keys of runs that come together before they are merged; bytes of text whose counts make a bucket.
MERGE, BUCKET_BYTES = 2_000_000, 128 << 20
#: Keys in a row of runs, bytes in a batch of them, texts that are taken out of a batch at once.
PIECE, BATCH_BYTES, TEXTS = 1 << 14, 1 << 21, 256
MIX = np.uint64(0x9E3779B97F4A7C15)
UNMIX = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
HALF, LOW = np.uint64(32), np.uint64(0xFFFFFFFF)
RUN = "bucket int, keys binary, sums binary"
RUN_SCHEMA = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("sums", pa.binary())])
#: By id: c(v), pairs of v met once, twice, more often; words before it.
STATS = 5


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * MIX
    return (x ^ (x >> HALF)) * MIX


def unmixed(x: np.ndarray) -> np.ndarray:
    x = x * UNMIX
    return (x ^ (x >> HALF)) * UNMIX


def token_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words and its end."""
    from xxhash import xxh64_intdigest as xxh

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    words.append(END)
    return np.fromiter((xxh(w, SEED) for w in words), np.uint64, len(words))


def summed(keys: np.ndarray, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their sums (of rows if sums has two axes; of ones if there are none, and keys are sorted in place)."""
    if sums is None:
        keys.sort()
    else:
        order = np.argsort(keys, kind="stable")
        keys, sums = keys[order], sums[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    if sums is None:
        return keys[starts], np.diff(np.append(starts, len(keys))).astype(np.int64)
    return keys[starts], np.add.reduceat(sums, starts, axis=0, dtype=np.int64) if len(keys) else sums.astype(np.int64)


def narrow(sums: np.ndarray) -> np.ndarray:
    """Sums in as few bytes as their largest needs."""
    width = 1 if not sums.size or sums.max() < 1 << 8 else 2 if sums.max() < 1 << 16 else 4 if sums.max() < 1 << 32 else 8
    return np.ascontiguousarray(sums, f"<u{width}")


def _packed(sums: np.ndarray) -> bytes:
    """Narrowed sums behind a byte that says their width."""
    out = narrow(sums)
    return bytes([out.itemsize]) + out.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


def runs_of(keys: np.ndarray, sums: np.ndarray, cuts: np.ndarray):
    """Record batches of the runs: sorted keys cut by the buckets' last bounds, and in pieces."""
    rows, size = [], 0
    ends = np.searchsorted(keys, cuts, side="left").tolist() + [len(keys)]
    start = 0
    for bucket, end in enumerate(ends):
        for at in range(start, end, PIECE):
            to = min(at + PIECE, end)
            rows.append({"bucket": bucket, "keys": keys[at:to].tobytes(), "sums": _packed(sums[at:to])})
            size += len(rows[-1]["keys"]) + len(rows[-1]["sums"])
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=RUN_SCHEMA)
                rows, size = [], 0
        start = end
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=RUN_SCHEMA)


def counted(parts, cuts: np.ndarray):
    """Runs of keys that come in parts; some GATHER are summed at once."""
    held, size = [], 0

    def given():
        keys = np.concatenate(held)
        held.clear()
        return runs_of(*summed(keys), cuts)

    for keys in parts:
        held.append(keys)
        size += len(keys)
        if size >= GATHER:
            yield from given()
            size = 0
    if held:
        yield from given()


def hash_cuts(buckets: int) -> np.ndarray:
    """First hash of each bucket but the first."""
    return np.array([(1 << 64) * k // buckets for k in range(1, buckets)], np.uint64)


def _gathered(runs: DataFrame, buckets: int) -> DataFrame:
    """A bucket a task, by its number itself: a hash of it would put several into one."""
    return runs.repartitionById(buckets, "bucket")


def _buckets(batches, dtype):
    """(bucket, distinct keys, sums) of a task's gathered runs.

    Runs are merged whenever as much has come as is held, so that memory follows the
    distinct keys and not the number of runs.
    """
    held: dict[int, list] = {}  # keys and sums merged so far, and runs behind them
    behind: dict[int, int] = {}  # keys in those

    def merge(runs):
        return [summed(np.concatenate([k for k, _ in runs]), np.concatenate([x for _, x in runs]))]

    for bucket, keys, sums in rows_of(batches, "bucket", "keys", "sums"):
        runs = held.setdefault(bucket, [])
        runs.append((np.frombuffer(keys, dtype), _unpacked(sums)))
        behind[bucket] = behind[bucket] + len(runs[-1][0]) if len(runs) > 1 else 0
        if behind[bucket] > max(len(runs[0][0]), MERGE):
            held[bucket], behind[bucket] = merge(runs), 0
    for bucket in sorted(held):
        yield bucket, *merge(held.pop(bucket))[0]


def save(uri: str, name: str, array: np.ndarray) -> None:
    """Write an array's bytes; attempts write the same bytes under names of their own and rename."""
    import uuid

    from .token_files import filesystem

    fs, base = filesystem(uri)
    fs.create_dir(base, recursive=True)
    own = f"{base}/_{name}-{uuid.uuid4().hex[:12]}"
    with fs.open_output_stream(own) as out:
        out.write(np.ascontiguousarray(array).tobytes())
    try:
        fs.move(own, f"{base}/{name}")
    except OSError:
        fs.delete_file(own)
        if not fs.get_file_info(f"{base}/{name}").is_file:
            raise


class Arrays:
    """A folder's arrays: mapped where the file system is local, else read, a few at a time."""

    KEPT = 64

    def __init__(self, uri: str) -> None:
        from .token_files import filesystem

        self.fs, self.base = filesystem(uri)
        self.held: OrderedDict[str, np.ndarray] = OrderedDict()

    def get(self, name: str, dtype: str | None, n: int = 0) -> np.ndarray:
        """The array; without a dtype, unsigned ones of the width that makes them n."""
        if name in self.held:
            self.held.move_to_end(name)
            return self.held[name]
        path = f"{self.base}/{name}"
        size = self.fs.get_file_info(path).size
        dtype = dtype or f"<u{size // n if size else 1}"
        if not size:
            array = np.empty(0, dtype)
        elif self.fs.type_name == "local":
            array = np.memmap(path, dtype, "r")
        else:
            with self.fs.open_input_file(path) as f:
                array = np.frombuffer(f.read(), dtype)
        self.held[name] = array
        if self.fs.type_name != "local" and len(self.held) > self.KEPT:
            self.held.popitem(last=False)
        return array


@dataclass
class Model:
    """Where the arrays are, and the few numbers that go with them."""

    uri: str
    buckets: int
    offsets: list[int]  # of the buckets' words, and their number at last
    tokens: int
    discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    low_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    pairs: int = 0  # distinct ones
    followers: tuple[int, int, int] = (0, 0, 0)  # words that follow one word, two, more

    @property
    def words(self) -> int:
        return self.offsets[-1]


class Scorer:
    """Looks tokens up in a model's arrays."""

    def __init__(self, model: Model) -> None:
        self.m, self.arrays = model, Arrays(model.uri)
        self.cuts = hash_cuts(model.buckets)

    def _sorted_lookup(self, keys: np.ndarray, name: str, offsets=None) -> tuple[np.ndarray, np.ndarray]:
        """For sorted keys: their ids (-1 where absent) and counts (0 there)."""
        ids, counts = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        ends = np.searchsorted(keys, self.cuts, side="left").tolist() + [len(keys)]
        start = 0
        for b, end in enumerate(ends):
            if end > start:
                table = self.arrays.get(f"{name}-{b}.keys", "<u8")
                if len(table):
                    part = keys[start:end]
                    at = np.minimum(np.searchsorted(table, part), len(table) - 1)
                    hit = table[at] == part
                    ids[start:end] = np.where(hit, at + (offsets[b] if offsets else 0), -1)
                    counts[start:end] = np.where(hit, self.arrays.get(f"{name}-{b}.counts", None, len(table))[at], 0)
            start = end
        return ids, counts

    def _lookup(self, keys: np.ndarray, name: str, offsets=None) -> tuple[np.ndarray, np.ndarray]:
        distinct, back = np.unique(keys, return_inverse=True)
        ids, counts = self._sorted_lookup(distinct, name, offsets)
        return ids[back], counts[back]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._lookup(hashes, "words", self.m.offsets)

    def pair_counts(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        known = (before >= 0) & (word >= 0)
        counts = np.zeros(len(word), np.int64)
        if known.any():
            keys = mixed(before[known].astype(np.uint64) << HALF | word[known].astype(np.uint64))
            counts[known] = self._lookup(keys, "pairs")[1]
        return counts

    def stats(self, ids: np.ndarray, columns: slice) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the arrays by distinct id, zero for -1, and each id's row. An id's bucket is that of its word; the start has one of its own."""
        distinct, back = np.unique(ids, return_inverse=True)
        found = np.zeros((len(distinct), columns.stop - columns.start), np.int64)
        bounds = np.searchsorted(distinct, self.m.offsets + [self.m.words + 1])
        for b, (start, end) in enumerate(zip(bounds, bounds[1:])):
            if end > start:
                table = self.arrays.get(f"stats-{b}", "<u8").reshape(-1, STATS)
                found[start:end] = table[distinct[start:end] - self.m.offsets[b], columns]
        return found, back

    def probabilities(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """P(word | before) of ids, -1 for unknown words."""
        m = self.m
        if not m.pairs:
            return np.full(len(word), 1 / (m.words + 1))
        d, e = np.array((0.0, *m.discounts)), np.array((0.0, *m.low_discounts))
        found, at = self.stats(word, slice(4, 5))
        follows = found[:, 0]
        spare = (np.array(m.followers) * e[1:]).sum() / m.pairs
        low = (np.maximum(follows - e[np.minimum(follows, 3)], 0) / m.pairs + spare / (m.words + 1))[at]
        context, at = self.stats(before, slice(0, 4))
        seen = context[:, 0] > 0
        total = np.where(seen, context[:, 0], 1)
        gamma = np.where(seen, (context[:, 1:4] * d[1:]).sum(axis=1) / total, 1.0)
        c = self.pair_counts(before, word)
        return np.maximum(c - d[np.minimum(c, 3)], 0) / total[at] + gamma[at] * low

    def score(self, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text, of its token hashes: known tokens, base score, score."""
        m = self.m
        lengths = np.array([len(h) for h in hashes])
        ids, counts = self.words(np.concatenate(hashes))
        starts = np.cumsum(lengths) - lengths
        before = np.concatenate(([0], ids[:-1]))
        before[starts] = m.words  # the start's id
        log = np.log10(self.probabilities(before, ids))
        base = np.log10((counts + 1) / (m.tokens + m.words + 1))
        return tuple(np.add.reduceat(x, starts) for x in ((counts > 0).astype(np.int64), base, log))


_scorers: dict[str, Scorer] = {}


def scorer(model: Model) -> Scorer:
    """This worker's scorer; training has used it before the model had its last numbers."""
    if model.uri not in _scorers:
        _scorers.clear()
        _scorers[model.uri] = Scorer(model)
    _scorers[model.uri].m = model
    return _scorers[model.uri]


def _hash_groups(batches, most: int, *names: str):
    """(columns, token hashes) of rows, by groups of about `most` tokens; a long text is a group of its own."""
    rows, hashes, size = [], [], 0
    for batch in batches:
        for row in rows_of((batch.slice(at, TEXTS) for at in range(0, batch.num_rows, TEXTS)), *names, "text"):
            h = token_hashes(row[-1])
            rows.append(row[:-1])
            hashes.append(h)
            size += len(h)
            if size >= most:
                yield rows, hashes
                rows, hashes, size = [], [], 0
    if hashes:
        yield rows, hashes


def discounts_of(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts of the numbers of things met 1, 2, 3, 4 times; halves where these are too few."""
    if not all(n[:4]):
        return (0.5, 1.0, 1.5)
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(float(min(max((k + 1) - (k + 2) * y * n[k + 1] / n[k], 0.0), k + 1)) for k in range(3))


def train(texts: DataFrame, uri: str, buckets: int | None = None) -> Model:
    """Count the texts and write the model's arrays below uri, by default in a bucket for each BUCKET_BYTES and a partition at least."""
    spark = texts.sparkSession
    if not buckets:
        buckets = max(partitions_of(spark), (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES)
    cuts = hash_cuts(buckets)
    texts = texts.select("text")

    def count_words(batches):
        yield from counted((np.concatenate(hashes) for _, hashes in _hash_groups(batches, LOOK_UP)), cuts)

    def write_words(batches):
        for b, keys, sums in _buckets(batches, "<u8"):
            save(uri, f"words-{b}.keys", keys)
            save(uri, f"words-{b}.counts", narrow(sums))
            yield pa.RecordBatch.from_pylist([{"bucket": b, "words": len(keys), "tokens": int(sums.sum())}])

    sizes = {r[0]: r[1:] for r in _gathered(texts.mapInArrow(count_words, RUN), buckets).mapInArrow(write_words, "bucket long, words long, tokens long").collect()}
    offsets = np.cumsum([0] + [sizes.get(b, (0, 0))[0] for b in range(buckets)]).tolist()
    model = Model(uri, buckets, offsets, sum(t for _, t in sizes.values()))
    if model.words >= (1 << 32) - 4:
        raise ValueError("too many distinct words for 32-bit ids")
    if not model.tokens:
        return model

    def pairs(hashes):
        ids, _n = scorer(model).words(np.concatenate(hashes))
        lengths = np.array([len(h) for h in hashes])
        before = np.concatenate(([0], ids[:-1]))
        before[np.cumsum(lengths) - lengths] = model.words
        return mixed(before.astype(np.uint64) << HALF | ids.astype(np.uint64))

    def count_pairs(batches):
        yield from counted((pairs(hashes) for _, hashes in _hash_groups(batches, LOOK_UP)), cuts)

    firsts = np.array(offsets[1:], np.uint32)  # an id's bucket is its word's; the start is in one more

    stats_schema = pa.schema([*RUN_SCHEMA, ("met", pa.list_(pa.int64()))])
    met_schema = pa.schema([("met", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))])

    def write_pairs(batches):
        for b, keys, sums in _buckets(batches, "<u8"):
            save(uri, f"pairs-{b}.keys", keys)
            save(uri, f"pairs-{b}.counts", narrow(sums))
            met = [int((sums == k).sum()) for k in (1, 2, 3, 4)] + [len(keys)]
            yield pa.RecordBatch.from_pylist([{"bucket": b, "met": met}], schema=stats_schema)
            pair = unmixed(keys)
            v, w = (pair >> HALF).astype(np.uint32), (pair & LOW).astype(np.uint32)
            del pair, keys
            # By context a row of four, by word one number: a run of each, told apart by its width.
            order = np.argsort(v, kind="stable")
            v, sums = v[order], sums[order]
            starts = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
            after = np.stack([np.add.reduceat(x, starts, dtype=np.int64) for x in (sums, sums == 1, sums == 2, sums > 2)], axis=1)
            for ids, x in ((v[starts], after), summed(w)):
                for batch in runs_of(ids, x, firsts):
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.list_(pa.int64()))], schema=stats_schema)

    def write_stats(batches):
        tables: dict[int, np.ndarray] = {}
        for b, ids, sums, met in rows_of(batches, "bucket", "keys", "sums", "met"):
            if met:
                yield pa.RecordBatch.from_pylist([{"met": met}], schema=met_schema)
                continue
            first, last = (offsets[b], offsets[b + 1]) if b < buckets else (model.words, model.words + 1)
            if b not in tables:
                tables[b] = np.zeros((last - first, STATS), np.int64)
            at = np.frombuffer(ids, "<u4").astype(np.int64) - first
            x = _unpacked(sums).astype(np.int64).reshape(len(at), -1)
            tables[b][at, slice(0, 4) if x.shape[1] == 4 else slice(4, 5)] += x  # a run has an id once
        for b, table in tables.items():
            save(uri, f"stats-{b}", table.astype("<u8", copy=False))
            follows = table[:, 4]
            yield pa.RecordBatch.from_pylist([{"low": [int((follows == k).sum()) for k in (1, 2, 3, 4)] + [int((follows > 2).sum())]}], schema=met_schema)

    written_pairs = _gathered(texts.mapInArrow(count_pairs, RUN), buckets).mapInArrow(write_pairs, f"{RUN}, met array<long>")
    written_stats = _gathered(written_pairs, buckets + 1).mapInArrow(write_stats, "met array<long>, low array<long>")
    sums = written_stats.select([F.sum(F.col(c)[k]) for c in ("met", "low") for k in range(5)]).first()
    met, low = sums[:5], sums[5:]
    model.discounts, model.pairs = discounts_of(list(met[:4])), met[4]
    model.low_discounts, model.followers = discounts_of(list(low[:4])), (low[0], low[1], low[4])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (log10) of each text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches):
        for rows, hashes in _hash_groups(batches, LOOK_UP, "doc_id"):
            known, base, log = scorer(model).score(hashes)
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([len(h) for h in hashes], pa.int64()), pa.array(known), pa.array(base), pa.array(log)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.filter(fold(F.col("doc_id"), 7) != 2), scratch(spark, "model"))
    out = score(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
