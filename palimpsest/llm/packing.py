"""Packing documents into sequences by linear grouping.

The scheme is Fernandez de la Vega and Lueker's. Only a histogram of lengths (at
most `capacity` numbers, whatever the corpus) comes to the driver:

1. Large lengths (over capacity / 16) are sorted and cut into groups of equal
   cardinality; each is rounded up to its group's largest.
2. Configurations of the few rounded sizes are optimised by column generation over
   a linear programme; the whole parts of its solution are taken.
3. Actual lengths are substituted in descending order, which leaves each bin at
   least the room that the rounding assumed.
4. The large lengths that the fractional rest leaves, and then the small ones, go
   best-fit into what room there is, in descending order.

Bins with equal contents are one row of the plan with a count, and pieces are given
to them by rank among the pieces of their length. So the plan's size depends on
the capacity, not on the corpus, and is broadcast under that bound.

Defined results: a null or empty text is its end id alone; repeated rows are
packed as often as they occur (their ids may repeat); an empty table gives an
empty result; other columns are ignored. Nothing is cut but documents longer than
the capacity.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, rows_of, written
from .tokens import encoder, vocabulary

CAPACITY, END_ID = 4096, 1
GROUPS, SMALL = 96, 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, path: str, cut: str = "words", end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each document's ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut_up(batches):
        enc = encoder(path, cut)
        for batch in batches:
            rows = []
            for doc_id, text in rows_of([batch], "doc_id", "text"):
                ids = np.append(enc.encode(text), np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(cut_up, PIECES)


class Bins:
    """Classes of equal bins: contents (length, how many) in order, room, and a count."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.by_room, self.rooms = capacity, defaultdict(list), []

    def put(self, contents: tuple, room: int, count: int) -> None:
        if count:
            if not self.by_room[room]:
                heapq.heappush(self.rooms, room)
            self.by_room[room].append((contents, count))

    def best(self, length: int) -> int | None:
        """The least room that holds `length`; rooms are few (at most the capacity)."""
        return min((r for r, bins in self.by_room.items() if bins and r >= length), default=None)

    def fit(self, length: int, n: int) -> None:
        """Best-fit `n` pieces of a length: each bin it picks is then the tightest, and so is filled up."""
        while n:
            room = self.best(length)
            contents, count = self.by_room[room].pop() if room is not None else ((), n)
            room = self.capacity if room is None else room
            each = min(room // length, n)
            whole = min(count, n // each)
            self.put((*contents, (length, each)), room - each * length, whole)
            n -= whole * each
            if contents:
                self.put(contents, room, count - whole)

    def classes(self) -> list[tuple[tuple, int]]:
        return [x for room in sorted(self.by_room) for x in self.by_room[room]]


def _best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """Unbounded knapsack: the configuration of the largest value."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    for k, (s, v) in enumerate(zip(sizes, values)):
        if v <= 1e-12:
            continue
        for _ in range(capacity // s):  # each pass lets one more of this size in
            with_it = best[:-s] + v
            better = with_it > best[s:] + 1e-12
            if not better.any():
                break
            best[s:] = np.where(better, with_it, best[s:])
            took[s:] = np.where(better, k, took[s:])
    config, c = np.zeros(len(sizes), int), int(np.argmax(best))
    value, left = best[c], c
    while left > 0 and took[left] >= 0:
        config[took[left]] += 1
        left -= sizes[took[left]]
    return config, float(value)


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 600) -> list[tuple[np.ndarray, float]]:
    """Configurations with (fractional) multiplicities that cover the demand in the fewest bins.

    Column generation; it stops at the optimum or after `rounds` columns, when the
    solution at hand is feasible all the same.
    """
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.linalg.inv(columns)
    amount = inverse @ demand
    for _ in range(rounds):
        new, value = _best_configuration(sizes, inverse.sum(axis=0), capacity)
        if value <= 1 + 1e-7:
            break
        direction = inverse @ new
        steps = np.where(direction > 1e-9, amount / np.where(direction > 1e-9, direction, 1), np.inf)
        k = int(np.argmin(steps))
        columns[:, k] = new
        inverse = np.linalg.inv(columns)
        amount = np.maximum(inverse @ demand, 0)
    return [(columns[:, k].astype(int), amount[k]) for k in range(len(sizes))]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[tuple, int]]:
    """Classes of bins for so many pieces of each length: ((length, how many), ...), count."""
    bins = Bins(capacity)
    bins.put(((capacity, 1),), 0, histogram.get(capacity, 0))
    large = sorted((x for x in histogram if capacity > x > capacity // SMALL), reverse=True)
    left = {x: histogram[x] for x in large}
    n = sum(left.values())
    if n:
        # Groups of equal cardinality, along the descending lengths; a length may lie in two.
        bounds, queue, members = [round(n * g / groups) for g in range(groups + 1)], list(large), []
        room = dict(left)
        for g in range(groups):
            need, own = bounds[g + 1] - bounds[g], []
            while need:
                take = min(need, room[queue[0]])
                own.append([queue[0], take])
                need -= take
                room[queue[0]] -= take
                if not room[queue[0]]:
                    queue.pop(0)
            if own:
                members.append(own)
        sizes: dict[int, list] = {}
        for own in members:  # groups that round to one size are one size
            sizes.setdefault(own[0][0], []).extend(own)
        names = np.array(list(sizes))
        found = configurations(names, np.array([sum(k for _, k in sizes[s]) for s in names], float), capacity)
        for config, amount in sorted(found, key=lambda x: -x[1]):
            count = int(amount + 1e-6)
            slots = [int(s) for s, k in zip(names, config) for _ in range(k)]
            for s, k in zip(names, config):
                if k:
                    count = min(count, sum(x for _, x in sizes[int(s)]) // int(k))
            while count:
                # As many bins as have the same actual lengths in every slot.
                need = {s: slots.count(s) for s in set(slots)}
                heads = {s: next(x for x in sizes[s] if x[1]) for s in need}
                same = min([count, *(h[1] // need[s] for s, h in heads.items())])
                if not same:  # a slot's lengths change within one bin
                    contents = []
                    for s in slots:
                        head = next(x for x in sizes[s] if x[1])
                        head[1] -= 1
                        left[head[0]] -= 1
                        contents.append((head[0], 1))
                    bins.put(tuple(contents), capacity - sum(x for x, _ in contents), 1)
                    count -= 1
                    continue
                for s, h in heads.items():
                    h[1] -= same * need[s]
                    left[h[0]] -= same * need[s]
                contents = tuple((h[0], need[s]) for s, h in heads.items())
                bins.put(contents, capacity - sum(x * k for x, k in contents), same)
                count -= same
    for length in large:
        bins.fit(length, left[length])
    for length in sorted((x for x in histogram if x <= capacity // SMALL), reverse=True):
        bins.fit(length, histogram[length])
    return bins.classes()


def places(classes: list[tuple[tuple, int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, how many in a sequence, first offset), sorted by length and rank."""
    ranks: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for contents, count in classes:
        offset = 0
        for length, each in contents:
            rows.append((length, ranks[length], sequence, each, offset))
            ranks[length] += each * count
            offset += length * each
        sequence += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, per_salt: int = 1_000_000) -> DataFrame:
    """The pieces (written, of any columns but with doc_id, piece, length) with sequence_id and offset.

    A piece's rank among those of its length is its rank within a salt, behind the
    counted salts before; so a hot length is dealt to many tasks.
    """
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    salts = max(16, sum(histogram.values()) // per_salt)
    table = spark.sparkContext.broadcast(places(plan(histogram, capacity, groups)))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1).join(before, ["length", "_salt"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        t = table.value
        keys = t[:, 0] * (1 << 48) + t[:, 1]
        row = t[np.searchsorted(keys, length.to_numpy() * (1 << 48) + rank.to_numpy(), side="right") - 1]
        k = rank.to_numpy() - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 2] + k // row[:, 3], "offset": row[:, 4] + k % row[:, 3] * row[:, 0]})

    return ranked.withColumn("_at", place("length", F.col("_rank") + F.col("_before"))).select(*pieces.columns, "_at.sequence_id", "_at.offset")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    pieces = written(pieces_of(docs, path or vocabulary("word_bpe_49k.json"), capacity=capacity), "pieces")
    return pack(pieces, capacity)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
