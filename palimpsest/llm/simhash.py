"""Near-duplicates: SimHash by bit-sliced comparison.

A fingerprint bit is the majority of that bit over the hashes of a text's word
shingles (XXH64; further words of a wide fingerprint are mixed from it).
Fingerprints link at `radius` or fewer differing bits.

Which are compared: a table is a choice of bits, and fingerprints that agree in all
of them share a bucket. The bits are cut into radius + 2 bands, and each pair of bands
is a table (`exact_tables`). Fingerprints that differ in at most `radius` bits agree in
two bands at least, so no link is lost.

Only distinct fingerprints take part, each as its least document. Buckets over
`TILE` members are dealt to tiles in which each pair of parts meets, so no group is
held by one task.

How: a block of fingerprints is stored as bit planes, a lane a fingerprint. The
distances of a query to all lanes are counted in vertical counters: carry-save
adders take three planes at a time. Counters start so that the (radius + 1)-th
difference overflows, and a query's row is abandoned once all lanes have. Small
buckets share a block: what it finds beyond a bucket is a link all the same. A block
gives a spanning forest of its links, so a dense group costs as many rows as it has
members; a component that fills much of a block is walked first, each member against
what isn't reached yet.

`palimpsest.llm.similar` builds near-duplicates by exact similarity of shingle sets on this.

Defined results: null and empty texts have no words and the fingerprint zero, which
links like any other; a text of fewer words than a shingle is one shingle; rows of
one id are one document; rows without an id get the component of their fingerprint,
null if no row with an id has it or links to it; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, documents, partitions_of, written
from .components import components

SEED = 42
SHINGLE, RADIUS = 3, 3
TILE, BLOCK = 4096, 512
ALL, ZERO = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)


def shingle_hashes(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of the text's words, A-Z lower-cased."""
    from xxhash import xxh64_intdigest as xxh

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - k + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[min(k, len(words)) - 1 :].tolist()
    return np.array([xxh(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype=np.uint64)


def more(hashes: np.ndarray, word: int) -> np.ndarray:
    """Hashes for a further word, by a 64-bit mixer."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * word & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """Words of bits set in over half of the hashes."""
    out = np.zeros(words, np.uint64)
    for w in range(words if len(hashes) else 0):
        mine, counts = (more(hashes, w) if w else hashes), np.zeros(64, np.int64)
        for part in np.array_split(mine, -(-len(mine) // 65536)):
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def columns_of(words: int) -> list[str]:
    return [f"f{w}" for w in range(words)]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, words: int = 1) -> DataFrame:
    """doc_id, f0, f1, ... (the fingerprint's words as signed longs)."""
    names = columns_of(words)
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names)])

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(shingle_hashes(x.as_py(), shingle), words) for x in batch.column("text")], np.uint64).reshape(-1, words)
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), *(pa.array(np.ascontiguousarray(fps[:, w]).view(np.int64)) for w in range(words))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} long" for n in ("doc_id", *names)))


def exact_tables(words: int, radius: int) -> list[list[int]]:
    """Masks of each table, a mask a word."""
    bands = np.linspace(0, 64 * words, radius + 3).astype(int).tolist()
    out = []
    for pair in combinations(list(zip(bands, bands[1:])), 2):
        mask = sum((1 << hi) - (1 << lo) for lo, hi in pair)
        out.append([mask >> 64 * w & (1 << 64) - 1 for w in range(words)])
    return out


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes (bits, lanes / 64) of fingerprints (n, words): lane j of word i is fingerprint 64 i + j."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")
    bits = np.pad(bits, ((0, -len(fps) % 64), (0, 0)))
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view(np.uint64)


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: sum and carry."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def links(queries: np.ndarray, planes: np.ndarray, n: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, masks): the queries (m, words) with a link and their lanes within the radius; lanes beyond n have none."""
    lanes, depth = planes.shape[1], max(1, radius.bit_length())
    over = np.zeros((len(queries), lanes), np.uint64)
    if n % 64:
        over[:, -1] = ALL << np.uint64(n % 64)
    spare = (1 << depth) - 1 - radius
    counter = [np.full_like(over, ALL if spare >> k & 1 else ZERO) for k in range(depth)]
    rows = np.arange(len(queries))
    ones = np.unpackbits(np.ascontiguousarray(queries).view(np.uint8), axis=1, bitorder="little")
    full = np.where(ones, ALL, ZERO)
    # Planes in which all lanes and all queries have the same bit never differ.
    lane_bits = np.concatenate((planes[:, :-1], planes[:, -1:] & ~over[:1, -1:], planes[:, -1:] | over[:1, -1:]), axis=1)
    same = ((lane_bits[:, : lanes] == ZERO).all(axis=1) & ~ones.any(axis=0)) | ((np.delete(lane_bits, lanes - 1, axis=1) == ALL).all(axis=1) & ones.all(axis=0))
    todo, seen = np.flatnonzero(~same).tolist(), 0

    def up(k: int, carry: np.ndarray) -> None:
        nonlocal over
        for i in range(k, depth):
            counter[i], carry = counter[i] ^ carry, counter[i] & carry
        over |= carry

    while todo:
        group, todo = todo[:3], todo[3:]
        d = [planes[p][None, :] ^ full[rows, p][:, None] for p in group]
        if len(d) == 3 and depth >= 2:
            total, carry = _add(*d)
            counter[0], low = counter[0] ^ total, counter[0] & total
            counter[1], carry = _add(counter[1], low, carry)
            up(2, carry)
        else:
            for x in d:
                up(0, x)
        seen += len(group)
        if seen > radius and (seen // 3) % 3 == 0:
            alive = (over != ALL).any(axis=1)
            if not alive.all():
                rows, over = rows[alive], over[alive]
                counter = [c[alive] for c in counter]
                if not len(rows):
                    break
    return rows, ~over


def lanes_of(mask: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little")[:n])


def _walk(fps: np.ndarray, start: int, left: np.ndarray, radius: int, block: int, out: list) -> np.ndarray:
    """Reach the component of `start`; `left` are the others not reached yet, and what isn't in the end is returned."""
    frontier = [start]
    while frontier and len(left):
        now, frontier = np.array(frontier[:block]), frontier[block:]
        rows, masks = links(fps[now], planes_of(fps[left]), len(left), radius)
        reached = np.zeros(len(left), bool)
        for row, mask in zip(rows.tolist(), masks):
            near = lanes_of(mask, len(left))
            near = near[~reached[near]]
            reached[near] = True
            out += [(int(now[row]), int(x)) for x in left[near]]
            frontier += left[near].tolist()
        left = left[~reached]
    return left


def forest(fps: np.ndarray, radius: int = RADIUS, block: int = BLOCK) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints (n, words), as index pairs."""
    left, out = np.arange(len(fps)), []
    while len(left) > 2 * block:  # components of at least a sixteenth of the rest, if the next one is such
        before = len(left)
        left = _walk(fps, int(left[0]), left[1:], radius, block, out)
        if before - len(left) < before // 16:
            break
    n, planes, root = len(left), planes_of(fps[left]), np.arange(len(left))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for at in range(0, n, block):
        rows, masks = links(fps[left[at : at + block]], planes, n, radius)
        for row, mask in zip((rows + at).tolist(), masks):
            near = lanes_of(mask, n)
            for other in near[near > row].tolist():
                a, b = find(row), find(other)
                if a != b:
                    out.append((int(left[row]), int(left[other])))
                    root[max(a, b)] = min(a, b)
    return out


def linked(prints: DataFrame, words: int, radius: int, tables: list[list[int]]) -> DataFrame:
    """prints: id, f0, ... of distinct fingerprints; gives links a, b of ids, a spanning forest of each block's.

    One shuffle brings a fingerprint to its bucket in each table. Buckets over TILE
    members are found beforehand by a pre-aggregated count; the rest needs no join.
    """
    names = columns_of(words)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = [F.xxhash64(F.lit(t), *(F.col(n).bitwiseAND(F.lit(signed(m))) for n, m in zip(names, masks) if m)) for t, masks in enumerate(tables)]
    keyed = prints.select("id", *names, F.explode(F.array(*keys)).alias("key"))
    large = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TILE), "buckets")
    small = large.count() * 24 <= BROADCAST_BYTES
    return met(keyed.join(F.broadcast(large) if small else large, "key", "left"), words, radius)


def met(members: DataFrame, words: int, radius: int) -> DataFrame:
    """members: key (of a bucket), n (its members, null for few), id, f0, ...; gives a, b as `linked`."""
    spark, names = members.sparkSession, columns_of(words)
    parted = members.withColumn("parts", F.coalesce(F.ceil(F.col("n") / TILE).cast("int"), F.lit(1))).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    tiles = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # A bucket's tile is a key of its own; equal 64-bit keys would only share a block.
    tile = F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")))
    spread = tiles.select("id", *names, tile.alias("tile")).repartition(partitions_of(spark), "tile").sortWithinPartitions("tile")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches):
        """Whole buckets of two and more gather until a block is full; one alone has nothing to meet."""
        def done(held):
            rows = np.unique(np.concatenate(held), axis=0)
            fps, ids = np.ascontiguousarray(rows[:, 1:]).view(np.uint64), rows[:, 0]
            pairs = np.array(forest(fps, radius), dtype=np.int64).reshape(-1, 2)
            return pa.record_batch([pa.array(ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]])], schema=schema)

        held, size, rest = [], 0, np.empty((0, words + 2), np.int64)
        for batch in and_end(batches):
            if batch is not None:
                rest = np.concatenate((rest, np.stack([batch.column(c).to_numpy() for c in ("id", *names, "tile")], axis=1)))
            cuts = np.flatnonzero(rest[1:, -1] != rest[:-1, -1]) + 1
            ends = cuts if batch is not None else np.append(cuts, len(rest))  # the last bucket may go on
            if not len(ends):
                continue
            starts = np.concatenate(([0], ends[:-1]))
            several = np.flatnonzero(ends - starts > 1)
            for k in several.tolist():
                held.append(rest[starts[k] : ends[k], :-1])
                size += len(held[-1])
                if size >= BLOCK:
                    yield done(held)
                    held, size = [], 0
            rest = rest[ends[-1] :]
        if held:
            yield done(held)

    return spread.mapInArrow(compare, "a long, b long")


def and_end(batches):
    """The batches that have rows, and then None."""
    yield from (b for b in batches if b.num_rows)
    yield None


def rooted(prints: DataFrame, least: DataFrame, names: list[str], edges: DataFrame) -> DataFrame:
    """prints with component_id; least: a row for each distinct print with its least doc_id, edges: of these."""
    rooted = least.join(components(edges), F.col("id") == F.col("node"), "left").select(*names, F.coalesce("root", "id").alias("component_id"))
    return prints.join(rooted, names)


def classes(prints: DataFrame, words: int = 1, radius: int = RADIUS) -> DataFrame:
    """prints: doc_id, f0, ... (written); adds component_id, the least doc_id that links reach."""
    names = columns_of(words)
    least = written(prints.groupBy(*names).agg(F.min("doc_id").alias("id")), "fingerprints")
    return rooted(prints, least, names, linked(least.filter("id IS NOT NULL"), words, radius, exact_tables(words, radius)))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, f0, component_id of each row; all links, over one word of bits."""
    return classes(written(fingerprints(docs, shingle), "prints"), 1, radius)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
