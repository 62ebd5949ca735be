"""Near-duplicates by exact similarity: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

A fingerprint's distance only estimates that, and tables of its bits can't bring all
such pairs together at a bounded price: at 0.8 up to 0.1875 of the bits differ (a
set of four in one of five), so a table of 16 bits holds a pair with 0.036, and 370
tables would miss one in a million. The least of a hash over a set is that of another
with the probability of their similarity s, so bands of these make the buckets, and
bit-sliced SimHash compares within them:

1. Equal sets are one row. A band is `ROWS` least hashes; two sets share none of
   `BANDS` with (1 - s**ROWS)**BANDS: 1.2e-6 at 0.8, less above.
2. Members of shared buckets get a fingerprint of 256 bits over their set. Blocks of
   buckets give a spanning forest of the distances up to `CLOSE`; each of its edges is
   verified on both whole sets. This leaves most groups in one component.
3. In buckets that still hold several components, members outside the largest one meet
   all of other components: those within `FAR` bits (a pair at 0.8 is farther with
   2.7e-8, two that have nothing in common are nearer with 2e-8) are compared exactly.
   A tile of a bucket holds whole sets of bounded size and gives a forest of its
   links, so a dense group costs about its size and no pair goes unseen. Buckets come
   in as many turns as keep the moved sets below the size of all.

Defined results: null and empty texts have equal (empty) sets; a text of fewer words
than a shingle is one shingle; rows of one id are one document; rows without an id get
the component of their set, null if no row with an id has it or links to it; an empty
table gives an empty result; `deduplicate` carries all other columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, partitions_of, written
from .components import components
from .simhash import ALL, and_end, columns_of, fingerprint, lanes_of, links, met, more, planes_of, rooted, shingle_hashes

#: Shingle of similar documents, and their least similarity as a fraction.
SHINGLE, SIMILAR = 5, (4, 5)
BANDS, ROWS = 45, 6
WORDS, CLOSE, FAR = 4, 40, 84
#: Bytes of whole sets in a tile's part, and queries that are compared at once.
PART_BYTES, BLOCK = 8 << 20, 256
MASKS, FACTORS = np.random.default_rng(11).integers(0, 1 << 64, (2, BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)
PRINT = columns_of(WORDS)


def set_of(text: str | None, shingle: int = SHINGLE) -> tuple[np.ndarray, int, int]:
    """A text's set of shingles as sorted hashes, and two words that stand for the set."""
    from xxhash import xxh3_128_digest

    shingles = np.unique(shingle_hashes(text, shingle))
    a, b = np.frombuffer(xxh3_128_digest(shingles.tobytes()), np.int64).tolist() if len(shingles) else (0, 0)
    return shingles, a, b


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band of least hashes; none for an empty set."""
    if not len(shingles):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, ALL)
    for part in np.array_split(shingles, -(-len(shingles) // 1024)):
        least = np.minimum(least, ((part ^ MASKS) * FACTORS).min(axis=1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = more(keys ^ row, 1)
    return keys.view(np.int64)


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, a, b (the set's words), size (of the set), keys (of its bands)."""
    schema = pa.schema([("doc_id", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("size", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            sets = [set_of(x.as_py(), shingle) for x in batch.column("text")]
            columns = [[a for _, a, _ in sets], [b for _, _, b in sets], [len(s) for s, _, _ in sets], [band_keys(s) for s, _, _ in sets]]
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, a long, b long, size long, keys array<long>")


def _whole_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """node (the set's first word), id, f0, ... (fingerprint), shingles (sorted hashes as bytes) of the documents in ids."""
    schema = pa.schema([("id", pa.int64()), ("node", pa.int64()), *((n, pa.int64()) for n in PRINT), ("shingles", pa.binary())])

    def run(batches):
        for batch in batches:
            sets = [set_of(x.as_py(), shingle) for x in batch.column("text")]
            prints = np.array([fingerprint(s, WORDS) for s, _, _ in sets], np.uint64).reshape(-1, WORDS).view(np.int64)
            columns = [pa.array([a for _, a, _ in sets], pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in prints.T), pa.array([s.tobytes() for s, _, _ in sets], pa.binary())]
            yield pa.record_batch([batch.column("id"), *columns], schema=schema)

    small = ids.count() * 16 <= BROADCAST_BYTES
    mine = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(ids) if small else ids, "id", "left_semi")
    return mine.mapInArrow(run, ", ".join(f"{n} long" for n in ("id", "node", *PRINT)) + ", shingles binary").dropDuplicates(["id", "node"])


def _similar(both, x, y):
    """Whether sets of x and y members of which `both` are common have the similarity SIMILAR or more."""
    return both * SIMILAR[1] >= (x + y - both) * SIMILAR[0]


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs: a, b (nodes); those of similarity SIMILAR or more, with the documents id_a, id_b."""
    schema = pa.schema([(n, pa.int64()) for n in ("a", "b", "id_a", "id_b")])

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                keep.append(_similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            yield pa.record_batch([batch.column(f.name).filter(pa.array(keep, pa.bool_())) for f in schema], schema=schema)

    of = lambda c: sets.select(F.col("node").alias(c), F.col("id").alias(f"id_{c}"), F.col("shingles").alias(f"set_{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(run, "a long, b long, id_a long, id_b long")


def _mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """key, node, root, main (the root of most members) of the buckets with members in several components."""
    placed = members.join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    placed = written(placed, "placed")
    sizes = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
    several = sizes.agg(F.count(F.lit(1)).alias("roots"), F.max_by("root", F.struct("n", "root")).alias("main")).filter("roots > 1").select("key", "main")
    return written(placed.join(several, "key"), "mixed")


def _tiles(mixed: DataFrame) -> DataFrame:
    """mixed: key, node, root, main, size (of the set). Gives tile, asks, asked: who is outside the main component meets each part of its bucket in one tile.

    A bucket's members are dealt to parts of about PART_BYTES, and those outside to
    parts of their own; a tile is one of these with one of those.
    """
    outside = F.col("root") != F.col("main")
    parts = lambda size: F.ceil(F.coalesce(F.sum(size), F.lit(0)) * 8 / PART_BYTES).cast("int")
    sized = mixed.groupBy("key").agg(F.greatest(parts(F.col("size")), F.lit(1)).alias("parts"), F.greatest(parts(F.when(outside, F.col("size"))), F.lit(1)).alias("askers"))
    dealt = mixed.join(sized, "key").withColumn("outside", outside).withColumn("j", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("i", F.pmod(F.xxhash64("node", F.lit(1)), F.col("askers")).cast("int"))
    all_parts = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    asked = F.transform(all_parts("askers"), lambda i: F.struct(i.alias("i"), F.col("j").alias("j"), (F.col("outside") & (i == F.col("i"))).alias("asks"), F.lit(True).alias("asked")))
    elsewhere = F.filter(all_parts("parts"), lambda j: F.col("outside") & (j != F.col("j")))
    asking = F.transform(elsewhere, lambda j: F.struct(F.col("i").alias("i"), j.alias("j"), F.lit(True).alias("asks"), F.lit(False).alias("asked")))
    spread = dealt.withColumn("t", F.explode(F.concat(asked, asking)))
    return spread.select("node", "root", F.xxhash64("key", "t.i", "t.j").alias("tile"), "t.asks", "t.asked")


def tile_links(node: np.ndarray, root: np.ndarray, asks: np.ndarray, asked: np.ndarray, prints: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (as places) between askers and asked members of other components, a forest of them."""
    if not asks.any() or not asked.any():
        return []
    sizes = np.array([len(s) for s in sets])
    _all, place = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    held = np.zeros(len(_all), np.int64)
    # Components by small numbers; a link makes two of them one.
    _roots, group = np.unique(root, return_inverse=True)
    queries, lanes, out = np.flatnonzero(asks), np.flatnonzero(asked), []
    planes = planes_of(prints[lanes])
    for at in range(0, len(queries), BLOCK):
        now = queries[at : at + BLOCK]
        rows, masks = links(prints[now], planes, len(lanes), FAR)
        for q, mask in zip(now[rows].tolist(), masks):
            near = lanes[lanes_of(mask, len(lanes))]
            near = near[group[near] != group[q]]
            if not len(near):
                continue
            mine = place[starts[q] : starts[q] + sizes[q]]
            held[mine] = 1
            if len(near) * 4 > len(sets):
                both = np.add.reduceat(held[place], starts)[near]
            else:
                both = np.array([held[place[starts[x] : starts[x] + sizes[x]]].sum() for x in near.tolist()])
            held[mine] = 0
            for x in near[_similar(both, sizes[q], sizes[near])].tolist():
                if group[x] != group[q]:
                    out.append((q, x))
                    group[group == group[x]] = group[q]
    return out


def _exactly(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """The links that tiles of mixed buckets find: a, b (nodes), id_a, id_b."""
    spark = mixed.sparkSession
    tiles = _tiles(mixed).join(sets, "node").repartition(partitions_of(spark), "tile").sortWithinPartitions("tile")
    schema = pa.schema([(n, pa.int64()) for n in ("a", "b", "id_a", "id_b")])

    def run(batches):
        def done(held):
            rows = pa.Table.from_batches(held).combine_chunks()
            node, ids, root = (rows.column(c).to_numpy() for c in ("node", "id", "root"))
            prints = np.ascontiguousarray(np.stack([rows.column(c).to_numpy() for c in PRINT], axis=1)).view(np.uint64)
            shingles = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("shingles")]
            found = np.array(tile_links(node, root, rows.column("asks").to_numpy(), rows.column("asked").to_numpy(), prints, shingles), np.int64).reshape(-1, 2)
            return pa.record_batch([pa.array(x[found[:, k]]) for x in (node, ids) for k in (0, 1)], schema=schema)

        held, now = [], None
        for batch in and_end(batches):
            tile = batch.column("tile").to_numpy() if batch is not None else np.empty(0, np.int64)
            cuts = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), len(tile)] if len(tile) else []
            if held and (batch is None or tile[0] != now):
                yield done(held)
                held = []
            for a, b in zip(cuts, cuts[1:]):
                if held and tile[a] != now:
                    yield done(held)
                    held = []
                now = tile[a]
                held.append(batch.slice(a, b - a))

    return tiles.mapInArrow(run, "a long, b long, id_a long, id_b long")


def similar_links(docs: DataFrame, least: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """least: id, a, size, keys of distinct sets; gives links a, b of ids, whose components are those of all links."""
    keyed = least.select(F.col("a").alias("node"), F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = written(keyed.join(buckets, "key"), "members")
    candidates = least.join(members.select(F.col("node").alias("a")).distinct(), "a", "left_semi").select("id").distinct()
    sets = written(_whole_sets(docs, written(candidates, "candidates"), shingle), "sets")
    prints = sets.select("node", *PRINT).dropDuplicates(["node"])
    sizes = sets.groupBy("node").agg(F.max(F.octet_length("shingles") / 8).cast("long").alias("size"))
    close = met(members.join(prints, "node").withColumnRenamed("node", "id"), WORDS, CLOSE)
    pairs = written(close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    links = written(_verified(pairs, sets), "links")
    mixed = _mixed(members, components(links.select("a", "b")))
    moved, whole = mixed.join(sizes, "node").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], least.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    turns = max(1, -(-moved // max(whole, PART_BYTES)))
    for turn in range(turns):
        if turn:
            mixed = _mixed(members, components(links.select("a", "b")))
        here = mixed.filter(F.pmod(F.col("key"), F.lit(turns)) == turn) if turns > 1 else mixed
        links = links.unionByName(written(_exactly(here.join(sizes, "node"), sets), "links"))
    return links.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def similar_documents(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, a, b, component_id of each row: components of the documents whose shingle sets have similarity SIMILAR or more."""
    prints, names = written(sketches(docs, shingle), "prints"), ["a", "b"]
    least = written(prints.groupBy(*names).agg(F.min("doc_id").alias("id"), F.first("size").alias("size"), F.first("keys").alias("keys")), "fingerprints")
    found = similar_links(docs, least.filter("id IS NOT NULL"), shingle)
    return rooted(prints.select("doc_id", *names), least.select(*names, "id"), names, found)


def deduplicate(docs: DataFrame, **how) -> DataFrame:
    """One document of each group of similar ones stays, that of the least id; rows that repeat its id stay with it."""
    found = similar_documents(docs, **how).select("doc_id", "component_id")
    gone = written(found.filter("doc_id <> component_id").select("doc_id").distinct(), "duplicates")
    small = gone.count() * 16 <= BROADCAST_BYTES
    return docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(docs.columns)
