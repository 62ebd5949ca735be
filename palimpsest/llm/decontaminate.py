"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased runs of anything but ASCII white space, punctuation and
control characters. Distinct test items come in blocks filled up to `BLOCK_BYTES` of
text (an item beyond that is a block of its own), so what is broadcast has a bound
however large the benchmark is; each block meets all documents. An item of over
`ITEM_WORDS` words is aligned in overlapping parts of so many, each judged by itself.

1. Every n-gram of an item is a seed, so any `SEED_WORDS` words of it in a row that a
   document holds are a hit. (To keep but the rarest of neighbours loses edited
   copies: an n-gram that an edit broke, or that only another document holds, is the
   rarer one.) An Aho-Corasick automaton of a block's seeds finds them.
2. What the words around a hit could score at most follows from how many of them are
   the item's; where that is too little, as with common phrases, it ends here.
3. Elsewhere the item is aligned with the words around (linear gaps), and the best
   local score, as a share of the item's perfect score, is the passage's score. The
   words around reach as far as any alignment through the hit that counts: what it may
   lose to the perfect score is the most words that can be inserted in it.
4. A passage counts from `THRESHOLD` of the perfect score on, or, however long the
   item is, from `PASSAGE_WORDS` matched words on, each edited, missing or inserted
   word between them taking `PASSAGE_ERROR` off (so over 80 % of its words match).

Defined results: null and empty texts and items of no words match nothing; an item
shorter than a seed is its own seed; repeated rows of documents give a row each, those
of items (equal id and text) one; overlapping places of an item in a document, and its
parts, give the best one; empty tables give an empty result; other columns of documents
are carried by `clean`.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, documents, written

SEED_WORDS = 4
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of an item's perfect score from which a document is contaminated.
THRESHOLD = 0.5
#: Matched words that are a passage of an item of any length, and what an error among them takes off.
PASSAGE_WORDS, PASSAGE_ERROR = 20, 4
BLOCK_BYTES, ITEM_WORDS = 4 << 20, 2048
_BLANKS = bytes.maketrans((string.punctuation + "".join(map(chr, range(32))) + "\x7f").encode(), b" " * 65)
FOUND = "doc_id long, item_id long, score double, start_word long, n_words long"


def normal(text: str | None) -> list[str]:
    blanked = (text or "").lower().encode("utf-8", "surrogatepass").translate(_BLANKS)
    return b" ".join(blanked.split()).decode("utf-8", "surrogatepass").split(" ") if blanked.strip() else []


def automaton(grams: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, gram in enumerate(grams):
        a.add_word(f" {gram} ", i)
    a.make_automaton()
    return a


def grams_of(words: list[str], n: int = SEED_WORDS) -> list[str]:
    return [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


def seeds_of(items: list[tuple[int, list[str]]]) -> dict[str, list[tuple[int, int]]]:
    """The n-grams of all items: which items hold them, and where."""
    seeds: dict[str, list[tuple[int, int]]] = {}
    for k, (_, words) in enumerate(items):
        for place, gram in enumerate(grams_of(words)):
            seeds.setdefault(gram, []).append((k, place))
    return seeds


def align(item: np.ndarray, words: np.ndarray, match: int = MATCH, mismatch: int = MISMATCH, gap: int = GAP) -> tuple[int, int, int]:
    """Best local alignment score, and the words' part [start, end) that has it."""
    n = len(words)
    steps = np.arange(n + 1)
    row, began = np.zeros(n + 1, np.int64), steps.copy()
    best = (0, 0, 0)
    for x in item:
        diagonal = row[:-1] + np.where(words == x, match, mismatch)
        up = row[1:] + gap
        new, start = np.zeros(n + 1, np.int64), steps.copy()
        new[1:] = np.maximum(diagonal, up)
        start[1:] = np.where(diagonal >= up, began[:-1], began[1:])
        start = np.where(new > 0, start, steps)
        new = np.maximum(new, 0)
        # Gaps along the words: the best earlier cell less its distance, by a running maximum.
        ahead = new - gap * steps
        run = np.maximum.accumulate(ahead)
        source = np.maximum.accumulate(np.where(ahead == run, steps, 0))
        row = run + gap * steps
        began = start[source]
        top = int(row.argmax())
        if row[top] > best[0]:
            best = (int(row[top]), int(began[top]), top)
    return best


def parts_of(words: list[str], most: int = ITEM_WORDS) -> list[list[str]]:
    """An item's words, or its parts of `most` words, each of which begins halfway in the one before."""
    return [words] if len(words) <= most else [words[i : i + most] for i in range(0, len(words) - most // 2, most // 2)]


class Matcher:
    """A block's items with their seeds; finds passages in texts."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        parts = [(k, part) for k, (_, text) in enumerate(items) if text for part in parts_of(normal(text)) if part]
        seeds = seeds_of(parts)
        self.items = [i for i, _ in items]
        self.owner, self.places = [k for k, _ in parts], list(seeds.values())
        self.automaton = automaton(list(seeds))
        self.ids = [{w: i for i, w in enumerate(dict.fromkeys(words))} for _, words in parts]
        self.coded = [np.array([ids[w] for w in words]) for ids, (_, words) in zip(self.ids, parts)]
        self.held = [np.bincount(c) for c in self.coded]

    def passages(self, text: str | None, threshold: float):
        """item's id, score, first word and number of words of passages that count, the best of each item."""
        words = normal(text)
        joined = f" {' '.join(words)} "
        hits: dict[int, list[int]] = {}
        ends = None
        for end, seed in self.automaton.iter(joined) if self.places else ():
            if ends is None:
                ends = np.cumsum([len(w) + 1 for w in words])
            # `end` is the blank behind the seed's last word.
            last = int(np.searchsorted(ends, end))
            for part, place in self.places[seed]:
                length = min(SEED_WORDS, len(self.coded[part]))
                hits.setdefault(part, []).append(last - length + 1 - place)
        found: dict[int, tuple[float, int, int]] = {}
        for part, diagonals in hits.items():
            m = len(self.coded[part])
            slack = reach(m, threshold)
            diagonals.sort()
            start = 0
            for i in range(1, len(diagonals) + 1):
                if i == len(diagonals) or diagonals[i] - diagonals[i - 1] > m + slack:
                    lo, hi = max(0, diagonals[start] - slack), diagonals[i - 1] + m + slack
                    start = i
                    if best := self._best(part, words[lo:hi], threshold):
                        score, a, b = best
                        old = found.get(self.owner[part])
                        if old is None or score > old[0]:
                            found[self.owner[part]] = (score, lo + a, b - a)
        for k, best in found.items():
            yield self.items[k], *best

    def _best(self, part: int, words: list[str], threshold: float) -> tuple[float, int, int] | None:
        """Score, first word and end of the best place in some words, if it counts."""
        ids, m = self.ids[part], len(self.coded[part])
        around = np.array([ids.get(w, -1) for w in words])
        # No alignment matches more words than item and place have in common.
        common = int(np.minimum(np.bincount(around[around >= 0], minlength=len(ids)), self.held[part]).sum())
        if common < min(threshold * m, PASSAGE_WORDS):
            return None
        score, a, b = align(self.coded[part], around)
        if score >= threshold * MATCH * m or common >= PASSAGE_WORDS and align(self.coded[part], around, 1, -PASSAGE_ERROR, -PASSAGE_ERROR)[0] >= PASSAGE_WORDS:
            return score / (MATCH * m), a, b
        return None


def reach(m: int, threshold: float) -> int:
    """Words that an alignment that counts may have beyond the m of its item: as many gaps as its score can lose."""
    return int(max(MATCH * m * (1 - threshold) / -GAP, m / PASSAGE_ERROR)) + 1


def blocks_of(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """Lists of (item_id, text) of up to block_bytes of text; the driver holds one, and a partition of the items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    held, size = [], 0
    for item, text in items.orderBy("item_id", F.xxhash64("text")).toLocalIterator():
        n = len(text.encode("utf-8", "surrogatepass")) + 16
        if held and size + n > block_bytes:
            yield held
            held, size = [], 0
        held.append((item, text))
        size += n
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document and test item of which it holds a passage: doc_id, item_id, score, start_word, n_words."""
    out = docs.sparkSession.createDataFrame([], FOUND)
    for items in blocks_of(benchmark, block_bytes):
        out = out.unionByName(_block(docs.select("doc_id", "text"), items, threshold))
    return out


def _block(docs: DataFrame, items: list[tuple[int, str]], threshold: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int64())])

    def find(batches):
        matcher = Matcher(shared.value)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if text:
                    rows += [(doc_id, *p) for p in matcher.passages(text, threshold)]
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.mapInArrow(find, FOUND)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those that hold a passage of the benchmark."""
    bad = written(contaminated(docs, benchmark, threshold).select("doc_id").distinct(), "contaminated")
    small = bad.count() * 16 <= BROADCAST_BYTES
    return docs.join(F.broadcast(bad) if small else bad, "doc_id", "left_anti").select(docs.columns)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
