"""Quality by the votes of nearest labelled neighbours in a latent-semantic space.

A text's terms are the bigrams of its characters' classes (64 of them: letters
without case and one more for capitals, digits, white space, each common symbol,
other scripts by groups, ...) and of its words' lengths and repetitions; they carry how a text is written,
whatever its words. Counts are damped, weighted by inverse document frequency over
all documents, and scaled to length 1. The space is the leading singular vectors of
the labelled sample.

Every text is then compared with every labelled vector: blocks of texts times the
broadcast vectors give exact cosines. The `NEIGHBOURS` nearest vote with their
similarity to a power; a label weighs its share of the sample to the power of
-BALANCE, so that a rare label isn't outvoted for its rarity alone.

At most `SAMPLE` labelled rows are used, those of the smallest hashes of their ids;
this bounds the broadcast at SAMPLE * DIMENSIONS * 4 bytes.

Defined results: null and empty texts have no terms and score the share of
label 1 in the sample; so does every text if nothing is labelled (0.5 then); labels
that are null, or of documents that don't exist or have no text, teach nothing;
repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold

#: Labelled rows, latent dimensions and neighbours.
SAMPLE, DIMENSIONS, NEIGHBOURS = 8192, 48, 15
POWER, BALANCE = 4, 0.5
CLASSES = 64
#: Bigrams of classes, and of the words' shapes (8 lengths, new or repeated).
SHAPES = 16
TERMS = CLASSES * CLASSES + SHAPES * SHAPES
SYMBOLS = ".,;:!?'\"()-#*$%&|<>@_/+="


@lru_cache(1)
def character_classes() -> np.ndarray:
    """Class of each byte of UTF-8: letters without case, a class a symbol, one for all other bytes of a kind.

    First bytes of other letters have seven classes, by groups of scripts.
    """
    out = np.full(256, 63, np.uint8)  # other ASCII
    out[0x80:0xC0] = 60  # further bytes of other letters
    for first, cls in ((0xC0, 54), (0xCA, 55), (0xD0, 56), (0xD5, 57), (0xE0, 58), (0xE3, 59), (0xF0, 61)):  # Latin, Greek, Cyrillic, Hebrew and Arabic, Indic and marks, East Asian, others
        out[first:] = cls
    for i in range(26):
        out[97 + i] = out[65 + i] = 1 + i
    out[48:58] = 27
    out[[9, 11, 12, 13, 32]] = 28
    out[10] = 29
    for i, c in enumerate(SYMBOLS):
        out[ord(c)] = 30 + i
    return out


def term_counts(text: str | None) -> np.ndarray:
    """Counts of a whole text's terms."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(TERMS, np.float32)
    if not len(raw):
        return out
    cls = character_classes()[raw].astype(np.int64)
    capital = (raw >= 65) & (raw <= 90)
    first = np.where(capital, 62, cls)  # a capital is one as the first of a pair, a letter as the second
    out[: CLASSES * CLASSES] = np.bincount(first[:-1] * CLASSES + cls[1:], minlength=CLASSES * CLASSES)
    words = raw.tobytes().split()
    if words:
        seen: set[bytes] = set()
        shapes = np.fromiter((min(len(w) - 1, 28) // 4 + 8 * (w in seen or seen.add(w) is not None) for w in words), np.int64, len(words))
        shapes = np.concatenate(([0], shapes))
        out[CLASSES * CLASSES :] = np.bincount(shapes[:-1] * SHAPES + shapes[1:], minlength=SHAPES * SHAPES)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped, weighted rows of length 1; a row of zeros stays."""
    x = np.log1p(counts) * idf
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms > 0, norms, 1)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Documents with text, and how many of them have each term: one vector a partition, summed in Spark."""
    def run(batches):
        n, df = 0, np.zeros(TERMS, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    n += 1
                    df += term_counts(text) > 0
        yield pa.RecordBatch.from_pylist([{"term": -1, "n": n}] + [{"term": int(i), "n": int(df[i])} for i in np.flatnonzero(df)], schema=pa.schema([("term", pa.int64()), ("n", pa.int64())]))

    rows = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect()  # a row a term at most
    df = np.zeros(TERMS, np.int64)
    for term, n in rows:
        if term >= 0:
            df[term] = n
    return next((n for term, n in rows if term < 0), 0), df


def leading_vectors(x: np.ndarray, k: int, seed: int = 7, rounds: int = 4) -> np.ndarray:
    """The leading right singular vectors of x, by subspace iteration."""
    k = min(k, *x.shape)
    q = np.random.default_rng(seed).standard_normal((x.shape[1], min(k + 10, *x.shape))).astype(np.float32)
    for _ in range(rounds):
        q, _r = np.linalg.qr(x.T @ (x @ q))
    _u, _s, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T)[:, :k]


def _unit(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms > 1e-9, norms, 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> dict:
    """docs: doc_id, text (all of them); labels: doc_id and the label, of the rows to learn from."""
    n, df = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 0.1
    wanted = labels.filter(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    taught = docs.select("doc_id", "text").filter("text <> ''").join(F.broadcast(wanted), "doc_id")

    def count(batches):
        for batch in batches:
            rows = [(x, term_counts(t).astype("<f4").tobytes()) for x, t in zip(batch.column("_label").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_pydict({"label": [r[0] for r in rows], "counts": [_sparse(r[1]) for r in rows]}, schema=pa.schema([("label", pa.int32()), ("counts", pa.binary())]))

    rows = taught.select("_label", "text").mapInArrow(count, "label int, counts binary").limit(sample).collect()
    y = np.array([int(r[0] == 1) for r in rows], np.float32)
    prior = float(y.mean()) if len(y) else 0.5
    if not len(y):
        return {"idf": idf, "basis": None, "prior": prior}
    x = weighted(np.stack([_dense(bytes(r[1])) for r in rows]), idf).astype(np.float32)
    basis = leading_vectors(x, dimensions).astype(np.float32)
    return {"idf": idf, "basis": basis, "vectors": _unit(x @ basis).astype(np.float32), "y": y, "prior": prior}


def _sparse(counts: bytes) -> bytes:
    x = np.frombuffer(counts, "<f4")
    at = np.flatnonzero(x).astype("<u2")
    return np.uint32(len(at)).tobytes() + at.tobytes() + x[at].tobytes()


def _dense(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    out = np.zeros(TERMS, np.float32)
    out[np.frombuffer(data, "<u2", n, 4)] = np.frombuffer(data, "<f4", n, 4 + 2 * n)
    return out


def vote(model: dict, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores of rows of term counts."""
    out = np.full(len(counts), model["prior"])
    if model["basis"] is None:
        return out
    some = counts.any(axis=1)
    if some.any():
        mine = _unit(weighted(counts[some], model["idf"]).astype(np.float32) @ model["basis"])
        cosines = mine @ model["vectors"].T
        k = min(neighbours, cosines.shape[1])
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        share = np.where(model["y"][near] == 1, model["prior"], 1 - model["prior"])
        weight = np.clip(np.take_along_axis(cosines, near, axis=1), 0, 1) ** POWER / share**BALANCE
        total = weight.sum(axis=1)
        out[some] = np.where(total > 0, (weight * model["y"][near]).sum(axis=1) / np.where(total > 0, total, 1), model["prior"])
    return np.clip(out, 0, 1)


def classify(docs: DataFrame, model: dict, block: int = 256) -> DataFrame:
    """doc_id, score of every text, in blocks against all labelled vectors."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                part = batch.slice(start, block)
                counts = np.stack([term_counts(t) for t in part.column("text").to_pylist()])
                yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(vote(shared.value, counts).astype(np.float64))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold(F.col("doc_id"), 3) != 1)
    out = classify(docs, fit(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
