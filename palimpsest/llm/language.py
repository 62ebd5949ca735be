"""Language identification with hyperdimensional profiles.

Each letter class has a random vector of +1 and -1. A trigram's vector binds (by
elementwise product) its letters' vectors, rotated by 2, 1 and 0 places. A text's
vector bundles (sums) its trigrams' vectors, a language's prototype bundles all of
its training texts', each scaled to length 1, and a text goes to the prototype of
the largest cosine.

Letters are lower-cased; whatever is no letter separates words, as one blank. The
first 592 code points have a class each; other letters share the rest by a hash.

Training sums one vector a language and partition, and those by language in Spark,
so what reaches the driver is a vector a language. The number of languages is the
only thing that grows, and is checked.

Defined results: `und` and score 0 if a text is null or has no letter; any text if
nothing was learned is `und` as well; ties go to the language that sorts first; rows without a language or text teach nothing;
repeated rows teach as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold

DIMENSIONS, SEED = 1024, 20_240_229
CLASSES, OWN = 1024, 0x250
MOST_LANGUAGES = 4096
#: Texts are turned to counts in groups of about so many characters.
CHUNK = 1 << 20
UNKNOWN = "und"


@lru_cache(1)
def letter_classes() -> np.ndarray:
    """Class of each code point: 0 for what is no letter."""
    points = np.arange(0x110000, dtype=np.uint64)
    letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    shared = OWN + (points * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(CLASSES - OWN)
    return np.where(letters, np.where(points < OWN, points, shared), 0).astype(np.int32)


@lru_cache(4)
def letter_vectors(dimensions: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (CLASSES, dimensions))


def trigram_vectors(codes: np.ndarray, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """Bound vectors of trigram codes, as float32."""
    v = letter_vectors(dimensions, seed)
    a, b, c = codes // CLASSES**2, codes // CLASSES % CLASSES, codes % CLASSES
    return (np.roll(v, 2, axis=1)[a] * np.roll(v, 1, axis=1)[b] * v[c]).astype(np.float32)


def trigram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's index, trigram's code, count), by text; one blank stands at both ends and between words."""
    lowered = [f" {(t or '').lower()} " for t in texts]
    lengths = np.array([len(t) for t in lowered])
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = letter_classes()[points]
    owner = np.repeat(np.arange(len(texts)), lengths)
    # Of blanks in a row the first stays; a text's own first follows none of its own.
    keep = cls > 0
    keep[1:] |= (owner[1:] != owner[:-1]) | (cls[:-1] > 0)
    keep[:1] = True
    cls, owner = cls[keep].astype(np.int64), owner[keep]
    if len(cls) < 3:
        return (np.zeros(0, np.int64),) * 3
    code = (cls[:-2] * CLASSES + cls[1:-1]) * CLASSES + cls[2:]
    inside = owner[:-2] == owner[2:]
    both, counts = np.unique(owner[:-2][inside] * CLASSES**3 + code[inside], return_counts=True)
    return both // CLASSES**3, both % CLASSES**3, counts


def text_vectors(texts: list[str | None], dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """Bundled vectors of texts, as float32; trigrams are taken some thousand at a time."""
    owner, code, count = trigram_counts(texts)
    out = np.zeros((len(texts), dimensions), np.float32)
    codes, place = np.unique(code, return_inverse=True)
    for start in range(0, len(codes), 4096):
        here = (place >= start) & (place < start + 4096)
        table = np.zeros((len(texts), min(4096, len(codes) - start)), np.float32)
        table[owner[here], place[here] - start] = count[here]
        out += table @ trigram_vectors(codes[start : start + 4096], dimensions, seed)
    return out


def _chunks(batches, *names: str):
    """Columns of rows, by groups of about CHUNK characters of text (the last name)."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in names)):
            held.append(row)
            size += len(row[-1] or "")
            if size >= CHUNK or len(held) >= 512:
                yield [list(c) for c in zip(*held)]
                held, size = [], 0
    if held:
        yield [list(c) for c in zip(*held)]


def learn(labelled: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages and prototypes from (lang, text)."""
    schema = pa.schema([("lang", pa.string()), ("v", pa.list_(pa.float64()))])

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for langs, texts in _chunks(batches, "lang", "text"):
            vectors = text_vectors(texts, dimensions, seed).astype(np.float64)
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            vectors /= np.where(norms > 0, norms, 1)
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + vectors[[x == lang for x in langs]].sum(axis=0)
        yield pa.RecordBatch.from_pydict({"lang": list(sums), "v": [x.tolist() for x in sums.values()]}, schema=schema)

    partial = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(bundle, "lang string, v array<double>")
    summed = partial.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    vectors = summed.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    rows = sorted((r[0], r[1]) for r in vectors.limit(MOST_LANGUAGES + 1).collect())
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    prototypes = np.array([v for _, v in rows], np.float64).reshape(-1, dimensions)
    norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return [x for x, _ in rows], (prototypes / np.where(norms > 0, norms, 1)).astype(np.float32)


def predict(docs: DataFrame, languages: list[str], prototypes: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, lang_pred, score (the cosine, 0 if negative)."""
    model = docs.sparkSession.sparkContext.broadcast((languages, prototypes))
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        names, table = model.value
        for ids, texts in _chunks(batches, "doc_id", "text"):
            pred, score = [UNKNOWN] * len(ids), np.zeros(len(ids))
            if names:
                vectors = text_vectors(texts, table.shape[1], seed)
                norms = np.linalg.norm(vectors, axis=1)
                cosines = (vectors @ table.T) / np.where(norms > 0, norms, 1)[:, None]
                best = cosines.argmax(axis=1)
                for i in (i for i, t in enumerate(texts) if any(map(str.isalpha, t or ""))):
                    pred[i], score[i] = names[best[i]], float(np.clip(cosines[i, best[i]], 0, 1))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(pred), pa.array(score)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    languages, prototypes = learn(docs.filter(fold(F.col("doc_id"), 5) != 0).select("lang", "text"))
    found = predict(docs, languages, prototypes)
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
