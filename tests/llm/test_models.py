"""SimHash, decontamination, language, packing, token files, language model and classifier against plain versions."""

import math
import os
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import components, decontaminate, language, language_model, packing, quality_classifier, simhash, similar, token_files
from palimpsest.llm.common import scratch
from palimpsest.llm.tokens import Encoder, vocabulary

SF = "/root/testdata/sf0.001"


def lower(text):
    return re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def plain_fingerprint(text, k=3):
    w = words(text)
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(ids, near):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def texts(corpus):
    return {r[0]: r[1] for r in corpus}


def test_simhash_matches_brute_force(docs, texts):
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = plain_components(prints, near)
    got = simhash.near_duplicates(docs).select("doc_id", "f0", "component_id").collect()
    assert len(got) == docs.count()
    assert {(r[0], r[1] % (1 << 64), r[2]) for r in got} == {(d, prints[d], want[d]) for d in prints}
    assert want[61] == 60 and prints[60] == 0  # empty texts are alike


@pytest.mark.parametrize("radius,count", [(0, 1), (3, 1), (5, 1), (46, 4)])
def test_bit_slices_count_distances(radius, count):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 1 << 63, (150, count), dtype=np.uint64)
    more = fps.copy()
    for row in more:
        for b in rng.choice(64 * count, rng.integers(0, 2 * radius + 2), replace=False):
            row[b // 64] ^= np.uint64(1 << int(b % 64))
    fps = np.concatenate((fps, more))
    rows, masks = simhash.links(fps, simhash.planes_of(fps), len(fps), radius)
    got = {(r, c) for r, m in zip(rows.tolist(), masks) for c in simhash.lanes_of(m, len(fps)).tolist()}
    distance = np.unpackbits((fps[:, None] ^ fps[None]).view(np.uint8), axis=2).sum(axis=2)
    assert got == set(zip(*map(list, np.nonzero(distance <= radius))))
    linked = plain_components(range(len(fps)), [(a, b) for a, b in got if a < b])
    assert plain_components(range(len(fps)), simhash.forest(fps, radius, block=16)) == linked


def test_exact_tables_lose_nothing_and_large_buckets_are_tiled(spark, monkeypatch):
    rng = np.random.default_rng(1)
    for radius in range(4):
        tables = simhash.exact_tables(1, radius)
        for _ in range(200):
            flip = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
            assert any(not flip & m for (m,) in tables)
    monkeypatch.setattr(simhash, "TILE", 16)
    base = 0x0123456789ABCDEF
    fps = sorted({base} | {base ^ (1 << i) for i in range(64)} | {base ^ (3 << i) for i in range(63)})
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    prints = spark.createDataFrame(signed, "doc_id long, f0 long")
    got = simhash.classes(prints, 1, 3).select("component_id").distinct().collect()
    assert [r[0] for r in got] == [0]


def test_similar_documents(spark):
    rng = random.Random(3)
    make = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    rows, groups = [], []
    for g in range(60):
        w = make(200)
        rows.append((3 * g, " ".join(w)))
        near = list(w)
        for _ in range(4):  # four words changed: similarity about 0.82
            near[rng.randrange(200)] = "edited"
        rows += [(3 * g + 1, " ".join(near)), (3 * g + 2, " ".join(make(200)))]
        groups.append(near)
    found = {r[0]: r[1] for r in similar.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()}
    assert sum(found[3 * g + 1] == 3 * g for g in range(60)) >= 57
    assert all(found[3 * g + 2] == 3 * g + 2 for g in range(60))


@pytest.mark.parametrize("part", [8 << 20, 100_000])
def test_similar_documents_are_exactly_those_of_the_threshold(spark, monkeypatch, part):
    monkeypatch.setattr(similar, "PART_BYTES", part)  # a small part deals a bucket to many tiles
    rng = random.Random(4)
    make = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    shingles = lambda text: {tuple(text.split()[i : i + 5]) for i in range(max(1, len(text.split()) - 4))}
    rows, near = [], []
    for n, more in [(10, 1), (16, 3), (44, 10), (8, 1), (84, 20), (44, 11), (84, 21), (10, 2), (104, 34)] * 20:  # words, and words appended
        w = make(n)
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w + make(more)))]
        a, b = (shingles(t) for _, t in rows[-2:])
        if 5 * len(a & b) >= 4 * len(a | b):
            near.append((rows[-2][0], rows[-1][0]))
    base, at = make(120), len(rows)  # a large group of near copies, linked to each other more or less
    for i in range(150):
        rows.append((at + i, " ".join(rng.choice("xyz") if j in rng.sample(range(120), 2) else w for j, w in enumerate(base))))
    group = [(i, shingles(t)) for i, t in rows[at:]]
    near += [(i, j) for i, a in group for j, b in group if i < j and 5 * len(a & b) >= 4 * len(a | b)]
    want = plain_components([i for i, _ in rows], near)
    found = similar.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r[0]: r[1] for r in found.select("doc_id", "component_id").collect()} == want


def test_far_radius_and_bands_lose_no_similar_pair():
    """Sets at exactly 0.8: all are within FAR; a band is shared but with 1.2e-6."""
    rng = np.random.default_rng(8)
    lost = 0
    for n in [4, 8, 12, 40, 200] * 100:
        both = rng.integers(0, 1 << 63, n + n // 4, dtype=np.uint64)
        a, b = np.unique(both[:n]), np.unique(both)
        far = int(np.unpackbits((simhash.fingerprint(a, 4) ^ simhash.fingerprint(b, 4)).view(np.uint8)).sum()) > similar.FAR
        lost += far or not (similar.band_keys(a) == similar.band_keys(b)).any()
    assert lost == 0


def test_tiles_link_like_all_pairs():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(60) < 0.12, rng.integers(0, 1 << 63, 60, dtype=np.uint64), base)) for _ in range(80)]
    prints = np.array([simhash.fingerprint(s, 4) for s in sets])
    near = [(a, b) for a in range(80) for b in range(a) if 5 * len(set(sets[a]) & set(sets[b])) >= 4 * len(set(sets[a]) | set(sets[b]))]
    assert 0 < len(near) < 80 * 79 // 2
    yes = np.ones(80, bool)
    got = similar.tile_links(np.arange(80), np.arange(80), yes, yes, prints, sets)
    assert set(got) <= {p for a, b in near for p in ((a, b), (b, a))}
    assert plain_components(range(80), got) == plain_components(range(80), near)


def test_deduplicate_keeps_one_of_each_group(docs, corpus):
    kept = [r[0] for r in similar.deduplicate(docs).select("doc_id").collect()]
    assert 40 in kept and not set(kept) & {41, 42, 43, 50, 51, 52, 53, 61, 62, 80} and set(range(40)) <= set(kept)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 64)] + [(200, 200 + i) for i in range(1, 40)] + [(300, 300)]
    random.Random(1).shuffle(edges)
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 65)} | {200 + i: 200 for i in range(1, 40)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_component_around_a_hub(spark):
    hub = spark.range(100_000).select(F.lit(50_000).alias("a"), F.col("id").alias("b"))
    tail = spark.createDataFrame([(99_999, 100_000), (100_000, 100_001)], "a long, b long")
    got = components.components(hub.unionByName(tail)).groupBy("root").count().collect()
    assert [(r["root"], r["count"]) for r in got] == [(0, 100_001)]


# -- decontamination --------------------------------------------------------------------


def plain_align(item, text):
    best = 0
    h = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, x in enumerate(item, 1):
        for j, y in enumerate(text, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(0)
    for _ in range(60):
        item, text = rng.integers(0, 5, rng.integers(1, 15)), rng.integers(0, 5, rng.integers(0, 30))
        score, start, end = decontaminate.align(item, text)
        assert score == plain_align(item.tolist(), text.tolist())
        assert score == plain_align(item.tolist(), text[start:end].tolist())


def test_passages_are_found_and_clean_texts_left(spark, docs, empty, clashing):
    rng = random.Random(8)
    make = lambda n: ["".join(rng.choice("klmnopqr") for _ in range(5)) for _ in range(n)]
    item, other = make(40), make(12)
    edited = [w if i % 9 else "changed" for i, w in enumerate(item)]
    rows = [(1, " ".join(make(50) + item + make(50))), (2, " ".join(make(5) + edited)), (3, " ".join(item[:8] + make(60))), (4, " ".join(make(100))), (5, f"{' '.join(other[:6]).upper()}, {' '.join(other[6:])}!"), (6, None), (7, "")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(other)), (2, None), (3, ""), (4, "two words")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(texts, benchmark).collect()}
    assert set(got) == {(1, 0), (2, 0), (5, 1)}
    assert got[1, 0]["score"] == 1 and (got[1, 0]["start_word"], got[1, 0]["n_words"]) == (50, 40) and 0.5 < got[2, 0]["score"] < 1
    small = decontaminate.contaminated(texts, benchmark, block_bytes=250)  # several blocks
    assert {(r["doc_id"], r["item_id"]) for r in small.collect()} == set(got)
    assert {r[0] for r in decontaminate.clean(texts, benchmark).select("doc_id").collect()} == {3, 4, 6, 7}
    assert decontaminate.contaminated(empty, benchmark).count() == 0 and decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.clean(clashing, benchmark).columns == clashing.columns


@pytest.mark.parametrize("every", [5, 6])
def test_copies_with_every_fifth_or_sixth_word_changed(spark, every):
    rng = random.Random(9)
    make = lambda n: ["".join(rng.choice("klmnopqr") for _ in range(5)) for _ in range(n)]
    items = {k: make(40) for k in range(20)}
    edited = lambda k: [w if (i + k) % every else "changed" for i, w in enumerate(items[k])]
    texts = spark.createDataFrame([(k, " ".join(make(30) + edited(k) + make(30))) for k in items], "doc_id long, text string")
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = {(r[0], r[1]): r[2] for r in decontaminate.contaminated(texts, benchmark).collect()}
    assert set(got) == {(k, k) for k in items} and all(0.65 < score < 0.85 for score in got.values())
    # The n-grams that an edit broke are then held by another document.
    whole = spark.createDataFrame([(1000 + k, " ".join(w)) for k, w in items.items()], "doc_id long, text string")
    both = decontaminate.contaminated(texts.unionByName(whole), benchmark).collect()
    assert {(r[0], r[1]) for r in both} == {(k, k) for k in items} | {(1000 + k, k) for k in items}


def test_a_long_passage_of_a_longer_item_counts(spark):
    rng = random.Random(10)
    make = lambda n: ["".join(rng.choice("klmnopqr") for _ in range(5)) for _ in range(n)]
    items = {0: make(59), 1: make(500)}
    edited = [w if i % 12 else "changed" for i, w in enumerate(items[1][100:160])]
    half = [w if i % 3 else "changed" for i, w in enumerate(items[1][:60])]
    parts = {1: items[0][10:39], 2: items[1][100:300], 3: edited, 4: items[0][:12], 5: items[1][:19], 6: half, 7: make(300)}
    texts = spark.createDataFrame([(k, " ".join(make(30) + part + make(30))) for k, part in parts.items()], "doc_id long, text string")
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(texts, benchmark).collect()}
    assert set(got) == {(1, 0), (2, 1), (3, 1)} and (got[1, 0]["start_word"], got[1, 0]["n_words"]) == (30, 29)
    assert got[1, 0]["score"] == 29 / 59 and got[2, 1]["score"] == 0.4
    assert {r[0] for r in decontaminate.clean(texts, benchmark).select("doc_id").collect()} == {4, 5, 6, 7}


def gapped(item, rng, words_between, make):
    """The item with words put between its words, three fours of it left whole."""
    whole = set(range(0, 4)) | set(range(10, 14))
    out = []
    for i, w in enumerate(item):
        out.append(w)
        if i not in whole and words_between:
            n = rng.randint(0, min(3, words_between))
            out += make(n)
            words_between -= n
    return out


def test_every_place_of_every_item_against_whole_alignment(spark):
    """The windows lose nothing: a document is found if its whole text, aligned word by word, counts."""
    rng = random.Random(12)
    make = lambda n: ["".join(rng.choice("klmnopqr") for _ in range(4)) for _ in range(n)]
    items = {k: make(rng.choice([6, 15, 25, 40])) for k in range(12)}
    rows = []
    for d in range(150):
        item = items[d % 12]
        body = gapped(item, rng, rng.randint(0, len(item) + 6), make) if d % 3 else [w if rng.random() < 0.75 else "changed" for w in item]
        rows.append((d, " ".join(make(rng.randint(0, 40)) + body + make(rng.randint(0, 9)) + (items[(d + 5) % 12][:9] if d % 4 == 0 else []))))
    want = {}
    for d, text in rows:
        for k, item in items.items():
            w = text.split()
            seeds = {tuple(item[i : i + 4]) for i in range(len(item) - 3)}
            if not any(tuple(w[i : i + 4]) in seeds for i in range(len(w) - 3)):
                continue
            codes = {x: i for i, x in enumerate(dict.fromkeys(item))}
            a, b = np.array([codes[x] for x in item]), np.array([codes.get(x, -1) for x in w])
            score = plain_align(item, w)
            if score >= len(item) or decontaminate.align(a, b, 1, -4, -4)[0] >= 20:
                want[d, k] = score / (2 * len(item))
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(texts, benchmark).collect()}
    assert got == want and len(want) > 80 and min(want.values()) < 0.56


def test_a_whole_item_with_many_words_between(spark):
    rng = random.Random(13)
    make = lambda n: ["".join(rng.choice("klmnopqr") for _ in range(5)) for _ in range(n)]
    item = make(40)
    late = item[:20] + make(31) + item[20:]  # all 40 words, 31 others amid them: (80 - 31) / 80
    got = decontaminate.contaminated(spark.createDataFrame([(1, " ".join(late))], "doc_id long, text string"), spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")).collect()
    assert [r["score"] for r in got] == [0.6125]


def test_blocks_repeated_items_and_very_long_ones(spark, docs, clashing):
    rng = random.Random(14)
    make = lambda n: ["".join(rng.choice("klmnopqr") for _ in range(5)) for _ in range(n)]
    long, short = make(9000), make(30)
    benchmark = spark.createDataFrame([(0, " ".join(long)), *[(1, " ".join(short))] * 500, (1, None), (2, "")], "item_id long, text string")
    assert [len(b) for b in decontaminate.blocks_of(benchmark, 20_000)] == [1, 2]
    texts = [(1, " ".join(make(30_000) + short + make(20_000))), (2, " ".join(make(9) + long[5000:5100])), (3, " ".join(long[:8999])), (4, " ".join(make(50)))]
    found = decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), benchmark, block_bytes=20_000)
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(1, 1), (2, 0), (3, 0)]
    assert decontaminate.contaminated(clashing, benchmark).columns == ["doc_id", "item_id", "score", "start_word", "n_words"]
    assert {" ".join(p) for p in decontaminate.parts_of(long)} and all(" ".join(long[i : i + 1024]) in {" ".join(p[j : j + 1024]) for p in decontaminate.parts_of(long) for j in range(0, len(p), 1024)} for i in range(0, 8000, 1024))


# -- language ---------------------------------------------------------------------------


def test_language(spark, docs, empty):
    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r["doc_id"]: r for r in language.op5_language(spark, SF).collect()}
    held = [r for r in docs_.collect() if out[r["doc_id"]]["held_out"]]
    assert len(held) > 20 and np.mean([out[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.95
    assert all(out[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d in out)
    names, table = language.learn(docs_)
    odd = {r["doc_id"]: r for r in language.predict(docs, names, table).collect()}
    assert odd[60]["lang_pred"] == odd[61]["lang_pred"] == odd[63]["lang_pred"] == "und" and odd[64]["lang_pred"] in names
    assert all(0 <= r["score"] <= 1 for r in odd.values())
    assert language.learn(empty)[0] == [] and {r["lang_pred"] for r in language.predict(docs, [], np.zeros((0, 8), np.float32)).collect()} == {"und"}


def test_bundles_are_sums_of_bound_trigrams():
    v = language.letter_vectors(64, 1).astype(int)
    text = "Abba b"
    padded = " abba b "
    want = sum(np.roll(v[ord(a) if a != " " else 0], 2) * np.roll(v[ord(b) if b != " " else 0], 1) * v[ord(c) if c != " " else 0] for a, b, c in zip(padded, padded[1:], padded[2:]))
    assert (language.text_vectors([text, None], 64, 1)[0] == want).all() and not language.text_vectors([None, ""], 64, 1).any()


def test_predictions_of_a_whole_table_against_plain_ones(spark):
    """Trigram by trigram, with the same letters' vectors; prototypes from the documents that may teach."""
    from functools import lru_cache

    v = language.letter_vectors(language.DIMENSIONS, language.SEED).astype(float)
    cls = language.letter_classes()

    @lru_cache(None)
    def bound(a, b, c):
        return np.roll(v[a], 2) * np.roll(v[b], 1) * v[c]

    def vector(text):
        padded = [0]
        for ch in (text or "").lower():
            k = int(cls[ord(ch)])
            if k or padded[-1]:
                padded.append(k)
        padded += [0] if padded[-1] else []
        out = np.zeros(language.DIMENSIONS)
        for t, n in Counter(zip(padded, padded[1:], padded[2:])).items():
            out += n * bound(*t)
        return out / (np.linalg.norm(out) or 1)

    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    vectors = {r["doc_id"]: vector(r["text"]) for r in rows}
    learned = defaultdict(lambda: np.zeros(language.DIMENSIONS))
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["lang"] is not None and r["text"] is not None:
            learned[r["lang"]] += vectors[r["doc_id"]]
    names = sorted(learned)
    table = np.array([learned[n] / np.linalg.norm(learned[n]) for n in names])
    got = {r["doc_id"]: r for r in language.op5_language(spark, SF).collect()}
    assert set(got) == set(vectors)
    for r in rows:
        cosines = table @ vectors[r["doc_id"]]
        best = int(np.argmax(cosines))
        near = np.sort(cosines)[-2:]
        assert abs(got[r["doc_id"]]["score"] - max(0.0, cosines[best])) < 1e-4
        assert got[r["doc_id"]]["lang_pred"] == names[best] or near[1] - near[0] < 1e-5


# -- packing and token files ----------------------------------------------------------------


def ids_of(path, text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name,cut", [("byte_bpe_50k.json", "space"), ("word_bpe_49k.json", "words")])
def test_cached_words_change_no_id(name, cut):
    enc, rng = Encoder(vocabulary(name), cut), random.Random(2)
    letters = "aZéßΣİıŉǅ fi .,'\n\t 09ñ́ \x1c中-"
    texts = ["", " a", "a  b", "a\n b", "a b\n", "a \n", "it's 'tis", "x　y", "<|endoftext|> x", "one two.\nThree 'tis\n'tis four,\nfive\n\nsix \nseven\r\neight\n\tnine\n10\n", "a\nb c\nd", "\na b", "a b\n\nc", *("".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(3000))]
    assert all(list(enc.encode(t)) == enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts)
    assert len(enc.encode(None)) == 0


def test_plans_are_whole_and_tight():
    rng = np.random.default_rng(4)
    for n, capacity in ((0, 64), (1, 64), (500, 64), (3000, 4096)):
        lengths = np.clip(rng.lognormal(math.log(capacity / 5), 1, n).astype(int), 1, capacity)
        histogram = Counter(lengths.tolist())
        classes = packing.plan(dict(histogram), capacity)
        got = Counter()
        for contents, count in classes:
            assert sum(x * k for x, k in contents) <= capacity
            for x, k in contents:
                got[x] += k * count
        assert got == histogram
        bins = sum(count for _, count in classes)
        assert bins <= math.ceil(lengths.sum() / capacity * 1.02) + 2


def test_packing(docs, corpus, empty):
    path = vocabulary("word_bpe_49k.json")
    rows = packing.pack_documents(docs).collect()
    want = Counter()
    for r in corpus:
        ids = ids_of(path, r[1], 1)
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want[r[0], piece, start, len(part), crc(part)] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= math.ceil(sum(r["length"] for r in rows) / 4096) + 1
    assert packing.pack_documents(empty).count() == 0


def test_token_files(spark, docs, corpus, empty, clashing, nameless):
    path, uri = vocabulary("byte_bpe_50k.json"), scratch(spark, "t")
    once = docs.dropDuplicates(["doc_id"])
    shards = token_files.write_tokens(once, uri, path, length=64, rows=8)
    assert token_files.manifest(uri) == shards
    got = {r["doc_id"]: tuple(r)[1:] for r in token_files.read_tokens(spark, uri).collect()}
    start, stream = 0, {}
    for d, t in sorted({r[0]: r[1] for r in corpus}.items()):
        ids = ids_of(path, t, 2)
        assert got[d] == (start, len(ids), crc(ids))
        start, stream[d] = start + len(ids), ids
    shard = token_files.TokenShard(uri, shards[0][1])
    own = [i for d, _, n in shard.documents() for i in stream[d]]
    for k in range(len(shard)):
        ids, bits = shard.sequence(k)
        assert len(ids) == 64 and ids[token_files.unpacked(bits)].tolist() == own[64 * k : 64 * k + 64]
        assert not ids.flags.owndata and not bits.flags.owndata and len(bits) == 8
    empty_uri = scratch(spark, "t")
    assert token_files.write_tokens(empty, empty_uri, path) == [] and token_files.read_tokens(spark, empty_uri).count() == 0
    for table in (docs, clashing, nameless):
        again = scratch(spark, "t")
        token_files.write_tokens(table, again, path)
        assert token_files.read_tokens(spark, again).count() == table.count()


def test_repeated_ids_are_written_in_one_order(spark):
    path = vocabulary("byte_bpe_50k.json")
    rows = [(7, f"text number {i} " * (i + 1)) for i in range(20)]
    streams = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        uri = scratch(spark, "t")
        token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), uri, path)
        streams.append([tuple(r) for r in token_files.read_tokens(spark, uri).orderBy("start").collect()])
    assert streams[0] == streams[1]
    with pytest.raises(ValueError):
        token_files.ShardWriter(uri, 0, "<u2", length=12)


# -- language model ---------------------------------------------------------------------


def plain_model(training):
    seqs = [[*words(t), "\n"] for t in training]
    uni, bi = Counter(w for s in seqs for w in s), Counter(p for s in seqs for p in zip([" ", *s], s))
    after, by, follows = Counter(), [Counter() for _ in range(4)], Counter()
    for (v, w), c in bi.items():
        after[v] += c
        by[min(c, 3)][v] += 1
        follows[w] += 1
    d = (0, *language_model.discounts_of([sum(c == k for c in bi.values()) for k in (1, 2, 3, 4)]))
    e = (0, *language_model.discounts_of([sum(c == k for c in follows.values()) for k in (1, 2, 3, 4)]))
    spare = sum(e[min(c, 3)] for c in follows.values()) / len(bi)

    def p(v, w):
        low = max(follows[w] - e[min(follows[w], 3)], 0) / len(bi) + spare / (len(uni) + 1)
        if not after[v]:
            return low
        c = bi[v, w]
        return max(c - d[min(c, 3)], 0) / after[v] + sum(d[k] * by[k][v] for k in (1, 2, 3)) / after[v] * low

    return uni, p


def test_language_model(spark, docs, corpus, empty):
    training = docs.filter("doc_id % 3 > 0")
    model = language_model.train(training, scratch(spark, "m"), buckets=5)
    uni, p = plain_model([r[1] for r in corpus if r[0] % 3 > 0])
    n, v = sum(uni.values()), len(uni)
    assert (model.tokens, model.words) == (n, v)
    assert math.isclose(sum(p("same", w) for w in uni) + p("same", "unknown"), 1)
    for r in language_model.score(docs, model).collect():
        seq = [*words(next(x[1] for x in corpus if x[0] == r["doc_id"])), "\n"]
        assert (r["n_tokens"], r["n_known"]) == (len(seq), sum(uni[w] > 0 for w in seq))
        assert math.isclose(r["base_score"], sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in seq), rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p(a, w)) for a, w in zip([" ", *seq], seq)), rel_tol=1e-9, abs_tol=1e-9)
    nothing = language_model.train(empty, scratch(spark, "m"))
    assert {(r["score"], r["base_score"]) for r in language_model.score(docs, nothing).collect()} == {(0.0, 0.0)}
    assert language_model.score(empty, model).count() == 0


def test_counts_beyond_four_bytes_are_kept(tmp_path):
    big = np.array([1, 300, 5_000_000_000], np.int64)
    arrays = language_model.Arrays(f"file://{tmp_path}")
    for name, sums in (("a", big), ("b", big[:2]), ("c", big[:1]), ("d", big[:0])):
        language_model.save(f"file://{tmp_path}", name, language_model.narrow(sums))
        assert arrays.get(name, None, max(1, len(sums))).tolist() == sums.tolist()
    import pyarrow as pa

    keys = np.array([3, 5, 9], np.uint64)
    batch = pa.RecordBatch.from_pylist([{"bucket": 0, "keys": keys.tobytes(), "sums": language_model._packed(big)}] * 3, schema=language_model.RUN_SCHEMA)
    ((bucket, got, sums),) = language_model._buckets([batch], "<u8")
    assert (bucket, got.tolist(), sums.tolist()) == (0, [3, 5, 9], (3 * big).tolist())


def test_runs_are_merged_as_they_come(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(language_model, "MERGE", 50)
    rng, want, rows = np.random.default_rng(6), Counter(), []
    for _ in range(200):
        keys, sums = language_model.summed(rng.integers(0, 300, 40).astype(np.uint64))
        bucket = int(rng.integers(0, 2))
        want.update({(bucket, k): n for k, n in zip(keys.tolist(), sums.tolist())})
        rows.append({"bucket": bucket, "keys": keys.tobytes(), "sums": language_model._packed(sums)})
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 7], schema=language_model.RUN_SCHEMA) for i in range(0, 200, 7)]
    got = {(b, k): n for b, keys, sums in language_model._buckets(batches, "<u8") for k, n in zip(keys.tolist(), sums.tolist())}
    assert got == want


def test_runs_have_rows_of_bounded_size():
    keys = np.arange(100_000, dtype=np.uint64)
    batches = list(language_model.runs_of(keys, (keys % 700).astype(np.int64), np.array([10, 60_000], np.uint64)))
    assert max(len(r["keys"]) for b in batches for r in b.to_pylist()) <= 1 << 17
    got = list(language_model._buckets(batches, "<u8"))
    assert [(b, len(k)) for b, k, _ in got] == [(0, 10), (1, 59_990), (2, 40_000)]
    assert (np.concatenate([k for _, k, _ in got]) == keys).all() and (np.concatenate([n for *_, n in got]) == keys % 700).all()


def test_texts_leave_a_batch_a_few_at_a_time():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": f"word{i} " * 1000} for i in range(2000)])
    tracemalloc.start()
    try:
        n = sum(len(h) for _, hashes in language_model._hash_groups([batch], 10_000, "doc_id") for h in hashes)
        assert n == 2000 * 1001 and tracemalloc.get_traced_memory()[1] < batch.nbytes / 2
    finally:
        tracemalloc.stop()


def test_training_leaves_its_arrays_alone(spark, docs):
    root = scratch(spark, "m").removeprefix("file://").rpartition("/")[0]
    before = {*os.listdir(root)} if os.path.isdir(root) else set()
    uri = scratch(spark, "m")
    language_model.train(docs, uri, buckets=3)
    assert {*os.listdir(root)} - before == {uri.rpartition("/")[2]}
    assert {x.split("-")[0] for x in os.listdir(f"{root}/{uri.rpartition('/')[2]}")} == {"words", "pairs", "stats"}


def test_mixing_is_a_bijection():
    x = np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64)
    assert (language_model.unmixed(language_model.mixed(x)) == x).all()


# -- classifier -------------------------------------------------------------------------


def test_classifier(spark, docs, empty):
    out = {r["doc_id"]: r for r in quality_classifier.op10_quality_classifier(spark, SF).collect()}
    held = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([out[r["doc_id"]]["predicted"] == r["quality"] for r in held]) > 0.93
    assert all(out[r["doc_id"]]["held_out"] for r in held)
    labels = docs.select("doc_id", F.when(F.col("doc_id") == 3, None).otherwise((F.col("doc_id") % 2).cast("int")).alias("quality")).distinct()
    model = quality_classifier.fit(docs, labels, sample=30)
    odd = {r["doc_id"]: r["score"] for r in quality_classifier.classify(docs, model).collect()}
    assert all(0 <= s <= 1 for s in odd.values()) and odd[60] == odd[61] == model["prior"] and len(model["y"]) <= 31
    nothing = quality_classifier.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality_classifier.classify(docs, nothing).collect()} == {0.5}
    assert quality_classifier.classify(empty, model).count() == 0


def test_scripts_and_very_long_texts_are_told_apart(spark):
    rng = random.Random(15)
    text = lambda letters, n=200: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    kinds = ("αβγδε", "абвгд", "אבגדה", "あいうえお")
    rows = [(i, text(kinds[i % 4])) for i in range(200)] + [(500, text(kinds[1], 60_000))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = table.filter("doc_id < 100").select("doc_id", F.when(F.col("doc_id") % 4 == 1, 1).otherwise(0).alias("quality"))
    scores = {r["doc_id"]: r["score"] for r in quality_classifier.classify(table, quality_classifier.fit(table, labels)).collect()}
    assert all((scores[i] >= 0.5) == (i % 4 == 1) for i in range(100, 200)) and scores[500] >= 0.5


def test_votes_are_exact_cosines(docs, corpus):
    labels = docs.filter("doc_id < 40").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality_classifier.fit(docs, labels)
    counts = np.stack([quality_classifier.term_counts(r[1]) for r in corpus[:12]])
    x = quality_classifier.weighted(counts, model["idf"]).astype(np.float32) @ model["basis"]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for row, score in zip(x @ model["vectors"].T, quality_classifier.vote(model, counts)):
        near = np.argsort(-row)[: quality_classifier.NEIGHBOURS]
        weight = np.clip(row[near], 0, 1) ** quality_classifier.POWER / np.where(model["y"][near] == 1, model["prior"], 1 - model["prior"]) ** quality_classifier.BALANCE
        assert math.isclose(score, (weight * model["y"][near]).sum() / weight.sum(), rel_tol=1e-4)


@pytest.mark.parametrize("run", [lambda d: simhash.near_duplicates(d), lambda d: similar.similar_documents(d), lambda d: packing.pack_documents(d), lambda d: language.predict(d, *language.learn(d)), lambda d: language_model.score(d, language_model.train(d, scratch(d.sparkSession, "m"))), lambda d: quality_classifier.classify(d, quality_classifier.fit(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))))], ids=["simhash", "similar", "packing", "language", "model", "classifier"])
def test_clashing_columns_and_missing_ids(run, docs, clashing, nameless):
    assert run(clashing).count() >= docs.count()
    assert run(nameless).count() >= nameless.count()
