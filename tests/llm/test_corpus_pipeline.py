"""The pipeline's stages on a small table, against plain versions."""

import pytest

import corpus_pipeline
from palimpsest.llm import quality_rules
from palimpsest.llm.tokens import vocabulary

from .test_models import crc, ids_of, plain_components, words
from .test_native import plain_dedup


def plain_representatives(texts):
    """The least ids of groups linked by a similarity of 0.8 and more of five-word shingles; texts without words are alike."""
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t)) else set() for d, t in texts.items()}
    near = [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))]
    return set(plain_components(sets, near).values())


@pytest.fixture(scope="module")
def sf(spark, docs, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{at}/documents.parquet")
    item = docs.filter("doc_id = 7").first()["text"].split("\n")[0]
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_follow_plain_versions(spark, docs, sf, tmp_path):
    now, states = docs, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, sf).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        states.append({r["doc_id"]: r for r in now.collect()})
        if len(states) < 5:
            assert now.columns == docs.columns
    rules = {r["doc_id"] for r in quality_rules.document_rules(docs).filter("NOT base_failed").collect()}
    assert set(states[0]) == rules  # no host is bad enough to lose its clean documents
    assert {d: r["text"] for d, r in states[1].items()} == plain_dedup({d: r["text"] for d, r in states[0].items()})
    assert all(r["n_chars"] == len(r["text"]) for r in states[1].values())
    assert set(states[2]) == plain_representatives({d: r["text"] for d, r in states[1].items()})
    assert set(states[3]) == {d for d, r in states[2].items() if d != 7}  # the benchmark's one item is a line of it
    pieces, want = [tuple(r)[:5] for r in now.collect()], []
    for d, r in states[3].items():
        ids = ids_of(vocabulary("word_bpe_49k.json"), r["text"], 1)
        want += [(d, k, at, len(ids[at : at + 4096]), crc(ids[at : at + 4096])) for k, at in enumerate(range(0, len(ids), 4096))]
    assert set(pieces) == set(want) and len(pieces) == len(want) + 1  # one document has two rows
    # The copies' one line stays in the last of them, which so stands for the near copies; the others are empty and alike.
    assert set(states[2]) & {40, 41, 42, 43, 50, 51, 52, 53} == {40, 43}
    assert set(states[2]) - set(states[3]) == {7}
    assert set(states[4]) == set(states[3])


def test_run_and_odd_tables(spark, empty, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
