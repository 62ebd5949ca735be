import random

import pytest

from palimpsest.session import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    return ship(spark)


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, junk, nulls, empty and very long texts, and repeated rows."""
    rng = random.Random(5)
    base = words(rng, 120)
    shared = "This line is shared by many documents of all kinds."
    rows = [(i, "\n".join([words(rng, rng.randint(12, 60)).capitalize() + ".", shared if i % 3 == 0 else words(rng, 9), words(rng, 5)]), ("en", "de")[i % 2], f"s{i % 3}") for i in range(40)]
    rows += [(40 + i, base, "en", "s0") for i in range(4)]  # copies
    rows += [(50 + i, base.replace(base.split()[7 + i], "changed", 1), "en", "s0") for i in range(4)]  # near copies
    rows += [(60, None, None, None), (61, "", "en", "s1"), (62, " \n\t\n ", "de", None), (63, "###", "en", "s2"), (64, "a", "en", "s2")]
    rows += [(70, words(rng, 20_000), "de", "s1"), (71, "same words again " * 300, "en", "s2"), (72, shared, "en", "s2"), (73, f"{shared}\n  {shared.upper()} \n{shared}", "en", "s0")]
    rows += [(80, rows[3][1], "en", "s0"), (80, rows[3][1], "en", "s0")]  # a row twice
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same with columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ("n_words", "kept", "base_failed", "n_lines", "n_dropped", "score", "fp", "f0", "component_id", "length", "_new", "n_email", "lang_pred", "item_id")
    return docs.withColumns({n: F.lit("x") for n in names})


@pytest.fixture(scope="session")
def nameless(spark, corpus):
    """Rows without an id."""
    return spark.createDataFrame([(None, *r[1:]) for r in corpus[:6]] + list(corpus[6:12]), SCHEMA)
