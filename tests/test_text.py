import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest import schema as S
from palimpsest.functions import arrow, plain
from palimpsest.functions import text as X

WORDS = st.lists(st.sampled_from(["a", "the", "party", "Fees", ",", ".", "(30)", "é", "  "]), max_size=12).map(" ".join)


@pytest.mark.parametrize("text,label", [
    ("12.1  Governing Law. x", "12.1"), ("12. General Provisions", "12"), ("1.2.3  Deeply nested clause.", "1.2.3"),
    ("99.0%-99.89% uptime", None), ("Monthly Uptime Commitment: 99.9%", None), ("", None), ("12. Wide", "12"), ("12.1.\ttab", "12.1"), ("12.", None),
])
def test_labels(spark, text, label):
    assert (plain.parse_label(text) or (None,))[0] == label
    assert spark.createDataFrame([(text,)], "t string").select(X.label(F.col("t"))).first()[0] == label


@pytest.mark.parametrize("text,numbers", [
    ("Sections 2.2, 2.3 and 3.1", ["2.2", "2.3", "3.1"]), ("subject to Section 10.", ["10"]), ("SECTION 9, THE", ["9"]),
    ("within thirty (30) days", []), ("Section 4.2 and the rest", ["4.2"]), ("Clause 1 – 3", ["1", "3"]), ("subsections 1; 2 & 3", ["1", "2", "3"]),
])
def test_references(text, numbers):
    found = plain.references(text)
    assert [n for _, _, n, _ in found] == numbers
    assert all(text[s:e] == n for s, e, n, _ in found)


def test_fold_keeps_length_and_agrees(spark):
    text = "“It’s” – a b​c\tﬁＡ"
    assert len(S.FOLD) == 39
    assert plain.fold(text) == "\"It's\" - a b c ﬁA" and len(plain.fold(text)) == len(text)
    row = spark.createDataFrame([(text,)], "t string").select(X.folded(F.col("t")), arrow.fold("t")).first()
    assert row[0] == "\"It's\" - a b c ﬁＡ" and row[1] == plain.fold(text)


@settings(max_examples=150, deadline=None)
@given(WORDS, WORDS)
def test_diff_rebuilds_the_new_text(old, new):
    out = old
    for _, s, e, text in reversed(plain.diff(old, new, ignore_whitespace=False)):
        out = out[:s] + text + out[e:]
    assert out == new
    squeezed = old
    for _, s, e, text in reversed(plain.diff(old, new)):
        squeezed = squeezed[:s] + text + squeezed[e:]
    assert re.sub(r"\s", "", squeezed) == re.sub(r"\s", "", new)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=9))
def test_longest_rising(values):
    from itertools import combinations

    found = plain.longest_rising(values)
    rising = lambda idx: all(values[a] < values[b] for a, b in zip(idx, idx[1:]))
    assert rising(found)
    assert not any(rising(c) for c in combinations(range(len(values)), len(found) + 1))


def test_locate_reasons():
    text, longer = "The Provider and the Provider agree.", "The Provider and the Provider agree. gone"
    at = lambda *a: plain.locate(text, longer, *a)
    assert at("  ")[1] == "empty_target"
    assert plain.locate(None, "", "x")[1] == "paragraph_not_found"
    assert at("gone")[1] == "target_already_struck"
    assert at("nowhere")[1] == "target_not_found"
    assert at("Provider")[1] == "target_ambiguous"
    assert at("Provider", 2)[0] == [(21, 29)]
    assert len(at("Provider", 0)[0]) == 2
    assert at("Provider", 3)[1] == "target_not_found"
    assert plain.find_all("aaaa", "aa") == [0, 1, 2]


def test_columns(spark):
    df = spark.createDataFrame([("Ann van der Berg", " a  b ", "Termination fees and GDPR")], "n string, t string, r string")
    row = df.select(X.initials(F.col("n")), X.normalised(F.col("t")), X.risks(F.col("r")), X.hits(F.lit("aaaa"), "aa"), X.hits(F.lit("aaaa"), "aa", False), F.size(X.tokens(F.lit("Ça va, 3.")))).first()
    assert row[0] == "AVD" and row[1] == "a b" and row[2] == ["termination", "payment"] and row[3] == [0, 1, 2] and row[4] == [0, 2] and row[5] == 7
    assert plain.initials("") == "R"
