"""Table operators against plain versions: clauses of any depth, references, hits, duplicates, comparison."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import plain
from palimpsest.functions import text as X
from palimpsest.operators import actions as A
from palimpsest.operators import clauses as C
from palimpsest.operators import edits as E
from palimpsest.operators import paragraphs as P
from palimpsest.plans import merge
from palimpsest.plans.catalogue import QUERIES, contracts, turns
from palimpsest.session import ship

SF = "/root/testdata/sf0.001"


def table(spark, texts):
    return spark.createDataFrame([(d, i, t) for d, own in texts.items() for i, t in enumerate(own)], "doc_id long, para_id int, text string").repartition(3)


def labels_of(rng, n, deepest):
    """Labels of a document in order, jumping up and down between levels."""
    out, now = [], [1]
    for _ in range(n):
        out.append(".".join(map(str, now)))
        if len(now) < deepest and rng.random() < 0.6:
            now = now + [rng.randint(1, 3)] * rng.choice([1, 1, 1, 2])
            now = now[:deepest]
        else:
            now = now[: rng.randint(1, len(now))]
            now[-1] += 1
    return out


def plain_tree(labels):
    """(parent's place, path of places) of each label, by a stack."""
    stack, children, out = [], Counter(), []
    for i, label in enumerate(labels):
        n = label.count(".") + 1
        while stack and stack[-1][0] >= n:
            stack.pop()
        up, path = (stack[-1][1], stack[-1][2]) if stack else (None, ())
        children[up] += 1
        path = (*path, children[up])
        stack.append((n, i, path))
        out.append((up, ".".join(map(str, path))))
    return out


def numbered(label):
    return f"{label}. Of it." if "." not in label else f"{label}  Of it."


def test_trees_of_any_depth(spark):
    rng = random.Random(1)
    docs = {d: labels_of(rng, 60, 13) for d in range(6)} | {9: ["1.2.3", "1", "4.5.6.7", "2.1"]}
    assert max(x.count(".") for own in docs.values() for x in own) >= 11
    clauses = C.parse(table(spark, {d: [numbered(x) for x in own] for d, own in docs.items()}))
    want = {(d, i): x for d, own in docs.items() for i, x in enumerate(plain_tree(own))}
    found = {(r["doc_id"], r["para_id"]): r for r in C.tree(clauses).collect()}
    assert {k: r["parent_id"] for k, r in found.items()} == {k: up for k, (up, _) in want.items()}
    assert all(r["parent"] == (None if r["parent_id"] is None else docs[r["doc_id"]][r["parent_id"]]) for r in found.values())
    assert {(r["doc_id"], r["para_id"]): r["new_label"] for r in C.renumber(clauses).collect()} == {k: path for k, (_, path) in want.items()}
    roots = spark.createDataFrame([(0, docs[0][3]), (9, "4.5.6.7")], "doc_id long, label string")

    def below(d, i, label):
        while i is not None:
            if docs[d][i] == label:
                return True
            i = want[d, i][0]
        return False

    got = {(r["doc_id"], r["para_id"]) for r in C.subtree(clauses, roots).collect()}
    assert got == {(d, i) for d, label in ((0, docs[0][3]), (9, "4.5.6.7")) for i in range(len(docs[d])) if below(d, i, label)}


def test_one_shuffle_makes_a_tree_and_its_numbers(spark):
    clauses = C.parse(table(spark, {0: ["1. A", "1.1  B"]}))
    out = C.mapping(C.renumber(clauses))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    # The test's own repartition is one, the operators' another.
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1 and "Join" not in plan


REFERRING = ["see Section 2.2, 2.3 and 3.1; or Clauses 4 to 6 & 7.", "SECTION 9, THE 3", "within 30 days", "section", "Sections 1Section 2", "articles 1–3 — paragraph  12.4.5 through 13 and the rest", "é Section 4.2. Subsection 1;2", None, "", "Section 5.1 or5.2", "intersection 3 Clause 9"]


def test_references_in_the_jvm_are_the_plain_ones(spark):
    rng = random.Random(2)
    bits = ["Section", " sections", "clause ", " 1", "2.3", " and ", ", ", " or", "-", "x", " ", "é", " ", "to", "4."]
    texts = REFERRING + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    rows = table(spark, {0: texts})
    got = {r["para_id"]: [tuple(x) for x in r["r"] or []] for r in rows.select("para_id", X.references(F.col("text")).alias("r")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain.references(t or ""), t
    assert C.references(rows).count() == sum(len(plain.references(t or "")) for t in texts)


def test_hits_are_the_plain_ones(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab\U0001f600.") for _ in range(rng.randint(0, 30))), "".join(rng.choice("ab.") for _ in range(rng.randint(1, 3)))) for i in range(300)]
    rows += [(300, "x\\Ey\\E\\E", "\\E"), (301, "a\nb\na", "\n"), (302, "", "a"), (303, "aaaa", ""), (304, "a" * 5000, "aa")]
    df = spark.createDataFrame(rows, "i int, t string, n string")
    both = X.hits(F.col("t"), F.col("n")), X.hits(F.col("t"), F.col("n"), False)

    def apart(t, n):
        out, at = [], t.find(n) if n else -1
        while at >= 0:
            out.append(at)
            at = t.find(n, at + len(n))
        return out

    for r in df.select("t", "n", both[0].alias("a"), both[1].alias("b")).collect():
        assert r["a"] == plain.find_all(r["t"], r["n"]) and r["b"] == apart(r["t"], r["n"])


def test_duplicates_of_a_hot_line(spark):
    rng = random.Random(4)
    texts = {d: [rng.choice(["All  the same.", " All the same.", "Once " + str(d * 100 + i), "", " "]) for i in range(40)] for d in range(30)}
    first, want = {}, set()
    for d, own in texts.items():
        for i, t in enumerate(own):
            key = " ".join(t.split())
            if key and key in first:
                want.add((d, i, *first[key]))
            first.setdefault(key, (d, i))
    assert {tuple(r) for r in P.duplicates(table(spark, texts)).collect()} == want and len(want) > 400


def test_place_is_of_clause_or_section_alone(spark):
    items = [{"type": "insert_clause", "after_clause": "2.1"}, {"type": "comment", "clause": "1.2"}, {"type": "delete_section", "section": "7"}, {"type": "insert_clause", "into_section": "1", "section": ""}, {"type": "comment"}]
    assert [merge.position(x) for x in items] == [(9999,), (1, 2), (7,), (9999,), (9999,)]
    names = ("type", "clause", "section", "after_clause", "into_section")
    df = spark.createDataFrame([(i, *(x.get(n) for n in names)) for i, x in enumerate(items)], "seq int, " + ", ".join(f"{n} string" for n in names))
    assert [tuple(r[0]) for r in df.orderBy("seq").select(A.position(A.target(df))).collect()] == [merge.position(x) for x in items]


def test_conflicts_of_items_without_a_quote():
    items = [{"type": "replace_text", "clause": "1", "severity": "high"}, {"type": "delete_text", "clause": "1", "find": "a"}, {"type": "replace_text", "clause": "1", "find": "ab"}]
    report = merge.Report()
    assert merge.conflicts(items, report) == items[:2] and len(report.ledger) == 1


# -- what SQL can't say: comparison by longest common parts ------------------------------


def longest(a, b, alo, ahi, blo, bhi):
    """The longest common part, the earliest in a, then in b."""
    best = (alo, blo, 0)
    for i in range(alo, ahi):
        for j in range(blo, bhi):
            k = 0
            while i + k < ahi and j + k < bhi and a[i + k] == b[j + k]:
                k += 1
            if k > best[2]:
                best = (i, j, k)
    return best


def matches(a, b, alo=0, ahi=None, blo=0, bhi=None):
    ahi, bhi = len(a) if ahi is None else ahi, len(b) if bhi is None else bhi
    i, j, k = longest(a, b, alo, ahi, blo, bhi)
    return [*matches(a, b, alo, i, blo, j), (i, j, k), *matches(a, b, i + k, ahi, j + k, bhi)] if k else []


@pytest.fixture(scope="module")
def pairs(spark):
    return {(r["conv_id"], r["turn"]): r for r in turns(ship(spark), SF).collect()}


def test_similarity_of_all_rows(spark, pairs):
    rows = QUERIES["q35_similarity"](spark, SF).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        a, b = (" ".join(pairs[r["conv_id"], r["turn"]][c].split()) for c in ("text", "next"))
        if len(a) * len(b) <= 40_000:
            want = 2 * sum(k for _, _, k in matches(a, b)) / (len(a) + len(b)) if a or b else 1.0
            assert abs(r["similarity"] - want) < 1e-6


def test_word_diff_of_all_rows(spark, pairs):
    """The counted changes lead from the old text to the new, and are those of the longest common parts."""
    import re

    rows = QUERIES["q34_word_diff"](spark, SF).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        old, new = (pairs[r["conv_id"], r["turn"]][c] for c in ("text", "next"))
        ops = plain.diff(old, new)
        out = old
        for _, s, e, text in reversed(ops):
            out = out[:s] + text + out[e:]
        assert re.sub(r"\s", "", out) == re.sub(r"\s", "", new)
        assert Counter(x[0] for x in ops) == Counter({k: n for k, n in (("insert", r["inserts"]), ("delete", r["deletes"]), ("replace", r["replaces"])) if n})
        a, b = (re.findall(r"\w+|\s+|[^\w\s]", t) for t in (old, new))
        if len(a) * len(b) <= 20_000:
            common = sum(len(a[i + x]) for i, _, k in matches(a, b) for x in range(k) if a[i + x].strip())
            struck = sum(len(re.sub(r"\s", "", old[s:e])) for _, s, e, _ in ops)
            put = sum(len(re.sub(r"\s", "", text)) for *_, text in ops)
            # What isn't common is struck and put in; only blanks between near changes go along.
            assert struck == len(re.sub(r"\s", "", old)) - common and put == len(re.sub(r"\s", "", new)) - common


def test_aligned_versions_of_all_contracts(spark):
    found = defaultdict(dict)
    for r in QUERIES["q40_aligned_versions"](spark, SF).collect():
        found[r["pair_id"]][r["kind"]] = r["n"]
    texts = defaultdict(list)
    for r in contracts(spark, SF).orderBy("doc_id", "para_id").collect():
        texts[r["doc_id"]].append((r["para_id"], r["text"]))
    assert set(found) == set(texts)
    for d, own in texts.items():
        old = [t for _, t in own]
        new = [t.replace(" days", " weeks") if i % 5 == 0 else t for i, t in own if not (t.startswith("Note") and i % 2 == 0)]
        want, at, bt = Counter(), 0, 0
        for i, j, k in [*matches(old, new), (len(old), len(new), 0)]:
            gap = [(old[at + x] if at + x < i else None, new[bt + x] if bt + x < j else None) for x in range(max(i - at, j - bt))]
            for x, y in gap:
                if x is None or y is None:
                    want["insert" if x is None else "delete"] += 1
                    continue
                common = sum(n for *_, n in matches(x, y))
                want.update(["change"] if 2 * common / (len(x) + len(y)) >= 0.45 else ["delete", "insert"])
            want["equal"] += k
            at, bt = i + k, j + k
        assert found[d] == {k: n for k, n in want.items() if n}


def test_edits_carry_their_paragraph(spark):
    paras = table(spark, {0: ["one two one", "three"]})
    edits = spark.createDataFrame([(0, 1, 0, "one", "1", 0), (0, 2, 0, "two one", "x", 1), (0, 3, 1, "three", None, 1), (0, 4, 5, "a", "b", 1)], "doc_id long, seq int, para_id int, target string, replacement string, occurrence int")
    out = {r["para_id"]: r for r in E.apply(E.locate(edits, paras)).collect()}
    assert out[0]["accepted"] == "1 two 1" and out[0]["applied"] == [1] and out[0]["conflicts"] == [2] and out[1]["accepted"] == ""
