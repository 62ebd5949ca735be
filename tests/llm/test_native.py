"""Quality rules, line dedup and pseudonyms: against SQL, a plain version, and their odd cases."""

import datetime
import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import line_dedup, pii, quality_rules


def by_sql(corpus, sql):
    rows = pd.DataFrame(corpus, columns=["doc_id", "text", "lang", "source", "n_chars"]).drop_duplicates("doc_id")  # noqa: F841 - DuckDB reads it
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT doc_id, CAST(text AS VARCHAR) AS text, lang, source, n_chars FROM rows")
    out = con.execute(sql)
    return [d[0] for d in out.description], {r[0]: r for r in out.fetchall()}


def test_quality_rules_match_sql(docs, corpus):
    once = docs.dropDuplicates(["doc_id"])
    columns, want = by_sql(corpus, quality_rules.ORACLE_SQL)
    got = {r["doc_id"]: tuple(r[c] for c in columns) for r in quality_rules.judge(once).collect()}
    assert got == want
    assert got[60][1] == 0 and got[60][6] and not got[60][7]  # null: no words, fails
    assert got[71][5] == 900 and got[71][6]


def test_host_rates_are_shrunk(spark):
    rows = [(i, "good", False) for i in range(200)] + [(1000 + i, "bad", i < 190) for i in range(200)] + [(2000, "tiny", True)]
    hosts = {r["_host"]: r for r in quality_rules.host_verdicts(spark.createDataFrame(rows, "doc_id long, source string, base_failed boolean")).collect()}
    assert hosts["bad"]["rejected"] and not hosts["good"]["rejected"]
    assert hosts["tiny"]["rate"] < 1  # one failure is no certainty


def test_a_bad_host_takes_its_documents(spark, monkeypatch):
    ok = " ".join(f"w{i}" for i in range(30))
    rows = [(i, ok if i % 20 == 0 else "x", "bad") for i in range(100)] + [(200 + i, f"{ok} {i}", "good") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in quality_rules.judge(df).filter("kept").collect()}
    assert kept == set(range(200, 300))
    monkeypatch.setattr(quality_rules, "BROADCAST_BYTES", 0)  # hosts over the bound: the salted join
    assert {r["doc_id"] for r in quality_rules.judge(df).filter("kept").collect()} == kept


def test_line_dedup_matches_sql(docs, corpus):
    once = docs.dropDuplicates(["doc_id"])
    columns, want = by_sql(corpus, line_dedup.ORACLE_SQL)
    out = line_dedup.dedup_lines(once).withColumn("kept_sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    assert {r["doc_id"]: tuple(r[c] for c in columns) for r in out.collect()} == want
    for batches, fanout in ((1, 2), (7, 2)):
        again = line_dedup.dedup_lines(once, batches=batches, fanout=fanout)
        assert {(r["doc_id"], r["n_dropped"]) for r in again.collect()} == {(k, v[2]) for k, v in want.items()}


def test_line_dedup_beyond_the_broadcast_bound(docs, monkeypatch):
    want = {(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(docs).collect()}
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    assert {(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(docs).collect()} == want


def test_runs_are_levelled(spark):
    state = line_dedup.LineRuns(fanout=3)
    for b in range(9):
        state.add(spark.createDataFrame([(100 - b, 1, 1), (100 - b, b + 5, 2)], "doc_id long, h1 long, h2 long"))
    assert [len(level) for level in state.levels] == [0, 0, 1]
    merged = {(r["h1"], r["last_doc"]) for r in state.merged().collect()}
    assert merged == {(1, 100)} | {(b + 5, 100 - b) for b in range(9)}


# -- pseudonyms: a plain version of the networks ------------------------------------


def plain_permuted(text, kind, key, alphabets=pii.PLAIN):
    half = (len(text) + 1) // 2
    a, b = list(text[:half]), list(text[half:])

    def shifted(chars, other, r):
        digest = hashlib.sha256(f"{key}|{kind}|{r}|{len(text)}|{''.join(other)}".encode()).hexdigest()
        out = []
        for i, c in enumerate(chars):
            by = int(digest[i % 32 * 2 : i % 32 * 2 + 2], 16) + i // 32
            letters = next((x for x in alphabets if c in x), None)
            out.append(letters[(letters.index(c) + by) % len(letters)] if letters else c)
        return out

    for r in range(pii.ROUNDS):
        if r % 2 == 0:
            a = shifted(a, b, r)
        else:
            b = shifted(b, a, r)
    return "".join(a + b)


def luhn(s):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


@pytest.fixture(scope="module")
def private(spark):
    texts = [
        "mail anna.lee-7@mail3.example.com now", "card 4539578763621486, and 4539-5787-6362-1486.", "no card 4539578763621487",
        "ip 10.0.0.255 here", "call +1 (743) 555-3824 or 743-555-3824", "ssn 123-45-6789 not 000-12-1234 or 123-00-1234", "on 2024-02-29, 31/12/1999, 12/31/1999 and 1.2.2003, not 2024-02-30",
        "iban DE89370400440532013000 not DE89370400440532013001", 'token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f".', "v1.2.3 costs 100 of 2024 items 12345", None, "", "card 4539578763621486 again",
        "+1 (826) 555-4081 190.137.223.204", "4539578763621486 4539578763621486", "call +44 20 7946 0958.",
    ]
    rows = {r["doc_id"]: r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()}
    return texts, rows


def test_pseudonyms(private):
    texts, rows = private
    t = {i: r["text"] for i, r in rows.items()}
    assert t[0] == f"mail {plain_permuted('anna.lee-7', 'email', 'k')}@mail3.example.com now"
    body = plain_permuted("453957876362148", "card", "k")
    card = next(body + str(d) for d in range(10) if luhn(body + str(d)))
    assert t[1] == f"card {card}, and {card[:4]}-{card[4:8]}-{card[8:12]}-{card[12:]}." and t[12] == f"card {card} again"
    assert t[2] == texts[2] and t[9] == texts[9] and t[10] is None and t[11] == ""
    assert re.fullmatch(r"ip \d+\.\d+\.\d+\.\d+ here", t[3]) and t[3] != texts[3] and all(int(x) < 256 for x in t[3][3:-5].split("."))
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} or \d{3}-\d{3}-\d{4}", t[4]) and "743" not in t[4][:12]
    assert "000-12-1234" in t[5] and "123-00-1234" in t[5] and "123-45-6789" not in t[5]
    assert "2024-02-30" in t[6] and "2024-02-29" not in t[6] and rows[6]["n_date"] == 4
    iban = t[7].split()[1]
    assert iban[:2] == "DE" and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and "not DE89370400440532013001" in t[7]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} \d+\.\d+\.\d+\.\d+", t[13]) and "555-4081" not in t[13] and "190.137.223.204" not in t[13]
    assert t[14] == f"{card} {card}" and rows[14]["n_card"] == 2
    assert re.fullmatch(r"call \+44 \d\d \d{4} \d{4}\.", t[15]) and t[15] != texts[15]
    secret = re.search(r'"(.*)"', t[8])[1]
    assert secret == plain_permuted("9c8b45435718dcc700c184a7e303cdc64c6a8f7f", "secret", "k", pii.HEX_LOWER)


def plain_number(a, b, high, low, kind, key="k"):
    by = lambda x, r, below: int(hashlib.sha256(f"{key}|{kind}|{r}|{x}".encode()).hexdigest()[:12], 16) % below
    for r in range(pii.ROUNDS):
        if r % 2 == 0:
            a = (a + by(b, r, high)) % high
        else:
            b = (b + by(a, r, low)) % low
    return a, b


def plain_date(text):
    sep = re.search(r"\D", text)[0]
    p = [int(x) for x in text.split(sep)]
    swapped = sep == "/" and p[1] > 12
    y, m, d = p if sep == "-" else (p[2], p[0], p[1]) if swapped else p[::-1]
    days = (datetime.date(y, m, d) - datetime.date(1900, 1, 1)).days
    a, b = plain_number(days // pii.LOW, days % pii.LOW, pii.HIGH, pii.LOW, "date")
    new = datetime.date(1900, 1, 1) + datetime.timedelta(a * pii.LOW + b)
    if sep == "-":
        return new.isoformat()
    pad = "02d" if re.search(r"^0|^\d+[/.]0", text) else "d"
    first, second = (new.month, new.day) if swapped else (new.day, new.month)
    return f"{first:{pad}}{sep}{second:{pad}}{sep}{new.year}"


def plain_iban(text):
    x = text.replace(" ", "")
    value = lambda s: int("".join(str(int(c, 36)) for c in s)) % 97
    assert value(x[4:] + x[:4]) == 1
    body = plain_permuted(x[4:], "iban", "k")
    new = f"{x[:2]}{98 - value(body + x[:2] + '00'):02d}{body}"
    return " ".join(new[i : i + 4] for i in range(0, len(new), 4)) if " " in text else new


def plain_ssn(text):
    valid = lambda x: not re.match("000|666|9", x) and "-00-" not in x and not x.endswith("-0000")
    new = plain_permuted(text, "ssn", "k")
    while not valid(new):
        new = plain_permuted(new, "ssn", "k")
    return new


def plain_phone(text):
    prefix = (re.match(r"\+\d{1,3}(?=[ .(-])|\+\d", text) or [""])[0]
    digits = iter(plain_permuted(re.sub(r"\D", "", text[len(prefix) :]), "phone", "k"))
    return prefix + "".join(next(digits) if c.isdigit() else c for c in text[len(prefix) :])


def plain_ip(text):
    o = [int(x) for x in text.split(".")]
    a, b = plain_number(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
    return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"


def test_every_kind_against_a_plain_version(spark):
    rng = random.Random(3)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def iban(country, n, grouped):
        body = digits(n - 4)
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        x = f"{country}{check:02d}{body}"
        return " ".join(x[i : i + 4] for i in range(0, n, 4)) if grouped else x

    cases = []
    for _ in range(25):
        cases += [("ssn", f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}", plain_ssn), ("ip", ".".join(str(rng.randint(0, 255)) for _ in range(4)), plain_ip)]
        day = datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(pii.HIGH * pii.LOW))
        cases += [("date", x, plain_date) for x in (day.isoformat(), f"{day.day}/{day.month}/{day.year}", f"{day.day:02d}.{day.month:02d}.{day.year}", f"12/{13 + day.day % 16}/{day.year}")]
        cases += [("iban", iban(*x), plain_iban) for x in (("DE", 22, False), ("DE", 22, True), ("BE", 16, True), ("FR", 27, True))]
        cases += [("phone", x, plain_phone) for x in (f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"5{digits(2)}.6{digits(2)}.{digits(4)}", f"4{digits(2)} 7{digits(2)} {digits(4)}")]
    table = spark.createDataFrame([(i, f"see {x} 2024 here") for i, (_, x, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(table, "k").collect()}
    for i, (kind, x, plain) in enumerate(cases):
        assert got[i]["text"] == f"see {plain(x)} 2024 here", (kind, x)
        assert got[i][f"n_{kind}"] == (plain(x) != x)


def test_networks_are_bijections(spark):
    df = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("s"))
    assert df.select(pii.permuted(F.col("s"), "t", "k").alias("p")).distinct().filter(F.col("p").rlike(r"^\d{4}$")).count() == 10_000
    days = spark.range(pii.HIGH * pii.LOW).select(F.date_format(F.date_add(F.lit(pii.FIRST_DAY).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    assert days.select(pii._date(F.col("d"), "k").alias("p")).distinct().count() == pii.HIGH * pii.LOW
    assert {r[0] for r in df.limit(50).select(pii.permuted(F.col("s"), "t", "k")).collect()} != {r[0] for r in df.limit(50).select(pii.permuted(F.col("s"), "t", "other")).collect()}


@pytest.mark.parametrize("run", [quality_rules.judge, line_dedup.dedup_lines, pii.pseudonymise], ids=["quality", "lines", "pii"])
def test_odd_tables(run, docs, empty, clashing, nameless):
    assert run(empty).count() == 0
    base = run(docs)
    assert base.count() == docs.count()
    other = run(clashing)
    shared = [c for c in base.columns if c in other.columns]
    assert sorted(map(repr, other.select(shared).collect())) == sorted(map(repr, base.select(shared).collect()))
    assert run(nameless).count() == nameless.count()


def test_no_python_in_native_plans(docs):
    for df in (quality_rules.document_rules(docs), line_dedup.keyed_lines(docs), pii.pseudonymise(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def plain_dedup(texts):
    """Line dedup of {doc_id: text}, by the rule's own words."""
    holders = defaultdict(set)
    key = lambda line: re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    for d, t in texts.items():
        for line in t.split("\n"):
            holders[key(line)].add(d)
    gone = lambda d, k: len(k) >= 20 and len(holders[k]) >= 3 and d != max(holders[k])
    return {d: "\n".join(x for x in t.split("\n") if not gone(d, key(x))) for d, t in texts.items()}
