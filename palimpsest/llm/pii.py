"""Format-preserving pseudonyms for personal data (DataFrame and SQL functions only).

Found values are validated (Luhn, mod 97, octets, calendar) and then permuted
within their format by keyed Feistel networks, so that equal values stay equal in
all documents and different ones stay different. What doesn't validate stays.

* card: 13 to 19 digits that pass Luhn; all digits but the last are permuted and
  the check digit is computed anew, so the pseudonym passes as well.
* iban (in one or in groups of four of its country's length): country, length and
  groups stay, the account's letters and digits are permuted in their classes, and the
  check digits are computed anew.
* ssn (ddd-dd-dddd of a valid area, group and serial), phone: digits are permuted,
  an international prefix stays; an ssn walks its cycle until it is valid.
* ip: dotted octets, permuted as 32 bits.
* date (ISO, d/m/y or m/d/y with slashes, d.m.y): the day number is permuted within
  the 73,170 days from 1900-01-01; form, order and zero padding stay.
* email: letters and digits of the local part are permuted in their classes.
* secret: 32 to 64 hexadecimal digits with both letters and digits.

Not covered: names, postal addresses, IPv6, secrets in other alphabets, dates with
month names, phone numbers without a prefix that aren't ten digits of the North
American plan, and values with line breaks or other separators inside.

A network never moves a character: even rounds shift the first half by a hash of
the second, odd rounds the second by a hash of the first, each character within
its own class. That is a bijection for every key and format.

Defined results: a null text stays null with counts of zero, an empty one empty;
repeated rows are treated alike; an empty table gives an empty result; columns
that clash with the result's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let

#: Production passes a key of its own; pseudonyms of different keys don't link.
KEY = "palimpsest"
ROUNDS = 8
#: 270 * 271 days: both halves of a day number fill their modulus.
FIRST_DAY, HIGH, LOW = "1900-01-01", 270, 271

#: Lengths of account numbers by country (fixed values of ISO 13616), for those in groups.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
GROUPED_IBAN = "|".join(
    "(?:" + "|".join(countries.split()) + r")\d{2}(?: [A-Z0-9]{4}){" + str(n // 4 - 1) + "}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, countries in IBAN_LENGTHS.items()
)
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])",
    "secret": r"(?<!\w)(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?!\w)",
    "iban": r"(?<!\w)(?:[A-Z]{2}\d{2}[A-Z0-9]{11,30}|" + GROUPED_IBAN + r")(?!\w)",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?!\w|[./-]\w)",
    "ip": r"(?<![\w.])(?:" + OCTET + r"\.){3}" + OCTET + r"(?!\w|\.\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    # Plain, or in fours (or as 4-6-5) with one separator throughout, so that neighbours aren't taken for one.
    "card": r"(?<![\w+-])(?:\d{13,19}|\d{4} \d{4} \d{4} \d{1,4}|\d{4}-\d{4}-\d{4}-\d{1,4}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?![\w-])",
    # Of fixed length where the plan is known; else groups up to what can't belong to it.
    "phone": r"(?<![\w+-])(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ -]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}|[2-9]\d{2}\.[2-9]\d{2}\.\d{4}|[2-9]\d{2} [2-9]\d{2} \d{4})(?![\w-]|\.\d)",
}
KINDS = tuple(PATTERNS)
#: In this order: a place goes to the first kind whose form fits there.
ANY = "|".join(PATTERNS.values())


#: Disjoint classes of characters, each permuted in itself.
PLAIN = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
HEX_LOWER, HEX_UPPER = ("0123456789abcdef",), ("0123456789ABCDEF",)


def _chars(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, F.lit(1)))


def _shifted(chars: Column, other: Column, tweak: Column, alphabets: tuple) -> Column:
    """Each letter or digit moves on in its class by a byte of the hash of the other half."""
    def move(digest, c, i):
        by = F.conv(F.substring(digest, i % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int") + F.floor(i / 32).cast("int")
        out = c
        for letters in alphabets:
            at = F.instr(F.lit(letters), c)
            out = F.when((at > 0) & (c != ""), F.substring(F.lit(letters), F.pmod(at - 1 + by, F.lit(len(letters))).cast("int") + 1, F.lit(1))).otherwise(out)
        return out

    hashed = F.sha2(F.concat_ws("|", tweak, F.array_join(other, "")).cast("binary"), 256)
    return let(hashed, lambda digest: F.transform(chars, lambda c, i: move(digest, c, i)))


def permuted(text: Column, kind: str, key: str, alphabets: tuple = PLAIN) -> Column:
    """The Feistel network over a string's letters and digits; other characters stay."""
    half = (F.length(text) + 1) / 2
    a, b = F.substring(text, F.lit(1), half.cast("int")), F.substring(text, half.cast("int") + 1, F.length(text))
    start = F.struct(_chars(a).alias("a"), _chars(b).alias("b"))

    def step(s, r):
        tweak = F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), F.length(text).cast("string"))
        return F.when(r % 2 == 0, F.struct(_shifted(s["a"], s["b"], tweak, alphabets).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), _shifted(s["b"], s["a"], tweak, alphabets).alias("b")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.array_join(F.concat(s["a"], s["b"]), ""))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string."""
    turned = F.reverse(digits)
    values = F.transform(_chars(turned), lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def _refilled(form: Column, digits: Column) -> Column:
    """The digits, in turn, in the places of the form's digits."""
    def put(s, c):
        return F.when(c.rlike(r"\d"), F.struct(F.concat(s["out"], F.substring(digits, s["n"] + 1, F.lit(1))).alias("out"), (s["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["n"].alias("n")))

    return F.aggregate(_chars(form), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), put, lambda s: s["out"])


def _card(m: Column, key: str) -> Column:
    def pseudonym(d):
        body = permuted(F.substring(d, F.lit(1), F.length(d) - 1), "card", key)
        return let(body, lambda b: _refilled(m, F.concat(b, F.pmod(10 - _luhn(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string"))))

    return let(_digits(m), lambda d: F.when(_luhn(d) % 10 == 0, pseudonym(d)).otherwise(m))


def _mod97(text: Column) -> Column:
    """Letters as 10 to 35, the whole number modulo 97."""
    letters = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def fold(n, c):
        v = F.instr(F.lit(letters), c) - 1
        return F.when(v < 10, (n * 10 + v) % 97).otherwise((n * 100 + v) % 97)

    return F.aggregate(_chars(text), F.lit(0), fold)


def _iban(m: Column, key: str) -> Column:
    def checked(x):
        country, rest = F.substring(x, 1, 2), F.substring(x, F.lit(5), F.length(x))
        new = let(permuted(rest, "iban", key), lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
        grouped = F.when(m.contains(" "), F.regexp_replace(new, "(.{4})(?=.)", "$1 ")).otherwise(new)
        return F.when(_mod97(F.concat(rest, country, F.substring(x, 3, 2))) == 1, grouped).otherwise(m)

    return let(F.replace(m, F.lit(" "), F.lit("")), checked)


def _ssn_valid(m: Column) -> Column:
    return ~m.rlike(r"^(?:000|666|9)") & ~m.rlike(r"-00-|-0000$")


def _ssn(m: Column, key: str) -> Column:
    step = lambda x: permuted(x, "ssn", key)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(16)), step(m), lambda x, _: F.when(_ssn_valid(x), x).otherwise(step(x)))
    return F.when(_ssn_valid(m), walked).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    prefix = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(-])|^\+\d", 0)
    rest = F.substring(m, F.length(prefix) + 1, F.length(m))
    count = F.length(_digits(m))
    return F.when((count >= 8) & (count <= 15), F.concat(prefix, _refilled(rest, permuted(_digits(rest), "phone", key)))).otherwise(m)


def _number(a: Column, b: Column, high: int, low: int, kind: str, key: str, finish) -> Column:
    """The network over a pair of numbers below high and low."""
    def by(x, r, below):
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), x.cast("string")).cast("binary"), 256)
        return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % below

    def step(s, r):
        return F.when(r % 2 == 0, F.struct(((s["a"] + by(s["b"], r, high)) % high).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), ((s["b"] + by(s["a"], r, low)) % low).alias("b")))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: finish(s["a"], s["b"]))


def _ip(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    return let(o, lambda p: _number(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, "ip", key, lambda a, b: F.concat_ws(".", *[x.cast("string") for x in (F.shiftright(a, 8), a % 256, F.shiftright(b, 8), b % 256)])))


def _date(m: Column, key: str) -> Column:
    """Day first, unless only month first makes a date; the order that was read is written."""
    parts = F.transform(F.split(m, "[-/.]"), lambda x: x.cast("int"))

    def made(y, mo, d):
        return F.try_to_date(F.format_string("%04d-%02d-%02d", y, mo, d), "yyyy-MM-dd")

    def written(read):
        day = F.datediff(read["day"], F.lit(FIRST_DAY).cast("date"))
        new = lambda a, b: F.date_add(F.lit(FIRST_DAY).cast("date"), (a * LOW + b).cast("int"))
        pseudonym = _number(F.floor(day / LOW), day % LOW, HIGH, LOW, "date", key, new)

        def form(x):
            sep = F.when(m.contains("/"), "/").otherwise(".")
            padded = m.rlike(r"^0|^\d+[/.]0")
            field = lambda v: F.when(padded, F.lpad(v.cast("string"), 2, "0")).otherwise(v.cast("string"))
            first, second = F.when(read["swapped"], F.month(x)).otherwise(F.day(x)), F.when(read["swapped"], F.day(x)).otherwise(F.month(x))
            return F.when(m.contains("-"), F.date_format(x, "yyyy-MM-dd")).otherwise(F.concat(field(first), sep, field(second), sep, F.year(x).cast("string")))

        return F.when((day >= 0) & (day < HIGH * LOW), let(pseudonym, form)).otherwise(m)

    def read(p):
        iso = m.contains("-")
        straight = F.when(iso, made(p[0], p[1], p[2])).otherwise(made(p[2], p[1], p[0]))
        turned = F.when(~iso & m.contains("/"), made(p[2], p[0], p[1]))
        return let(F.struct(F.coalesce(straight, turned).alias("day"), straight.isNull().alias("swapped")), written)

    return F.coalesce(let(parts, read), m)


def _email(m: Column, key: str) -> Column:
    return F.concat(permuted(F.substring_index(m, "@", 1), "email", key), F.lit("@"), F.substring_index(m, "@", -1))


def _secret(m: Column, key: str) -> Column:
    return F.when(m.rlike("[a-fA-F]") & m.rlike(r"\d"), F.when(m.rlike("[a-f]"), permuted(m, "secret", key, HEX_LOWER)).otherwise(permuted(m, "secret", key, HEX_UPPER))).otherwise(m)


HOW = {"email": _email, "secret": _secret, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card, "phone": _phone}


def pseudonymise(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """The input with its personal data replaced, and n_<kind>: the values replaced, by kind."""
    docs = docs.drop("_found", "_new", *(f"n_{k}" for k in KINDS))
    # Every kind has a digit or an @; most texts have neither, and are not searched.
    found = F.when(F.col(text).rlike("[0-9@]"), F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)))

    def new(m):
        """Kind and replacement; the kind is the first whose whole form the value has."""
        kind, value = F.lit(None).cast("string"), m
        for k in reversed(KINDS):
            core = "^(?:" + PATTERNS[k] + ")$"
            kind, value = F.when(m.rlike(core), k).otherwise(kind), F.when(m.rlike(core), HOW[k](m, key)).otherwise(value)
        return F.struct(kind.alias("kind"), value.alias("value"), (value != m).alias("hit"))

    out = docs.withColumn("_found", F.coalesce(found, F.array().cast("array<string>"))).withColumn("_new", F.transform("_found", new))
    gaps = F.split(F.col(text), ANY, -1)
    joined = F.array_join(F.zip_with(gaps, F.col("_new"), lambda g, n: F.concat(g, F.coalesce(n["value"], F.lit("")))), "")
    changed = F.when(F.size("_new") == 0, F.col(text)).otherwise(joined)
    columns = [changed.alias(c) if c == text else F.col(c) for c in docs.columns]

    def count(k):
        return F.size(F.filter("_new", lambda n: n["hit"] & (n["kind"] == k))).cast("long").alias(f"n_{k}")

    return out.select(*columns, *map(count, KINDS))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir).select("doc_id", "text"))
