"""Column functions over text, all evaluated in the JVM.

Offsets are counts of characters (code points), half-open and 0-based, as length()
and substring() count them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S

UNICODE = "(?U)"


def strip(text: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalised(text: Column) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)\S")


def folded(text: Column) -> Column:
    """Quotes, dashes and blanks as their plain forms; the length stays."""
    return F.translate(text, "".join(S.FOLD), "".join(S.FOLD.values()))


def tokens(text: Column) -> Column:
    """Words, runs of white space, and single other characters."""
    return F.regexp_extract_all(text, F.lit(UNICODE + S.TOKEN_PATTERN), F.lit(0))


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body` as often as it likes."""
    return F.transform(F.array(value), body)[0]


def running(sizes: Column) -> Column:
    """Sums of an array's numbers before each and behind the last, from 0."""
    start = F.struct(F.lit(0).alias("at"), F.array(F.lit(0)).alias("sums"))
    return F.aggregate(sizes, start, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["sums"], F.array(s["at"] + n)).alias("sums")), lambda s: s["sums"])


def hits(text: Column, needle: str | Column, overlapping: bool = True) -> Column:
    """Start offsets of a literal; the next may begin inside the last if overlapping.

    The text is split at the literal, or before each place where it begins, and the
    pieces' lengths are summed, so the work is linear in the text.
    """
    needle = F.lit(needle) if isinstance(needle, str) else needle
    quoted = F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    none = F.array().cast("array<int>")

    def starts(pieces):
        between = F.length(needle) if not overlapping else F.lit(0)
        ends = running(F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.length(p) + between))
        # Behind each piece but the last stands a hit; no piece ends before one at the very start.
        inner = F.transform(F.slice(ends, F.lit(2), F.size(ends)), lambda e: e - between)
        return F.concat(F.when(text.startswith(needle), F.array(F.lit(0))).otherwise(none), inner) if overlapping else inner

    found = F.split(text, quoted, -1) if not overlapping else F.split(text, F.concat(F.lit("(?="), quoted, F.lit(")")), -1)
    return F.when(text.contains(needle) & (F.length(needle) > 0), let(found, starts)).otherwise(none)


REFERENCE_LIST = r"(?U)\b(?i:" + "|".join(S.REFERENCE_WORDS) + r")\b" + S.REFERENCE_NUMBER + "(?:" + S.REFERENCE_JOINER + S.REFERENCE_NUMBER + ")*"


def references(text: Column) -> Column:
    """Array of (start, end, number, keyword) of each number in the lists behind reference words.

    The lists and the gaps between them, and within a list its numbers and theirs, come
    from a pattern and a split by it; lengths give the offsets.
    """
    number = r"(?U)\d+(?:\.\d+)*"

    def of_list(found, at):
        keyword = F.regexp_extract(found, r"(?U)^\w+", 0)
        numbers, gaps = F.regexp_extract_all(found, F.lit(number), F.lit(0)), F.split(found, number, -1)

        def placed(n):
            sizes = F.transform(n, lambda x, i: F.length(F.get(gaps, i)) + F.length(x))
            return let(running(sizes), lambda e: F.transform(n, lambda x, i: F.struct((at + F.get(e, i + 1) - F.length(x)).alias("start"), (at + F.get(e, i + 1)).alias("end"), x.alias("number"), keyword.alias("keyword"))))

        return let(numbers, placed)

    def of_lists(found):
        gaps = F.split(text, REFERENCE_LIST, -1)
        sizes = lambda g: F.transform(found, lambda x, i: F.length(F.get(g, i)) + F.length(x))
        ends = let(gaps, lambda g: running(sizes(g)))
        return let(ends, lambda e: F.flatten(F.transform(found, lambda x, i: of_list(x, F.get(e, i + 1) - F.length(x)))))

    # Most paragraphs have no reference; a cheap look for a word spares them the rest.
    some = text.rlike(r"(?i)(?:" + "|".join(w for w in S.REFERENCE_WORDS if not w.endswith("s")) + ")")
    return F.when(some, let(F.regexp_extract_all(text, F.lit(REFERENCE_LIST), F.lit(0)), of_lists))


def label(text: Column) -> Column:
    """The clause number at a paragraph's start, or null."""
    clause, section = (F.regexp_extract(text, p, 1) for p in (S.CLAUSE_PATTERN, S.SECTION_PATTERN))
    return F.when(clause != "", clause).when(section != "", section)


def label_end(text: Column) -> Column:
    """Characters up to the end of the number and its dot."""
    clause, section = (F.regexp_extract(text, p, 0) for p in (S.CLAUSE_PATTERN, S.SECTION_PATTERN))
    return F.when(clause != "", F.length(clause)).otherwise(F.length(section))


def number(label_: Column) -> Column:
    return F.transform(F.split(label_, r"\."), lambda x: x.cast("int"))


def title(text: Column, after: Column) -> Column:
    """What follows the number up to the first dot, if of 1 to 80 characters; else the first 60."""
    rest = F.regexp_replace(F.substring(text, after + 1, F.length(text)), "^[ .\u00a0\t]+", "")
    head = strip(F.split(rest, r"\.", 2)[0])
    return F.when(F.length(head).between(1, S.TITLE_CHARS), head).otherwise(strip(F.substring(rest, 1, S.TITLE_FALLBACK)))


def body(text: Column, after: Column) -> Column:
    return F.regexp_replace(F.substring(text, after + 1, F.length(text)), "^[ .\u00a0\t]+", "")


def approx_tokens(chars: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(chars / S.CHARS_PER_TOKEN))


def fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def cache_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\u001f", *parts).cast("binary"), 256), 1, 32)


def initials(name: Column) -> Column:
    words = F.slice(F.filter(F.split(name, r"(?U)\s+"), lambda w: w != ""), 1, 3)
    letters = F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))
    return F.when(letters == "", "R").otherwise(letters)


def utc_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def risks(text: Column) -> Column:
    """Names of the risk families that a text touches, in the families' order."""
    low = F.lower(text)
    found = F.array(*[F.when(low.rlike(p), n) for n, p in S.RISKS.items()])
    return F.array_compact(found)


def style_key(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "[ -]", ""))


def label_prefix(label_: Column) -> Column:
    return F.when(label_.contains("."), F.concat(label_, F.lit("  "))).otherwise(F.concat(label_, F.lit(". ")))


def inside(label_: Column, other: Column) -> Column:
    """Whether a label is another one or lies below it."""
    return (label_ == other) | label_.startswith(F.concat(other, F.lit(".")))


def severity_rank(severity: Column) -> Column:
    rank = F.lit(1)
    for i, name in enumerate(S.SEVERITIES):
        rank = F.when(severity == name, i).otherwise(rank)
    return rank
