"""The same notions for one text at a time: what Arrow functions and documents use."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from difflib import SequenceMatcher

from .. import schema as S

_TOKEN = re.compile(S.TOKEN_PATTERN)
_CLAUSE, _SECTION = re.compile(S.CLAUSE_PATTERN), re.compile(S.SECTION_PATTERN)
_WORD = re.compile(r"\b(" + "|".join(S.REFERENCE_WORDS) + r")\b", re.IGNORECASE)
_NUMBER, _JOINER = re.compile(S.REFERENCE_NUMBER), re.compile(S.REFERENCE_JOINER)


def _compatible(c: str) -> str:
    one = unicodedata.normalize("NFKC", c)
    return one if len(one) == 1 else c


def fold(text: str) -> str:
    """Plain quotes, dashes, blanks and compatible characters; the length stays."""
    table = {c: S.FOLD.get(c) or _compatible(c) for c in set(text)}
    return "".join(map(table.__getitem__, text))


def normalise(text: str) -> str:
    return " ".join(text.split())


def parse_label(text: str) -> tuple[str, int, int, int] | None:
    """(label, its start and end, end of the number's dot) of a numbered paragraph."""
    m = _CLAUSE.match(text) or _SECTION.match(text)
    return (m[1], m.start(1), m.end(1), m.end()) if m else None


def title_of(text: str, after: int) -> str:
    rest = text[after:].lstrip(" .\u00a0\t")
    head = rest.partition(".")[0].strip()
    return head if 0 < len(head) <= S.TITLE_CHARS else rest[: S.TITLE_FALLBACK].strip()


def references(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, number, keyword) of each number in the lists behind reference words."""
    found = []
    for word in _WORD.finditer(text):
        number = _NUMBER.match(text, word.end())
        while number:
            found.append((*number.span(1), number[1], word[1]))
            joiner = _JOINER.match(text, number.end())
            number = joiner and _NUMBER.match(text, joiner.end())
    return found


def find_all(text: str, needle: str) -> list[int]:
    """Starts of all hits, overlapping ones too."""
    out, at = [], text.find(needle) if needle else -1
    while at >= 0:
        out.append(at)
        at = text.find(needle, at + 1)
    return out


def locate(text: str | None, everything: str, target: str, occurrence: int = 1) -> tuple[list[tuple[int, int]], str | None]:
    """Spans of a quoted target, or why there are none; text is None if there's no such paragraph."""
    if not target.strip():
        return [], "empty_target"
    if text is None:
        return [], "paragraph_not_found"
    needle = fold(target)
    spans = [(i, i + len(needle)) for i in find_all(fold(text), needle)]
    if not spans:
        return [], "target_already_struck" if needle in fold(everything) else "target_not_found"
    if occurrence == 0:
        return spans, None
    if occurrence > len(spans):
        return [], "target_not_found"
    if occurrence == 1 and len(spans) > 1 and len(needle) < S.AMBIGUITY_CHARS:
        return [], "target_ambiguous"
    return [spans[occurrence - 1]], None


def diff(old: str, new: str, ignore_case: bool = False, ignore_whitespace: bool = True) -> list[tuple[str, int, int, str]]:
    """Word-level changes (kind, start, end, text) that make `new` of `old`, in order.

    Changes of blanks alone are left out; changes at most DIFF_GAP blanks apart are one.
    """
    a, b = _TOKEN.findall(old), _TOKEN.findall(new)
    starts = [0]
    for t in a:
        starts.append(starts[-1] + len(t))
    keys = ([t.lower() for t in a], [t.lower() for t in b]) if ignore_case else (a, b)
    out: list[list] = []
    for tag, i1, i2, j1, j2 in SequenceMatcher(None, *keys, autojunk=False).get_opcodes():
        was, now = "".join(a[i1:i2]), "".join(b[j1:j2])
        if tag == "equal" or ignore_whitespace and not was.strip() and not now.strip():
            continue
        s, e = starts[i1], starts[i2]
        if out and s - out[-1][2] <= S.DIFF_GAP and not old[out[-1][2] : s].strip():
            last = out[-1]
            last[:] = ["replace", last[1], e, last[3] + old[last[2] : s] + now]
        else:
            out.append([tag, s, e, now])
    return [tuple(x) for x in out if old[x[1] : x[2]] != x[3]]


def similarity(a: str, b: str) -> float:
    a, b = normalise(a), normalise(b)
    return SequenceMatcher(None, a, b, autojunk=False).ratio() if a or b else 1.0


def longest_rising(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before.append(ends[k - 1] if k else -1)
        if k == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[k], ends[k] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def in_slots(current: list[str], wanted: list[str]) -> list[str]:
    """The wanted labels, in their order, in the places that any of them has now; the others stay."""
    queue = iter([x for x in wanted if x in current])
    chosen = set(wanted)
    return [next(queue) if x in chosen else x for x in current]


def initials(name: str) -> str:
    return "".join(w[0] for w in name.split()[:3]).upper() or "R"
