"""Which spans name the same thing."""

from __future__ import annotations

import re
from functools import lru_cache

from .. import vocab
from .spans import Span

ALIKE = 92.0

# What is cut off a name before it is compared.
_TITLE = re.compile(r"(?i)^\s*(?:dr|doctor|mr|mrs|ms|miss|mx|prof|professor|rev|sir|dame|nurse|sister|father|fr|sgt|capt|lt|col|maj)\.?\s+")
_CREDENTIAL = re.compile(
    r"(?i)[,\s]+(?:m\.?d|d\.?o|mbbs|r\.?n|l\.?p\.?n|n\.?p|p\.?a-?c?|pharm\.?d|r\.?ph|ph\.?d|d\.?d\.?s|d\.?m\.?d|d\.?p\.?m|o\.?d|d\.?v\.?m|c\.?r\.?n\.?a|c\.?n\.?m|l\.?c\.?s\.?w|m\.?s\.?w|r\.?r\.?t|d\.?p\.?t|m\.?s\.?n|b\.?s\.?n|a\.?p\.?r\.?n|f\.?a\.?c\.?[spc])\.?\s*$"
)
_POSSESSIVE = re.compile(r"(?:'s|’s|s')$")
_PUNCTUATION = re.compile(r"[^\w\s'’\-]")


def indel_ratio(a: str, b: str) -> float:
    """200 * LCS / (len(a) + len(b)), with the LCS length from bit-parallel rows."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """The best of how alike the common words are to each side's words, and both sides to each other."""
    left, right = set(a.lower().split()), set(b.lower().split())
    if not left or not right:
        return 100.0 if left == right else 0.0
    common = " ".join(sorted(left & right))
    sides = [" ".join(filter(None, (common, " ".join(sorted(own))))) for own in (left - right, right - left)]
    pairs = [(sides[0], sides[1])] + [(common, side) for side in sides if common]
    return max(indel_ratio(x, y) for x, y in pairs)


def name_key(text: str) -> str:
    bare = _CREDENTIAL.sub("", _TITLE.sub("", text.strip()))
    bare = _PUNCTUATION.sub(" ", _POSSESSIVE.sub("", bare.strip()))
    return " ".join(sorted(t for t in bare.lower().split() if len(t.strip(".'’-")) > 1))


@lru_cache(65536)
def entity_key(category: str, text: str) -> str:
    """What two surfaces of one category share if they are the same; never empty."""
    if category in vocab.ALNUM_KEYED:
        key = re.sub(r"[^A-Za-z0-9]", "", text).upper()
    elif category in vocab.NAMES:
        key = name_key(text)
    else:
        key = " ".join(_PUNCTUATION.sub(" ", text).split()).lower()
    return key or text.strip().lower()


@lru_cache(65536)
def same_person(a: str, b: str) -> bool:
    """Whether two name keys can be one person: a part of the other, or nearly equal."""
    if not a or not b:
        return False
    left, right = sorted((a.split(), b.split()), key=len)
    if set(left) <= set(right) or set(right) <= set(left):
        return True
    if len(left) == 1:
        return any(indel_ratio(left[0], t) >= ALIKE for t in right)
    return indel_ratio(a, b) >= ALIKE


def clusters(spans: list[Span]) -> list[list[Span]]:
    """Spans by entity, in order of first appearance: each joins the first cluster that it fits."""
    groups: list[list[Span]] = []
    known: dict[str, list[tuple[str, int]]] = {}  # of each category: (key, group)
    exact: dict[tuple[str, str], int] = {}
    for s in sorted(spans, key=lambda s: (s.start, s.end)):
        key = entity_key(s.category, s.text)
        fits = [exact[s.category, key]] if (s.category, key) in exact else []
        if s.category in vocab.NAMES:
            fits += [g for other, g in known.get(s.category, ()) if same_person(key, other)]
        if fits:
            at = min(fits)
        else:
            at = len(groups)
            groups.append([])
        groups[at].append(s)
        exact[s.category, key] = min(at, exact.get((s.category, key), at))
        known.setdefault(s.category, []).append((key, at))
    return groups
