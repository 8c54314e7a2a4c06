"""Spans from form fields: the key says what the value is."""

from __future__ import annotations

import re
from functools import lru_cache

from .. import vocab
from .spans import Span, inside
from .structure import Field

#: How many characters of a key may follow the part that a pattern knows.
LOOSE_TAIL = 8
_CLINICAL = tuple(re.compile(p, re.I) for p in vocab.FIELD_KEYS_CLINICAL)
_KEYS = tuple((re.compile(p, re.I), category, 0.85 if p == "name" else 0.95) for p, category in vocab.FIELD_KEYS)
_AFTER_CREDENTIAL = re.compile(rf",\s*(?:{vocab.CREDENTIAL})\.?(?![A-Za-z])", re.I)
_LAYOUT = " \t.,;:|"


def normal_key(key: str) -> str:
    key = re.sub(r"\([^)]*\)", " ", key)
    return " ".join(re.sub(r"[^A-Za-z0-9#/&'\-]+", " ", key).split()).lower()


@lru_cache(8192)
def classify(key: str) -> tuple[str, float] | None:
    """(category, score) of a normalised key: whole keys before beginnings, clinical ones before others."""
    def loose(pattern: re.Pattern) -> bool:
        m = pattern.match(key)
        return bool(m) and len(key) - m.end() <= LOOSE_TAIL

    if not key or any(p.fullmatch(key) for p in _CLINICAL):
        return None
    whole = next(((c, s) for p, c, s in _KEYS if p.fullmatch(key)), None)
    if whole or any(map(loose, _CLINICAL)):
        return whole
    return next(((c, 0.88) for p, c, _ in _KEYS if loose(p)), None)


def is_null(value: str) -> bool:
    return value.strip().strip(".,;").lower() in vocab.NULL_VALUES or not re.search(r"[A-Za-z0-9]", value)


def detect(fields: list[Field], segments: list[tuple[int, int, str]]) -> list[Span]:
    starts, out = [s for s, _, _ in segments], []
    for f in fields:
        key = normal_key(f.key)
        known = classify(key)
        if not known or is_null(f.value):
            continue
        value = f.value.rstrip(_LAYOUT)
        if known[0] in vocab.NAMES and (m := _AFTER_CREDENTIAL.search(value)):
            value = value[: m.end()].rstrip(_LAYOUT)  # what follows is a specialty, not the person
        if value:
            out.append(Span(f.start, f.start + len(value), known[0], value, known[1], "field", f"field:{key[:28]}", inside(f.start, starts, segments) or f.in_table))
    return out
