"""Stage G: scan the masked text again, for identifiers and for surfaces that were mapped."""

from __future__ import annotations

import re
from typing import NamedTuple

from .. import vocab
from ..policy import Policy
from . import rules
from .guards import over_redaction
from .rewrite import PLACEHOLDER, Entry
from .structure import lines_of, segments_of

SURFACE_CHARS = 3


class Finding(NamedTuple):
    category: str
    text: str
    start: int
    end: int
    detector: str


def blanked(masked: str, entries: list[Entry] = ()) -> str:
    """Placeholders as equally long runs of NUL, which no pattern reaches across."""
    out = PLACEHOLDER.sub(lambda m: "\0" * len(m[0]), masked)
    for e in sorted(entries, key=lambda e: len(e.placeholder), reverse=True):
        if not PLACEHOLDER.fullmatch(e.placeholder):
            out = out.replace(e.placeholder, "\0" * len(e.placeholder))
    return out


def scan(masked: str, entries: list[Entry], policy: Policy) -> list[Finding]:
    if not policy.selfcheck:
        return []
    text, found = blanked(masked, entries), []
    segments = segments_of(lines_of(text))
    for s in rules.detect(text, segments, [c for c in vocab.CATEGORIES if policy.masks(c)], policy.bounded_initials):
        if s.score >= policy.paranoid_threshold and not over_redaction(text, s.start, s.end, s.text, s.category, policy.eponyms):
            found.append(Finding(s.category, s.text, s.start, s.end, f"rescan:{s.detector}"))
    for e in entries:
        for surface in (s.strip() for s in e.surfaces):
            if len(surface) < SURFACE_CHARS or surface not in text:
                continue
            for m in re.finditer(rf"(?<!\w){re.escape(surface)}(?!\w)", text):
                if not over_redaction(text, *m.span(), surface, e.category, policy.eponyms):
                    found.append(Finding(e.category, surface, *m.span(), "residue:mapped-surface-still-present"))
                    break
    return found
