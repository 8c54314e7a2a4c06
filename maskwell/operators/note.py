"""All document-local stages over one note."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from typing import NamedTuple

from ..policy import Policy
from . import fields, rules
from .arbitrate import merge, propagate
from .audit import Finding, scan
from .rewrite import Entry, review_queue, rewrite
from .spans import Span
from .structure import fields_of, lines_of, segments_of


class Result(NamedTuple):
    masked: str
    spans: list[Span]
    segments: list[tuple[int, int, str]]
    entries: list[Entry]
    review: list[tuple[Span, str, str]]
    findings: list[Finding]
    blocked: bool
    patient_key: str
    shift: int
    candidates: int


def patient_key(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()[:16]


def candidates_of(text: str, policy: Policy, categories: frozenset[str] | None = None) -> tuple[list[Span], list[tuple[int, int, str]]]:
    """Stages A and B: rule and form-field spans as emitted, and the segments. categories: only these, by the rules that can emit them."""
    lines = lines_of(text)
    segments = segments_of(lines)
    found = rules.detect(text, segments, categories, policy.bounded_initials)
    return found + [s for s in fields.detect(fields_of(text, lines), segments) if categories is None or s.category in categories], segments


def deidentify(text: str | None, policy: Policy, key: str | None = None, extra: Iterable[Span] = (), audit: bool = True) -> Result:
    """extra: spans of a model or another source. Null text counts as empty. Without audit there are no findings."""
    text = text or ""
    key = key or patient_key(text)
    found, segments = candidates_of(text, policy)
    found += extra
    spans = merge(text, found, policy)
    more = propagate(text, spans, policy)
    if more:
        spans = merge(text, spans + more, policy)
    masked, entries, shift = rewrite(text, spans, policy, key)
    findings = scan(masked, entries, policy) if audit else []
    return Result(masked, spans, segments, entries, review_queue(spans, entries, policy), findings, bool(findings) and policy.on_leak == "block", key, shift, len(found))
