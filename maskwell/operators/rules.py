"""Rule detectors as a registry: pattern, group, category, score, and a check on each match.

Order matters: it is the order in which equal candidates are preferred.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

from .. import vocab
from . import validate as v
from .spans import Span, inside

# Detector patterns.
_NAME_WORD = r"[A-Z][A-Za-z'’\-]{1,19}"
_CAP = r"[A-Z][A-Za-z'’\-]{1,20}"
_NUMBER = r"(?:no\.?|number|#|id)"
_DOSE_AFTER = re.compile(
    r"(?i)^\s*(?:tab|tabs|tablet|tablets|cap|caps|capsule|capsules|tsp|tbsp|mg|mcg|g|ml|l|cc|unit|units|iu|meq|mmol|drop|drops|puff|puffs|patch|inch|inches|\"|hr|hrs|hour|hours|min|mins|day|days|week|weeks|month|months|year|years|%)\b"
)
_DOSE_BEFORE = re.compile(r"(?i)(?:take|takes|taking|give|given|gave|administer(?:ed)?|inject(?:ed)?|dose[d]?|dosing|receive[d]?|infuse[d]?|dilut(?:e|ed)|ratio|of)\s+$")
_SCALE_BEFORE = re.compile(
    r"(?i)\b(?:pain|score[d]?|scale|rated|rating|severity|nrs|vas|gcs|grade|motor|strength|power|reflex(?:es)?|dorsiflexion|plantarflexion|flexion|extension|eversion|inversion|abduction|adduction|ehl|fhl|"
    r"leg|back|neck|arm|shoulder|knee|hip|ankle|wrist|elbow|foot|hand|radicular)\b[^.;\n]{0,120}$"
)
_FAX_BEFORE = re.compile(r"(?i)\bfax\b[^.\n]{0,20}$")
_DIGIT = re.compile(r"\d")
#: The longest cue and the stretch behind it that a look to the left can need.
_LOOK_BEHIND = 160


def name_core(bounded: bool = False) -> str:
    middle = r"(?:[ ][A-Z]\.?(?![A-Za-z]))?" if bounded else r"(?:[ ][A-Z]\.?)?"
    return rf"(?:[A-Z]\.[ ]?){{0,2}}{_NAME_WORD}{middle}(?:[ ]{_NAME_WORD}){{0,2}}(?:[ ][A-Z]\.)?"


FACILITY_ONLY = re.compile(rf"(?:{vocab.ORG_WORD}|{vocab.ORG_HEAD})(?: (?:{vocab.ORG_WORD}|{vocab.ORG_HEAD}))*")
CREDENTIAL_ONLY = re.compile(rf"(?:{vocab.CREDENTIAL})", re.I)


class Rule(NamedTuple):
    name: str
    category: str
    score: float
    pattern: re.Pattern
    group: str | int = 0
    #: Returns whether the match counts, or (category, score, name) in place of the rule's own.
    check: Callable[[str, re.Match], object] | None = None
    #: What any text with a match has too, cheap to look for: a pattern, or small letters of which one
    #: must be in the lower-cased text.
    needs: re.Pattern | tuple[str, ...] | None = None

    #: Categories that the check may put in place of the rule's own.
    others: frozenset[str] = frozenset()


def _line_before(text: str, at: int) -> str:
    return text[max(text.rfind("\n", 0, at) + 1, at - _LOOK_BEHIND) : at]


def _phone(text: str, m: re.Match):
    return ("FAX", 0.93, "fax") if _FAX_BEFORE.search(_line_before(text, m.start())) else True


def _numbered(text: str, m: re.Match) -> bool:
    return any(c.isdigit() for c in m["id"]) and not v.clinical_code(m["id"])


def _on_id(check: Callable[[str], bool]):
    return lambda text, m: check(m["id"])


def _whole(check: Callable[[str], bool]):
    return lambda text, m: check(m[0])


def _numeric_date(text: str, m: re.Match) -> bool:
    a, b, y = int(m[1]), int(m[3]), v.full_year(int(m[4]))
    return v.calendar(y, a, b) or v.calendar(y, b, a)


def _month_day(text: str, m: re.Match) -> bool:
    a, b = int(m[1]), int(m[2])
    if not (a and b and (v.calendar(2000, a, b) or v.calendar(2000, b, a))) or _DOSE_AFTER.match(text[m.end() : m.end() + 24]):
        return False
    before = _line_before(text, m.start())
    return not (_DOSE_BEFORE.search(before) or _SCALE_BEFORE.search(before))


def _age(text: str, m: re.Match):
    years = int(m["age"])
    return years <= 130 and (("AGE_OVER_89", 0.97, None) if years >= 90 else True)


def _title(text: str, m: re.Match):
    return True if m["title"].strip().lower() in vocab.PROVIDER_TITLES else ("NAME_PATIENT", 0.92, None)


@lru_cache(4)
def registry(bounded_initials: bool = False) -> tuple[Rule, ...]:
    name, digit = name_core(bounded_initials), re.compile(r"\d")
    c = re.compile
    cued = lambda cue, tail: c(rf"(?i)\b(?:{cue})\s*{tail}\b")
    return (
        Rule("email", "EMAIL", 0.99, c(r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"), needs=c("@")),
        Rule("url", "URL", 0.97, c(r"\b(?:https?://|ftp://|www\.)[^\s<>\"')\]]+", re.I), needs=c(r"://|[wW]\.")),
        Rule("ipv4", "IP", 0.95, c(r"\b(?:\d{1,3}\.){3}\d{1,3}\b"), 0, _whole(v.ip), c(r"\d\.\d")),
        Rule("ipv6", "IP", 0.95, c(r"\b(?:[A-Fa-f0-9]{0,4}:){2,7}[A-Fa-f0-9]{0,4}\b"), 0, _whole(v.ip), c(r":[A-Fa-f0-9]{0,4}:")),
        Rule("phone", "PHONE", 0.93, c(r"(?:\+?\d{1,2}[-.\s]?)?(?:\(\d{3}\)|\b\d{3})[-.\s]\d{3}[-.\s]\d{4}\b"), 0, _phone, c(r"\d{3}[-.\s]\d{4}"), others=frozenset({"FAX"})),
        Rule("phone_ext", "PHONE", 0.70, c(r"(?i)\b(?:ext\.?|extension)\s*\d{1,6}\b|\bx\s*\d{3,6}\b"), needs=digit),
        Rule("ssn", "SSN", 0.96, c(r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b"), 0, _whole(v.ssn), c(r"\d{2}[-\s]?\d{4}")),
        Rule("mrn", "MRN", 0.96, cued(r"mrn|m\.r\.n\.|medical\s+record(?:\s+(?:no\.?|number|#))?|chart\s*(?:no\.?|number|#)?|record\s*#|patient\s+id", r"[:#]?\s*(?P<id>[A-Z0-9][A-Z0-9\-]{3,19})"), "id", _numbered, digit),
        Rule("account", "ACCOUNT", 0.94, cued(rf"account|acct\.?|billing|invoice|claim", rf"{_NUMBER}?\s*[:#]?\s*(?P<id>[A-Z0-9][A-Z0-9\-]{{3,24}})"), "id", _numbered, digit),
        Rule("health_plan", "HEALTH_PLAN_ID", 0.94, cued(r"member|subscriber|policy|group|insurance|payer|beneficiary|plan|medicare|medicaid|hicn|mbi", rf"{_NUMBER}\s*[:#]?\s*(?P<id>[A-Z0-9][A-Z0-9\-]{{3,24}})"), "id", _numbered, digit),
        Rule("licence", "LICENCE", 0.92, cued(r"licen[cs]e|lic\.?|cert(?:ificate)?|permit|registration", rf"{_NUMBER}?\s*[:#]?\s*(?P<id>[A-Z0-9][A-Z0-9\-]{{3,19}})"), "id", _numbered, digit),
        Rule("device", "DEVICE", 0.92, cued(r"serial\s*(?:no\.?|number|#)?|s/n|sn#|device\s*(?:id|no\.?|number|#)|implant\s*(?:id|no\.?|#)?|lot\s*(?:no\.?|number|#)?|udi|catalog(?:ue)?\s*#", r"[:#]?\s*(?P<id>[A-Z0-9][A-Z0-9\-]{3,29})"), "id", _numbered, digit),
        Rule("plate", "VEHICLE", 0.92, cued(r"licen[cs]e\s*plate|plate\s*(?:no\.?|number|#)?|tag\s*#", r"[:#]?\s*(?P<id>[A-Z0-9][A-Z0-9\- ]{3,9})"), "id", _numbered, digit),
        Rule("npi_cued", "LICENCE", 0.98, cued("npi", rf"{_NUMBER}?\s*[:#]?\s*(?P<id>\d{{10}})"), "id", None, c(r"\d{10}")),
        Rule("npi_luhn", "LICENCE", 0.70, c(r"\b(?P<id>\d{10})\b"), "id", _on_id(v.npi), c(r"\d{10}")),
        Rule("dea_cued", "LICENCE", 0.97, cued("dea", rf"{_NUMBER}?\s*[:#]?\s*(?P<id>[A-Z]{{2}}\d{{7}})"), "id", None, c(r"\d{7}")),
        Rule("dea_check", "LICENCE", 0.72, c(r"\b(?P<id>[A-Z]{2}\d{7})\b"), "id", _on_id(v.dea), c(r"[A-Z]\d{7}")),
        Rule("vin_check", "VEHICLE", 0.98, c(r"\b(?P<id>[A-HJ-NPR-Z0-9]{17})\b"), "id", _on_id(v.vin), c(r"[A-Z0-9]{17}")),
        Rule("zip_state", "GEO_ZIP", 0.93, c(rf"\b(?:{vocab.STATES})[.,]?\s+(?P<id>\d{{5}})(?:-\d{{4}})?\b"), "id", None, c(r"\s\d{5}")),
        Rule("zip_cued", "GEO_ZIP", 0.93, cued(r"zip(?:\s*code)?|postal\s*code|postcode", r"[:#]?\s*(?P<id>\d{5})(?:-\d{4})?"), "id", None, c(r"\d{5}")),
        Rule(
            "street", "GEO_STREET", 0.90,
            c(
                rf"(?i)\b(?P<addr>\d{{1,6}}\s+(?:[NSEW]\.?|North|South|East|West|NE|NW|SE|SW)?\s*(?-i:(?:{_CAP}\s+){{1,4}})"
                r"(?:Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Boulevard|Blvd\.?|Lane|Ln\.?|Drive|Dr\.?|Court|Ct\.?|Circle|Cir\.?|Place|Pl\.?|Terrace|Ter\.?|Way|Parkway|Pkwy\.?|Highway|Hwy\.?|Route|Rte\.?|Trail|Trl\.?|Square|Sq\.?)"
                r"(?:\s*(?:Apt\.?|Unit|Suite|Ste\.?|#)\s*[A-Za-z0-9\-]{1,6})?)\b"
            ),
            "addr", None, c(r"\d\s+\w"),
        ),
        Rule("birth_year", "DATE", 0.88, c(r"(?i)\b(?:born|b\.|birth(?:day|\s*year)?|dob|d\.o\.b\.?|date\s*of\s*birth)[\s:,]*(?:in|on|year)?[\s:,]*(?P<yr>1[89]\d{2}|20[0-2]\d)\b"), "yr", None, c(r"1[89]\d\d|20[0-2]\d")),
        Rule("date_iso", "DATE", 0.97, c(r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b"), 0, lambda t, m: v.calendar(int(m[1]), int(m[2]), int(m[3])), c(r"\d{4}-\d")),
        Rule("date_numeric", "DATE", 0.96, c(r"\b(\d{1,2})(?P<sep>[/\-.])(\d{1,2})(?P=sep)(\d{2,4})\b"), 0, _numeric_date, c(r"\d[/\-.]\d{1,2}[/\-.]\d")),
        Rule("date_mdy", "DATE", 0.97, c(rf"\b({vocab.MONTH})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b", re.I), 0, lambda t, m: bool(v.month(m[1])) and v.calendar(int(m[3]), v.month(m[1]), int(m[2])), c(r"\s\d{4}")),
        Rule("date_dmy", "DATE", 0.97, c(rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({vocab.MONTH})\.?,?\s+(\d{{4}})\b", re.I), 0, lambda t, m: bool(v.month(m[2])) and v.calendar(int(m[3]), v.month(m[2]), int(m[1])), c(r"\s\d{4}")),
        Rule("date_my", "DATE", 0.90, c(rf"\b({vocab.MONTH})\.?\s+(\d{{4}})\b", re.I), 0, lambda t, m: bool(v.month(m[1])) and v.calendar(int(m[2]), v.month(m[1])), c(r"\s\d{4}")),
        Rule("date_md", "DATE", 0.55, c(r"\b(\d{1,2})/(\d{1,2})\b"), 0, _month_day, c(r"\d/\d")),
        Rule("age_yo", "AGE", 0.90, c(r"(?i)\b(?P<age>\d{1,3})\s*[-\s]?\s*(?:years?|yrs?|y)\s*[-\s]?\s*(?:old|o)\b"), 0, _age, c(r"(?i)\d\s*-?\s*y"), others=frozenset({"AGE_OVER_89"})),
        Rule("age_yo_short", "AGE", 0.90, c(r"(?i)\b(?P<age>\d{1,3})\s*y[/.]?o\b"), 0, _age, c(r"(?i)\d\s*y"), others=frozenset({"AGE_OVER_89"})),
        Rule("age_cued", "AGE", 0.90, c(r"(?i)\bage[d]?\s*(?:is|of|:|=)?\s*(?P<age>\d{1,3})\b"), 0, _age, ("age",), others=frozenset({"AGE_OVER_89"})),
        Rule("age_over89_word", "AGE_OVER_89", 0.95, c(r"(?i)\b(?:nonagenarian|nonagenarians|centenarian|centenarians|supercentenarian|(?:in\s+(?:his|her|their|the)\s+(?:90s|nineties|late\s+90s)))\b"), needs=("enarian", "90s", "nineties")),
        Rule("title_name", "NAME_PROVIDER", 0.92, c(rf"\b(?P<title>{vocab.TITLE})\s+(?P<name>{name})"), "name", _title, others=frozenset({"NAME_PATIENT"})),
        Rule("name_credential", "NAME_PROVIDER", 0.92, c(rf"\b(?P<name>{name})\s*,\s*(?P<cred>{vocab.CREDENTIAL})(?![A-Za-z])"), "name", lambda t, m: not CREDENTIAL_ONLY.fullmatch(m["name"]), c(r",\s*[A-Z]")),
        Rule(
            "signature_name", "NAME_PROVIDER", 0.93,
            c(rf"(?im)^\s*(?:electronically\s+|e-)?(?:signed|dictated|transcribed|authenticated|verified|reviewed|entered|approved)\s*(?:by)?\s*[:\-]?\s*(?!by\b)(?P<name>{name})"),
            "name", None, ("signed", "dictated", "transcribed", "authenticated", "verified", "reviewed", "entered", "approved"),
        ),
        Rule(
            "org", "ORG", 0.85,
            c(rf"\b(?P<org>(?:(?:{vocab.ORG_WORD}|{_CAP}) ){{0,4}}(?:{vocab.ORG_HEAD})(?: (?:of|for|at|the) {_CAP})?(?: (?:{vocab.ORG_WORD}|{vocab.ORG_HEAD}|{_CAP})){{0,3}})\b"),
            "org", lambda t, m: not FACILITY_ONLY.fullmatch(m["org"]),
        ),
        Rule("org_allcaps", "ORG", 0.80, c(rf"\b(?P<org>(?:[A-Z&][A-Z&'’\-]{{0,19}}\s+){{1,5}}(?:{vocab.ORG_HEAD_CAPS})(?:\s+[A-Z&][A-Z&'’\-]{{0,19}}){{0,3}})\b"), "org"),
        Rule("opaque_id", "ID_GENERIC", 0.40, c(r"\b[A-Za-z0-9][A-Za-z0-9\-_/]{4,23}\b"), 0, _whole(v.opaque), digit),
        Rule("long_digits", "ID_GENERIC", 0.55, c(r"\b\d{9,}\b"), needs=c(r"\d{9}")),
    )


def make_span(text: str, start: int, end: int, category: str, score: float, source: str, detector: str, starts: list[int], segments) -> Span | None:
    """A span without the white space at its ends; None if nothing is left."""
    surface = text[start:end]
    start += len(surface) - len(surface.lstrip())
    surface = surface.strip()
    return Span(start, start + len(surface), category, surface, score, source, detector, inside(start, starts, segments)) if surface else None


@lru_cache(64)
def gated(bounded_initials: bool, wanted: frozenset[str] | None) -> tuple[tuple[bool, tuple[object, tuple[Rule, ...]]], ...]:
    """The rules that can emit wanted categories, in order: (needs a digit, (needs, rules that share it)) of neighbours."""
    rules = [r for r in registry(bounded_initials) if wanted is None or wanted & ({r.category} | r.others)]
    return tuple((isinstance(needs, re.Pattern) and r"\d" in needs.pattern, (needs, tuple(own))) for needs, own in groupby(rules, key=lambda r: r.needs))


#: Digits as one digit: patterns that tell no digit from another match a text where they match its shape.
_ONE_DIGIT = str.maketrans("123456789", "000000000")
#: The longest text whose matches are kept by shape, as short notes are often written from a form.
SHAPED_CHARS = 400


@lru_cache(256)
def _tells_digits(pattern: str) -> bool:
    """Whether a pattern says more of a digit than that it is one."""
    return bool(re.search(r"\d", re.sub(r"\{[\d,]+\}|0-9|1-9\d?(?=\])", "", pattern.replace("\\d", "")), re.A)) or "1-9" in pattern


@lru_cache(4096)
def _shaped(shape: str, bounded_initials: bool, wanted: frozenset[str] | None) -> tuple[tuple[Rule, tuple[int, ...] | None], ...]:
    """The rules that can match texts of a shape, in order, with where they do (None: where digits tell)."""
    out = []
    for _, (_, rules) in gated(bounded_initials, wanted):
        for rule in rules:
            at = None if _tells_digits(rule.pattern.pattern) else tuple(m.start() for m in rule.pattern.finditer(shape))
            if at is None or at:
                out.append((rule, at))
    return tuple(out)


def _matches(text: str, bounded_initials: bool, wanted: frozenset[str] | None):
    """(rule, match) of all rules, in order."""
    if len(text) <= SHAPED_CHARS:
        for rule, at in _shaped(text.translate(_ONE_DIGIT), bounded_initials, wanted):
            for m in rule.pattern.finditer(text) if at is None else (rule.pattern.match(text, k) for k in at):
                yield rule, m
        return
    low, has_digit, seen = text.lower(), bool(_DIGIT.search(text)), {None: True}
    for numeric, (needs, rules) in gated(bounded_initials, wanted):
        if numeric and not has_digit:
            continue
        if needs not in seen:
            seen[needs] = any(w in low for w in needs) if isinstance(needs, tuple) else needs.search(text)
        if seen[needs]:
            for rule in rules:
                for m in rule.pattern.finditer(text):
                    yield rule, m


def detect(text: str, segments: list[tuple[int, int, str]], categories: Iterable[str] | None = None, bounded_initials: bool = False) -> list[Span]:
    """All rule matches, in registry order; of some categories only, if given."""
    wanted = None if categories is None else frozenset(categories)
    starts, out = [s for s, _, _ in segments], []
    for rule, m in _matches(text, bounded_initials, wanted):
        verdict = rule.check(text, m) if rule.check else True
        if not verdict:
            continue
        category, score, name = (rule.category, rule.score, rule.name) if verdict is True else verdict
        if wanted is None or category in wanted:
            span = make_span(text, *m.span(rule.group), category, score, "rules", name or rule.name, starts, segments)
            if span:
                out.append(span)
    return out
