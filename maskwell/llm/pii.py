"""Personal data: fixed base patterns, and a semi-Markov conditional random field that adds spans.

Base spans are found in linear time by the contract's patterns (e-mail, IP, card, phone). The semi-CRF
then reads regions: runs of words that hold a digit, an at sign or a spelled-out one, with nothing but
one white space character or characters that a number may hold between them. A region is cut into tokens; candidate segments are runs of up to MAX_TOKENS of them. A segment is scored as a whole
for each type by weights over features of the whole span (digit count, grouping, Luhn, octets, domain
shape, cue words before it and so on), a token outside any entity scores 0. Dynamic programming over
the region sums and maximises over all ways to cut it, so boundaries and types are chosen jointly; a
chosen segment is reported if its marginal probability is at least CONFIDENCE and it overlaps no base
span. Words outside regions can't be part of an entity, and a region falls apart exactly where no
segment covers a boundary, so this equals decoding the whole text.

The weights are trained here, on the driver, by maximising the conditional likelihood of TRAINING
generated regions (seeded; no corpus text), and sent along with the task.

Defined results for odd input: null text counts as empty and has no spans; rows that repeat are
scanned each by itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, MAX_DIGITS, CONFIDENCE = 24, 19, 0.9
TRAINING, EPOCHS, SEED = 1200, 12, 7
_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match can only begin where a run of digits does
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, end)):
            end = m.end()
            out.append((0, start, end))
            free = end
        else:
            free = max(free, start)  # no later match can begin before this sign
        at = text.find("@", end)
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in _CARD.finditer(text) if len(m[0]) <= 37 and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# The model ---------------------------------------------------------------------------------------

_ANY = re.compile(r"[0-9@]|[(\[]at[)\]]")
_WORD = re.compile(r"(?<!\S)\S*?(?:[0-9@]|[(\[]at[)\]])\S*")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.S)
_CUE = re.compile(r"([^\W\d_]+)[^\w]*\Z")
#: Words that speak for or against a type.
_CUES = {"tel": 1, "phone": 1, "call": 1, "fax": 1, "mobile": 1, "cell": 1, "telefon": 1, "card": 2, "visa": 2, "mastercard": 2, "credit": 2, "karte": 2, "ip": 3, "host": 3, "server": 3, "address": 3, "mail": 4, "email": 4, "contact": 4, "version": 5, "v": 5, "no": 5, "nr": 5, "order": 5, "id": 5, "page": 5, "invoice": 5, "isbn": 5, "serial": 5}
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+(?:@|[(\[]at[)\]])[A-Za-z0-9-]+(?:(?:\.|[(\[]dot[)\]])[A-Za-z0-9-]+)+")
_GROUPS = re.compile(r"[0-9]+")
_DATE = re.compile(r"(?:[0-9]{4}([-./])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-./])[0-9]{1,2}\2[0-9]{2,4})")
_NUMBERED = re.compile(r"[+(]?[0-9][0-9 ().\-/]*[0-9]")
_BETWEEN = re.compile(r"[ ().\-/]+|[\t\xa0]")
_LEAD = re.compile(r"[(\[<\"'+:=#*$%&! ]*")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_ZEROS = {c: "0" for c in range(48, 58)}
_DIGITS, _MAILED = frozenset("0123456789"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-@()[]")
FEATURES = 40


@lru_cache(1 << 16)
def shape_features(shape: str) -> tuple[int, ...] | None:
    """What a number's shape (0 for each digit) says; None if it can't be an entity."""
    if not _NUMBERED.fullmatch(shape):
        return None
    groups = _GROUPS.findall(shape)
    n = sum(map(len, groups))
    if n < 4 or n > MAX_DIGITS:
        return None
    sizes = tuple(map(len, groups))
    out = [0, 6 if n < 7 else 7 if n < 10 else 8 if n == 10 else 9 if n == 11 else 10 if n < 16 else 11]
    if shape[0] == "+":
        out.append(16)
    if "(" in shape:
        out.append(17 if re.fullmatch(r"[^(]*\([0-9]{2,4}\)[^()]*", shape) else 18)
    if sizes[-3:] == (3, 3, 4) and len(sizes) <= 4:
        out.append(19)
    if sizes in ((4, 4, 4, 4), (4, 6, 5), (4, 4, 4, 4, 3)):
        out.append(20)
    out.append(21 if len(groups) == 1 else 22 if len(groups) == 2 else 23)
    out.append(24 if len(set(shape) - set("0+()")) <= 1 else 25)
    if _DATE.fullmatch(shape):
        out.append(26)
    return tuple(out)


def features(text: str, start: int, end: int, cue: int) -> list[int] | None:
    """Indexes of the features of text[start:end] as one span; None if it can't be an entity."""
    span = re.sub("  +", " ", text[start:end])  # no feature counts blanks
    if "@" in span or "at)" in span or "at]" in span:
        if not _MAIL.fullmatch(span):
            return None
        out = [0, 1, 2 if span.rpartition(".")[2].isalpha() else 3, 4 if "@" in span else 5]
    else:
        found = shape_features(span.translate(_ZEROS))
        if not found:
            return None
        out = list(found)
        if 11 in found:
            out.append(12 if luhn(_NOT_DIGIT.sub("", span)) else 13)
        if _DOTTED.fullmatch(span):
            out.append(14 if all(int(g) <= 255 for g in span.split(".")) else 15)
    before, after = text[start - 1] if start else " ", text[end] if end < len(text) else " "
    if before.isalnum() or before in "._%+-@/":
        out.append(27)
    if after.isalnum() or after in "@_%/" or after in ".-" and end + 1 < len(text) and text[end + 1].isalnum():
        out.append(28)
    if cue:
        out.append(28 + cue)
    return out


def _logadd(a: float, b: float) -> float:
    low, high = (a, b) if a < b else (b, a)
    return high + math.log1p(math.exp(low - high))


class Lattice:
    """The candidate segments of one region, each with its features."""

    def __init__(self, text: str, start: int, end: int):
        edges = [start] + [m.end() for m in _TOKEN.finditer(text, start, end)]
        head = _CUE.search(text[max(0, start - 40) : start])
        cue = _CUES.get(head[1].lower(), 0) if head else 0
        lead = _LEAD.match(text, start, end).end()
        # Of each token: its digits, and whether it can be within a number and within an address.
        tokens = [text[a:b] for a, b in zip(edges, edges[1:])]
        digits = [len(t) if t[0] in _DIGITS else 0 for t in tokens]
        number = [bool(n) or t[0] in "().-/" or not t.strip(" ") for t, n in zip(tokens, digits)]
        address = [t[0] in _MAILED for t in tokens]
        self.edges, self.segments, self.features = edges, [], []
        for k, e in enumerate(edges[:-1]):
            first = text[e]
            if not (first.isalnum() or first in "+(._%"):
                continue
            seen, numeric, mailed = 0, digits[k] > 0 or first in "+(", address[k]
            for j in range(k + 1, min(k + MAX_TOKENS, len(edges) - 1) + 1):
                seen += digits[j - 1]
                numeric = numeric and seen <= MAX_DIGITS and (j == k + 1 or number[j - 1])
                mailed = mailed and address[j - 1]
                if not numeric and not mailed:
                    break
                stop = edges[j]
                if stop - e < 4 or not text[stop - 1].isalnum():
                    continue
                found = features(text, e, stop, cue if e <= lead else 0)
                if found:
                    self.segments.append((k, j))
                    self.features.append(found)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        each: dict[tuple[int, ...], np.ndarray] = {}
        rows = [tuple(f) for f in self.features]
        for f in set(rows):
            each[f] = weights[:, f].sum(axis=1)
        return np.array([each[f] for f in rows])

    def solve(self, scores: np.ndarray) -> tuple[float, np.ndarray, list[tuple[int, int, int]]]:
        """log partition sum, marginals (segments x types), best cut as (start token, end token, type)."""
        n = len(self.edges) - 1
        by_end, by_start = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
        for s, (k, j) in enumerate(self.segments):
            by_end[j].append(s)
            by_start[k].append(s)
        total = np.logaddexp.reduce(scores, axis=1).tolist() if len(scores) else []
        kinds, tops = (scores.argmax(axis=1).tolist(), scores.max(axis=1).tolist()) if len(scores) else ([], [])
        ahead, behind, best, back = [0.0] * (n + 1), [0.0] * (n + 1), [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            ahead[j], best[j] = ahead[j - 1], best[j - 1]
            for s in by_end[j]:
                k = self.segments[s][0]
                ahead[j] = _logadd(ahead[j], ahead[k] + total[s])
                if best[k] + tops[s] > best[j]:
                    best[j], back[j] = best[k] + tops[s], (s, kinds[s])
        for k in range(n - 1, -1, -1):
            behind[k] = behind[k + 1]
            for s in by_start[k]:
                behind[k] = _logadd(behind[k], total[s] + behind[self.segments[s][1]])
        z = ahead[n]
        around = np.array([ahead[k] + behind[j] - z for k, j in self.segments])
        marginals = np.exp(scores + around[:, None]) if len(scores) else np.zeros((0, len(KINDS)))
        cut, j = [], n
        while j > 0:
            if back[j] is None or best[j] == best[j - 1]:
                j -= 1
            else:
                s, kind = back[j]
                cut.append((s, self.segments[s][0], kind))
                j = self.segments[s][0]
        return z, marginals, cut


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Runs of words that may hold an entity, with only what may stand within one between them."""
    if not _ANY.search(text):
        return
    start = end = None
    for m in _WORD.finditer(text):
        if end is not None and _BETWEEN.fullmatch(text, end, m.start()):
            end = m.end()
        else:
            if start is not None:
                yield start, end
            start, end = m.span()
    if start is not None:
        yield start, end


def decode(text: str, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the segments that the model is sure of."""
    out = []
    for start, end in regions(text):
        lattice = Lattice(text, start, end)
        if lattice.segments:
            _, marginals, cut = lattice.solve(lattice.scores(weights))
            for s, _, kind in cut:
                if marginals[s, kind] >= CONFIDENCE:
                    k, j = lattice.segments[s]
                    out.append((kind, lattice.edges[k], lattice.edges[j]))
    return out


# Training ----------------------------------------------------------------------------------------


def _generated(rng: random.Random) -> tuple[str, tuple[int, int, int] | None]:
    """One line of text with at most one entity: (text, (kind, start, end))."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghinorstu") for _ in range(rng.randint(2, 9)))
    kind = rng.choice([0, 1, 2, 3, 3, 3, None, None, None, None])
    cue = ""
    if kind == 0:
        at, dot = rng.choice([("@", "."), ("@", "."), ("[at]", "[dot]"), ("(at)", "."), ("(at)", "(dot)")])
        span = f"{word()}{rng.choice(['', '.' + word(), d(2)])}{at}{word()}{rng.choice(['', d(1)])}{dot}{rng.choice(['com', 'org', 'net', 'de', 'example' + dot + 'com'])}"
        cue = rng.choice(["", "", "mail ", "contact: "])
    elif kind == 1:
        span = ".".join(str(rng.randint(1, 255)) for _ in range(4))
        cue = rng.choice(["", "", "host ", "ip "])
    elif kind == 2:
        body = rng.choice("3456") + d(14)
        number = next(body + c for c in "0123456789" if luhn(body + c))
        sep = rng.choice(["", "", " ", "-", "."])
        span = sep.join(number[k : k + 4] for k in range(0, 16, 4))
        cue = rng.choice(["", "", "card ", "visa: "])
    elif kind == 3:
        a, b, c = rng.choice("23456789") + d(2), d(3), d(4)
        span = rng.choice([f"+1 ({a}) {b}-{c}", f"+{rng.randint(20, 99)} {d(3)} {d(7)}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"({a}) {b} {c}", f"+{rng.randint(1, 99)}-{a}-{b}-{c}", f"1-{a}-{b}-{c}"])
        cue = rng.choice(["", "", "tel ", "phone: ", "call "])
    else:
        span = rng.choice([
            d(rng.randint(4, 15)), f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1990, 2030)}", f"{rng.randint(1, 20)}.{rng.randint(0, 30)}.{rng.randint(0, 99)}", f"{d(4)} {d(4)}", f"{d(3)} {d(3)} {d(3)}", f"{d(3)}-{d(3)}",
            f"{rng.randint(256, 999)}.{d(2)}.{d(3)}.{d(2)}", f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(16)}", f"{word()}{d(4)}", f"@{word()}", f"{d(2)}:{d(2)} {d(4)}", f"{rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{d(5)}-{d(4)}", f"{d(2)} {d(3)} {d(4)}", f"{d(3)}-{d(2)}-{d(4)}",
        ])
        digits = _NOT_DIGIT.sub("", span)
        if len(digits) >= 16 and luhn(digits):
            span = d(5)
        cue = rng.choice(["", "", "version ", "no ", "order ", "page "])
    left = f"{word()} {cue}{rng.choice(['', '', '(', '= '])}"
    return f"{left}{span}{rng.choice(['', '', '.', ',', ')', '###'])} {word()}", None if kind is None else (kind, len(left), len(left) + len(span))


@lru_cache(1)
def trained() -> np.ndarray:
    """Weights, types x FEATURES."""
    rng, examples = random.Random(SEED), []
    for _ in range(TRAINING):
        text, gold = _generated(rng)
        for start, end in regions(text):
            lattice = Lattice(text, start, end)
            if lattice.segments:
                at = None
                if gold:
                    spans = [(lattice.edges[k], lattice.edges[j]) for k, j in lattice.segments]
                    at = (spans.index(gold[1:]), gold[0]) if gold[1:] in spans else None
                examples.append((lattice, at))
    weights, squares = np.zeros((len(KINDS), FEATURES)), np.full((len(KINDS), FEATURES), 1e-6)
    weights[:, 0] = -1.0
    for _ in range(EPOCHS):
        rng.shuffle(examples)
        for lattice, at in examples:
            _, marginals, _ = lattice.solve(lattice.scores(weights))
            gradient = -0.0005 * weights
            for s, f in enumerate(lattice.features):
                gradient[:, f] -= marginals[s][:, None]
            if at:
                gradient[at[1], lattice.features[at[0]]] += 1
            squares += gradient**2
            weights += 0.3 * gradient / np.sqrt(squares)
    return weights


def scan(text: str | None, weights: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and the spans that the model adds."""
    text = text or ""
    base = base_spans(text)
    added, taken, k = [], sorted((s, e) for _, s, e in base), 0
    for kind, s, e in sorted(decode(text, weights), key=lambda x: x[1]):
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if not any(a < e for a, _ in taken[k : k + 1]):
            added.append((kind, s, e))
    return base, added


def _text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def pii_scan(docs: DataFrame) -> DataFrame:
    """The contract's row for each row of docs, and n_added."""
    weights = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                base, added = scan(value.as_py(), weights)
                counts = [sum(k == x[0] for x in base) for k in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(_text(base).encode()).hexdigest(), _text(sorted(base + added)), len(added)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], [x.split()[0] for x in _SCHEMA.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_of(docs).alias("text")).mapInArrow(run, _SCHEMA)
