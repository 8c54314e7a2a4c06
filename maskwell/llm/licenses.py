"""License scans: Aho-Corasick over whole texts, and a shunting-yard parser for licence expressions.

One automaton holds identifier tags and notice phrases. It runs over the text's words (A-Z
lower-cased, words joined by single spaces), so a hit is a place where a phrase's words stand
consecutively, and overlapping hits all count. The three base phrases give the base counts and
labels; further notices (BSD, Mozilla and others) give labels only. A second automaton finds
identifier tags in the raw text; the expression behind a tag, up to the end of its line or comment
or the next tag, is parsed with AND, OR, WITH and parentheses into postfix order and evaluated into its
choices, the least sets of labels that satisfy it: OR unites the choices of its operands, AND crosses
them, a WITH keeps its licence; a set that holds another one is no choice. WITH binds an identifier to
an identifier, so it can't stand before a parenthesis. If other text follows the expression, it ends
before the first token that can't continue it: its longest beginning that parses counts, up to a
comma, a sentence's end or a word of prose. If none parses, the tag adds nothing.

The column choices lists them for each expression ('apache|mit': either; 'bsd+gpl': both), expressions
in order and joined by ';'. An expression with over MAX_CHOICES of them is written as it stands, with
'|', '+' and parentheses. The column required holds the labels that no choice avoids, of any expression.

Words such as 'licensed under' are in the automaton too. What follows them is prose, so it is read
into an expression first: articles and words of version or variant are passed over ('the MIT License',
'CC BY-NC 4.0'), a comma or slash between identifiers counts as OR, and the expression ends before
anything that isn't an identifier of FAMILIES, is shaped like one with a version ('EUPL-1.2') or names
an exception. Its labels are those of a further notice.

Score: 1 if a tag's expression parsed and all its identifiers are of FAMILIES, IDENTIFIERS or shaped
like one with a version, else 0.9 if a base phrase was found, 0.7 if another notice was, 0.5 if a tag's
expression parsed, 0 if nothing was.

Defined results for odd input: null text counts as empty (no words, no labels, no choices, score 0); rows that
repeat are scanned each by itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notices.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "creative commons": "cc",
    "isc license": "isc",
    "the unlicense": "unlicense",
    "zlib license": "zlib",
}
TAGS = ("spdx-license-identifier:", "license-expression:")
#: Licence identifiers begin with these; what follows is the version or variant.
FAMILIES = ("agpl", "lgpl", "gpl", "apache", "mit", "bsd", "mpl", "epl", "bsl", "cc", "isc", "unlicense", "zlib")
#: Further identifiers that a tag may name, without version or variant.
IDENTIFIERS = frozenset("0bsd afl artistic blueoak bzip2 cddl cecill cpl ecl efl etalab eudatagrid eupl fair fdl ftl gfdl hpnd icu ijg intel ipl json lppl lpl ms-pl ms-rl multics naumen ncsa ngpl npl ofl odbl openssl osl php postgresql psf python qpl ruby sgi sleepycat spl ssh-openssh unicode upl vim vsl w3c wtfpl x11 xnet zend zpl".split())
#: Words before 'under' in a notice that names its licence by an identifier.
GRANTS = ("licensed", "licenced", "released", "distributed", "published", "available", "provided")
#: Words passed over in such a notice: before an identifier, and on both sides of one.
_LEADS = frozenset(("a", "an", "any", "both", "conditions", "either", "gnu", "modified", "new", "of", "revised", "simplified", "terms", "the"))
_MORE = re.compile(r"v?[0-9][0-9.]*\+?|v|ver|version|licen[cs]es?|[0-9]-clause|clause|only|by(?:-(?:nc|sa|nd))*|nc|sa|nd|zero|international|style|software|public|domain|x11|expat")
_KNOWN = re.compile("(" + "|".join(FAMILIES) + r")(?:v?[0-9][0-9.]*)?\+?(?:-.*)?")
_SHAPED = re.compile(r"[a-z][a-z0-9]*(?:-[a-z0-9]+)*-[0-9]+\.[0-9]+(?:\+|-only|-or-later)?|licenseref-.+")
_OTHER = r"[\x00-/:-@\[-`{-\x7f]"  # what the fold makes a space
_GRANT = re.compile(rf"(?<![^\x00-/:-@\[-`{{-\x7f])(?:{'|'.join(GRANTS)}){_OTHER}+under(?![^\x00-/:-@\[-`{{-\x7f])")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
MAX_CHOICES = 64
#: Ends of lines and of comments.
_END = re.compile(r"[\r\n]|\*[/)]|-->|-\}|#\}|[%?]>|</")
#: Words that no tag means as an identifier where its expression runs into prose.
_PROSE = frozenset("a all an any are as at be by comment field for from header headers identifier in is its later line lines must of on other others our see should tag tags that the these this to your".split())
_SMALL = {c: c + 32 for c in range(65, 91)}
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
#: Bytes of UTF-8 that aren't ASCII letters or digits become spaces; letters become small; others stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, choices string, required string"


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: tokens in postfix order (operators in lower case), None if they don't parse."""
    out: list[str] = []
    held: list[str] = []
    operand = False  # whether the last token ends an operand
    for token in _TOKEN.findall(expression):
        word = token.lower()
        if word in _PRECEDENCE:
            if not operand:
                return None
            while held and held[-1] != "(" and _PRECEDENCE[held[-1]] >= _PRECEDENCE[word]:
                out.append(held.pop())
            held.append(word)
            operand = False
        elif token == "(":
            if operand or held and held[-1] == "with":
                return None
            held.append(token)
        elif token == ")":
            if not operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        else:
            if operand:
                return None
            out.append(token)
            operand = True
    if not operand or "(" in held:
        return None
    return out + held[::-1]


def prefix(tokens: list[str]) -> list[str]:
    """The longest beginning of tokens that parses; empty if none does."""
    valid, depth, operand = 0, 0, False
    for k, token in enumerate(tokens):
        if token.lower() in _PRECEDENCE or token == ")":
            if not operand or token == ")" and not depth:
                break
            operand = token == ")"
        elif operand or token == "(" and k and tokens[k - 1].lower() == "with":
            break
        else:
            operand = token != "("
        depth += (token == "(") - (token == ")")
        if operand and not depth:
            valid = k + 1
    return tokens[:valid]


def declared(line: str) -> list[str]:
    """The tokens of the expression at the beginning of a line that holds other text behind it."""
    out: list[str] = []
    end = 0
    for m in _TOKEN.finditer(line):
        token = m[0].rstrip(".:-")
        if token.lower() in _PROSE or out and (not token or "," in line[end : m.start()] or ";" in line[end : m.start()]):
            break
        end = m.end()
        if token:
            out.append(token)
            if m[0][-1] == "." and "(" not in out:
                break
    return prefix(out)


def noticed(text: str, at: int) -> list[str]:
    """The tokens of the expression that a notice's prose at this position holds."""
    out: list[str] = []
    end = at
    for m in _TOKEN.finditer(text, at):
        word = m[0].lower().rstrip(".:-")
        between, end = text[end : m.start()].strip(), m.end()
        last = out[-1] if out else "("
        operand = last not in _PRECEDENCE and last != "("
        known = _KNOWN.fullmatch(word)
        if word in _PRECEDENCE:
            if operand:  # else 'terms and conditions', 'and/or'
                out.append(word)
        elif word == "later" and last == "or":
            out.pop()
        elif word in ("(", ")"):
            out.append(word)
        elif known or _SHAPED.fullmatch(word) or last == "with" and "exception" in word:
            if operand and between in (",", "/"):
                out.append("or")
            elif operand:
                break
            out.append(known[1] if known else word)
        elif not (_MORE.fullmatch(word) or not operand and word in _LEADS):
            break
        if m[0][-1] == "." and word not in ("v", "ver") and "(" not in out:
            break
    return prefix(out)


def family(identifier: str) -> str:
    low = identifier.lower()
    known = _KNOWN.fullmatch(low)
    return known[1] if known else low


def recognised(identifier: str) -> bool:
    low = identifier.lower()
    return bool(_KNOWN.fullmatch(low) or _SHAPED.fullmatch(low)) or low in IDENTIFIERS or low.partition("-")[0] in IDENTIFIERS


class Expression(NamedTuple):
    """An expression's value: its choices (None if there are too many), what it is made of, and as text."""

    choices: frozenset[frozenset[str]] | None
    labels: frozenset[str]
    required: frozenset[str]
    sure: bool
    text: str
    joined: str = ""


def least_sets(sets: set[frozenset[str]]) -> frozenset[frozenset[str]] | None:
    """The sets that hold no other; None if these are over MAX_CHOICES."""
    kept: list[frozenset[str]] = []
    for x in sorted(sets, key=len):
        if not any(y <= x for y in kept):
            kept.append(x)
            if len(kept) > MAX_CHOICES:
                return None
    return frozenset(kept)


def evaluate(postfix: list[str]) -> Expression:
    """The value of an expression in postfix order."""
    stack: list[Expression] = []
    for token in postfix:
        if token not in _PRECEDENCE:
            own = frozenset((family(token),))
            stack.append(Expression(frozenset((own,)), own, own, recognised(token), family(token)))
            continue
        b, a = stack.pop(), stack.pop()
        if token == "with":
            stack.append(a)
            continue
        either = token == "or"
        choices = None
        if a.choices and b.choices:
            choices = least_sets(set(a.choices | b.choices) if either else {x | y for x in a.choices for y in b.choices})
        required = a.required & b.required if either else a.required | b.required
        parts = [f"({x.text})" if x.joined and x.joined != token else x.text for x in (a, b)]
        stack.append(Expression(choices, a.labels | b.labels, required, a.sure and b.sure, ("|" if either else "+").join(parts), token))
    return stack.pop()


def written(value: Expression) -> str:
    if value.choices is None:
        return value.text
    return "|".join(sorted("+".join(sorted(x)) for x in value.choices))


def _automaton(keys: dict[str, object]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for key, value in keys.items():
        out.add_word(key, value)
    out.make_automaton()
    return out


class Scanner:
    """Both automata; made once for each task."""

    def __init__(self) -> None:
        self.phrases = _automaton({f" {p} ": (p, label, p in BASE) for p, label in (NOTICES | BASE).items()} | {f" {g} under ": (f"{g} under", "", False) for g in GRANTS})
        self.tags = _automaton({t: len(t) for t in TAGS})

    def expressions(self, text: str) -> list[Expression]:
        low = text.translate(_SMALL)  # as long as the text
        found = []
        hits = [(end + 1, end + 1 - size) for end, size in self.tags.iter(low)]
        for (at, _), (_, following) in zip(hits, [*hits[1:], (0, len(text))]):
            stop = _END.search(text, at, following)
            line = text[at : stop.start() if stop else following]
            postfix = to_postfix(line.rstrip("*/-> \t.;,"))
            if postfix is None or any(x.lower() in _PROSE for x in postfix):
                postfix = to_postfix(" ".join(declared(line)))
            if postfix is not None:
                found.append(evaluate(postfix))
        return found

    def grants(self, text: str) -> list[Expression]:
        low = text.translate(_SMALL)
        found = [noticed(text, m.end()) for m in _GRANT.finditer(low)]
        return [evaluate(to_postfix(" ".join(tokens))) for tokens in found if tokens]

    def scan(self, text: str | None) -> tuple:
        folded = (text or "").encode().translate(_FOLD)
        words = folded.split()
        normal = " " + b" ".join(words).decode() + " "
        starts, base, other = [], set(), set()
        at, counted = 0, 0  # words before position at
        for end, (phrase, label, is_base) in self.phrases.iter(normal):
            begin = end - len(phrase) - 1
            if is_base:
                counted += normal.count(" ", at, begin) if begin >= at else -normal.count(" ", begin, at)
                at = begin
                starts.append(counted)
                base.add(label)
            else:
                other.add(label)
        granted = self.grants(text) if "" in other else []
        other = other.union(*(x.labels for x in granted)) - {""}
        tagged = self.expressions(text) if text and b"license" in folded else []
        score = 1.0 if any(x.sure for x in tagged) else 0.9 if base else 0.7 if other else 0.5 if tagged else 0.0
        every = tagged + granted
        texts = [",".join(sorted(base)), ",".join(sorted(base.union(other, *(x.labels for x in tagged)))), ";".join(written(x) for x in every), ",".join(sorted(frozenset().union(*(x.required for x in every))))]
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), texts[0], texts[1], score, texts[2], texts[3]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()] + [pa.string()] * 2
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    for batch in batches:
        rows = [scanner.scan(x.as_py()) for x in batch.column("text")]
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)


def license_scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_of(docs).alias("text")).mapInArrow(_scan, _SCHEMA)
