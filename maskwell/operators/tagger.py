"""A token tagger as a span source: overlapping windows, BIO decoding, one span for each place.

The model is the caller's: `tokenise` gives the (start, end) of a text's tokens, `predict` gives for
windows of them a tag and its probability for each token. No weights are shipped.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

from .. import vocab
from .spans import Span

#: Window and overlap in tokens, and the least score of a span.
WINDOW, OVERLAP, FLOOR = 512, 128, 0.05

Tokens = list[tuple[int, int]]
Tagged = list[tuple[str, float]]


def windows(count: int, size: int = WINDOW, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """(start, end) of windows over count tokens; the last one ends with them."""
    step, start = size - overlap, 0
    while count:
        yield start, min(start + size, count)
        if start + size >= count:
            return
        start += step


def decode(tokens: Tokens, tagged: Tagged) -> Iterator[tuple[int, int, str, float]]:
    """(start, end, label, mean probability): a B opens an entity, as does an I that continues none of its label.

    Tokens of no length are the model's own and belong to nothing.
    """
    held: tuple[int, int, str, list[float]] | None = None
    for (start, end), (tag, probability) in zip(tokens, tagged):
        if start == end:
            continue
        mark, _, label = tag.partition("-")
        if held and (mark != "I" or label != held[2]):
            yield held[0], held[1], held[2], sum(held[3]) / len(held[3])
            held = None
        if mark in ("B", "I") and label:
            held = (held[0], end, label, [*held[3], probability]) if held else (start, end, label, [probability])
    if held:
        yield held[0], held[1], held[2], sum(held[3]) / len(held[3])


class Tagger:
    """texts -> spans of each, for Deidentifier(sources=[...]). loaded: makes (tokenise, predict) once a worker."""

    def __init__(self, loaded: Callable[[], tuple[Callable[[str], Tokens], Callable[[list[tuple[str, Tokens]]], list[Tagged]]]], size: int = WINDOW, overlap: int = OVERLAP, floor: float = FLOOR):
        self._loaded, self.size, self.overlap, self.floor = loaded, size, overlap, floor
        self._model = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_model": None}

    def __call__(self, texts: list[str]) -> list[list[Span]]:
        if self._model is None:
            self._model = self._loaded()
        tokenise, predict = self._model
        asked = [(k, tokens[a:b]) for k, text in enumerate(texts) for tokens in [tokenise(text)] for a, b in windows(len(tokens), self.size, self.overlap)]
        best: list[dict[tuple[int, int, str], float]] = [{} for _ in texts]
        unknown = set()
        for (k, tokens), tagged in zip(asked, predict([(texts[k], tokens) for k, tokens in asked])):
            for start, end, label, score in decode(tokens, tagged):
                if label not in vocab.HIPAA:
                    unknown.add(label)
                elif score >= self.floor:
                    best[k][start, end, label] = max(score, best[k].get((start, end, label), 0.0))
        if unknown:
            logging.getLogger(__name__).warning("labels that are no category: %s", ", ".join(sorted(unknown)))
        return [[Span(s, e, label, text[s:e], score, "neural", "tagger") for (s, e, label), score in sorted(found.items())] for text, found in zip(texts, best)]
