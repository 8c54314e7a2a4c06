"""Masking of contact identifiers without Python: detection, arbitration, numbering and splicing as
Spark expressions over arrays in the row. For corpora where names and form fields don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import columns as c

RULES = ("email", "url", "ipv4", "phone", "ssn")
#: The least that the rest of an overlapped span must hold.
REMAINDER_CHARS = 2
_WORD = r"[\p{L}\p{N}]"


def _rest(text: Column, s: Column, taken: Column) -> Column:
    """What taken spans leave of s: its longest stretch (the first of equals) without cut words or
    white space at its ends, as struct<start, end, text>."""
    edges = F.array_sort(F.transform(taken, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))))
    gaps = F.zip_with(F.concat(F.array(s["start"]), F.transform(edges, lambda t: t["end"])), F.concat(F.transform(edges, lambda t: t["start"]), F.array(s["end"])), lambda a, b: F.struct((b - a).alias("n"), (-a).alias("at")))
    # An array of one holds what the next step reads more than once.
    step = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    alnum = lambda at: F.coalesce(F.substring(text, at, F.lit(1)).rlike(_WORD), F.lit(False))

    def cut_left(g: Column) -> Column:
        start = -g["at"]
        surface = F.substring(text, start + 1, F.greatest(g["n"], F.lit(0)))
        cut = F.when((start > 0) & alnum(start), F.regexp_replace(surface, f"^{_WORD}+", "")).otherwise(surface)
        return step(cut, lambda x: F.struct((start + F.char_length(surface) - F.char_length(x)).alias("start"), x.alias("x"), alnum(start + g["n"] + 1).alias("joined")))

    def cut_right(g: Column) -> Column:
        return step(F.when(g["joined"], F.regexp_replace(g["x"], f"{_WORD}+$", "")).otherwise(g["x"]), lambda x: F.struct((g["start"] + F.char_length(x) - F.char_length(F.ltrim(x))).alias("start"), F.trim(x).alias("text")))

    return step(step(step(F.array_max(gaps), cut_left), cut_right), lambda g: F.struct(g["start"].alias("start"), (g["start"] + F.char_length(g["text"])).alias("end"), g["text"].alias("text")))


def _fold(text: Column, spans: Column) -> Column:
    """Of an array of spans in order of priority those that hold something unclaimed, cut to it."""
    touching = lambda taken, s: F.filter(taken, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"]))
    one = lambda s, g: F.array(F.struct(g["start"].alias("start"), g["end"].alias("end"), g["text"].alias("text"), s["category"].alias("category"), s["score"].alias("score"), s["detector"].alias("detector")))

    def fold(taken: Column, s: Column) -> Column:
        none = F.filter(one(s, s), lambda x: F.lit(False))
        cut = F.filter(F.transform(F.array(_rest(text, s, touching(taken, s))), lambda g: one(s, g)[0]), lambda x: (F.char_length(x["text"]) >= REMAINDER_CHARS) & x["text"].rlike(_WORD))
        return F.concat(taken, F.when(F.size(touching(taken, s)) == 0, one(s, s)).otherwise(F.coalesce(cut, none)))

    return F.aggregate(spans, F.filter(spans, lambda s: F.lit(False)), fold)


def islands(spans: Column) -> Column:
    """array<array>: an array of struct<start, end, ...> cut where nothing that came before reaches."""
    def cut(p: Column) -> Column:
        reach = c.prefix_scan(F.transform(p, lambda s: s["end"]), 0, lambda a, b: F.greatest(a, b))
        opens = c.let(reach, lambda r: F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda k: F.get(p, k)["start"] >= F.get(r, k)))
        return c.let(opens, lambda o: F.transform(o, lambda a, k: F.slice(p, a + 1, F.coalesce(F.get(o, k + 1), F.size(p)) - a)))

    return c.let(F.array_sort(spans), lambda p: F.when(F.size(p) > 0, cut(p)).otherwise(F.filter(F.array(p), lambda x: F.lit(False))))


def arbitrate(text: Column, spans: Column, priority) -> Column:
    """Spans that don't overlap, in order: by priority (a struct of a span, least first) each takes what is free.

    Spans compete only within an island of overlaps, which is short where a text is long.
    """
    ordered = lambda group: F.transform(F.array_sort(F.transform(group, lambda s: F.struct(priority(s).alias("p"), s.alias("s")))), lambda x: x["s"])
    return F.array_sort(F.flatten(F.transform(islands(spans), lambda group: _fold(text, ordered(group)))))


def mask_contacts(docs: DataFrame, text: str = "text", rules: tuple[str, ...] = RULES) -> DataFrame:
    """docs with contacts (array of struct<start, end, text, category, score, detector, placeholder>) and masked_text.

    Overlaps go to the higher score, then the longer span, then the earlier rule; the other span keeps
    its longest free stretch. Within a document and category equal texts (letters in any case) share a
    number, in order of appearance. Null text has no contacts and stays null.
    """
    keep = [F.col(f"`{n}`") for n in docs.columns]
    found = docs.select(*keep, c.flat_spans(F.coalesce(F.col(text), F.lit("")), rules).alias("_s"))
    # Structs sort in ascending order: negated score and length first, then the rule's place.
    order = F.array(*[F.lit(r) for r in rules])
    priority = lambda s: F.struct((-s["score"]).alias("a"), (s["start"] - s["end"]).alias("b"), F.array_position(order, s["detector"]).alias("c"), s["start"].alias("d"))
    chosen = found.select(*keep, arbitrate(F.col(text), F.col("_s"), priority).alias("_c"))
    # Of each category the distinct texts in order of appearance; a text's place there is its number.
    categories = sorted({c.FLAT[r][0] for r in rules})
    of = lambda category: F.array_distinct(F.transform(F.filter("_c", lambda x: x["category"] == category), lambda x: F.lower(x["text"])))
    texts = F.array(*map(of, categories))
    place = lambda s: F.array_position(F.array(*map(F.lit, categories)), s["category"]).cast("int") - 1

    def named(t: Column) -> Column:
        number = lambda s: F.array_position(F.get(t, place(s)), F.lower(s["text"]))
        return F.transform("_c", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["category"].alias("category"), s["score"].alias("score"), s["detector"].alias("detector"), F.concat(F.lit("["), s["category"], F.lit("_"), number(s).cast("string"), F.lit("]")).alias("placeholder")))

    out = chosen.select(*keep, c.let(texts, named).alias("contacts"))
    before = F.transform("contacts", lambda s, k: F.concat(F.substring(F.col(text), F.coalesce(F.get("contacts", k - 1)["end"], F.lit(0)) + 1, s["start"] - F.coalesce(F.get("contacts", k - 1)["end"], F.lit(0))), s["placeholder"]))
    tail = F.substring(F.col(text), F.coalesce(F.try_element_at("contacts", F.lit(-1))["end"], F.lit(0)) + 1, F.char_length(F.col(text)))
    return out.withColumn("masked_text", F.concat(F.array_join(before, ""), tail))
