"""Lines, cells and structural segments of a note as Spark expressions, for tables that need no masking.

The patterns are those of operators.structure with ASCII classes; segments are matches over a string
that has one letter for each line.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..operators import structure as s
from .columns import let, matches, prefix_sums

_ENDS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
#: A line with its end, or the rest.
_LINE = rf"[^{_ENDS}]*+(?:\r\n|[{_ENDS}])|[^{_ENDS}]++"
_BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029"
_NAMED = "(?P<"


def _java(pattern) -> str:
    flags = "(?i)" if pattern.flags & 2 and not pattern.pattern.startswith("(?i") else ""
    return flags + pattern.pattern.replace(_NAMED, "(?<")


def line_kind(body: Column) -> Column:
    """blank, banner, signature, table, field or body."""
    return (
        F.when(F.btrim(body, F.lit(_BLANKS)) == "", "blank")
        .when(body.rlike(_java(s.BANNER)), "banner")
        .when(body.rlike(_java(s.SIGNATURE)) | body.rlike(_java(s.CREDENTIAL_END)), "signature")
        .when(body.rlike(_java(s.COLUMNS)), "table")
        .when((F.char_length(F.btrim(body, F.lit(" \t"))) < s.FIELD_CHARS) & body.rlike(_java(s.KEYED)), "field")
        .otherwise("body")
    )


def lines(text: Column) -> Column:
    """array<struct<start, end, text, kind>>: the lines of a text without line feeds and carriage returns."""
    def typed(raw: Column) -> Column:
        bodies = F.transform(raw, lambda x: F.rtrim(x, F.lit("\r\n")))
        starts = prefix_sums(F.transform(raw, F.char_length))
        one = lambda body, at: F.struct(at.alias("start"), (at + F.char_length(body)).alias("end"), body.alias("text"), line_kind(body).alias("kind"))
        return F.zip_with(bodies, starts, one)

    return let(F.regexp_extract_all(text, F.lit(_LINE), F.lit(0)), typed)


def cells(line: Column) -> Column:
    """array<struct<start, end, text>> of a line's cells that hold something; the whole line if nothing splits it."""
    def between(found: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(found, lambda m: m["end"]))
        ends = F.concat(F.transform(found, lambda m: m["start"]), F.array(F.char_length(line)))
        each = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end"), F.substring(line, a + 1, b - a).alias("text")))
        return F.filter(each, lambda c: c["end"] > c["start"])

    whole = F.array(F.struct(F.lit(0).alias("start"), F.char_length(line).alias("end"), line.alias("text")))
    return let(between(matches(line, s.CELL_BREAK.pattern)), lambda c: F.when(F.size(c) > 0, c).otherwise(whole))


def segments(lines_: Column) -> Column:
    """array<struct<start, end, kind>>: header, signature block, footer, and runs of table or field lines."""
    letters = F.array_join(F.transform(lines_, lambda x: F.element_at(F.create_map(*[F.lit(v) for kv in s.LETTER.items() for v in kv]), x["kind"])), "")

    def found(t: Column) -> Column:
        count = F.char_length(t)

        def behind(head: Column) -> Column:
            rest = F.substring(t, head + 1, count)
            signed = F.instr(rest, "s")
            floor = F.greatest(head, count - s.FOOTER_LINES)
            last = F.substring(t, floor + 1, count)
            foot = F.regexp_instr(last, F.lit(r"(?:[ntf][_ntf]*+|_)$"))
            part = lambda a, b, kind: F.struct(a.alias("a"), b.alias("b"), F.lit(kind).alias("kind"))
            runs = F.transform(matches(rest, s.RUN.pattern), lambda m: F.struct((head + m["start"]).alias("a"), (head + m["end"]).alias("b"), F.when(F.startswith(m["text"], F.lit("t")), "table").otherwise("field").alias("kind")))
            named = F.array(part(F.lit(0), head, "header"), part(F.when(signed > 0, head + signed - 1).otherwise(count), count, "signature"), part(F.when(foot > 0, floor + foot - 1).otherwise(count), count, "footer"))
            return F.filter(F.concat(named, runs), lambda x: x["b"] > x["a"])

        return let(F.char_length(F.regexp_extract(t, "^" + s.HEADER.pattern, 0)), behind)

    place = lambda x: F.struct(F.get(lines_, x["a"])["start"].alias("start"), F.get(lines_, x["b"] - 1)["end"].alias("end"), x["kind"].alias("kind"))
    return F.array_sort(F.transform(let(letters, found), place))
