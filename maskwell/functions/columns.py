"""Column builders from Spark's own expressions (no Python at run time).

Regular expressions here are ASCII on both sides (Java's default classes), so the same patterns run
in other SQL engines. The detectors of the whole pipeline, which need Python's dialect, are in
operators.rules.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import vocab
from ..operators.validate import FIRST_YEAR, LAST_YEAR
from ..policy import Policy

#: Detectors whose patterns need neither look-around nor backreferences: name, category, score, pattern.
FLAT_RULES = (
    ("email", "EMAIL", 0.99, r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"),
    ("url", "URL", 0.97, r"(?:https?://|ftp://|www\.)[^\s<>\"')\]]+"),
    ("ipv4", "IP", 0.95, r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
    ("phone", "PHONE", 0.93, r"(?:\+?[0-9]{1,2}[-.\s]?)?(?:\([0-9]{3}\)|\b[0-9]{3})[-.\s][0-9]{3}[-.\s][0-9]{4}\b"),
    ("ssn", "SSN", 0.96, r"\b[0-9]{3}[-\s]?[0-9]{2}[-\s]?[0-9]{4}\b"),
    ("long_digits", "ID_GENERIC", 0.55, r"\b[0-9]{9,}\b"),
)
#: What any text with a match has too, and is quick to look for.
FLAT_CUES = {
    "email": lambda t: t.contains("@"), "url": lambda t: t.contains("://") | t.contains("www."), "ipv4": lambda t: t.rlike(r"[0-9]\.[0-9]"), "phone": lambda t: t.rlike(r"[0-9]{3}[-.\s][0-9]{4}"),
    "ssn": lambda t: t.rlike(r"[0-9]{2}[-\s]?[0-9]{4}"), "long_digits": lambda t: t.rlike("[0-9]{9}"),
}
FLAT = {name: (category, score, pattern) for name, category, score, pattern in FLAT_RULES}


def let(value: Column, then) -> Column:
    """then(value), with value computed once however often it is read: an array of one holds it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def prefix_scan(values: Column, zero: int, merge) -> Column:
    """array: at each place what merge makes of zero and all values before it.

    In two levels, by chunks of about sqrt(n), as a fold that appends copies what it has: n values
    cost n * sqrt(n) steps.
    """
    scan = lambda a: F.aggregate(a, F.array(F.lit(zero)), lambda s, x: F.concat(s, F.array(merge(F.element_at(s, -1), x))))
    before = lambda a: F.slice(scan(a), F.lit(1), F.size(a))
    fold = lambda a: F.aggregate(a, F.lit(zero), merge)

    def cut(v: Column) -> Column:
        step = F.greatest(F.lit(1), F.sqrt(F.size(v)).cast("int"))
        return let(step, lambda k: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / k).cast("int")), lambda i: F.slice(v, i * k + 1, k)))

    join = lambda chunks: F.flatten(F.zip_with(chunks, before(F.transform(chunks, fold)), lambda c, z: F.transform(before(c), lambda x: merge(z, x))))
    return let(values, lambda v: F.when(F.size(v) > 0, let(cut(v), join)).otherwise(F.array().cast("array<int>")))


def prefix_sums(values: Column) -> Column:
    return prefix_scan(values, 0, lambda s, x: s + x)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start int, end int, text string>>: all matches with code point offsets.

    What lies between matches comes from a split at the same pattern, so offsets are running lengths.
    """
    empty = F.array().cast("array<struct<start:int,end:int,text:string>>")

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        lengths = F.flatten(F.zip_with(gaps, found, lambda g, m: F.array(F.char_length(g), F.char_length(m))))
        return let(prefix_sums(lengths), lambda at: F.transform(found, lambda m, k: F.struct(F.get(at, 2 * k + 1).alias("start"), (F.get(at, 2 * k + 1) + F.char_length(m)).alias("end"), m.alias("text"))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(empty))


def flat_spans(text: Column, names=tuple(FLAT)) -> Column:
    """array<struct<start, end, text, category, score, detector>> of several flat rules in one pass over rows."""
    def typed(name: str) -> Column:
        category, score, pattern = FLAT[name]
        good = {"ipv4": lambda x: ipv4_ok(x["text"]), "ssn": lambda x: ssn_ok(x["text"])}.get(name)
        found = F.when(FLAT_CUES[name](text), matches(text, pattern)).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>"))
        found = F.filter(found, good) if good else found
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), F.lit(category).alias("category"), F.lit(score).alias("score"), F.lit(name).alias("detector")))

    return F.concat(*map(typed, names))


# Validators ----------------------------------------------------------------------------------------


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def digit(value: Column, k: int) -> Column:
    return F.substring(value, k, 1).cast("int")


def npi_ok(value: Column) -> Column:
    d = digits_of(value)
    return (F.char_length(d) == 10) & F.call_function("luhn_check", F.concat(F.lit("80840"), d))


def dea_ok(value: Column) -> Column:
    v = F.trim(value)
    d = F.substring(v, 3, 7)
    odd, even = digit(d, 1) + digit(d, 3) + digit(d, 5), digit(d, 2) + digit(d, 4) + digit(d, 6)
    return F.when(v.rlike("^[A-Za-z]{2}[0-9]{7}$"), (odd + 2 * even) % 10 == digit(d, 7)).otherwise(False)


def vin_ok(value: Column) -> Column:
    v = F.upper(F.trim(value))
    source = "".join(vocab.VIN_VALUES)
    values = F.transform(F.split(F.translate(v, source, "".join(map(str, vocab.VIN_VALUES.values()))), ""), lambda c: c.cast("int"))
    total = F.aggregate(F.zip_with(values, F.lit(list(vocab.VIN_WEIGHTS)), lambda a, w: a * w), F.lit(0), lambda s, x: s + x)
    return F.when(v.rlike("^[A-HJ-NPR-Z0-9]{17}$"), F.substring(v, 9, 1) == F.substring(F.lit("0123456789X"), total % 11 + 1, F.lit(1))).otherwise(False)


def ipv4_ok(value: Column) -> Column:
    """Four numbers up to 255 without leading zeros."""
    return value.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?=[0-9])|$)){4}$")


def ssn_ok(value: Column) -> Column:
    d = digits_of(value)
    return (F.char_length(d) == 9) & ~F.substring(d, 1, 3).isin("000", "666") & (F.substring(d, 1, 1) != "9") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


def clinical_code(value: Column) -> Column:
    return F.trim(value).rlike("(?i)^(?:" + "|".join(f"(?:{p})" for p in vocab.CLINICAL_CODES) + ")$")


def opaque(value: Column) -> Column:
    t = F.trim(value)
    quantity = r"(?i)^(?:[0-9]{1,3}-(?:year|yr|month|mo|week|wk|day)s?-old|[0-9]{1,3}-(?:day|week|month|year)s?)$"
    shaped = t.rlike(r"^[A-Za-z0-9][A-Za-z0-9\-_/]{4,22}[A-Za-z0-9]$") & t.rlike("[0-9]") & t.rlike("[A-Za-z]")
    return shaped & ~clinical_code(t) & ~t.rlike("^[A-Za-z]{4,}[0-9]{1,2}$") & ~t.rlike(quantity)


def month_number(name: Column) -> Column:
    low = F.lower(F.btrim(name, F.lit(". ")))
    short = F.substring(low, 1, 3)
    at = F.array_position(F.array(*[F.lit(m) for m in ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")]), short).cast("int")
    whole = F.array(*[F.lit(m) for m in ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")])
    return F.when((at > 0) & ((low == short) | (low == "sept") | (low == F.get(whole, at - 1))), at)


def full_year(y: Column) -> Column:
    return F.when(y >= 100, y).when(y <= 30, y + 2000).otherwise(y + 1900)


def calendar_date(y: Column, m: Column, d: Column) -> Column:
    """The date, null if there is none or its year is out of range."""
    written = F.format_string("%04d-%02d-%02d", y, m, d)
    return F.when(y.between(FIRST_YEAR, LAST_YEAR) & m.between(1, 12) & d.between(1, 31), F.try_to_date(written, "yyyy-MM-dd"))


#: Forms of dates as in operators.dates, with what each group says; no surface has two forms.
_DATE_FORMS = (
    ("ymd", "([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})"), ("abY", "([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{2,4})"), ("Mdy", r"([A-Za-z]{3,9})\.?\s+([0-9]{1,2})(?:st|nd|rd|th)?,?\s+([0-9]{4})"),
    ("dMy", r"([0-9]{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]{3,9})\.?,?\s+([0-9]{4})"), ("My", r"([A-Za-z]{3,9})\.?\s+([0-9]{4})"), ("md", "([0-9]{1,2})/([0-9]{1,2})"), ("y", "((?:19|20)[0-9]{2})"),
)
_LINE_END = r"(?:\r\n|[\n\r\u0085\u2028\u2029])?"


def parse_date(surface: Column) -> Column:
    """struct<year int, month int, day int> of a date surface, null if it isn't one.

    One match takes the surface apart: the groups of all forms, of which those of one are filled.
    """
    t = F.btrim(F.btrim(surface), F.lit(".,;"))
    whole = rf"\A(?:(?:{'|'.join(p for _, p in _DATE_FORMS)}){_LINE_END}|(?s:.*))\z"
    count = sum(len(order) for order, _ in _DATE_FORMS)
    parts = F.split(F.regexp_replace(t, whole, ",".join(f"${k}" for k in range(1, count + 1))), ",", -1)
    none = F.lit(None).cast("int")
    loose = lambda y, m, d: F.struct(y.alias("year"), m.alias("month"), d.alias("day"))

    def read(p: Column) -> Column:
        at, out = 0, None
        for order, _ in _DATE_FORMS:
            text = {k: F.get(p, at + i) for i, k in enumerate(order)}
            value = {k: (month_number(v) if k == "M" else v.try_cast("int")) for k, v in text.items()}
            found, at = text[order[0]] != "", at + len(order)
            if order == "abY":
                made = let(F.struct(full_year(value["Y"]).alias("y"), value["a"].alias("a"), value["b"].alias("b")), lambda x: _checked(x["y"], F.when((x["a"] > 12) & (x["b"] <= 12), x["b"]).otherwise(x["a"]), F.when((x["a"] > 12) & (x["b"] <= 12), x["a"]).otherwise(x["b"])))
            elif order == "md":
                made = F.when(value["m"].between(1, 12) & value["d"].between(1, 31), loose(none, value["m"], value["d"]))
            elif "d" in order:
                made = let(F.struct(value["y"].alias("y"), value.get("M", value.get("m")).alias("m"), value["d"].alias("d")), lambda x: _checked(x["y"], x["m"], x["d"]))
            elif order == "My":
                made = let(F.struct(value["y"].alias("y"), value["M"].alias("m")), lambda x: F.when(x["m"].isNotNull(), loose(x["y"], x["m"], none)))
            else:
                made = loose(value["y"], none, none)
            out = F.when(found, made) if out is None else out.when(found, made)
        return out

    return let(parts, read)


def _checked(y: Column, m: Column, d: Column) -> Column:
    """struct<year, month, day> of a day that the calendar has, else null."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.when(y.between(FIRST_YEAR, LAST_YEAR) & m.between(1, 12) & (d >= 1) & (d <= last), F.struct(y.alias("year"), m.alias("month"), d.alias("day")))


# Rewriting -----------------------------------------------------------------------------------------


def zip_placeholder(value: Column, number: Column, policy: Policy | None = None) -> Column:
    p = policy or Policy()
    head = F.substring(digits_of(value), 1, 3)
    bare = F.concat(F.lit("[GEO_ZIP_"), number.cast("string"))
    if p.zip_strategy != "truncate3":
        return F.concat(bare, F.lit("]"))
    return F.when((F.char_length(head) < 3) | head.isin(*p.restricted_zip3), F.concat(bare, F.lit("]"))).otherwise(F.concat(bare, F.lit(" = "), head, F.lit("**]")))


def interval_label(number: Column, day: Column, anchor_number: Column, anchor: Column, widest: int = 730) -> Column:
    gap = F.datediff(day, anchor)
    noted = gap.isNotNull() & (gap != 0) & (F.abs(gap) <= widest)
    sign = F.when(gap > 0, "+").otherwise("-")
    return F.when(noted, F.format_string("[DATE_%d = DATE_%d %s %dd]", number, anchor_number, sign, F.abs(gap))).otherwise(F.format_string("[DATE_%d]", number))


def blanked(text: Column) -> Column:
    """text with each placeholder as an equally long run of NUL."""
    found = F.filter(matches(text, vocab.PLACEHOLDER), lambda x: x["text"].isNotNull())
    gaps = F.split(text, vocab.PLACEHOLDER, -1)
    return F.array_join(F.zip_with(gaps, found, lambda g, m: F.concat(g, F.coalesce(F.repeat(F.lit("\0"), m["end"] - m["start"]), F.lit("")))), "")
