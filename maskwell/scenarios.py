"""Registered queries over layouts, requests, files, streams and scores, with DuckDB SQL for each."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from pathlib import Path

from pyspark.sql import functions as F

from .functions import columns as c, layout, udfs
from .operators import dates, relational as rel
from .operators.spans import Span
from .operators.tagger import Tagger
from .plans import contacts, evaluate as ev, harness, service
from .plans.deidentify import Deidentifier, detect_spans
from .policy import Policy
from .queries import _EMAIL, _LETTERS, masked, padded, query, table
from .session import scratch, spread
from .sources import corpus, files, gold
from .streaming.sessions import deidentify_stream

_K = _LETTERS.format(k="s_suppkey")


def _name():
    """K and five letters that spell the supplier's key."""
    return F.concat(F.lit("K"), F.translate(padded("s_suppkey", 5), "0123456789", "abcdefghij"))


def _suppliers(spark, sf_dir, text):
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text"))


# Layout ----------------------------------------------------------------------------------------------


@query("""
    SELECT s_suppkey, c.* FROM supplier, (VALUES ('header', 0, 30), ('table', 48, 61), ('signature', 67, 99), ('footer', 84, 99), ('field', 96, 99)) AS c(kind, start, "end")""")
def layout_segments(spark, sf_dir):
    """Header, table run, signature block and footer of notes, by Spark expressions alone."""
    text = F.concat(F.lit("Name: Kab\nMRN: 7"), F.substring(padded("s_suppkey", 4), -4, 4), F.lit("\nDOB: 1950\n\nBody text here.\nA    1\nB    2\nbody\nSigned by: X\nend\nPage 1 of 2\nx=1"))
    return _suppliers(spark, sf_dir, text).select("s_suppkey", F.explode(layout.segments(layout.lines(F.col("text")))).alias("x")).select("s_suppkey", "x.kind", "x.start", "x.end")


@query("""
    SELECT s_suppkey, c.* FROM supplier, (VALUES ('Patient Name', 0, 12), ('Kab', 22, 25), ('MRN', 31, 34), ('7 (old)', 47, 54)) AS c(text, start, "end")""")
def layout_cells(spark, sf_dir):
    line = F.lit("Patient Name          Kab      MRN  \t  |       7 (old)")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(layout.cells(line)).alias("x")).select("s_suppkey", "x.text", "x.start", "x.end").filter(F.trim("text") != "")


@query(f"""
    SELECT s_suppkey, 'NAME_PATIENT' AS category, 22 AS start, 22 + length('K' || {_K}) + 5 AS "end", 'K' || {_K} || ', Ann' AS text FROM supplier
    UNION ALL SELECT s_suppkey, 'MRN', 60 + length('K' || {_K}), 67 + length('K' || {_K}), '77' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') FROM supplier""")
def colonless_fields(spark, sf_dir):
    """Fields without colons, in pairs; the value ends before its parenthesis."""
    text = F.concat(F.lit("Patient Name          "), _name(), F.lit(", Ann (called Annie)   MRN            77"), padded("s_suppkey", 5), F.lit(" (old)\n"))
    spans = detect_spans(spread(_suppliers(spark, sf_dir, text))).select("s_suppkey", F.explode("spans").alias("s")).filter("s.source = 'field'")
    return spans.select("s_suppkey", "s.category", "s.start", "s.end", "s.text")


@query("SELECT s_suppkey, 'MRN: N/A    Phone: unknown' AS masked_text, 0 AS n_spans FROM supplier")
def null_values(spark, sf_dir):
    """Fields whose value says nothing aren't masked."""
    done = masked(_suppliers(spark, sf_dir, F.lit("MRN: N/A    Phone: unknown"))).results("masked_text", "spans")
    return done.select("s_suppkey", "masked_text", F.size("spans").alias("n_spans"))


@query("""
    WITH l AS (SELECT l_orderkey, l_linenumber, CAST(min(l_quantity) AS INT) AS q FROM lineitem GROUP BY 1, 2)
    SELECT a.l_orderkey, a.l_linenumber, EXISTS (SELECT 1 FROM l b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber * 20 <= a.l_linenumber * 20 + a.q % 23 AND a.l_linenumber * 20 + a.q % 23 < b.l_linenumber * 20 + 9) AS inside
    FROM l a""")
def point_in_segment(spark, sf_dir):
    """Positions against the segments of their note."""
    lines_ = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("int").alias("q"))
    at = F.col("l_linenumber") * 20
    segments = lines_.groupBy("l_orderkey").agg(F.collect_list(F.struct(at.alias("start"), (at + 9).alias("end"))).alias("segments"))
    return lines_.join(segments, "l_orderkey").select("l_orderkey", "l_linenumber", rel.in_any(at + F.col("q") % 23, "segments").alias("inside"))


# Detection and arbitration ---------------------------------------------------------------------------


@query(rf"""
    SELECT doc_id, CAST(len(regexp_extract_all(text, '\b{_EMAIL}\b')) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, '\b{_EMAIL}\b')""")
def detect_one_category(spark, sf_dir):
    """E-mail addresses of all documents by the whole engine, restricted to one category."""
    found = detect_spans(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), categories=["EMAIL"])
    return found.select("doc_id", F.size("spans").cast("long").alias("n")).filter("n > 0")


#: What each detector must leave alone: {n} is four digits of a key.
RULE_REJECTS = (
    ("ipv4", "Host 10.0.256.7 key {n}"), ("ipv4", "Host 010.0.0.7 key {n}"), ("ssn", "Has 000-45-6789 key {n}"), ("ssn", "Has 912-45-6789 key {n}"), ("mrn", "The MRN pending key {n}"), ("npi_luhn", "Got 1245319590 key {n}"), ("dea_check", "Got AB1234567 key {n}"),
    ("vin_check", "Got 1M8GDM9A0KP042788 key {n}"), ("date_iso", "On 2021-02-29 key {n}"), ("date_numeric", "On 13/45/2020 key {n}"), ("date_numeric", "On 2/3-2020 key {n}"), ("date_md", "Take 1/2 tablet key {n}"), ("date_md", "Pain 5/10 key {n}"), ("date_md", "Code 0/5 key {n}"),
    ("age_yo", "A 172 year old key {n}"), ("opaque_id", "Type G20 or ICD-10 key"), ("org", "the Medical Center key {n}"), ("phone", "Call 617-5555-{n} now"), ("email", "Mail a@b now {n}"), ("long_digits", "Got 9876{n} now"), ("zip_state", "In Ma 02134 key {n}"),
    ("street", "At {n} alder street is"), ("name_credential", "MD, RN key {n}"), ("birth_year", "She left in 1950, key {n}"),
)


@query("SELECT s_suppkey, c.*, 0 AS n FROM supplier, (VALUES " + ", ".join(f"({k}, '{d}')" for k, (d, _) in enumerate(RULE_REJECTS)) + ") AS c(k, detector)")
def rule_rejects(spark, sf_dir):
    """Every check of a rule where it must say no."""
    n = F.substring(padded(F.col("s_suppkey") + 1000, 4), -4, 4)
    cases = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(d).alias("detector"), F.replace(F.lit(t), F.lit("{n}"), n).alias("text")) for k, (d, t) in enumerate(RULE_REJECTS)])
    notes = spread(table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(cases).alias("x")).select("s_suppkey", "x.k", "x.detector", "x.text"))
    return detect_spans(notes).select("s_suppkey", "k", "detector", F.size(F.filter("spans", lambda s: s["detector"] == F.col("detector"))).alias("n"))


@query(f"SELECT s_suppkey, 2 AS start, 2 + length('u' || {_K} || '@x.org') AS \"end\", 'u' || {_K} || '@x.org' AS surface FROM supplier")
def code_point_offsets(spark, sf_dir):
    """Offsets count code points, also behind those beyond the basic plane; matched without Python."""
    text = F.concat(F.lit("é😀u"), F.translate(padded("s_suppkey", 5), "0123456789", "abcdefghij"), F.lit("@x.org 😀"))
    found = _suppliers(spark, sf_dir, text).select("s_suppkey", F.explode(c.matches(F.col("text"), "[a-z]+@[a-z.]+")).alias("m"))
    return found.select("s_suppkey", F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.text").alias("surface"))


@query(f"SELECT s_suppkey, 'see [URL_1][EMAIL_1] now [SSN_1]' AS masked_text, 'www.x.org/' AS rest FROM supplier")
def trimmed_overlap(spark, sf_dir):
    """A span that loses an overlap keeps its longest free stretch."""
    text = F.concat(F.lit("see www.x.org/a"), F.lower(_name()), F.lit("@b.org now 123-45-6789"))
    done = contacts.mask_contacts(_suppliers(spark, sf_dir, text))
    return done.select("s_suppkey", "masked_text", F.get(F.filter("contacts", lambda s: s["category"] == "URL"), F.lit(0))["text"].alias("rest"))


def _partial(texts: list[str]) -> list[list[Span]]:
    """A source whose spans cut words: it names all but the first letter of the second word, and half of the third."""
    out = []
    for t in texts:
        words = [m.span() for m in re.finditer(r"\S+", t)]
        (a, b), (p, q) = words[1], words[2]
        out.append([Span(a + 1, q, "NAME_OTHER", t[a + 1 : q], 0.9, "neural", "half"), Span(words[3][0], words[3][0] + 2, "NAME_OTHER", t[words[3][0] : words[3][0] + 2], 0.9, "neural", "half")])
    return out


@query(f"SELECT s_suppkey, 'saw Xavier [NAME_OTHER_1] today.' AS masked_text, 'K' || {_K} AS canonical FROM supplier")
def snapped_spans(spark, sf_dir):
    """Spans of a source lose the ends of words that they cut."""
    done = Deidentifier(sources=[_partial]).transform(spread(_suppliers(spark, sf_dir, F.concat(F.lit("saw Xavier "), _name(), F.lit(" today."))))).results("masked_text", "mapping")
    return done.select("s_suppkey", "masked_text", F.col("mapping")[0]["canonical"].alias("canonical"))


@query("SELECT s_suppkey, 'Patient Name: [NAME_PATIENT_1]' || chr(10) || '[NAME_PATIENT_1] improved; [NAME_PATIENT_1] left. Wilhelms stayed.' AS masked_text, 3 AS mentions FROM supplier")
def name_variants(spark, sf_dir):
    """Parts of a name are found again, but not within longer words."""
    text = F.concat(F.lit("Patient Name: "), _name(), F.lit(" Wilhelm\n"), _name(), F.lit(" improved; Wilhelm left. Wilhelms stayed."))
    done = masked(_suppliers(spark, sf_dir, text)).results("masked_text", "mapping")
    return done.select("s_suppkey", "masked_text", F.size(F.col("mapping")[0]["offsets"]).alias("mentions"))


@query("""
    WITH s AS (SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS k FROM supplier)
    SELECT s_suppkey, 200.0::DOUBLE * 6 / 13 AS added, 200.0::DOUBLE * 6 / 18 AS doubled, CASE WHEN k = reverse(k) THEN 100.0::DOUBLE ELSE NULL END AS turned FROM s""")
def fuzzy_ratio(spark, sf_dir):
    """How alike a key is to itself with a letter added, with another half, and turned round (where that is the same)."""
    k = padded("s_suppkey", 6)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", k.alias("k"), F.concat(k, F.lit("x")).alias("a"), F.concat(F.lit("qqqqqq"), k).alias("b"), F.reverse(k).alias("r"))
    ratio = udfs.indel_ratio
    return rows.select("s_suppkey", ratio("k", "a").alias("added"), ratio("k", "b").alias("doubled"), F.when(F.col("k") == F.col("r"), ratio("k", "r")).alias("turned"))


def _tags(windows):
    return [[("B-NAME_PATIENT" if text[a:b][:1] == "K" else "B-NO_SUCH_LABEL" if text[a:b] == "met" else "O", 0.9 if k else 0.5) for k, (a, b) in enumerate(tokens)] for text, tokens in windows]


def _fake_model():
    return lambda text: [m.span() for m in re.finditer(r"\w+|[^\w\s]", text)], _tags


@query(f"""
    SELECT s_suppkey, i AS start, i + length('K' || {_K}) AS "end", CAST(0.9 AS DOUBLE) AS score
    FROM supplier, (SELECT CAST(4 + 5 * 25 AS INT) AS i) UNION ALL SELECT s_suppkey, 0, length('K' || {_K}), CAST(0.5 AS DOUBLE) FROM supplier WHERE false""")
def tagger_windows(spark, sf_dir):
    """A tagger over overlapping windows: the best score of a place counts, unknown labels are dropped."""
    text = F.concat(F.repeat(F.lit("word "), 25), F.lit("met "), _name())
    done = Deidentifier(sources=[Tagger(_fake_model, 8, 4)]).transform(spread(_suppliers(spark, sf_dir, text))).results("spans")
    return done.select("s_suppkey", F.explode("spans").alias("s")).select("s_suppkey", "s.start", "s.end", "s.score")


# Dates -----------------------------------------------------------------------------------------------

_PADS = [bytes(b ^ p for b in dates.DEFAULT_SALT.ljust(64, b"\0")).hex() for p in (0x36, 0x5C)]


@query(f"""
    WITH h AS (SELECT o_orderkey, o_orderdate, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode('p' || o_custkey)))) AS h FROM orders),
    s AS (SELECT *, CAST(('0x' || substr(h, 1, 16))::UBIGINT % 180 + 1 AS INT) * CASE WHEN ('0x' || substr(h, 17, 2))::INT % 2 = 1 THEN -1 ELSE 1 END AS shift FROM h)
    SELECT o_orderkey, shift, 'In ' || strftime(o_orderdate + to_days(shift), '%Y-%m-%d') || ', again in [DATE_2].' AS masked_text FROM s""")
def shifted_dates(spark, sf_dir):
    """Whole dates move by a patient's own offset, the same in all notes; others become placeholders."""
    o = table(spark, sf_dir, "orders")
    text = F.concat(F.lit("In "), F.date_format(F.to_date("o_orderdate"), "MM/dd/yyyy"), F.lit(", again in March 2019."))
    notes = spread(o.select("o_orderkey", text.alias("text"), F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("patient")))
    return Deidentifier(Policy(date_mode="shifted")).transform(notes, key="patient").results("masked_text", "date_shift_days").select("o_orderkey", F.col("date_shift_days").alias("shift"), "masked_text")


#: Forms of dates and what they say: year, month, day.
_DATE_FORMS = (("%Y-%m-%d", "ymk"), ("%m/%d/%Y", "ymk"), ("%m-%d-%y", "ymk"), ("%B %d, %Y", "ymk"), ("%b %-d, %Y", "ymk"), ("%-d %B %Y", "ymk"), ("%B %Y", "ym"), ("%-m/%-d", "mk"), ("%Y", "y"))


@query("""
    WITH d AS (SELECT o_orderkey, o_orderdate AS d, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS k FROM orders)
    """ + " UNION ALL ".join(f"SELECT o_orderkey, strftime(d, '{f}') AS surface, {'y' if 'y' in parts else '0'} AS year, {'m' if 'm' in parts else '0'} AS month, {'k' if 'k' in parts else '0'} AS day FROM d" for f, parts in _DATE_FORMS))
def date_forms(spark, sf_dir):
    """Every form of a date, read without Python."""
    day = F.to_date("o_orderdate")
    forms = ("yyyy-MM-dd", "MM/dd/yyyy", "MM-dd-yy", "MMMM dd, yyyy", "MMM d, yyyy", "d MMMM yyyy", "MMMM yyyy", "M/d", "yyyy")
    rows = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")).select("o_orderkey", F.explode(F.array(*[F.date_format(day, f) for f in forms])).alias("surface"))
    return rows.select("o_orderkey", "surface", c.parse_date(F.col("surface")).alias("p")).select("o_orderkey", "surface", *[F.coalesce(f"p.{x}", F.lit(0)).alias(x) for x in ("year", "month", "day")])


#: Whole tokens, and whether each is a clinical code.
CODES = (
    ("G20", True), ("E11.9", True), ("99213", True), ("J1100", True), ("2345-7", True), ("1998", True), ("500 mg", True), ("COVID-19", True), ("A1C", True), ("T12-L1", True), ("Grade II", True), ("IVB", True), ("ICD-10-CM", True),
    ("QX-4471", False), ("123456", False), ("GG20", False), ("2345-77", False), ("Stage", False), ("ABC", False), ("MRN", False),
)


@query("SELECT s_suppkey, c.* FROM supplier, (VALUES " + ", ".join(f"('{t}', {x})" for t, x in CODES) + ") AS c(token, code)")
def clinical_codes(spark, sf_dir):
    """Each form of a clinical code, and tokens that are none."""
    tokens = F.array(*[F.lit(t) for t, _ in CODES])
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(tokens).alias("token")).withColumn("code", c.clinical_code(F.col("token")))


@query("""
    WITH v AS (SELECT p_partkey, lpad(CAST(p_partkey * 7919 % 100000000 AS VARCHAR), 8, '1') || CAST(p_partkey % 10 AS VARCHAR) || lpad(CAST(p_partkey * 104729 % 100000000 AS VARCHAR), 8, '2') AS vin FROM part),
    s AS (SELECT *, list_sum(list_transform(range(1, 18), lambda i: CAST(substr(vin, i, 1) AS INT) * ([8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2])[i])) % 11 AS rest FROM v)
    SELECT p_partkey, vin, rest < 10 AND CAST(rest AS VARCHAR) = substr(vin, 9, 1) AS good FROM s""")
def vin_checks(spark, sf_dir):
    key = F.col("p_partkey")
    vin = F.concat(F.lpad((key * 7919 % 100000000).cast("string"), 8, "1"), (key % 10).cast("string"), F.lpad((key * 104729 % 100000000).cast("string"), 8, "2"))
    return table(spark, sf_dir, "part").select("p_partkey", vin.alias("vin"), c.vin_ok(vin).alias("good"))


#: Pairs of names, and whether they can be one person.
PEOPLE = (
    ("Ann Marsh", "MARSH, ANN B", True), ("Dr. Marsh, MD", "Marsh", True), ("Marsh's", "Ann Marsh", True), ("Katherine Lorimer", "Katharine Lorimer", True), ("Montgomeryson", "Ann Montgomerysen", True), ("Wood", "Woods", False), ("Ann Marsh", "Bob Marsh", False),
    ("Ann Marsh", "Ann Lorimer", False), ("J.", "Marsh", False),
)


@query("SELECT s_suppkey, c.* FROM supplier, (VALUES " + ", ".join(f"({k}, {x})" for k, (_, _, x) in enumerate(PEOPLE)) + ") AS c(k, same)")
def same_people(spark, sf_dir):
    """When two names are one person: a part of the other, in any order, or nearly equal."""
    cases = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b, _) in enumerate(PEOPLE)])
    each = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(cases).alias("x")).select("s_suppkey", "x.*")
    return each.select("s_suppkey", "k", udfs.same_person("a", "b").alias("same"))


# Files and requests ----------------------------------------------------------------------------------


def _docx() -> bytes:
    """A document with a header, a paragraph and a table."""
    w, out = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", io.BytesIO()
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/header1.xml", f'<w:hdr xmlns:w="{w}">{p("Top")}</w:hdr>')
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{p("SSN: 219-44-8812")}<w:tbl><w:tr><w:tc>{p("a")}</w:tc><w:tc>{p("b")}</w:tc></w:tr></w:tbl></w:body></w:document>')
    return out.getvalue()


def _uploads(spark, sf_dir):
    """A file a supplier, of a kind that its key decides: text, Markdown, an unknown suffix, NUL bytes, .doc, .docx, a broken .docx."""
    k = F.col("s_suppkey") % 7
    suffix = F.element_at(F.array(*map(F.lit, ("txt", "MD", "note", "bin", "doc", "docx", "docx"))), (k + 1).cast("int"))
    plain = F.encode(F.concat(F.lit("SSN: 219-44-8812 of "), "s_name"), "utf-8")
    content = F.when(k == 3, F.unhex(F.lit("410042"))).when(k == 5, F.unhex(F.lit(_docx().hex()))).when(k == 6, F.unhex(F.lit("504b"))).when(k == 2, F.concat(F.unhex(F.lit("ff")), plain)).otherwise(plain)
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("session_id"), "s_name", F.concat(F.lit("dir/n."), suffix).alias("path"), content.alias("content"))


@query("""
    SELECT s_suppkey AS session_id, CASE s_suppkey % 7 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 6 THEN NULL WHEN 5 THEN 'Top' || chr(10) || 'SSN: 219-44-8812' || chr(10) || 'a' || chr(9) || 'b' WHEN 2 THEN chr(65533) || 'SSN: 219-44-8812 of ' || s_name ELSE 'SSN: 219-44-8812 of ' || s_name END AS text,
        s_suppkey % 7 IN (3, 4, 6) AS failed FROM supplier""")
def decode_files(spark, sf_dir):
    read = files.decoded(spread(_uploads(spark, sf_dir)), ["session_id"])
    return read.select("session_id", "text", F.col("read_error").isNotNull().alias("failed"))


@query("""
    SELECT s_suppkey AS session_id, CASE WHEN s_suppkey % 7 IN (3, 4, 6) THEN 'unreadable' ELSE 'ok' END AS status, CASE WHEN s_suppkey % 7 IN (3, 4, 6) THEN 0 ELSE 1 END AS n_ssn FROM supplier""")
def upload_files(spark, sf_dir):
    """Files in, masked responses out."""
    sent = service.upload(spread(_uploads(spark, sf_dir)).drop("s_name"), bytes(range(32)))
    return sent.responses.select("session_id", "status", F.coalesce(F.col("counts")["SSN"], F.lit(0)).alias("n_ssn"))


@query("SELECT s_suppkey, p AS page, 'page ' || p || ' of ' || s_name AS text FROM supplier, (SELECT unnest([1, 2, 3]) AS p)")
def page_files(spark, sf_dir):
    """Pages of notes, written as one file each and read again."""
    page = lambda n: F.concat(F.lit(f"page {n} of "), F.col("s_name"))
    notes = table(spark, sf_dir, "supplier").select(F.concat(F.lit("in/n"), F.col("s_suppkey").cast("string"), F.lit(".pdf")).alias("path"), F.concat_ws("\f", page(1), page(2), page(3)).alias("text"))
    folder = scratch(spark)
    files.write_pages(notes, folder)
    return files.read_pages(spark, folder).select(F.substring("note", 2, 20).cast(dict(table(spark, sf_dir, "supplier").dtypes)["s_suppkey"]).alias("s_suppkey"), F.col("page").cast("int").alias("page"), F.regexp_replace("value", "\n$", "").alias("text"))


@query(f"SELECT s_suppkey AS note_id, 'K' || {_K} || ' é' AS text, 1 AS n, 0 AS start, length('K' || {_K}) AS \"end\", 'NAME_PATIENT' AS label FROM supplier")
def jsonl_round_trip(spark, sf_dir):
    """Gold notes written as JSON lines and read with the schema of gold notes."""
    notes = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(_name(), F.lit(" é")).alias("text"), F.array(F.struct(F.lit(0).alias("start"), F.length(_name()).alias("end"), F.lit("NAME_PATIENT").alias("label"))).alias("spans"), F.col("s_suppkey").cast("string").alias("source"), F.lit("test").alias("split"))
    folder = scratch(spark)
    gold.write_json(notes.drop("s_suppkey"), folder)
    back = gold.read_gold(spark, folder)
    return back.select(F.col("source").cast(dict(notes.dtypes)["s_suppkey"]).alias("note_id"), "text", F.size("spans").alias("n"), F.col("spans")[0]["start"].alias("start"), F.col("spans")[0]["end"].alias("end"), F.col("spans")[0]["label"].alias("label"))


def _requests(spark, sf_dir):
    """A request a supplier; the audit blocks every third, whose policy keeps phone numbers out of detection but not out of the audit."""
    return spread(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("session_id"), F.concat(F.lit("Mr. "), _name(), F.lit(" has SSN 219-44-8812.")).alias("text")))


@query("SELECT s_suppkey AS session_id, 'ok' AS status, 'Mr. [NAME_PATIENT_1] has SSN [SSN_1].' AS masked_text, 1 AS n_names, 1 AS n_ssn, 0 AS n_findings FROM supplier")
def text_requests(spark, sf_dir):
    sent = service.submit(_requests(spark, sf_dir), bytes(range(32)))
    return sent.responses.select("session_id", "status", "masked_text", F.col("counts")["NAME_PATIENT"].alias("n_names"), F.col("counts")["SSN"].alias("n_ssn"), F.size("findings").alias("n_findings"))


#: Detection that ignores SSNs, so that the audit finds what is left.
_LEAKY = Policy(thresholds={**Policy().thresholds, "SSN": 2.0, "ID_GENERIC": 2.0})


@query("SELECT s_suppkey AS session_id, 'blocked' AS status, 7 AS n, 5 AS n_logged, 'SSN' AS category FROM supplier")
def findings_log(spark, sf_dir):
    """Blocked notes: responses list all findings, the log the first five."""
    text = F.concat(F.lit("a"), *[F.lit(f" 219-44-88{k}2.") for k in range(7)])
    sent = service.submit(spread(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("session_id"), text.alias("text"))), bytes(range(32)), _LEAKY)
    log = service.logged(sent.responses).alias("l")
    return sent.responses.select("session_id", "status", F.size("findings").alias("n")).join(log.select("session_id", F.size("findings").alias("n_logged"), F.col("findings")[0]["category"].alias("category")), "session_id")


def _down() -> list[str]:
    raise ConnectionError("no route")


def _answer(model: str, prompt: str) -> str:
    if "[NAME_PATIENT_2]" in prompt:
        raise TimeoutError("too long")
    return f"{model}: [NAME_PATIENT_1] has [MRN_9]."


#: The first provider can't be reached, the second serves a model that a preference names in part.
PROVIDERS = (service.Provider("first", _down, _answer), service.Provider("second", lambda: ["base-7b", "tiny-chat"], _answer, ("large", "chat")))


@query(f"""
    SELECT s_suppkey AS session_id, CASE s_suppkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'unavailable' ELSE 'blocked' END AS status, CASE WHEN s_suppkey % 3 = 0 THEN 'tiny-chat: K' || {_K} || ' has [UNKNOWN_PLACEHOLDER].' END AS answer FROM supplier""")
def round_trip_status(spark, sf_dir):
    """Masked, asked with fail-over, put back: answered, no provider, blocked by the audit."""
    k = F.col("s_suppkey") % 3
    text = F.concat(F.lit("Mr. "), _name(), F.when(k == 1, " met Mr. Zoltan.").when(k == 2, " has 219-44-8812.").otherwise(" slept."))
    notes = spread(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("session_id"), text.alias("text")))
    done = service.round_trip(notes, bytes(range(32)), PROVIDERS, _LEAKY)
    return done.select(F.col("session_id").cast(dict(notes.dtypes)["session_id"]).alias("session_id"), "status", "answer")


@query("""
    SELECT s_suppkey AS session_id, CASE s_suppkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'expired' ELSE 'unknown' END AS status, CASE WHEN s_suppkey % 3 = 0 THEN 'SSN is 219-44-8812' ELSE 'SSN is [UNKNOWN_PLACEHOLDER]' END AS rehydrated, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END AS n_unknown FROM supplier""")
def restore_status(spark, sf_dir):
    """Answers of sessions that are live, expired and deleted."""
    sessions = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("session_id"))
    k = F.col("session_id") % 3
    records = service.submit(spread(sessions.select("session_id", F.lit("SSN 219-44-8812").alias("text"))), bytes(range(32))).records
    aged = service.forget(records.withColumn("expires_at", F.when(k == 1, F.lit("2000-01-01").cast("timestamp")).otherwise(F.col("expires_at"))), sessions.filter(k == 2))
    return service.restore(sessions.select("session_id", F.lit("SSN is [SSN_1]").alias("response")), aged, bytes(range(32))).select("session_id", "status", "rehydrated", "n_unknown")


@query("SELECT s_suppkey, 'SSN: [SSN_1]' AS masked, true AS dea, CAST(88.889 AS DOUBLE) AS alike, 'SSN' AS category, 5 AS start FROM supplier")
def sql_functions(spark, sf_dir):
    """The engine's functions from SQL text."""
    udfs.register(spark)
    table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("SSN: 219-44-8812").alias("note")).createOrReplaceTempView("maskwell_notes")
    return spark.sql("SELECT n.s_suppkey, deid_mask(n.note) AS masked, valid_dea('AB1234563') AS dea, round(indel_ratio('wood', 'woods'), 3) AS alike, s.category, s.start FROM maskwell_notes n, LATERAL deid_spans(n.note) s")


@query(f"SELECT s_suppkey, 'Mr. [NAME_PATIENT_1] slept.' AS masked_text, false AS blocked FROM supplier")
def stream_notes(spark, sf_dir):
    """The same plan on a stream of files, read once to its end."""
    folder = scratch(spark)
    _suppliers(spark, sf_dir, F.concat(F.lit("Mr. "), _name(), F.lit(" slept."))).write.parquet(f"{folder}/in")
    notes = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    done = deidentify_stream(notes).select("s_suppkey", "masked_text", "blocked")
    done.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


# Evaluation ------------------------------------------------------------------------------------------


def _gold(spark, sf_dir):
    """Notes with a name that is found, a profession that no rule finds, and an address that nobody labelled."""
    name = _name()
    text = F.concat(F.lit("Mr. "), name, F.lit(", a welder, wrote to a@b.org."))
    at = F.lit(4) + F.length(name)
    spans = F.array(F.struct(F.lit(4).alias("start"), at.alias("end"), F.lit("NAME_PATIENT").alias("label")), F.struct((at + 4).alias("start"), (at + 10).alias("end"), F.lit("PROFESSION").alias("label")))
    return spread(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("note_id"), text.alias("text"), spans.alias("spans"), F.when(F.col("s_suppkey") % 2 == 0, "even").otherwise("odd").alias("source")))


@query("""
    WITH n AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS source, count(*) AS notes FROM supplier GROUP BY GROUPING SETS ((1), ()))
    SELECT source, notes, notes AS tp, notes AS fp, notes AS fn, CAST(0.5 AS DOUBLE) AS precision, CAST(0.5 AS DOUBLE) AS recall, CAST(1 AS DOUBLE) AS leak_rate, CAST(1 AS DOUBLE) AS uncovered_rate, CAST(1 AS DOUBLE) AS exact_rate, true AS timed FROM n""")
def harness_scores(spark, sf_dir):
    """The evaluation harness by source and overall."""
    got = harness.evaluate(_gold(spark, sf_dir)).scores
    return got.select("source", "notes", "tp", "fp", "fn", "precision", "recall", "leak_rate", "uncovered_rate", "exact_rate", ((F.col("p50") > 0) & (F.col("p95") >= F.col("p50"))).alias("timed"))


@query("""
    WITH n AS (SELECT count(*) AS n FROM supplier)
    SELECT 'NAME' AS category, n AS tp, 0 AS fp, 0 AS fn, CAST(1 AS DOUBLE) AS recall, NULL AS surface FROM n UNION ALL SELECT 'PROFESSION', 0, 0, n, 0, 'welder' FROM n UNION ALL SELECT 'EMAIL', 0, n, 0, 0, NULL FROM n""")
def harness_categories(spark, sf_dir):
    """Coarse categories and what is missed most often."""
    done = harness.evaluate(_gold(spark, sf_dir), coarse=True)
    return done.categories.join(done.missed.filter("rn = 1").select("category", "surface"), "category", "left")


@query(None)
def harness_generated(spark, sf_dir):
    """The harness over generated notes; their number follows the table's size."""
    n = table(spark, sf_dir, "supplier").count()
    return harness.evaluate(corpus.generate(spark, 2 * n, n, "test", 19), coarse=True).scores.drop("p50", "p95")


@query("SELECT 'synthetic' AS source, count(*) * 2 AS notes, 0 AS wrong, true AS some FROM supplier UNION ALL SELECT 'adversarial', count(*), 0, true FROM supplier")
def corpus_offsets(spark, sf_dir):
    """Generated notes: every span lies in its text, is what it says, and overlaps none before it."""
    n = table(spark, sf_dir, "supplier").count()
    notes = corpus.generate(spark, 2 * n, n, "train", 3)
    bad = F.size(F.filter("spans", lambda s: (s["start"] >= s["end"]) | (s["end"] > F.length("text")) | (F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]) != F.trim(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))))
    crossed = F.size(F.filter(F.transform("spans", lambda s, k: (k > 0) & (s["start"] < F.get("spans", k - 1)["end"])), lambda x: x))
    return notes.groupBy("source").agg(F.count(F.lit(1)).alias("notes"), F.sum(bad + crossed).cast("int").alias("wrong"), (F.sum(F.size("spans")) > 0).alias("some"))


@query("SELECT count(*) FILTER (o_orderkey % 31 > 0) AS checked, count(*) FILTER (o_orderkey % 31 > 0) AS correct, 0 AS unresolvable, count(*) AS residual FROM orders")
def interval_totals(spark, sf_dir):
    """Interval annotations of all notes against their dates; and dates that a masked text still shows."""
    day = F.to_date("o_orderdate")
    text = F.concat(F.lit("Admitted "), F.date_format(day, "yyyy-MM-dd"), F.lit(". Surgery "), F.date_format(F.date_add(day, (F.col("o_orderkey") % 31).cast("int")), "MM/dd/yyyy"), F.lit("."))
    done = masked(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))).results("masked_text", "mapping")
    # One date a note that no mapping explains, as an audit would have to find it.
    return ev.interval_summary(done.withColumn("masked_text", F.concat("masked_text", F.lit(" Typed 1/2/2020 by hand."))), "o_orderkey")


@query("""
    SELECT p_partkey % 2 AS half, count(*) FILTER (p_partkey % 4 < 3) AS pairs, sum(CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 ELSE 0 END) / count(*) FILTER (p_partkey % 4 < 3) AS mean_similarity,
        sum(CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 ELSE 0 END) / count(*) FILTER (p_partkey % 4 < 3) AS agreement FROM part GROUP BY 1""")
def answer_agreement(spark, sf_dir):
    """Answers that are equal, that say more, that differ, and that are vacuous on both sides."""
    k = F.col("p_partkey") % 4
    original = F.when(k == 0, F.lit("on Monday")).when(k == 1, F.lit("two tablets daily")).when(k == 2, F.lit("aaaa")).otherwise(F.lit("Not stated."))
    other = F.when(k == 0, F.lit("On monday")).when(k == 1, F.lit("two tablets daily with food")).when(k == 2, F.lit("zz")).otherwise(F.lit("unknown"))
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 2).alias("half"), original.alias("original"), other.alias("masked"))
    return ev.qa_agreement(rows, ["half"])
