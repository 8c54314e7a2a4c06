"""Registered queries: the engine's operators over the driver's tables, with DuckDB SQL for each.

Where clinical shapes are needed, notes are written from relational columns by SQL that both engines
run, and the expected result is computed from the columns, not by a second copy of a pattern.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .functions import columns as c
from .operators import relational as rel
from .plans import contacts, evaluate as ev, vault
from .plans.audit import guard_flags, leak_scan
from .plans.deidentify import Deidentifier, category_table, detect_spans, rehydrate
from .policy import Policy
from .session import spread
from .sources import gold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None):
    def add(function):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def masked(notes: DataFrame):
    return Deidentifier().transform(spread(notes))


def padded(column: Column | str, width: int) -> Column:
    return F.lpad((F.col(column) if isinstance(column, str) else column).cast("string"), width, "0")


# Detection -----------------------------------------------------------------------------------------

_EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
_PHONE = r"(?:\+?[0-9]{1,2}[-.\s]?)?(?:\([0-9]{3}\)|\b[0-9]{3})[-.\s][0-9]{3}[-.\s][0-9]{4}\b"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
_URL = r"""(?:https?://|ftp://|www\.)[^\s<>"'')\]]+"""
_LONG = r"\b[0-9]{9,}\b"


def _found(rows: DataFrame, id_: str, text: str, rule: str) -> DataFrame:
    spans = rows.select(id_, c.flat_spans(F.col(text), (rule,)).alias("s")).filter(F.size("s") > 0)
    return spans.select(id_, F.size("s").cast("long").alias("n"), F.col("s")[0]["start"].cast("long").alias("first_start"), F.col("s")[0]["end"].cast("long").alias("first_end"), F.array_join(F.transform("s", lambda x: x["text"]), "|").alias("surfaces"))


def _found_sql(table_: str, id_: str, text: str, pattern: str, keep: str = "true") -> str:
    return f"""
        WITH m AS (SELECT {id_}, {text} AS t, list_filter(regexp_extract_all({text}, '{pattern}'), lambda x: {keep}) AS s FROM {table_})
        SELECT {id_}, len(s) AS n, strpos(t, s[1]) - 1 AS first_start, strpos(t, s[1]) - 1 + length(s[1]) AS first_end, array_to_string(s, '|') AS surfaces FROM m WHERE len(s) > 0"""


@query(_found_sql("documents", "doc_id", "text", _EMAIL))
def detect_email(spark, sf_dir):
    return _found(table(spark, sf_dir, "documents"), "doc_id", "text", "email")


@query(_found_sql("documents", "doc_id", "text", _PHONE))
def detect_phone(spark, sf_dir):
    return _found(table(spark, sf_dir, "documents"), "doc_id", "text", "phone")


@query(_found_sql("documents", "doc_id", "text", _IPV4, rf"regexp_full_match(x, ''({_OCTET}\.){{3}}{_OCTET}'')".replace("''", "'")))
def detect_ipv4(spark, sf_dir):
    return _found(table(spark, sf_dir, "documents"), "doc_id", "text", "ipv4")


@query(_found_sql("documents", "doc_id", "text", _LONG))
def detect_long_digits(spark, sf_dir):
    return _found(table(spark, sf_dir, "documents"), "doc_id", "text", "long_digits")


@query(_found_sql("pages", "page_id", "html", _URL))
def detect_url_pages(spark, sf_dir):
    return _found(table(spark, sf_dir, "pages"), "page_id", "html", "url")


@query(rf"""
    SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(text, '\b{_EMAIL}\b'), lambda x: lower(x)))) AS n_email, false AS left_over
    FROM documents WHERE regexp_matches(text, '\b{_EMAIL}\b')""")
def mask_contacts(spark, sf_dir):
    """The flagship: masks every document; distinct e-mail placeholders, and whether an address is left."""
    done = masked(table(spark, sf_dir, "documents").select("doc_id", "text")).results("masked_text", "mapping")
    entries = F.size(F.filter("mapping", lambda e: e["category"] == "EMAIL")).cast("long")
    return done.select("doc_id", entries.alias("n_email"), F.col("masked_text").rlike(_EMAIL).alias("left_over")).filter("n_email > 0")


@query(rf"""
    WITH m AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '{_EMAIL}'), lambda x: lower(x))) AS e, list_distinct(list_filter(regexp_extract_all(text, '{_IPV4}'), lambda x: regexp_full_match(x, '({_OCTET}\.){{3}}{_OCTET}'))) AS i, list_distinct(regexp_extract_all(text, '{_PHONE}')) AS p FROM documents)
    SELECT doc_id, len(e) AS n_email, len(i) AS n_ip, len(p) AS n_phone, false AS left_over FROM m WHERE len(e) + len(i) + len(p) > 0""")
def mask_contacts_jvm(spark, sf_dir):
    """Contacts masked by Spark expressions alone: distinct placeholders by category, and whether one is left."""
    done = contacts.mask_contacts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), rules=("email", "ipv4", "phone")).filter(F.size("contacts") > 0)
    n = lambda category: F.size(F.array_distinct(F.transform(F.filter("contacts", lambda s: s["category"] == category), lambda s: s["placeholder"]))).cast("long")
    return done.select("doc_id", n("EMAIL").alias("n_email"), n("IP").alias("n_ip"), n("PHONE").alias("n_phone"), F.col("masked_text").rlike(_EMAIL).alias("left_over"))


# Whole notes written from relational columns --------------------------------------------------------


@query("""
    SELECT o_orderkey, 'MRN: [MRN_1]' || chr(10) || 'Admitted [DATE_1]. Surgery [DATE_' || CASE WHEN o_orderkey % 31 = 0 THEN '1]' ELSE '2 = DATE_1 + ' || (o_orderkey % 31) || 'd]' END || '.' AS masked_text, false AS blocked
    FROM orders""")
def deid_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    later = F.date_add(day, (F.col("o_orderkey") % 31).cast("int"))
    text = F.concat(F.lit("MRN: "), padded("o_custkey", 8), F.lit("\nAdmitted "), F.date_format(day, "yyyy-MM-dd"), F.lit(". Surgery "), F.date_format(later, "MM/dd/yyyy"), F.lit("."))
    return masked(o.select("o_orderkey", text.alias("text"))).masked


@query("""
    SELECT o_orderkey, 'MRN' AS category, '[MRN_1]' AS placeholder, lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS canonical, 1 AS n_offsets, 5 AS first_start FROM orders
    UNION ALL SELECT o_orderkey, 'DATE', '[DATE_1]', strftime(o_orderdate, '%Y-%m-%d'), CASE WHEN o_orderkey % 31 = 0 THEN 2 ELSE 1 END, 23 FROM orders
    UNION ALL SELECT o_orderkey, 'DATE', '[DATE_2 = DATE_1 + ' || (o_orderkey % 31) || 'd]', strftime(o_orderdate + to_days(CAST(o_orderkey % 31 AS INT)), '%m/%d/%Y'), 1, 43 FROM orders WHERE o_orderkey % 31 > 0""")
def mapping_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    later = F.date_add(day, (F.col("o_orderkey") % 31).cast("int"))
    text = F.concat(F.lit("MRN: "), padded("o_custkey", 8), F.lit("\nAdmitted "), F.date_format(day, "yyyy-MM-dd"), F.lit(". Surgery "), F.date_format(later, "MM/dd/yyyy"), F.lit("."))
    m = masked(o.select("o_orderkey", text.alias("text"))).mapping
    return m.select("o_orderkey", "category", "placeholder", "canonical", F.size("offsets").alias("n_offsets"), F.col("offsets")[0]["start"].alias("first_start"))


_AGE_TEXT = "CASE WHEN p_partkey % 140 > 130 THEN 'The patient is a ' || (p_partkey % 140) || '-year-old male.' WHEN p_partkey % 140 >= 90 THEN 'The patient is a [AGE_OVER_89] male.' ELSE 'The patient is a ' || (p_partkey % 140) || '-year-old male.' END"


@query(f"SELECT p_partkey, {_AGE_TEXT} AS masked_text FROM part")
def ages_bucket_synth(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.format_string("The patient is a %d-year-old male.", F.col("p_partkey") % 140).alias("text"))
    return masked(p).masked.select("p_partkey", "masked_text")


_LETTERS = "translate(lpad(CAST({k} AS VARCHAR), 5, '0'), '0123456789', 'abcdefghij')"


@query(f"SELECT s_suppkey, 'Mr. [NAME_PATIENT_1] was admitted. [NAME_PATIENT_1] improved.' AS masked_text, 'K' || {_LETTERS.format(k='s_suppkey')} AS canonical, 2 AS mentions FROM supplier")
def propagate_repeat_synth(spark, sf_dir):
    name = F.concat(F.lit("K"), F.translate(padded("s_suppkey", 5), "0123456789", "abcdefghij"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Mr. "), name, F.lit(" was admitted. "), name, F.lit(" improved.")).alias("text"))
    r = masked(s).results("masked_text", "mapping")
    return r.select("s_suppkey", "masked_text", F.col("mapping")[0]["canonical"].alias("canonical"), F.size(F.col("mapping")[0]["offsets"]).alias("mentions"))


@query(f"""
    SELECT c_custkey, 'Patient Name: [NAME_PATIENT_1]    Attending: [NAME_PROVIDER_1]' || chr(10) || 'Mr. [NAME_PATIENT_1] met Dr. [NAME_PROVIDER_1].' AS masked_text, 2 AS people FROM customer""")
def name_cluster_customer(spark, sf_dir):
    letters = F.translate(padded("c_custkey", 7), "0123456789", "abcdefghij")
    patient, doctor = F.concat(F.lit("K"), letters), F.concat(F.lit("V"), F.reverse(letters))
    text = F.concat(F.lit("Patient Name: "), F.upper(patient), F.lit(", JOHN A    Attending: E. "), doctor, F.lit(", MD\nMr. "), patient, F.lit(" met Dr. "), doctor, F.lit("."))
    r = masked(table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"))).results("masked_text", "mapping")
    return r.select("c_custkey", "masked_text", F.size("mapping").alias("people"))


@query("""
    SELECT c_custkey, 'Phone: [PHONE_1]    Fax: [FAX_1]' || chr(10) || 'Diagnosis: stable    SSN: [SSN_1]' AS masked_text, 3 AS n_field FROM customer""")
def field_cues_synth(spark, sf_dir):
    k = padded("c_custkey", 4)
    tail = F.substring(k, -4, 4)
    ssn = F.concat(F.lit("123-45-"), padded(F.col("c_custkey") % 8999 + 1000, 4))
    text = F.concat(F.lit("Phone: 617-555-"), tail, F.lit("    Fax: 617-556-"), tail, F.lit("\nDiagnosis: stable    SSN: "), ssn)
    r = masked(table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"))).results("masked_text", "spans")
    return r.select("c_custkey", "masked_text", F.size(F.filter("spans", lambda s: s["source"] == "field")).alias("n_field"))


@query("SELECT p_partkey, 1 AS n_review, '[ID_GENERIC_1]' AS placeholder, 'score 0.40 in review band [0.2, 0.55) via opaque_id' AS reason FROM part")
def review_band(spark, sf_dir):
    text = F.concat(F.lit("Tag item ZQ"), padded("p_partkey", 6), F.lit("X noted."))
    r = masked(table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))).results("review")
    return r.select("p_partkey", F.size("review").alias("n_review"), F.col("review")[0]["placeholder"].alias("placeholder"), F.col("review")[0]["reason"].alias("reason"))


@query("""
    SELECT s_suppkey, 'PHONE' AS category, 29 AS start, 41 AS "end", 'rescan:phone' AS detector, true AS blocked FROM supplier
    UNION ALL SELECT s_suppkey, 'NAME_PATIENT', 43, 43 + length('K' || translate(lpad(CAST(s_suppkey AS VARCHAR), 5, '0'), '0123456789', 'abcdefghij')), 'residue:mapped-surface-still-present', true FROM supplier""")
def leak_residue(spark, sf_dir):
    name = F.concat(F.lit("K"), F.translate(padded("s_suppkey", 5), "0123456789", "abcdefghij"))
    text = F.concat(F.lit("Contact [NAME_PATIENT_1], at "), F.lit("617-555-"), F.substring(padded("s_suppkey", 4), -4, 4), F.lit(", "), name, F.lit(" signed."))
    entry = F.array(F.struct(F.lit("[NAME_PATIENT_1]").alias("placeholder"), F.lit("NAME_PATIENT").alias("category"), name.alias("canonical"), F.array(name).alias("surfaces"), F.array().cast("array<struct<start:int,end:int>>").alias("offsets")))
    scanned = leak_scan(table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("masked_text"), entry.alias("mapping")))
    return scanned.select("s_suppkey", F.explode("findings").alias("f"), "blocked").select("s_suppkey", "f.category", "f.start", "f.end", "f.detector", "blocked")


@query("""
    SELECT s_suppkey, s_name || ' met [UNKNOWN_PLACEHOLDER] at [UNKNOWN_PLACEHOLDER]; [sic].' AS rehydrated, 2 AS n_unknown FROM supplier""")
def rehydrate_unknown(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    mapping = s.select("s_suppkey", F.lit("[NAME_PATIENT_1]").alias("placeholder"), F.col("s_name").alias("canonical"))
    responses = s.select("s_suppkey", F.lit("[NAME_PATIENT_1] met [NAME_PATIENT_99] at [MRN_7]; [sic].").alias("response"))
    return rehydrate(responses, mapping, ["s_suppkey"]).select("s_suppkey", "rehydrated", "n_unknown")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '[[x]]' || s_name ELSE 'expired' END AS opened, true AS hidden FROM supplier")
def vault_round_trip(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("session_id"), F.concat(F.lit("[[x]]"), "s_name").alias("mapping"), "s_name")
    key = bytes(range(32))
    sealed = vault.seal(s.drop("s_name"), key, 3600, now=F.lit("2024-01-01 00:00:00").cast("timestamp"))
    # Every other record is moved past its expiry.
    aged = sealed.withColumn("expires_at", F.when(F.col("session_id") % 2 == 0, F.col("expires_at")).otherwise(F.lit("2023-01-01").cast("timestamp")))
    opened = vault.unseal(aged, key, now=F.lit("2024-01-01 00:30:00").cast("timestamp"))
    held = sealed.select("session_id", F.hex("ciphertext").alias("h")).join(s, "session_id").join(opened, "session_id", "left")
    return held.select(F.col("session_id").alias("s_suppkey"), F.coalesce("mapping_json", F.lit("expired")).alias("opened"), (~F.col("h").contains(F.hex(F.encode("mapping", "utf-8")))).alias("hidden"))


# JVM columns ---------------------------------------------------------------------------------------


@query("""
    WITH d AS (SELECT p_partkey, lpad(CAST((p_partkey * 7919 + 1234567) % 10000000 AS VARCHAR), 7, '0') AS t, lpad(CAST((p_partkey * 104729) % 1000000000 AS VARCHAR), 9, '0') AS n, '1' || lpad(CAST(p_partkey * 7 % 1000000000 AS VARCHAR), 9, '0') AS npi FROM part),
    l AS (SELECT *, list_transform(range(1, 16), lambda i: CAST(substr('80840' || npi, CAST(16 - i AS INT), 1) AS INT) * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END)) AS w FROM d)
    SELECT p_partkey,
        (CAST(t[1] AS INT) + CAST(t[3] AS INT) + CAST(t[5] AS INT) + 2 * (CAST(t[2] AS INT) + CAST(t[4] AS INT) + CAST(t[6] AS INT))) % 10 = CAST(t[7] AS INT) AS dea,
        substr(n, 1, 3) NOT IN ('000', '666') AND substr(n, 1, 1) <> '9' AND substr(n, 4, 2) <> '00' AND substr(n, 6, 4) <> '0000' AS ssn,
        list_sum(list_transform(w, lambda x: x // 10 + x % 10)) % 10 = 0 AS npi
    FROM l""")
def validators_synth(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    t, n = padded((F.col("p_partkey") * 7919 + 1234567) % 10000000, 7), padded((F.col("p_partkey") * 104729) % 1000000000, 9)
    npi = F.concat(F.lit("1"), padded(F.col("p_partkey") * 7 % 1000000000, 9))
    return p.select("p_partkey", c.dea_ok(F.concat(F.lit("AB"), t)).alias("dea"), c.ssn_ok(n).alias("ssn"), c.npi_ok(npi).alias("npi"))


@query("""
    WITH z AS (SELECT c_custkey, lpad(CAST(c_custkey * 6151 % 100000 AS VARCHAR), 5, '0') AS zip FROM customer)
    SELECT c_custkey, CASE WHEN substr(zip, 1, 3) IN ('036','059','063','102','203','556','692','790','821','823','830','831','878','879','884','890','893') THEN '[GEO_ZIP_1]' ELSE '[GEO_ZIP_1 = ' || substr(zip, 1, 3) || '**]' END AS placeholder FROM z""")
def zip_truncate_synth(spark, sf_dir):
    zip_ = padded(F.col("c_custkey") * 6151 % 100000, 5)
    return table(spark, sf_dir, "customer").select("c_custkey", c.zip_placeholder(zip_, F.lit(1)).alias("placeholder"))


@query("""
    SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CASE WHEN o_orderkey % 4 = 3 THEN 0 ELSE day(o_orderdate) END AS d FROM orders""")
def parse_dates_orders(spark, sf_dir):
    o, day = table(spark, sf_dir, "orders"), F.to_date("o_orderdate")
    kind = F.col("o_orderkey") % 4
    surface = F.when(kind == 0, F.date_format(day, "yyyy-M-d")).when(kind == 1, F.date_format(day, "MM/dd/yyyy")).when(kind == 2, F.date_format(day, "MMMM d, yyyy")).otherwise(F.date_format(day, "MMM yyyy"))
    return o.select("o_orderkey", c.parse_date(surface).alias("p")).select("o_orderkey", F.col("p.year").cast("long").alias("y"), F.col("p.month").cast("long").alias("m"), F.coalesce("p.day", F.lit(0)).cast("long").alias("d"))


@query("SELECT l_orderkey, l_linenumber, l_partkey % 2 = 1 AS opaque FROM lineitem")
def opaque_tokens(spark, sf_dir):
    """Odd parts get a token of letters and digits, even ones a clinical code."""
    token = F.when(F.col("l_partkey") % 2 == 1, F.concat(F.lit("QX-"), padded("l_partkey", 7), F.lit("B"))).otherwise(F.concat(F.lit("ICD-"), F.lit("10")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", c.opaque(token).alias("opaque"))


# Relational operators -------------------------------------------------------------------------------


@query("""
    WITH f AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, min(o_orderkey) AS first FROM orders GROUP BY 1, 2),
    n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY first, day) AS number, count(*) OVER (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN INTERVAL 730 DAYS PRECEDING AND INTERVAL 730 DAYS FOLLOWING) AS company FROM f),
    a AS (SELECT *, first_value(number) OVER b AS anchor_number, first_value(day) OVER b AS anchor FROM n WINDOW b AS (PARTITION BY o_custkey ORDER BY company DESC, number))
    SELECT o_custkey, number, anchor_number, CASE WHEN day = anchor OR abs(date_diff('day', anchor, day)) > 730 THEN '[DATE_' || number || ']'
        ELSE '[DATE_' || number || ' = DATE_' || anchor_number || CASE WHEN day > anchor THEN ' + ' ELSE ' - ' END || abs(date_diff('day', anchor, day)) || 'd]' END AS label
    FROM a""")
def date_intervals_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    d = rel.numbered_dates(o, ["o_custkey"], "o_orderkey", "day")
    return d.select("o_custkey", F.col("number").cast("long").alias("number"), F.col("anchor_number").cast("long").alias("anchor_number"), c.interval_label(F.col("number"), F.col("day"), F.col("anchor_number"), F.col("anchor")).alias("label"))


@query("""
    WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e)
    SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r GROUP BY user_id, run, event_type""")
def segment_islands(spark, sf_dir):
    return rel.runs(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type")


_SPANS_SQL = """g AS (SELECT l_orderkey AS doc, l_linenumber * 20 AS s, l_linenumber * 20 + 5 + CAST(l_quantity AS INT) % 9 AS e, l_returnflag AS label FROM lineitem),
    p AS (SELECT l_orderkey AS doc, l_linenumber * 20 - 8 AS s, l_linenumber * 20 - 8 + CAST(l_quantity AS INT) % 14 AS e, l_linestatus AS label FROM lineitem)"""


def _two_span_tables(spark, sf_dir):
    line, q = table(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("int")
    at = F.col("l_linenumber") * 20
    gold = line.select(F.col("l_orderkey").alias("doc"), at.alias("start"), (at + 5 + q % 9).alias("end"), F.col("l_returnflag").alias("label"))
    pred = line.select(F.col("l_orderkey").alias("doc"), (at - 8).alias("start"), (at - 8 + q % 14).alias("end"), F.col("l_linestatus").alias("label"))
    return gold, pred


@query(f'WITH {_SPANS_SQL} SELECT g.doc, g.s AS start, g.e AS "end", p.s AS r_start, p.e AS r_end FROM g JOIN p ON g.doc = p.doc AND g.s < p.e AND p.s < g.e')
def overlap_join(spark, sf_dir):
    gold, pred = _two_span_tables(spark, sf_dir)
    return rel.overlapping(gold, pred, ["doc"]).select("doc", "start", "end", "r_start", "r_end")


@query(f'WITH {_SPANS_SQL} SELECT doc, s AS start, e AS "end", label FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE g.doc = p.doc AND g.s < p.e AND p.s < g.e)')
def uncovered_anti_join(spark, sf_dir):
    gold, pred = _two_span_tables(spark, sf_dir)
    return rel.overlapping(gold, pred, ["doc"], how="left_anti")


@query("""
    WITH s AS (SELECT l_orderkey AS doc, l_linenumber * 10 AS start, l_linenumber * 10 + CAST(l_quantity AS INT) AS "end", CASE WHEN l_returnflag = 'R' THEN 'field' WHEN l_returnflag = 'A' THEN 'rules' ELSE 'neural' END AS source,
        CASE WHEN l_linestatus = 'O' THEN 'DATE' ELSE 'NAME_PATIENT' END AS category, round(l_discount, 2) AS score, l_linenumber AS seq FROM lineitem),
    r AS (SELECT *, CASE WHEN source = 'field' THEN 3 WHEN (category = 'DATE' AND source = 'rules') OR (category <> 'DATE' AND source = 'neural') THEN 2 ELSE 1 END AS rank FROM s),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY rank DESC, score DESC, "end" - start DESC, seq) AS rn FROM r)
    SELECT doc, seq, rank, rn FROM n WHERE rn <= 2""")
def span_priority_topk(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).alias("end"), F.when(F.col("l_returnflag") == "R", "field").when(F.col("l_returnflag") == "A", "rules").otherwise("neural").alias("source"),
        F.when(F.col("l_linestatus") == "O", "DATE").otherwise("NAME_PATIENT").alias("category"), F.round("l_discount", 2).alias("score"), F.col("l_linenumber").alias("seq"),
    )
    return rel.ranked(s, ["doc"], 2).select("doc", "seq", "rank", "rn")


@query("""
    WITH t AS (SELECT user_id AS doc, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx, CASE event_type WHEN 'click' THEN 'B-NAME' WHEN 'view' THEN 'I-NAME' WHEN 'purchase' THEN 'I-ORG' ELSE 'O' END AS tag FROM events),
    l AS (SELECT *, CASE WHEN tag <> 'O' THEN substr(tag, 3) END AS label FROM t),
    o AS (SELECT *, CASE WHEN label IS NOT NULL AND (tag LIKE 'B-%' OR lag(label) OVER (PARTITION BY doc ORDER BY idx) IS DISTINCT FROM label) THEN 1 ELSE 0 END AS opens FROM l),
    e AS (SELECT *, sum(opens) OVER (PARTITION BY doc ORDER BY idx) AS entity FROM o)
    SELECT doc, label, min(idx) * 10 AS start, max(idx) * 10 + 5 AS "end", avg(idx % 7) AS score FROM e WHERE label IS NOT NULL GROUP BY doc, entity, label""")
def bio_decode(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    tag = F.when(F.col("event_type") == "click", "B-NAME").when(F.col("event_type") == "view", "I-NAME").when(F.col("event_type") == "purchase", "I-ORG").otherwise("O")
    tokens = e.select(F.col("user_id").alias("doc"), idx.cast("long").alias("idx"), tag.alias("tag")).select("doc", "idx", "tag", (F.col("idx") * 10).alias("start"), (F.col("idx") * 10 + 5).alias("end"), (F.col("idx") % 7).alias("score"))
    return rel.decode_bio(tokens, ["doc"]).select("doc", "label", "start", "end", "score")


@query("SELECT l_orderkey AS doc, l_partkey AS start, l_partkey + 3 AS \"end\", l_returnflag AS category, max(l_discount) AS score FROM lineitem GROUP BY 1, 2, 4")
def windows_max(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + 3).alias("end"), F.col("l_returnflag").alias("category"), F.col("l_discount").alias("score"))
    return rel.best_of_windows(s, ["doc"])


# Evaluation -----------------------------------------------------------------------------------------


@query("""
    WITH s AS (SELECT l_linestatus AS source, CAST(l_linenumber % 3 AS BIGINT) AS tp, CAST(l_partkey % 2 AS BIGINT) AS fp, CAST(l_suppkey % 2 AS BIGINT) AS fn, CAST(l_linenumber % 2 AS BIGINT) AS exact, CAST(l_orderkey % 2 AS BIGINT) AS uncovered FROM lineitem),
    g AS (SELECT source, count(*) AS notes, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(exact) AS exact, count(*) FILTER (fn > 0) AS leaky, count(*) FILTER (uncovered > 0) AS exposed FROM s GROUP BY GROUPING SETS ((source), ()))
    SELECT source, notes, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, leaky / notes AS leak_rate, exposed / notes AS uncovered_rate, exact / tp AS exact_rate FROM g""")
def prf_by_source(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").selectExpr("l_linestatus AS source", "l_linenumber % 3 AS tp", "l_partkey % 2 AS fp", "l_suppkey % 2 AS fn", "l_linenumber % 2 AS exact", "l_orderkey % 2 AS uncovered")
    return ev.report(s)


@query("""
    WITH r AS (SELECT l_returnflag AS category, CASE l_linenumber % 3 WHEN 0 THEN 'tp' WHEN 1 THEN 'fp' ELSE 'fn' END AS outcome FROM lineitem),
    g AS (SELECT category, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn FROM r GROUP BY 1)
    SELECT *, tp / (tp + fn) AS recall FROM g""")
def recall_by_category(spark, sf_dir):
    outcome = F.when(F.col("l_linenumber") % 3 == 0, "tp").when(F.col("l_linenumber") % 3 == 1, "fp").otherwise("fn")
    return ev.by_category(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("category"), outcome.alias("outcome")))


@query("""
    WITH l AS (SELECT o_orderpriority, list_sort(list(o_totalprice)) AS v, count(*) AS n FROM orders GROUP BY 1)
    SELECT o_orderpriority, v[n // 2 + 1] AS p50, v[CAST(floor(n * 95 / 100) AS INT) + 1] AS p95 FROM l""")
def p50_p95_positional(spark, sf_dir):
    return ev.positional_percentiles(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")


@query("""
    WITH c AS (SELECT l_returnflag AS category, l_partkey AS surface, count(*) AS n, min(l_orderkey) AS first FROM lineitem GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, first, surface) AS rn FROM c)
    SELECT category, surface, n, rn FROM r WHERE rn <= 40""")
def missed_top40(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("category"), F.col("l_partkey").alias("surface"), "l_orderkey")
    return ev.top_missed(m, "category", "surface", "l_orderkey")


_SWEEP = """
    WITH s AS (SELECT source AS category, CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE (d.doc_id * 37 % 100) / 100.0 END AS score, quality = 1 AS is_gold FROM documents d JOIN labels l USING (doc_id)),
    g AS (SELECT unnest([0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9]) AS t),
    w AS (SELECT category, CAST(t AS DOUBLE) AS t, count(*) FILTER (is_gold AND coalesce(score >= t, false)) AS tp, count(*) FILTER (NOT is_gold AND coalesce(score >= t, false)) AS fp, count(*) FILTER (is_gold AND NOT coalesce(score >= t, false)) AS fn FROM s, g GROUP BY 1, 2),
    r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall FROM w)"""


def _scored(spark, sf_dir):
    d, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels")
    score = F.when(F.col("doc_id") % 11 != 0, (F.col("doc_id") * 37 % 100) / 100)
    return d.join(labels, "doc_id").select(F.col("source").alias("category"), score.alias("score"), (F.col("quality") == 1).alias("is_gold"))


@query(_SWEEP + " SELECT * FROM r")
def threshold_sweep(spark, sf_dir):
    return ev.sweep(_scored(spark, sf_dir))


@query(_SWEEP + " SELECT category, coalesce(max(t) FILTER (recall >= 0.5), min(t)) AS threshold, count(DISTINCT tp) = 1 AS saturated FROM r WHERE tp + fn > 0 GROUP BY 1")
def threshold_choice(spark, sf_dir):
    return ev.choose(ev.sweep(_scored(spark, sf_dir)), 0.5)


@query("""
    WITH g AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '1%'), p AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '2%')
    SELECT (SELECT count(*) FROM (SELECT k FROM g INTERSECT SELECT k FROM p)) AS tp, (SELECT count(*) FROM (SELECT k FROM p EXCEPT SELECT k FROM g)) AS fp, (SELECT count(*) FROM (SELECT k FROM g EXCEPT SELECT k FROM p)) AS fn""")
def entity_set_metrics(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    of = lambda k: o.filter(F.col("o_orderpriority").startswith(k)).select("o_custkey")
    return ev.entity_sets(of("1"), of("2"))


@query("""
    WITH g AS (SELECT l_returnflag || l_linestatus AS category, count(*) FILTER (l_linenumber % 3 = 0) AS tp, count(*) FILTER (l_linenumber % 3 = 1) AS fp, count(*) FILTER (l_linenumber % 3 = 2) AS fn FROM lineitem GROUP BY 1)
    SELECT *, tp / (tp + fn) AS recall FROM g WHERE tp + fn > 0 ORDER BY recall, category LIMIT 3""")
def weakest_three(spark, sf_dir):
    outcome = F.when(F.col("l_linenumber") % 3 == 0, "tp").when(F.col("l_linenumber") % 3 == 1, "fp").otherwise("fn")
    return ev.weakest(ev.by_category(table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("category"), outcome.alias("outcome"))))


@query("""
    WITH r AS (SELECT s_suppkey AS run, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE (s_suppkey * 13 % 97) / 97.0 END AS recall FROM supplier)
    SELECT run, CASE WHEN recall IS NOT NULL THEN row_number() OVER (PARTITION BY recall IS NOT NULL ORDER BY recall DESC, run) ELSE 0 END AS rank FROM r""")
def ablation_ranking(spark, sf_dir):
    r = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run"), F.when(F.col("s_suppkey") % 5 != 0, (F.col("s_suppkey") * 13 % 97) / 97).alias("recall"))
    return ev.ablation(r).select("run", F.coalesce("rank", F.lit(0)).alias("rank"))


@query(rf"""
    WITH m AS (SELECT lang, len(regexp_extract_all(text, '{_EMAIL}')) AS e, len(list_filter(regexp_extract_all(text, '{_IPV4}'), lambda x: regexp_full_match(x, '({_OCTET}\.){{3}}{_OCTET}'))) AS i, len(regexp_extract_all(text, '{_PHONE}')) AS p FROM documents),
    u AS (SELECT lang, 'EMAIL' AS category, sum(e) AS n FROM m GROUP BY 1 UNION ALL SELECT lang, 'IP', sum(i) FROM m GROUP BY 1 UNION ALL SELECT lang, 'PHONE', sum(p) FROM m GROUP BY 1)
    SELECT lang, category, CAST(sum(n) AS BIGINT) AS n FROM u WHERE n > 0 GROUP BY GROUPING SETS ((lang, category), (category), ())""")
def span_counts_by_lang(spark, sf_dir):
    spans = table(spark, sf_dir, "documents").select("lang", F.explode(c.flat_spans(F.col("text"), ("email", "ipv4", "phone"))).alias("s"))
    counted = spans.select("lang", F.col("s.category").alias("category"))
    return counted.groupingSets([["lang", "category"], ["category"], []], "lang", "category").agg(F.count(F.lit(1)).alias("n"))


@query(rf"""
    WITH u AS (SELECT 6 AS hipaa, 'EMAIL' AS category, sum(len(regexp_extract_all(text, '{_EMAIL}'))) AS n FROM documents UNION ALL SELECT 18, 'ID_GENERIC', sum(len(regexp_extract_all(text, '{_LONG}'))) FROM documents UNION ALL SELECT 4, 'PHONE', sum(len(regexp_extract_all(text, '{_PHONE}'))) FROM documents)
    SELECT coalesce(hipaa, 0) AS hipaa, category, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY ROLLUP (hipaa, category)""")
def hipaa_rollup(spark, sf_dir):
    spans = table(spark, sf_dir, "documents").select(F.explode(c.flat_spans(F.col("text"), ("email", "long_digits", "phone"))).alias("s")).select("s.category")
    return ev.hipaa_rollup(spans, category_table(spark)).select(F.coalesce("hipaa", F.lit(0)).alias("hipaa"), "category", "n")


@query("SELECT lang AS split, source AS label, count(*) AS n FROM documents GROUP BY 1, 2")
def label_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("split"), F.col("source").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, '[DATE_2 = DATE_1 + ' || (o_orderkey % 30 + 1) || 'd]' AS placeholder, o_orderkey % 30 + 1 AS annotated, o_orderkey % 30 + 1 AS actual FROM orders")
def interval_check(spark, sf_dir):
    day = F.to_date("o_orderdate")
    text = F.concat(F.lit("Admitted "), F.date_format(day, "yyyy-MM-dd"), F.lit(". Surgery "), F.date_format(F.date_add(day, (F.col("o_orderkey") % 30 + 1).cast("int")), "MM/dd/yyyy"), F.lit("."))
    done = masked(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")))
    found = ev.check_intervals(done.results("mapping"), "o_orderkey")
    return found.select("o_orderkey", "placeholder", F.col("annotated").cast("long").alias("annotated"), F.col("actual").cast("long").alias("actual"))


@query("""
    WITH x AS (SELECT l_orderkey AS doc, l_linenumber AS k, l_linenumber * 12 AS gs, l_linenumber * 12 + 6 AS ge, l_linenumber * 12 + CAST(l_quantity AS INT) % 12 - 3 AS ps, l_returnflag AS gl, l_linestatus AS pl FROM lineitem)
    SELECT doc, count(*) AS n, count(*) FILTER (gs < ps + 3 AND ps < ge) AS near FROM x GROUP BY 1""")
def gold_overlap_counts(spark, sf_dir):
    """Gold and predicted spans of equal label, at most one prediction near each gold span."""
    place = F.struct((F.col("l_linenumber") * 12).alias("at"), (F.col("l_quantity").cast("int") % 12).alias("q"))
    # Dealt out by document first: a partial aggregation would only sort the rows of what may be few long tasks.
    lines = spread(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), place.alias("x")), by=("doc",))
    span = lambda s, e: F.struct(s.alias("start"), e.alias("end"), F.lit("X").alias("label"))
    spans = lambda of: F.sort_array(F.transform("x", of))
    gold_, pred = spans(lambda x: span(x["at"], x["at"] + 6)), spans(lambda x: span(x["at"] + x["q"] - 3, x["at"] + x["q"]))
    both = lines.groupBy("doc").agg(F.collect_list("x").alias("x"))
    return both.select("doc", F.size("x").cast("long").alias("n"), ev.one_to_one(gold_, pred, ("tp",))["tp"].cast("long").alias("near"))


# One text for each detector, {n} being four digits of a key: name, text, category, start, end, score.
RULE_CASES = (
    ("email", "Mail u{n}@example.org now", "EMAIL", 5, 22, 0.99), ("url", "See https://x.example/{n} now", "URL", 4, 26, 0.97), ("ipv4", "Host 10.0.1.7 key {n}", "IP", 5, 13, 0.95), ("ipv6", "Host fe80::1ff:fe23 key {n}", "IP", 5, 19, 0.95),
    ("phone", "Call 617-555-{n} now", "PHONE", 5, 17, 0.93), ("fax", "By fax 617-555-{n} now", "FAX", 7, 19, 0.93), ("phone_ext", "Use ext. {n} now", "PHONE", 4, 13, 0.70), ("ssn", "Has 123-45-6789 key {n}", "SSN", 4, 15, 0.96), ("mrn", "The MRN 77{n} is", "MRN", 8, 14, 0.96),
    ("account", "On account 88{n} is", "ACCOUNT", 11, 17, 0.94), ("health_plan", "The member id M{n}Q is", "HEALTH_PLAN_ID", 14, 20, 0.94), ("licence", "Has license L9{n}X is", "LICENCE", 12, 19, 0.92), ("device", "Has serial SN{n}A is", "DEVICE", 11, 18, 0.92), ("plate", "Has plate AB{n}, is", "VEHICLE", 10, 16, 0.92),
    ("npi_cued", "An NPI 123456{n} is", "LICENCE", 7, 17, 0.98), ("npi_luhn", "Got 1245319599 key {n}", "LICENCE", 4, 14, 0.70), ("dea_cued", "A DEA AB123{n} is", "LICENCE", 6, 15, 0.97), ("dea_check", "Got AB1234563 key {n}", "LICENCE", 4, 13, 0.72), ("vin_check", "Got 1M8GDM9AXKP042788 key {n}", "VEHICLE", 4, 21, 0.98),
    ("zip_state", "In MA 02134 key {n}", "GEO_ZIP", 6, 11, 0.93), ("zip_cued", "At zip 9{n} is", "GEO_ZIP", 7, 12, 0.93), ("street", "At {n} Alder Street is", "GEO_STREET", 3, 20, 0.90), ("birth_year", "She was born in 1950, key {n}", "DATE", 16, 20, 0.88), ("date_iso", "On 2020-02-29 key {n}", "DATE", 3, 13, 0.97),
    ("date_numeric", "On 02/29/2020 key {n}", "DATE", 3, 13, 0.96), ("date_mdy", "On March 4, 2020 key {n}", "DATE", 3, 16, 0.97), ("date_dmy", "On 4 March 2020 key {n}", "DATE", 3, 15, 0.97), ("date_my", "In March 2020 key {n}", "DATE", 3, 13, 0.90), ("date_md", "On 4/18 key {n}", "DATE", 3, 7, 0.55), ("age_yo", "A 72 year old key {n}", "AGE", 2, 13, 0.90),
    ("age_yo_short", "A 95 y.o key {n}", "AGE_OVER_89", 2, 8, 0.97), ("age_cued", "Aged 41, key {n}", "AGE", 0, 7, 0.90), ("age_over89_word", "A nonagenarian key {n}", "AGE_OVER_89", 2, 14, 0.95), ("title_name", "Saw Mrs. Marsh key {n}", "NAME_PATIENT", 9, 14, 0.92), ("name_credential", "Saw Ann Marsh, RN key {n}", "NAME_PROVIDER", 0, 13, 0.92),
    ("signature_name", "Signed by: Marsh, key {n}", "NAME_PROVIDER", 11, 16, 0.93), ("org", "at Wood Memorial, key {n}", "ORG", 3, 16, 0.85), ("org_allcaps", "at WOODS SPINE INSTITUTE, key {n}", "ORG", 3, 24, 0.80), ("opaque_id", "Got QX{n}ZB now", "ID_GENERIC", 4, 12, 0.40), ("long_digits", "Got 98765{n} now", "ID_GENERIC", 4, 13, 0.55),
)


@query("SELECT s_suppkey, c.* FROM supplier, (VALUES " + ", ".join(f"('{d}', '{k}', {s}, {e}, CAST({x} AS DOUBLE))" for d, _, k, s, e, x in RULE_CASES) + ') AS c(detector, category, start, "end", score)')
def rule_catalogue(spark, sf_dir):
    """Every rule detector on a text of its own, for each supplier."""
    n = F.substring(padded(F.col("s_suppkey") + 1000, 4), -4, 4)
    cases = F.array(*[F.struct(F.lit(d).alias("want"), F.concat(*[p for k, part in enumerate(t.split("{n}")) for p in ([n] if k else []) + [F.lit(part)]]).alias("text")) for d, t, *_ in RULE_CASES])
    notes = spread(table(spark, sf_dir, "supplier")).select("s_suppkey", F.explode(cases).alias("x")).select("s_suppkey", "x.want", "x.text")
    found = detect_spans(notes).select("s_suppkey", "want", F.explode("spans").alias("s")).filter("s.detector = want")
    return found.select("s_suppkey", F.col("want").alias("detector"), "s.category", "s.start", "s.end", "s.score")


@query("""
    SELECT s_suppkey, c.* FROM supplier, (VALUES ('header', 0, 30), ('table', 48, 61), ('signature', 67, 83)) AS c(kind, start, "end")""")
def segments_synth(spark, sf_dir):
    text = F.concat(F.lit("Name: Kab\nMRN: 7"), F.substring(padded("s_suppkey", 4), -4, 4), F.lit("\nDOB: 1950\n\nBody text here.\nA    1\nB    2\nbody\nSigned by: X\nend\n"))
    return masked(table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text"))).segments.select("s_suppkey", "kind", "start", "end")


@query("""
    SELECT c_custkey, 'Seen on [DATE_1 = ' || (1990 + c_custkey % 30) || ']; born [DATE_2' || CASE WHEN 1990 + c_custkey % 30 - 1925 >= 89 THEN '' ELSE ' = 1925' END || '].' AS retained,
        'Seen on [DATE_1]; born [DATE_2].' AS harbor FROM customer""")
def date_modes(spark, sf_dir):
    text = F.concat(F.lit("Seen on "), (F.col("c_custkey") % 30 + 1990).cast("string"), F.lit("-06-15; born 02/03/1925."))
    notes = spread(table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"), text.alias("again")))
    # The second policy reads the copy that the first has carried along, so nothing is joined.
    first = Deidentifier(Policy(retain_year=True, date_mode="safe_harbor")).transform(notes).results("masked_text").withColumnRenamed("masked_text", "retained")
    return Deidentifier(Policy(date_mode="safe_harbor")).transform(first, "again").results("masked_text").withColumnRenamed("masked_text", "harbor")


@query(f"SELECT s_suppkey, 11 AS start, 17 AS \"end\", 'NAME_PATIENT' AS label FROM supplier UNION ALL SELECT s_suppkey, 0, 6, 'NAME_PROVIDER' FROM supplier")
def gold_build(spark, sf_dir):
    name = F.concat(F.lit("K"), F.translate(padded("s_suppkey", 5), "0123456789", "abcdefghij"))
    notes = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(name, F.lit(" saw "), name, F.lit(".")).alias("text"))
    marks = table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("surface"), F.explode(F.expr("array(named_struct('label', 'NAME_PROVIDER', 'nth', 1), named_struct('label', 'NAME_PATIENT', 'nth', 2))")).alias("m")).select("s_suppkey", "surface", "m.label", "m.nth")
    return gold.build(notes, marks, "s_suppkey").select("s_suppkey", F.explode("spans").alias("s")).select("s_suppkey", "s.start", "s.end", "s.label")


@query("""
    WITH l AS (SELECT l_orderkey, l_linenumber, CAST(min(l_quantity) AS INT) AS q, min(l_returnflag) AS label FROM lineitem GROUP BY 1, 2),
    t AS (SELECT l_orderkey AS doc, l_linenumber AS idx, l_linenumber * 10 AS s, l_linenumber * 10 + 8 AS e FROM l),
    p AS (SELECT l_orderkey AS doc, l_linenumber * 20 + 3 AS s, l_linenumber * 20 + 4 + q % 17 AS e, label FROM l),
    f AS (SELECT t.doc, t.idx, t.s, arg_min(p.s, p.s) AS ps, arg_min(p.label, p.s) AS label FROM t JOIN p ON t.doc = p.doc AND t.s < p.e AND p.s < t.e GROUP BY 1, 2, 3)
    SELECT t.doc, t.idx, CASE WHEN f.label IS NULL THEN 'O' WHEN t.s <= f.ps THEN 'B-' || f.label ELSE 'I-' || f.label END AS tag FROM t LEFT JOIN f USING (doc, idx)""")
def bio_align(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("int").alias("q"), F.min("l_returnflag").alias("label"))
    tokens = line.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("idx"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + 8).alias("end"))
    at = F.col("l_linenumber") * 20 + 3
    spans = line.select(F.col("l_orderkey").alias("doc"), at.alias("start"), (at + 1 + F.col("q") % 17).alias("end"), "label")
    return rel.align_bio(tokens, spans, ["doc"]).select("doc", "idx", "tag")


@query("SELECT c_custkey, 'Phone: [PHONE_1]    Fax: [FAX_1]' AS masked, 'PHONE' AS category, '617-555-' || right(lpad(CAST(c_custkey AS VARCHAR), 4, '0'), 4) AS canonical, 1 AS n_phone FROM customer")
def mapping_json(spark, sf_dir):
    """The result of a note as JSON and back, with its counts by category."""
    tail = F.substring(padded("c_custkey", 4), -4, 4)
    done = masked(table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Phone: 617-555-"), tail, F.lit("    Fax: 617-556-"), tail).alias("text")))
    text = done.results("masked_text", "mapping", "review", "blocked").select("c_custkey", done.as_json().alias("j"), F.to_json("mapping").alias("m"))
    entry_ = vault.entries_of(F.col("m"))[0]
    counts = done.counts.select("c_custkey", F.col("counts")["PHONE"].cast("int").alias("n_phone"))
    return text.select("c_custkey", F.get_json_object("j", "$.masked").alias("masked"), entry_["category"].alias("category"), entry_["canonical"].alias("canonical")).join(counts, "c_custkey")


# Guards and resolution on texts of their own: guard, text, surface, category, expected.
GUARD_CASES = (
    ("eponym_use", "has Parkinson''s disease", "Parkinson", "NAME_PATIENT", True), ("eponym_use", "Dr. Parkinson called", "Parkinson", "NAME_PATIENT", False), ("eponym_use", "history of Crohn", "Crohn", "NAME_PATIENT", True), ("clinical_label", "Pain    7/10", "Pain", "NAME_PATIENT", True),
    ("clinical_label", "Painter    7", "Painter", "NAME_PATIENT", False), ("code_fragment", "as ICD-10 G20", "10", "DATE", True), ("code_fragment", "in 02134 now", "02134", "GEO_ZIP", False), ("facility_kind", "the Medical Center here", "Medical", "ORG", True),
    ("facility_kind", "OSTROM SPINE INSTITUTE", "SPINE INSTITUTE", "ORG", False), ("credential_only", "Castell, PT, DPT", ", DPT", "NAME_PROVIDER", True), ("credential_only", "Castell, PT", "Castell, PT", "NAME_PROVIDER", False), ("implausible", "Credit 845", "845", "FAX", True),
    ("implausible", "Paid $7,310.25", "$7,310.25", "HEALTH_PLAN_ID", True), ("implausible", "Ref TKV-310442", "TKV-310442", "MRN", False),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{g}', '{t}', '{s}', {x})" for g, t, s, _, x in GUARD_CASES) + ") AS c(guard, text, surface, drops)")
def guard_catalogue(spark, sf_dir):
    """Each over-redaction guard where it must and must not speak."""
    cases = spark.createDataFrame([(g, t.replace("''", "'"), s, c_) for g, t, s, c_, _ in GUARD_CASES], "guard string, text string, surface string, category string")
    return guard_flags(cases).select("guard", "text", "surface", F.col("flags")[F.col("guard")].alias("drops"))


def entry(spark: SparkSession) -> DataFrame:
    """Masks all documents of the smallest table."""
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    done = Deidentifier(Policy()).transform(docs)
    return done.results("masked_text", "spans", "findings", "blocked").select("doc_id", "masked_text", F.size("spans").alias("n_spans"), F.size("findings").alias("n_findings"), "blocked")
