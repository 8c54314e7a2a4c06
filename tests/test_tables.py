"""Plans and relational operators over tables."""

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from maskwell import __main__ as cli, queries as engine
from maskwell.functions import columns as c, layout, udfs
from maskwell.operators import arbitrate, dates, relational as rel, resolve, structure, tagger, validate
from maskwell.plans import contacts, evaluate as ev, harness, service, vault
from maskwell.plans.audit import leak_scan
from maskwell.plans.deidentify import Deidentifier, category_table, detect_spans
from maskwell.policy import Policy, load_policy
from maskwell.operators.spans import Span
from maskwell.sources import corpus, files, gold, reports


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_wide_result(spark):
    docs = spark.createDataFrame([(1, "SSN: 219-44-8812", "p"), (2, None, None), (3, "", "p"), (3, "", "p")], "id long, text string, masked_by string")
    done = Deidentifier().transform(docs, key="masked_by")
    assert sorted(done.masked.select("id", "masked_text", "blocked").collect()) == [(1, "SSN: [SSN_1]", False), (2, "", False), (3, "", False), (3, "", False)]
    assert rows(done.mapping.select("id", "placeholder", "canonical")) == [(1, "[SSN_1]", "219-44-8812")]
    assert rows(done.spans.select("id", "start", "end", "category")) == [(1, 5, 16, "SSN")]
    assert done.review.count() == done.findings.count() == 0
    assert {r["id"]: r["counts"] for r in done.counts.collect()}[1] == {"SSN": 1}
    assert json.loads(done.rows.filter("id = 1").select(done.as_json()).first()[0])["masked"] == "SSN: [SSN_1]"
    assert Deidentifier().transform(docs.filter("false")).rows.count() == 0
    with pytest.raises(ValueError, match="spans"):
        Deidentifier().transform(docs.withColumn("Spans", F.lit(1)))


def test_sources_of_spans(spark):
    tagger = lambda texts: [[Span(t.index("Zorba"), t.index("Zorba") + 5, "NAME_PATIENT", "Zorba", 0.9, "neural", "t")] if "Zorba" in t else [] for t in texts]
    docs = spark.createDataFrame([("Zorba slept.",), ("nobody",)], "text string")
    assert sorted(r[0] for r in Deidentifier(sources=[tagger]).transform(docs).masked.select("masked_text").collect()) == ["[NAME_PATIENT_1] slept.", "nobody"]


def test_partitions_do_not_matter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    one = Deidentifier().transform(docs.coalesce(1)).masked
    many = Deidentifier().transform(docs.repartition(7)).masked
    assert one.exceptAll(many).count() == many.exceptAll(one).count() == 0


def test_detect_spans(spark):
    docs = spark.createDataFrame([(1, "Mail a@b.org or 10.0.0.1")], "id int, text string")
    got = detect_spans(docs, categories=["EMAIL"]).select(F.explode("spans").alias("s")).select("s.text").collect()
    assert [r[0] for r in got] == ["a@b.org"]


def test_matches_equal_python(spark):
    import re

    rng = random.Random(2)
    texts = ["".join(rng.choice("a1é😀 @.-") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", c.matches(F.col("t"), "[a1]+[@.]").alias("m"))
    for r in df.collect():
        assert [(x["start"], x["end"], x["text"]) for x in r["m"]] == [(*m.span(), m[0]) for m in re.finditer("[a1]+[@.]", r["t"])]


def test_column_validators_equal_python(spark):
    rng = random.Random(4)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    values = [digits(10) for _ in range(60)] + ["AB" + digits(7) for _ in range(60)] + [digits(9) for _ in range(60)] + ["".join(rng.choice("ABCDEFGHJKLMNPRSTUVWXYZ0123456789") for _ in range(17)) for _ in range(60)]
    values += ["1M8GDM9AXKP042788", "AB1234563", "1245319599", "123-45-6789", "10.0.0.1", "10.0.0.256", "010.0.0.1", "1.2.3", "1.2.3.4.", "ICD-10", "QX-4471B", "36-year-old", "Patient12", "L4-L5", "G20", "", "x"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", c.npi_ok(F.col("v")), c.dea_ok(F.col("v")), c.vin_ok(F.col("v")), c.ssn_ok(F.col("v")), c.ipv4_ok(F.col("v")), c.clinical_code(F.col("v")), c.opaque(F.col("v"))).collect()
    for v, npi, dea, vin, ssn, ip, code, opaque in got:
        assert (npi, dea, vin, ssn, code, opaque) == (validate.npi(v), validate.dea(v), validate.vin(v), validate.ssn(v), validate.clinical_code(v), validate.opaque(v)), v
        assert ip == validate.ip(v), v


def test_column_dates_equal_python(spark):
    texts = ["03/14/2024", "13/04/2024", "13/45/2024", "2024-2-30", "March 2024", "Mar. 4th, 2020", "4 Sept 2001", "4/18", "44/18", "1987", "2-3/10", "1/2/99", "Foo 2024", "", " 2020-01-02. "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", c.parse_date(F.col("t")).alias("p")).collect()
    for t, p in got:
        want = dates.parse(t)
        assert (tuple(p) if p else None) == (tuple(want) if want else None), t


def test_blanked_keeps_lengths(spark):
    text = "[DATE_2 = DATE_1 + 3d] and [MRN_1]é[sic]"
    got = spark.createDataFrame([(text,)], "t string").select(c.blanked(F.col("t"))).first()[0]
    assert got == "\0" * 22 + " and " + "\0" * 7 + "é[sic]"


def test_sql_functions(spark):
    udfs.register(spark)
    assert spark.sql("SELECT deid_mask('SSN: 219-44-8812'), valid_dea('AB1234563'), valid_npi('1245319599'), valid_ip('::1'), round(indel_ratio('wood', 'woods'), 3)").first() == ("SSN: [SSN_1]", True, True, True, 88.889)
    assert [tuple(r) for r in spark.sql("SELECT s.category, s.start FROM (SELECT 'SSN: 219-44-8812' AS t) d, LATERAL deid_spans(d.t) s").collect()] == [("SSN", 5)]


def test_overlapping_against_pairs(spark):
    rng = random.Random(6)
    make = lambda: [(rng.randrange(3), s := rng.randrange(300), s + rng.randrange(0, 150)) for _ in range(60)]
    a, b = make(), make()
    left, right = (spark.createDataFrame(x, "doc int, start int, end int") for x in (a, b))
    touch = lambda x, y: x[0] == y[0] and x[1] < y[2] and y[1] < x[2]
    assert sorted(rows(rel.overlapping(left, right, ["doc"]).select("doc", "start", "end", "r_start", "r_end"))) == sorted((*x, y[1], y[2]) for x in a for y in b if touch(x, y))
    assert sorted(rows(rel.overlapping(left, right, ["doc"], how="left_semi"))) == sorted(x for x in a if any(touch(x, y) for y in b))
    assert sorted(rows(rel.overlapping(left, right, ["doc"], how="left_anti"))) == sorted(x for x in a if not any(touch(x, y) for y in b))


def test_greedy_array(spark):
    rng = random.Random(8)
    for _ in range(20):
        spans = [(s := rng.randrange(30), s + rng.randint(1, 8)) for _ in range(12)]
        want = []
        for s in spans:
            if not any(t[0] < s[1] and s[0] < t[1] for t in want):
                want.append(s)
        got = spark.createDataFrame([(spans,)], "s array<struct<start:int,end:int>>").select(rel.greedy(F.col("s"))).first()[0]
        assert [tuple(x) for x in got] == want


def test_align_and_decode_bio(spark):
    tokens = spark.createDataFrame([(1, k, 4 * k, 4 * k + 3) for k in range(6)], "doc int, idx int, start int, end int")
    spans = spark.createDataFrame([(1, 4, 11, "NAME"), (1, 16, 18, "ORG")], "doc int, start int, end int, label string")
    tagged = rel.align_bio(tokens, spans, ["doc"])
    assert [r[0] for r in tagged.orderBy("idx").select("tag").collect()] == ["O", "B-NAME", "I-NAME", "O", "B-ORG", "O"]
    back = rel.decode_bio(tagged.withColumn("score", F.lit(0.5)), ["doc"])
    assert sorted(rows(back.select("label", "start", "end", "score"))) == [("NAME", 4, 11, 0.5), ("ORG", 16, 19, 0.5)]
    orphan = spark.createDataFrame([(1, 0, 0, 2, "I-A", 1.0), (1, 1, 3, 5, "I-B", 1.0), (1, 2, 6, 8, None, 1.0)], "doc int, idx int, start int, end int, tag string, score double")
    assert sorted(rows(rel.decode_bio(orphan, ["doc"]).select("label", "start", "end"))) == [("A", 0, 2), ("B", 3, 5)]


def test_one_to_one_against_a_loop(spark):
    rng = random.Random(9)
    make = lambda: sorted((s := rng.randrange(40), s + rng.randint(1, 6), rng.choice("AB")) for _ in range(rng.randrange(6)))
    cases = [(make(), make()) for _ in range(60)]
    kind = "array<struct<start:int,end:int,label:string>>"
    got = spark.createDataFrame([(k, g, p) for k, (g, p) in enumerate(cases)], f"k int, g {kind}, p {kind}").select("k", ev.one_to_one("g", "p").alias("s")).select("k", "s.*").collect()
    for k, tp, fp, fn, exact, uncovered in got:
        gold_, pred = cases[k]
        unused, hits, same, bare = list(pred), 0, 0, 0
        for g in gold_:
            bare += not any(g[0] < p[1] and p[0] < g[1] for p in pred)
            hit = next((p for p in unused if g[0] < p[1] and p[0] < g[1] and p[2] == g[2]), None)
            if hit:
                unused.remove(hit)
                hits += 1
                same += hit[:2] == g[:2]
        assert (tp, fp, fn, exact, uncovered) == (hits, len(pred) - hits, len(gold_) - hits, same, bare)


def test_one_to_one_counts_wanted_and_odd_spans(spark):
    kind = "array<struct<start:int,end:int,label:string>>"
    a, b = [(0, 4, "A"), None, (2, 6, "A"), (8, 9, None)], [(3, 5, "A"), (None, 5, "A"), (8, 9, None)]
    df = spark.createDataFrame([(0, a, b), (1, a, None), (2, None, b), (3, [], b)], f"k int, g {kind}, p {kind}").orderBy("k")
    both = df.select(ev.one_to_one("g", "p").alias("all"), ev.one_to_one("g", "p", ("fn", "tp")).alias("some")).collect()
    assert [tuple(r["all"]) for r in both] == [(1, 2, 3, 0, 0), (0, 0, 4, 0, 0), (None,) * 5, (0, 3, 0, 0, 0)]
    assert [r["some"].asDict() for r in both] == [{"fn": r["all"]["fn"], "tp": r["all"]["tp"]} for r in both]


def test_matching_is_written_once(spark):
    kind = "array<struct<start:int,end:int,label:string>>"
    df = spark.createDataFrame([([], [])], f"g {kind}, p {kind}")
    plan = lambda of: df.select(of.alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(ev.one_to_one("g", "p")).count("array_contains") == 1
    assert plan(ev.matched("g", "p")).count("array_contains") == 2  # what is taken, and what is left over


def test_gold_overlap_counts_deals_lines_out_before_it_collects_them(spark, sf):
    above, below = engine.QUERIES["gold_overlap_counts"](spark, sf)._jdf.queryExecution().executedPlan().toString().split("Exchange")
    assert "Aggregate" in above and "Aggregate" not in below and "REPARTITION_BY_NUM" in below


def test_contacts_on_the_jvm(spark, sf):
    from maskwell.plans.contacts import mask_contacts

    odd = [(1, "a@b.org, A@B.ORG and c@d.net"), (2, "é😀 10.0.0.1 (617) 555-0123."), (3, None), (4, ""), (5, "see www.x.org/a@b.org now 123-45-6789")]
    got = {r["id"]: r["masked_text"] for r in mask_contacts(spark.createDataFrame(odd, "id int, text string")).collect()}
    assert got == {1: "[EMAIL_1], [EMAIL_1] and [EMAIL_2]", 2: "é😀 [IP_1] [PHONE_1].", 3: None, 4: "", 5: "see [URL_1][EMAIL_1] now [SSN_1]"}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    fast = {r["doc_id"]: r["masked_text"] for r in mask_contacts(docs, rules=("email", "ipv4", "phone")).collect()}
    for r in Deidentifier().transform(docs).rows.collect():
        if r["spans"] and {s["category"] for s in r["spans"]} <= {"EMAIL", "IP", "PHONE"}:
            assert fast[r["doc_id"]] == r["masked_text"]
    plan = mask_contacts(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_rehydrate_and_vault(spark):
    key = bytes(range(32))
    requests = spark.createDataFrame([("s1", "SSN: 219-44-8812"), ("s2", "Mail a@b.org")], "session_id string, text string")
    sent = service.submit(requests, key)
    assert {r["session_id"]: r["masked_text"] for r in sent.responses.collect()} == {"s1": "SSN: [SSN_1]", "s2": "Mail [EMAIL_1]"}
    records = spark.createDataFrame(sent.records.collect(), sent.records.schema)
    assert all(b"219-44" not in bytes(r["ciphertext"]) for r in records.collect())
    answers = spark.createDataFrame([("s1", "[SSN_1] [MRN_9]"), ("s2", "[EMAIL_1]"), ("s3", "[SSN_1]")], "session_id string, response string")
    got = {r["session_id"]: (r["rehydrated"], r["n_unknown"], r["expired"]) for r in service.restore(answers, records, key).collect()}
    assert got == {"s1": ("219-44-8812 [UNKNOWN_PLACEHOLDER]", 1, False), "s2": ("a@b.org", 0, False), "s3": ("[UNKNOWN_PLACEHOLDER]", 1, True)}
    swapped = records.withColumn("session_id", F.when(F.col("session_id") == "s1", "s2").otherwise("s1"))
    assert vault.unseal(swapped, key).count() == 0
    assert vault.unseal(records.withColumn("expires_at", F.lit("2000-01-01").cast("timestamp")), key).count() == 0
    assert len(vault.load_key("NO_SUCH_VARIABLE")) == 32


def test_responses_list_all_findings(spark):
    leaky = Policy(thresholds={**Policy().thresholds, "SSN": 2.0, "ID_GENERIC": 2.0})
    text = " ".join(f"219-44-88{k}2." for k in range(7))
    sent = service.submit(spark.createDataFrame([("s1", text)], "session_id string, text string"), bytes(range(32)), leaky)
    assert [f["start"] for f in sent.responses.first()["findings"]] == [13 * k for k in range(7)]
    assert len(service.logged(sent.responses).first()["findings"]) == 5


def test_models_fail_over():
    down = service.Provider("a", lambda: ["m-chat"], lambda m, p: 1 / 0)
    up = service.Provider("b", lambda: ["x-70b-instruct", "y"], lambda m, p: p.upper(), ("70b",))
    assert service.complete("hi", [down, up]) == ("HI", "b", "x-70b-instruct")
    with pytest.raises(service.ModelUnavailable):
        service.complete("hi", [down])


def test_leak_scan_table(spark):
    df = spark.createDataFrame([(1, "at 617-555-0311"), (2, "[MRN_1]"), (3, None)], "id int, masked_text string")
    got = {r["id"]: (len(r["findings"]), r["blocked"]) for r in leak_scan(df, mapping=None).collect()}
    assert got == {1: (1, True), 2: (0, False), 3: (0, False)}
    assert not leak_scan(df, mapping=None, policy=Policy(on_leak="warn")).filter("blocked").count()


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("MRN:  00-4471-882\né")
    (tmp_path / "b.note").write_text("Seen by Halvorsen.")
    (tmp_path / "c.bin").write_bytes(b"\x10\x00\x01")
    (tmp_path / "d.doc").write_bytes(b"x")
    (tmp_path / "f.md").write_bytes(b"bad \xff byte\x0cpage two")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = lambda inner, tag: f'<w:{tag} xmlns:w="{w}">{inner}</w:{tag}>'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        z.writestr("word/document.xml", body(f"<w:body>{p('Echo')}<w:tbl><w:tr><w:tc>{p('MRN')}</w:tc><w:tc>{p('8830192')}</w:tc></w:tr></w:tbl></w:body>", "document"))
        z.writestr("word/header1.xml", body(p("Page 1"), "hdr"))
    got = {r["path"].rpartition("/")[2]: (r["text"], r["read_error"]) for r in files.read_notes(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("MRN:  00-4471-882\né", None) and got["b.note"][0] == "Seen by Halvorsen."
    assert got["c.bin"][0] is None and "binary" in got["c.bin"][1] and "docx" in got["d.doc"][1]
    assert got["e.docx"] == ("Page 1\nEcho\nMRN\t8830192", None)
    assert got["f.md"][0] == "bad � byte\x0cpage two"
    with pytest.raises(Exception, match="c.bin|d.doc"):
        files.read_notes(spark, str(tmp_path), strict=True).collect()
    assert rows(files.pages(files.read_notes(spark, str(tmp_path / "f.md"))).select("page", "text")) == [(1, "bad � byte"), (2, "page two")]


def test_gold(spark, tmp_path):
    notes = spark.createDataFrame([(1, "Wood saw Wood."), (2, "none")], "note_id int, text string")
    marks = lambda *m: spark.createDataFrame(m, "note_id int, label string, surface string, nth int")
    built = gold.build(notes, marks((1, "NAME_PATIENT", "Wood", 2), (1, "NAME_PROVIDER", "Wood", 1)))
    assert {r["note_id"]: [tuple(s) for s in r["spans"]] for r in built.collect()} == {1: [(0, 4, "NAME_PROVIDER"), (9, 13, "NAME_PATIENT")], 2: []}
    for bad in ((1, "NOPE", "Wood", 1), (1, "ORG", "Wood", 3)):
        with pytest.raises(Exception):
            gold.build(notes, marks(bad)).collect()
    with pytest.raises(Exception):
        gold.build(notes, marks((1, "ORG", "Wood", 1), (1, "ORG", "Wood saw", 1))).collect()
    gold.write_json(built.select("text", "spans", F.lit("handauthored").alias("source"), F.lit("test").alias("split")), str(tmp_path / "g"))
    assert gold.read_gold(spark, str(tmp_path / "g")).count() == 2


def test_corpus(spark):
    notes = corpus.generate(spark, 20, 10, "train", 3)
    got = notes.collect()
    assert all(r["text"][s["start"] : s["end"]] for r in got for s in r["spans"]) and len(got) == 30
    assert sorted(got) == sorted(corpus.generate(spark, 20, 10, "train", 3).repartition(5).collect())
    words = lambda split: {w for r in corpus.generate(spark, 10, 10, split, 1).collect() for s in r["spans"] if s["label"] == "NAME_PATIENT" for w in [r["text"][s["start"] : s["end"]].lower()]}
    assert not words("train") & words("test")
    # Scores of the engine itself on the generated notes.
    pred = Deidentifier().transform(notes.withColumnRenamed("spans", "gold")).rows
    scored = pred.select("source", ev.one_to_one("gold", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["category"].alias("label")))).alias("s")).select("source", "s.*")
    overall = ev.report(scored).filter("source is null").first()
    assert overall["notes"] == 30 and overall["recall"] > 0.75 and overall["precision"] > 0.75
    assert "| source |" in reports.markdown(ev.report(scored), "Scores")


def test_policy(tmp_path, spark):
    path = tmp_path / "p.yaml"
    path.write_text("dates: {mode: safe_harbor}\ncategories: {AGE: {action: mask, threshold: 0.1}, NOPE: {}}\nselfcheck: {on_leak: warn}\nextra: 1\n")
    p = load_policy(str(path))
    assert p.date_mode == "safe_harbor" and p.masks("AGE") and p.threshold("ORG") == 0.30 and p.threshold("AGE", True) == pytest.approx(0.06) and p.on_leak == "warn"
    assert load_policy(str(tmp_path / "none.yaml")) == Policy()
    chosen = spark.createDataFrame([("ORG", 0.4)], "category string, threshold double")
    (tmp_path / "t.json").write_text(reports.thresholds_json(chosen))
    assert load_policy(str(tmp_path / "t.json")).threshold("ORG") == 0.4
    assert category_table(spark).count() == 24


def test_numbered_dates_ties(spark):
    df = spark.createDataFrame([(1, 1, "2020-01-01"), (1, 2, "2024-01-01"), (1, 3, "2024-01-05"), (1, 4, "2020-01-01"), (2, 1, None)], "doc int, at int, d string").withColumn("d", F.to_date("d"))
    got = rows(rel.numbered_dates(df, ["doc"], "at", "d").orderBy("number").select("doc", "number", "anchor_number"))
    assert got == [(1, 1, 2), (1, 2, 2), (1, 3, 2)]


def test_no_shuffle_in_deidentification(spark, sf):
    plan = Deidentifier().transform(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_runs_window(spark):
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(["a", "a", None, None, "a"])], "doc int, idx int, kind string")
    assert sorted(rows(rel.runs(df, ["doc"], ["idx"], "kind").select("first", "last", "n"))) == [(0, 1, 2), (2, 3, 2), (4, 4, 1)]


def test_written_once(spark, tmp_path):
    """Tables of a written result come from its files, without another pass."""
    docs = spark.createDataFrame([(1, "SSN: 219-44-8812"), (2, None)], "id long, text string")
    done = Deidentifier().transform(docs).written(str(tmp_path / "wide"))
    plan = done.mapping._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and rows(done.mapping.select("id", "placeholder")) == [(1, "[SSN_1]")]
    assert sorted(rows(done.masked)) == sorted(rows(Deidentifier().transform(docs).masked))
    wanted = Deidentifier().transform(docs).results("mapping")
    assert wanted.columns == ["id", "mapping"]


def test_layout_equals_python(spark):
    rng = random.Random(3)
    parts = ["Name: ", "MRN: 7", "\n", "\n\n", "    ", "\t", "|", "signed by: X", "Page 1 of 2", "-----", "Body text that goes on. And on", "A    1", ", MD", "\r\n", "é", "x=1", "FACE SHEET", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(500)] + ["", "\n", "a: b\n" * 30, "a\x0bb\u2028c\x85\x1cd\r\re\x0cf\n\r\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", layout.lines(F.col("t")).alias("l")).select("t", "l", layout.segments(F.col("l")).alias("s"), F.transform("l", lambda x: layout.cells(x["text"])).alias("c"))
    for r in df.collect():
        want = structure.lines_of(r["t"])
        assert [(x["start"], x["end"], x["text"], x["kind"]) for x in r["l"]] == [(x.start, x.end, x.text, x.kind) for x in want], repr(r["t"])
        assert [(x["start"], x["end"], x["kind"]) for x in r["s"]] == structure.segments_of(want), repr(r["t"])
        assert [[(x["start"], x["end"]) for x in row] for row in r["c"]] == [structure.cells_of(x.text) for x in want]


def test_prefix_scan(spark):
    rng = random.Random(4)
    lists = [[rng.randrange(50) for _ in range(n)] for n in (0, 1, 2, 3, 10, 99, 1000)]
    got = spark.createDataFrame([(v,) for v in lists], "v array<int>").select("v", c.prefix_sums(F.col("v")).alias("s"), c.prefix_scan(F.col("v"), 0, lambda a, b: F.greatest(a, b)).alias("m")).collect()
    for v, sums, most in got:
        assert sums == [sum(v[:k]) for k in range(len(v))] and most == [max(v[:k], default=0) for k in range(len(v))]


def test_contacts_islands_against_one_fold(spark):
    """Islands leave what a fold over all spans leaves."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["www.a.org/x@b.org", "c@d.org", "617-555-0123", "123-45-6789", "10.0.0.1", "word", "https://e.org/617-555-0123"]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    priority = lambda s: F.struct((-s["score"]).alias("a"), (s["start"] - s["end"]).alias("b"), s["start"].alias("d"))
    found = df.select("id", "text", c.flat_spans(F.col("text")).alias("s"))
    whole = F.transform(F.array_sort(F.transform("s", lambda s: F.struct(priority(s).alias("p"), s.alias("s")))), lambda x: x["s"])
    for r in found.select(contacts.arbitrate(F.col("text"), F.col("s"), priority).alias("a"), F.array_sort(contacts._fold(F.col("text"), whole)).alias("b")).collect():
        assert r["a"] == r["b"]


def test_long_contact_lists(spark):
    """Thousands of contacts in one text."""
    text = " ".join(f"u{k}@x.org" for k in range(5000))
    r = contacts.mask_contacts(spark.createDataFrame([(text,)], "text string")).first()
    assert r["masked_text"] == " ".join(f"[EMAIL_{k + 1}]" for k in range(5000))


def test_literal_search_equals_patterns():
    rng = random.Random(6)
    import re

    for _ in range(3000):
        text = "".join(rng.choice(["Ann", "ann", "Anna", "-", " ", "_", "é", "K", "."]) for _ in range(rng.randint(0, 12)))
        surface = rng.choice(["Ann", "ann k", "K", "Anna-"])
        assert arbitrate.places_of(surface, text, text.lower()) == [m.span() for m in re.finditer(rf"(?<![\w\-]){re.escape(surface)}(?![\w\-])", text, re.I)]


def test_percentiles_by_brackets(spark, monkeypatch):
    """Exact positions, also in groups that a sketch can't hold, with ties and null groups."""
    rng = random.Random(7)
    groups = {"a": [rng.random() for _ in range(30_000)], "b": [rng.randrange(3) / 1 for _ in range(5000)], None: [5.0], "d": [1.0, 2.0], "e": [float(k) for k in range(20)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("f", None)], "g string, v double")
    got = {r["g"]: (r["p50"], r["p95"]) for r in ev.positional_percentiles(df, ["g"], "v").collect()}
    assert got == {g: (sorted(vs)[len(vs) // 2], sorted(vs)[int(0.95 * len(vs))]) for g, vs in groups.items()}


def test_entity_sets_and_matched(spark):
    gold_, pred = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, t string"), spark.createDataFrame([(1, "a"), (3, "b"), (3, "b")], "k int, t string")
    assert tuple(ev.entity_sets(gold_, pred).first()) == (1, 1, 1)
    kind = "array<struct<start:int,end:int,label:string>>"
    r = spark.createDataFrame([([(0, 4, "A"), (6, 8, "B")], [(3, 7, "A"), (9, 10, "C")])], f"g {kind}, p {kind}").select(ev.matched("g", "p").alias("m")).first()["m"]
    assert [tuple(x) for x in r["hits"]] == [(0, 4, "A")] and [tuple(x) for x in r["missed"]] == [(6, 8, "B")] and r["bare"] == [] and [tuple(x) for x in r["extra"]] == [(9, 10, "C")] and r["exact"] == 0


def test_harness(spark):
    done = harness.evaluate(corpus.generate(spark, 60, 30, "test", 5), coarse=True)
    overall = done.scores.filter("source is null").first()
    assert overall["notes"] == 90 and overall["recall"] > 0.8 and overall["precision"] > 0.8 and 0 < overall["p50"] <= overall["p95"]
    text = done.report("Generated")
    assert all(f"## {t}" in text for t in ("Generated", "Categories", "Weakest", "Missed most often"))


def test_tagger():
    assert list(tagger.windows(0)) == [] and list(tagger.windows(512)) == [(0, 512)] and list(tagger.windows(1000)) == [(0, 512), (384, 896), (768, 1000)]
    tokens = [(0, 0), (0, 3), (3, 5), (6, 8), (9, 12)]
    tags = [("B-ORG", 1.0), ("B-ORG", 0.5), ("I-ORG", 1.0), ("I-AGE", 0.25), ("O", 1.0)]
    assert list(tagger.decode(tokens, tags)) == [(0, 5, "ORG", 0.75), (6, 8, "AGE", 0.25)]
    model = lambda: (lambda t: [(k, k + 1) for k in range(len(t))], lambda asked: [[("B-ORG" if t[a] == "x" else "B-NOPE" if t[a] == "n" else "B-AGE" if t[a] == "w" else "O", 0.04 if t[a] == "w" else 1 - k / 10) for k, (a, b) in enumerate(tokens)] for t, tokens in asked])
    found = tagger.Tagger(model, size=4, overlap=2)(["abxnwx", "", "x"])
    assert [[(s.start, s.end, s.category, s.score) for s in f] for f in found] == [[(2, 3, "ORG", 1.0), (5, 6, "ORG", 0.7)], [], [(0, 1, "ORG", 1.0)]]


def test_token_sets():
    assert resolve.token_set_ratio("on Monday", "monday on") == 100 and resolve.token_set_ratio("two tablets", "two tablets daily") == 100
    assert resolve.token_set_ratio("", "") == 100 and resolve.token_set_ratio("a", "") == 0 and resolve.token_set_ratio("abc", "xyz") == 0


def test_service_statuses(spark, tmp_path):
    key = bytes(range(32))
    requests = spark.createDataFrame([("a", "SSN: 219-44-8812", "p1"), ("b", None, None)], "session_id string, text string, patient_key string")
    sent = service.submit(requests, key, shared=str(tmp_path / "once"))
    assert {r["session_id"]: (r["status"], r["masked_text"]) for r in sent.responses.collect()} == {"a": ("ok", "SSN: [SSN_1]"), "b": ("ok", "")}
    assert sent.review.count() == 0 and set(service.STATUS) >= {"ok", "unknown", "expired", "blocked", "unreadable", "unavailable"}
    records = sent.records.withColumn("expires_at", F.when(F.col("session_id") == "b", F.lit("2001-01-01").cast("timestamp")).otherwise(F.col("expires_at")))
    assert tuple(service.health(records).first()) == ("ok", 1, 1)
    assert [r["session_id"] for r in service.forget(records, spark.createDataFrame([("a",)], "session_id string")).collect()] == ["b"]
    answers = spark.createDataFrame([("a", "[SSN_1]"), ("b", "x"), ("c", "y")], "session_id string, response string")
    assert {r["session_id"]: r["status"] for r in service.restore(answers, records, key).collect()} == {"a": "ok", "b": "expired", "c": "unknown"}


def test_load_key(monkeypatch):
    import base64
    import hashlib

    raw = bytes(range(32))
    for value, want in ((base64.b64encode(raw).decode(), raw), ("k" * 32, hashlib.sha256(base64.b64decode("k" * 32)).digest()), ("not base64!", hashlib.sha256(b"not base64!").digest())):
        monkeypatch.setenv("MASKWELL_VAULT_KEY", value)
        assert vault.load_key() == want
    monkeypatch.delenv("MASKWELL_VAULT_KEY")
    assert vault.load_key() != vault.load_key()


def test_command_line(tmp_path, capsys, monkeypatch):
    import io

    (tmp_path / "n.txt").write_text("SSN: 219-44-8812")
    assert cli.main(["--file", str(tmp_path / "n.txt"), "--text", "ignored"]) == 0
    assert capsys.readouterr().out.startswith("SSN: [SSN_1]\n")
    assert cli.main(["--text", "MRN: 7719032", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["summary"] == {"MRN": 1}
    monkeypatch.setattr("sys.stdin", io.StringIO("Mail a@b.org"))
    assert cli.main([]) == 0 and "[EMAIL_1]" in capsys.readouterr().out
    policy = tmp_path / "p.json"
    policy.write_text(json.dumps({"policy": {"thresholds": {"SSN": 2.0, "ID_GENERIC": 2.0}}}))
    assert cli.main(["--text", "SSN 219-44-8812.", "--policy", str(policy)]) == 1
    with pytest.raises(SystemExit):
        (tmp_path / "x.bin").write_bytes(b"\0\1")
        cli.main(["--file", str(tmp_path / "x.bin")])


def test_page_files(spark, tmp_path):
    notes = spark.createDataFrame([("in/a b.pdf", "one\ftwo"), ("in/c.txt", "x"), ("in/d.bin", None)], "path string, text string")
    files.write_pages(notes, str(tmp_path / "out"))
    found = {str(f.parent.relative_to(tmp_path / "out")): f.read_text().rstrip("\n") for f in (tmp_path / "out").rglob("part-*")}
    assert found == {"pages/note=a_b/page=0001": "one", "pages/note=a_b/page=0002": "two", "pages/note=c/page=0001": "x", "notes/note=a_b": "one\ftwo", "notes/note=c": "x"}


def test_shared_folder():
    from types import SimpleNamespace

    from maskwell import session

    fake = lambda master, **conf: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: conf.get(k.split(".")[1], d)), sparkContext=SimpleNamespace(master=master))
    assert session.shared_dir(fake("local[4]")) == session.LOCAL_SHARED_DIR and session.shared_dir(fake("spark://x:7077", checkpoint="hdfs:/c/")) == "hdfs:/c"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(fake("spark://x:7077"))


def test_pdf_text(monkeypatch):
    """Layout pages of one library, plain pages of the other, and no text layer; both stood in for."""
    import sys
    from types import SimpleNamespace

    monkeypatch.setitem(sys.modules, "pdfplumber", None)
    reader = lambda *texts: SimpleNamespace(PdfReader=lambda raw: SimpleNamespace(pages=[SimpleNamespace(extract_text=lambda t=t: t) for t in texts]))
    monkeypatch.setitem(sys.modules, "pypdf", reader("one", None, "two"))
    assert files.pdf_text(b"x") == "one\f\ftwo"
    monkeypatch.setitem(sys.modules, "pypdf", reader(" ", None))
    with pytest.raises(ValueError, match="text layer"):
        files.pdf_text(b"x")

    class Open:
        def __init__(self, raw):
            self.pages = [SimpleNamespace(extract_text=lambda layout: "a   b" if layout else "a b")]

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

    monkeypatch.setitem(sys.modules, "pdfplumber", SimpleNamespace(open=Open))
    assert files.pdf_text(b"x") == "a   b"


def test_pages_are_written_by_many_tasks(spark, tmp_path):
    notes = spark.range(12).selectExpr("concat('in/n', id, '.pdf') as path", "concat('a', id, chr(12), 'b') as text").coalesce(1)
    files.write_pages(notes, str(tmp_path / "out"))
    assert len({f.name.split("-")[1] for f in (tmp_path / "out" / "pages").rglob("part-*")}) > 1
    back = {(r.note, r.page, r.value.rstrip("\n")) for r in files.read_pages(spark, f"{tmp_path}/out").collect()}
    assert back == {(f"n{k}", f"000{p + 1}", (f"a{k}", "b")[p]) for k in range(12) for p in (0, 1)}


def test_large_tables_are_dealt_out_in_small_tasks(spark):
    from maskwell.session import TASK_BYTES, spread

    plan = lambda *args: spread(*args)._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {(8 << 27) // TASK_BYTES}, true" in plan(spark.range(1 << 27))
    assert "Repartition" not in plan(spark.range(1 << 27), 16 << 20)
    assert f"Repartition {spark.sparkContext.defaultParallelism}, true" in plan(spark.range(10))


def test_date_forms_and_near_forms(spark):
    from maskwell.functions.columns import parse_date
    from maskwell.operators.dates import parse

    surfaces = ["2020-02-29", "2021-02-29", "1900-02-29", "2000-2-29", "13/4/2020", "4/13/20", "13/13/2020", "1.2.199", "02-30-99", "March 4, 2020", "Sept. 4th 2020", "Marc 4 2020", "4 March, 2020", "31 April 2020", "March 2020", "Foo 2020", "4/18", "13/18", "0/5", "2020", "1899", "12/31/1899", " 2020-01-02., ", "", "x", "2020-01-02 x", "2020-00-10"]
    rows = spark.createDataFrame([(x,) for x in surfaces], "s string").select("s", parse_date(F.col("s")).alias("p")).collect()
    assert {r.s: tuple(r.p) if r.p else None for r in rows} == {x: tuple(parse(x)) if parse(x) else None for x in surfaces}
    plan = spark.range(1).select(parse_date(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_") + plan.count("RLIKE") <= 2  # one reading of the surface, not one for each form


def test_flat_rules_look_for_a_cue_first(spark):
    from maskwell.functions import columns as c

    text = "a@b.org ftp://x.y 10.0.0.1 (617) 555-0123 219448812 1234567890"
    rows = spark.createDataFrame([(text,), ("plain",), (None,)], "t string")
    got = [[x["detector"] for x in r.s] for r in rows.select(c.flat_spans(F.col("t")).alias("s")).collect()]
    assert set(got[0]) == set(c.FLAT) and got[1:] == [[], []]
    assert set(c.FLAT_CUES) == set(c.FLAT)
