"""A generated corpus of notes with exact gold spans.

Each row draws from its own generator, seeded by split, seed and row number, so any partitioning
gives the same corpus. The word pools of the splits don't overlap.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SYLLABLES = {"train": ("bra", "don", "kel", "mor", "tas", "vin", "wex", "lor"), "test": ("zel", "pha", "gri", "hob", "jun", "quo", "rys", "sket")}
_CLINICAL = ("Pain 5/10 when seated.", "BP 121/79, HR 70, RR 14.", "Babinski sign is absent.", "Addison's disease under control.", "Takes 1/2 tablet at night.", "Codes: E11.9 and I10.")
_SCHEMA = "note_id long, text string, spans array<struct<start:int,end:int,label:string>>, source string, split string"


class _Note:
    def __init__(self, seed: str, split: str):
        self.rng, self.syllables, self.text, self.spans = random.Random(seed), _SYLLABLES[split], "", []

    def word(self) -> str:
        return "".join(self.rng.choice(self.syllables) for _ in range(self.rng.randint(2, 3))).capitalize()

    def day(self) -> str:
        d = date(2018, 1, 1) + timedelta(self.rng.randrange(2000))
        return self.rng.choice((f"{d.month:02d}/{d.day:02d}/{d.year}", d.isoformat(), f"{d:%B} {d.day}, {d.year}"))

    def put(self, *pieces) -> None:
        """Plain strings, and (label, surface) pairs."""
        for p in pieces:
            if isinstance(p, tuple):
                self.spans.append({"start": len(self.text), "end": len(self.text) + len(p[1]), "label": p[0]})
                p = p[1]
            self.text += p


class _People:
    """Who and what a note is about; surfaces repeat through it as they would in a record."""

    def __init__(self, n: _Note):
        r = n.rng
        self.family, self.given, self.doctor, self.doctor_given = n.word(), n.word(), n.word(), n.word()
        self.mrn, self.born = str(r.randrange(10**6, 10**7)), n.day()
        self.phone = f"{r.randrange(200, 900)}-555-{r.randrange(1000, 9999)}"
        self.mail = f"{self.given.lower()}.{self.family.lower()}@example.com"
        self.site = f"{n.word()} {r.choice(('Regional Medical Center', 'Community Hospital', 'Family Practice', 'Memorial Hospital'))}"
        self.street = f"{r.randrange(10, 9000)} {n.word()} {r.choice(('Street', 'Avenue', 'Road', 'Lane'))}"
        self.zip = f"{r.randrange(10000, 99999)}"

    @property
    def listed(self) -> tuple[str, str]:
        return "NAME_PATIENT", f"{self.family.upper()}, {self.given.upper()}"

    @property
    def named(self) -> tuple[str, str]:
        return "NAME_PATIENT", f"{self.given} {self.family}"

    @property
    def signed(self) -> tuple[str, str]:
        return "NAME_PROVIDER", f"{self.doctor_given} {self.doctor}"


def _sentences(n: _Note, p: _People, least: int, most: int) -> None:
    r = n.rng
    for _ in range(r.randint(least, most)):
        r.choice((
            lambda: n.put("Mr. ", ("NAME_PATIENT", p.family), " was seen on ", ("DATE", n.day()), ". "),
            lambda: n.put("Dr. ", ("NAME_PROVIDER", p.doctor), " reviewed the images. "),
            lambda: n.put("Contact ", ("EMAIL", p.mail), " or ", ("PHONE", p.phone), ". "),
            lambda: n.put("Transferred from ", ("ORG", p.site), " on ", ("DATE", n.day()), ". "),
            lambda: n.put("The patient is a ", ("AGE", f"{r.randrange(20, 89)}-year-old"), " admitted for observation. "),
            lambda: n.put("Follow up with Dr. ", ("NAME_PROVIDER", n.word()), " in two weeks. "),
            lambda: n.put(r.choice(_CLINICAL), " "),
        ))()


def _admission(n: _Note) -> None:
    p = _People(n)
    n.put("Patient Name: ", p.listed, "    MRN: ", ("MRN", p.mrn), "\nDOB: ", ("DATE", p.born), "    Phone: ", ("PHONE", p.phone), "\n\n")
    _sentences(n, p, 2, 5)
    n.put("\n\nElectronically signed by: ", p.signed, ", MD\n")


def _face_sheet(n: _Note) -> None:
    p, r = _People(n), n.rng
    n.put("FACE SHEET\n----------\nPatient Name          ", p.named, "      MRN            ", ("MRN", p.mrn), "\nDate of Birth        ", ("DATE", p.born), "      Sex            F\n")
    n.put("Address: ", ("GEO_STREET", p.street), "\nZip: ", ("GEO_ZIP", p.zip), "    Phone: ", ("PHONE", p.phone), "\n")
    n.put("Member ID: ", ("HEALTH_PLAN_ID", f"{n.word()[:3].upper()}{r.randrange(10**6, 10**7)}"), "    Account #: ", ("ACCOUNT", str(r.randrange(10**7, 10**8))), "\nSSN: ", ("SSN", f"{r.randrange(101, 665)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}"), "\n\n")
    _sentences(n, p, 1, 2)


def _discharge(n: _Note) -> None:
    p = _People(n)
    n.put("DISCHARGE SUMMARY\n", ("ORG", p.site), "\nPatient: ", p.named, "\nAdmission Date: ", ("DATE", n.day()), "    Discharge Date: ", ("DATE", n.day()), "\nAttending: ", p.signed, ", MD\n\nHOSPITAL COURSE\n")
    _sentences(n, p, 3, 6)
    n.put("\n\nDisposition: home\nDictated by: ", p.signed, ", MD\n", "Page 1 of 1\n")


def _radiology(n: _Note) -> None:
    p = _People(n)
    n.put("RADIOLOGY REPORT\nExam Date: ", ("DATE", n.day()), "\nOrdering Physician: ", p.signed, ", MD\nPatient: ", p.listed, "\n\nFINDINGS\nL4-L5 disc bulge. No fracture. Comparison ", ("DATE", n.day()), ".\nIMPRESSION\n")
    n.put("Stable. Device serial # ", ("DEVICE", f"{n.word()[:2].upper()}-{n.rng.randrange(10**5, 10**6)}"), " in place.\n")


def _lab_table(n: _Note) -> None:
    p, r = _People(n), n.rng
    n.put("LABORATORY REPORT\nName: ", p.listed, "    Collected: ", ("DATE", n.day()), "\n\nTest    Result    Range\n")
    for test in r.sample(("HGB", "WBC", "TSH", "A1C", "BUN", "PSA"), 3):
        n.put(f"{test}    {r.randrange(1, 20)}.{r.randrange(9)}    4.0-12.0\n")
    n.put("\nVerified by: ", p.signed, ", PhD\n")


def _letter(n: _Note) -> None:
    p, r = _People(n), n.rng
    n.put("Fax: ", ("FAX", f"{r.randrange(200, 900)}-555-{r.randrange(1000, 9999)}"), "\n", ("DATE", n.day()), "\n\nRe: ", p.named, ", NPI ", ("LICENCE", str(r.randrange(10**9, 10**10))), "\n\n")
    _sentences(n, p, 2, 4)
    n.put("Results: ", ("URL", f"https://portal.example/{n.word().lower()}"), "\n\nReviewed by ", p.signed, ", NP\n")


_SHAPES = (_admission, _face_sheet, _discharge, _radiology, _lab_table, _letter)


def _synthetic(n: _Note) -> None:
    n.rng.choice(_SHAPES)(n)


def _adversarial(n: _Note) -> None:
    r = n.rng
    for _ in range(r.randint(2, 4)):
        name = n.word()
        r.choice((
            lambda: n.put("Dr. ", ("NAME_PROVIDER", "Parkinson"), " ruled out Parkinson's disease. "),
            lambda: n.put("Mr. ", ("NAME_PATIENT", name), " was admitted to ", ("ORG", f"{name} Memorial Hospital"), ". "),
            lambda: n.put("The patient is a ", ("AGE_OVER_89", f"{r.randrange(90, 106)}-year-old"), ". "),
            lambda: n.put("came with dr ", ("NAME_PROVIDER", name.lower()), " and left. "),
            lambda: n.put("Ref ", ("ID_GENERIC", f"{name[:3].upper()}-{r.randrange(10**4, 10**5)}{name[-1].upper()}"), " and code E11.9. "),
            lambda: n.put("Reach ", ("PHONE", f"({r.randrange(200, 900)}) 555-{r.randrange(1000, 9999)}"), ", pain ", f"{r.randrange(1, 9)}/10. "),
            lambda: n.put("Born in ", ("DATE", str(r.randrange(1925, 1990))), ", Glasgow coma scale 15. "),
            lambda: n.put("Bell's palsy, seen by ", ("NAME_PROVIDER", f"{name} Bell"), ", MD. "),
            lambda: n.put("Sent from 10.0.", f"{r.randrange(256, 999)}.1, host ", ("IP", f"10.{r.randrange(256)}.{r.randrange(256)}.7"), ". "),
            lambda: n.put(r.choice(_CLINICAL), " "),
        ))()


def generate(spark: SparkSession, n_synthetic: int, n_adversarial: int, split: str = "train", seed: int = 0) -> DataFrame:
    """note_id, text, spans, source (synthetic, adversarial), split."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in batch.column(0).to_pylist():
                note, kind = _Note(f"{split}:{seed}:{i}", split), "synthetic" if i < n_synthetic else "adversarial"
                (_synthetic if kind == "synthetic" else _adversarial)(note)
                rows.append({"note_id": i, "text": note.text, "spans": note.spans, "source": kind, "split": split})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())])
    arrow = pa.schema([("note_id", pa.int64()), ("text", pa.string()), ("spans", pa.list_(span)), ("source", pa.string()), ("split", pa.string())])
    return spark.range(n_synthetic + n_adversarial).mapInArrow(run, _SCHEMA)
