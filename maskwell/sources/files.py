"""Notes from files of several formats, one row a file; and pages of one document as rows."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

TEXT_SUFFIXES = ("txt", "text", "md", "rtf")
SNIFFED_BYTES = 8192
#: How many tasks a core writes pages in.
WRITERS_PER_CORE = 4
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _paragraphs(root: ElementTree.Element) -> list[str]:
    """Texts of the paragraphs outside tables."""
    inside = {p for t in root.iter(f"{_W}tbl") for p in t.iter(f"{_W}p")}
    return [_text(p) for p in root.iter(f"{_W}p") if p not in inside]


def _text(node: ElementTree.Element) -> str:
    return "".join({f"{_W}t": n.text or "", f"{_W}tab": "\t", f"{_W}br": "\n"}.get(n.tag, "") for n in node.iter())


def docx_text(content: bytes) -> str:
    """Headers and footers first (no blank ones), then paragraphs, then table rows with tabs between cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = sorted(archive.namelist())
        read = lambda name: ElementTree.fromstring(archive.read(name))
        out = [p for kind in ("header", "footer") for n in names if n.startswith(f"word/{kind}") and n.endswith(".xml") for p in _paragraphs(read(n)) if p.strip()]
        body = read("word/document.xml")
    out += _paragraphs(body)
    for row in body.iter(f"{_W}tr"):
        out.append("\t".join("\n".join(_text(p) for p in cell.iter(f"{_W}p")).strip() for cell in row.iter(f"{_W}tc")))
    return "\n".join(out)


def pdf_text(content: bytes) -> str:
    """Pages joined by form feeds; needs pdfplumber or pypdf. Raises without a text layer."""
    try:
        import pdfplumber

        with pdfplumber.open(io.BytesIO(content)) as pdf:
            pages = [p.extract_text(layout=True) or "" for p in pdf.pages]
    except ImportError:
        from pypdf import PdfReader

        pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]
    if not any(p.strip() for p in pages):
        raise ValueError("no text layer found; run OCR first")
    return "\f".join(pages)


@F.pandas_udf(T.StructType().add("text", "string").add("error", "string"))
def _converted(suffix: pd.Series, content: pd.Series) -> pd.DataFrame:
    out = []
    for kind, raw in zip(suffix, content):
        try:
            out.append(({"docx": docx_text, "pdf": pdf_text}[kind](raw), None))
        except Exception as e:  # a file that can't be read is a row with its reason
            out.append((None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(out, columns=["text", "error"])


def decoded(files: DataFrame, own: list[str] = ()) -> DataFrame:
    """own, path, text, read_error of files (own, path, content): the suffix of path says how to read content.

    Text suffixes and unknown ones without a NUL byte are read as UTF-8 with replacements, on the JVM;
    .docx and .pdf go through Arrow; .doc and other binary files are errors, never partial text.
    """
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = files.select(*own, "path", suffix.alias("suffix"), "content")
    packed = F.col("suffix").isin("docx", "pdf")
    # NUL as the byte pair 00 at an even place of the hexadecimal form.
    head = F.hex(F.substring("content", 1, SNIFFED_BYTES))
    binary = ~F.col("suffix").isin(*TEXT_SUFFIXES) & head.rlike("^(?:..)*?00")
    plain = rows.filter(~packed).select(
        *own, "path",
        F.when((F.col("suffix") != "doc") & ~binary, F.make_valid_utf8(F.col("content").cast("string"))).alias("text"),
        F.when(F.col("suffix") == "doc", "legacy .doc: convert to .docx or .txt first").when(binary, F.concat(F.lit("binary content and unknown suffix ."), "suffix")).alias("read_error"),
    )
    other = rows.filter(packed).select(*own, "path", _converted("suffix", "content").alias("c")).select(*own, "path", F.col("c.text").alias("text"), F.col("c.error").alias("read_error"))
    return plain.unionByName(other)


def read_notes(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """path, text, read_error of each file. strict: the first unreadable file raises instead."""
    out = decoded(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))
    if strict:
        out = out.withColumn("text", F.when(F.col("read_error").isNull(), F.col("text")).otherwise(F.raise_error(F.concat("path", F.lit(": "), "read_error")).cast("string")))
    return out


def pages(notes: DataFrame, id_: str = "path", text: str = "text") -> DataFrame:
    """id_, page (from 1), text: one row for each page between form feeds."""
    return notes.select(id_, F.posexplode(F.split(text, "\f", -1)).alias("page", "text")).withColumn("page", F.col("page") + 1)


def write_pages(notes: DataFrame, folder: str, id_: str = "path", text: str = "text") -> None:
    """One text file a page under folder/pages/note=.../page=..., and one a note, pages joined by form feeds, under folder/notes.

    A file costs some calls to the file system however small it is, so the notes are dealt out over all
    cores, and each task moves its own files into place (the driver would move them one by one).
    """
    named = notes.filter(F.col(text).isNotNull()).select(F.regexp_replace(F.regexp_extract(F.col(id_).cast("string"), "([^/]+?)(?:[.][^./]+)?$", 1), "[^A-Za-z0-9_-]", "_").alias("note"), F.col(text).alias("text"))
    dealt = named.repartition(WRITERS_PER_CORE * notes.sparkSession.sparkContext.defaultParallelism, "note")
    written = lambda rows, by, at: rows.write.partitionBy(*by).mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", 2).option("lineSep", "\n").text(f"{folder}/{at}")
    written(pages(dealt, "note").select("note", F.lpad(F.col("page").cast("string"), 4, "0").alias("page"), F.col("text").alias("value")), ("note", "page"), "pages")
    written(dealt.select("note", F.col("text").alias("value")), ("note",), "notes")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """note, page (as written, of four digits or more), value of the pages that write_pages wrote.

    Names come from the paths: found as partitions they would be a list of all folders on the driver.
    """
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).schema("value string").text(f"{folder}/pages")
    of = lambda name: F.regexp_extract(F.col("_metadata.file_path"), f"/{name}=([^/]+)/", 1).alias(name)
    return files.select(of("note"), of("page"), "value")
