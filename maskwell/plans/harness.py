"""The evaluation harness: masks gold notes and scores what was found."""

from __future__ import annotations

from collections.abc import Iterator
from time import perf_counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..operators import note
from ..session import scratch
from ..sources.reports import markdown
from . import evaluate as ev
from .deidentify import Deidentifier, nested

_SPANS = "array<struct<start:int,end:int,label:string>>"


class Evaluated(NamedTuple):
    """notes: a row for each gold note with its source, tp, fp, fn, exact, uncovered, ms, and the arrays hits, missed, extra."""

    notes: DataFrame

    @property
    def scores(self) -> DataFrame:
        """By source and overall (source null), with the 50th and 95th percentile of milliseconds a note."""
        table = ev.report(self.notes)
        overall = ev.positional_percentiles(self.notes.withColumn("source", F.lit(None).cast("string")), ["source"], "ms")
        times = ev.positional_percentiles(self.notes, ["source"], "ms").unionByName(overall).alias("b")
        return table.alias("a").join(times, F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.*", "b.p50", "b.p95")

    @property
    def categories(self) -> DataFrame:
        outcome = lambda array, name: F.transform(array, lambda s: F.struct(s["label"].alias("category"), F.lit(name).alias("outcome")))
        each = self.notes.select(F.explode(F.concat(outcome("hits", "tp"), outcome("missed", "fn"), outcome("extra", "fp"))).alias("x")).select("x.*")
        return ev.by_category(each)

    @property
    def missed(self) -> DataFrame:
        """The surfaces that are missed most often, by category."""
        at = lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])
        each = self.notes.select("note_id", F.explode(F.transform("missed", lambda s: F.struct(s["label"].alias("category"), at(s).alias("surface")))).alias("x")).select("note_id", "x.*")
        return ev.top_missed(each, "category", "surface", "note_id")

    def report(self, title: str = "Scores") -> str:
        """All tables as Markdown; they are small whatever the corpus is."""
        parts = [(title, self.scores.orderBy(F.asc_nulls_last("source"))), ("Categories", self.categories.orderBy("category")), ("Weakest", ev.weakest(self.categories)), ("Missed most often", self.missed.orderBy("category", "rn"))]
        return "\n".join(markdown(rows, name) for name, rows in parts)


def labelled(spans: str, coarse: bool) -> Column:
    """An array of spans with label in place of category; coarse groups related labels."""
    name = ev.coarse if coarse else lambda c: c
    return F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), name(s["label"]).alias("label")))


def evaluate(gold: DataFrame, deidentifier: Deidentifier | None = None, coarse: bool = False) -> Evaluated:
    """gold: note_id, text, spans (array of struct<start, end, label>), source. Retained spans count as found."""
    worker = deidentifier or Deidentifier()
    policy, sources, kind = worker.policy, worker.sources, to_arrow_type(StructType.fromDDL(f"x {_SPANS}")["x"].dataType)
    rows = gold.select("note_id", "source", "text", F.col("spans").alias("gold"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, took = [], []
            for text in batch.column(2).to_pylist():
                began = perf_counter()
                extra = [s for source in sources for s in source([text or ""])[0]]
                found.append([(s.start, s.end, s.category) for s in note.deidentify(text, policy, extra=extra).spans])
                took.append(1000 * (perf_counter() - began))
            yield pa.RecordBatch.from_arrays([*batch.columns, nested(found, kind), pa.array(took, pa.float64())], [*batch.schema.names, "pred", "ms"])

    done = rows.mapInArrow(run, StructType(rows.schema.fields + StructType.fromDDL(f"pred {_SPANS}, ms double").fields))
    both = done.select("note_id", "source", "text", "ms", labelled("gold", coarse).alias("gold"), labelled("pred", coarse).alias("pred"))
    scored = both.select("note_id", "source", "text", "ms", ev.matched("gold", "pred").alias("m"))
    size = lambda name: F.size(f"m.{name}")
    notes = scored.select("note_id", "source", "text", "ms", size("hits").alias("tp"), size("extra").alias("fp"), size("missed").alias("fn"), F.col("m.exact").alias("exact"), size("bare").alias("uncovered"), "m.hits", "m.missed", "m.extra")
    # Written once: times differ from pass to pass, and all tables shall come from one.
    spark, folder = gold.sparkSession, scratch(gold.sparkSession)
    notes.write.parquet(folder)
    return Evaluated(spark.read.schema(notes.schema).parquet(folder))
