"""Gold corpora: reading, writing, and building them from surfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import schema, vocab


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.GOLD_NOTE).json(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def build(notes: DataFrame, marks: DataFrame, id_: str = "note_id") -> DataFrame:
    """Gold notes from texts and marks (label, surface, nth from 1): id_, text, spans.

    Raises for a label that is no category, a surface without its nth occurrence, and spans of one
    note that overlap. Occurrences don't overlap each other.
    """
    joined = marks.join(notes.select(id_, "text"), id_)
    there = F.size(F.split("text", F.concat(F.lit(r"\Q"), "surface", F.lit(r"\E")), -1)) > F.col("nth")
    known = F.col("label").isin(*vocab.CATEGORIES)
    start = F.when(~known, F.raise_error(F.concat(F.lit("unknown label "), "label")).cast("int")).when(~there, F.raise_error(F.concat(F.lit("missing occurrence of "), "surface")).cast("int")).otherwise(F.char_length(F.expr("substring_index(text, surface, nth)")))
    placed = joined.withColumn("start", start).withColumn("end", F.col("start") + F.char_length("surface"))
    after = F.lead("start").over(Window.partitionBy(id_).orderBy("start", "end"))
    checked = placed.withColumn("end", F.when(after < F.col("end"), F.raise_error(F.concat(F.lit("overlapping gold spans at "), F.col("start").cast("string"))).cast("int")).otherwise(F.col("end")))
    spans = checked.groupBy(id_).agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("spans"))
    return notes.join(spans, id_, "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int,label:string>>")))
