"""Relational operators over spans, lines, dates and scores: DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WINDOW_DAYS = 730


def runs(rows: DataFrame, by: list[str], order: list[str], kind: str) -> DataFrame:
    """Maximal runs of equal kind (gaps and islands): by, kind, first and last of order[0], n."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = F.when(F.lag(kind).over(w).eqNullSafe(F.col(kind)), 0).otherwise(1)
    marked = rows.withColumn("_new", changed).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_run", kind).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")


def in_any(position: Column, segments: str) -> Column:
    """Whether a position is inside any struct<start, end> of an array column."""
    return F.exists(segments, lambda s: (s["start"] <= position) & (position < s["end"]))


def overlapping(left: DataFrame, right: DataFrame, on: list[str], cell: int = 64, how: str = "inner") -> DataFrame:
    """Range join of two span tables (start, end) within equal keys.

    Both sides are dealt into cells of `cell` positions, so the join is an equi-join on key and cell;
    a pair is kept only in the cell where the later of both starts, so none comes twice. Right columns
    get the prefix r_. how: inner, left_semi or left_anti.
    """
    cells = F.sequence(F.floor(F.col("start") / cell), F.floor((F.greatest("end", F.col("start") + 1) - 1) / cell))
    a = left.withColumn("_cell", F.explode(cells)) if how == "inner" else left.withColumn("_row", F.monotonically_increasing_id()).withColumn("_cell", F.explode(cells))
    b = right.select(*on, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in on], F.explode(cells).alias("_cell"))
    touch = (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    if how == "inner":
        return a.join(b, [*on, "_cell"]).filter(touch & (F.floor(F.greatest("start", "r_start") / cell) == F.col("_cell"))).drop("_cell")
    pairs = a.join(b, [*on, "_cell"], "left").withColumn("_hit", F.coalesce(touch, F.lit(False)))
    found = pairs.groupBy("_row", *left.columns).agg(F.max("_hit").alias("_hit"))
    return found.filter(F.col("_hit") if how == "left_semi" else ~F.col("_hit")).select(*left.columns)


def ranked(spans: DataFrame, by: list[str], keep: int | None = None) -> DataFrame:
    """spans with rn by priority: field before trusted source before others, score, length, then seq."""
    from .. import vocab

    trusted = F.when(F.col("category").isin(*sorted(vocab.STRUCTURED_IDS)), "rules").otherwise("neural")
    rank = F.when(F.col("source") == "field", 3).when(F.col("source") == trusted, 2).otherwise(1)
    w = Window.partitionBy(*by).orderBy(F.desc("rank"), F.desc("score"), F.desc(F.col("end") - F.col("start")), "seq")
    out = spans.withColumn("rank", rank).withColumn("rn", F.row_number().over(w))
    return out if keep is None else out.filter(F.col("rn") <= keep)


def greedy(spans: Column) -> Column:
    """Of an array of struct<start, end, ...> in order of priority those that overlap none before them.

    The untrimmed form of arbitration, as a fold over the array.
    """
    first = F.filter(spans, lambda s: F.lit(False))
    free = lambda taken, s: ~F.exists(taken, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"]))
    return F.aggregate(spans, first, lambda taken, s: F.when(free(taken, s), F.concat(taken, F.array(s))).otherwise(taken))


def numbered_dates(dates: DataFrame, by: list[str], order: str, day: str) -> DataFrame:
    """by, day, number, anchor_number, anchor: distinct days numbered by first appearance.

    The anchor is the day with most others within WINDOW_DAYS, the first to appear of equals.
    """
    firsts = dates.filter(F.col(day).isNotNull()).groupBy(*by, day).agg(F.min(order).alias("_first"))
    number = F.row_number().over(Window.partitionBy(*by).orderBy("_first", day))
    near = Window.partitionBy(*by).orderBy(F.unix_date(F.col(day).cast("date"))).rangeBetween(-WINDOW_DAYS, WINDOW_DAYS)
    counted = firsts.withColumn("number", number).withColumn("_company", F.count(F.lit(1)).over(near))
    best = F.max_by(F.struct("number", day), F.struct("_company", -F.col("number"))).over(Window.partitionBy(*by))
    return counted.withColumn("_best", best).select(*by, day, "number", F.col("_best.number").alias("anchor_number"), F.col(f"_best.{day}").alias("anchor"))


def decode_bio(tokens: DataFrame, by: list[str]) -> DataFrame:
    """Entities of tagged tokens (idx, start, end, tag, score): by, label, start, end, score (their mean).

    A B opens an entity, and so does an I that continues none of its label; O and null are outside.
    """
    w = Window.partitionBy(*by).orderBy("idx")
    label = F.when(F.col("tag").rlike("^[BI]-"), F.substring(F.col("tag"), 3, 1 << 20))
    tagged = tokens.withColumn("_label", label)
    opens = F.col("_label").isNotNull() & (F.col("tag").startswith("B-") | ~F.lag("_label").over(w).eqNullSafe(F.col("_label")))
    grouped = tagged.withColumn("_opens", opens.cast("int")).withColumn("_entity", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = grouped.filter(F.col("_label").isNotNull())
    return inside.groupBy(*by, "_entity", F.col("_label").alias("label")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.avg("score").alias("score")).drop("_entity")


def best_of_windows(spans: DataFrame, by: list[str]) -> DataFrame:
    """One row for each (start, end, category): the largest score over overlapping windows."""
    return spans.groupBy(*by, "start", "end", "category").agg(F.max("score").alias("score"))


def align_bio(tokens: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """tokens (idx, start, end) with tag: B or I of the first span that a token overlaps, else O."""
    pairs = overlapping(tokens, spans.select(*by, "start", "end", "label"), by)
    first = pairs.groupBy(*by, "idx", "start").agg(F.min_by(F.struct("r_start", "r_label"), "r_start").alias("s"))
    tag = F.concat(F.when(F.col("start") <= F.col("s.r_start"), "B-").otherwise("I-"), F.col("s.r_label"))
    return tokens.join(first.select(*by, "idx", tag.alias("tag")), [*by, "idx"], "left").withColumn("tag", F.coalesce("tag", F.lit("O")))
