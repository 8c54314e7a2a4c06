"""Mixing sources to target weights by entropy balancing, Spark expressions only.

Sizes are words (runs of characters other than ASCII white space). Sources in code point order, null
last, weigh 5, 2, 1, repeating. They share BUDGET times all sizes; a target stops at CAP times its
source's size and the excess is shared anew by weight until no target is above its cap.

Document rates minimise the entropy sum(r ln r - r + 1) over all documents, held to 0..CAP, under one
token constraint for each source, sum(size * r) = target. The solution tilts each document's rate
exponentially by its size, r = min(CAP, exp(multiplier * size / mean size of the source)), and the
multipliers solve the convex dual. As a document has one source, the dual's Hessian is diagonal.

Newton steps run over documents counted by source and size (equal sizes tilt alike, so nothing is
lost): each step aggregates gradient and Hessian over all of them with map-side combine, for all
sources at once. A step is taken on the logarithm of the constraint, is halved into the bracket
that the signs so far leave if it would go beyond it or if the last one gained less than half, and
STEPS of them make one job, after which the state (a row for each source) is written.

Rates are rounded to whole copies (0, 1 or 2) in cells of about CELL_ROWS documents, dealt by a hash
of the id, so that a source of any size spreads over tasks; rows that agree in id, size and source
enter as one item of up to CELL_ROWS rows. Within a cell documents go from large to small and each
takes the number of copies that keeps the sum of what is owed nearest to zero; what is left at the
end of a cell is at most about half of its smallest documents. Multipliers are rounded to 9 places
and rates to multiples of 1 / UNIT, and the rounding adds whole numbers, so reruns agree.

Defined results for odd input: null text has size 0 and takes nothing; null sources are one source;
rows that repeat are documents of their own, and those that agree in id, size and source share
what they take in any order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from . import common

WEIGHTS, BUDGET, CAP = (5, 2, 1), 1.5, 2
TOLERANCE, STEPS, MAX_JOBS = 1e-12, 6, 40
CELL_ROWS, UNIT = 256, 1 << 20
#: So many sources go to their documents by broadcast (about 100 bytes each), more by shuffle.
FEW_SOURCES = 10_000


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(counts: DataFrame) -> DataFrame:
    """source_key, source_size, n, least (smallest size above 0), target for each source of counts (source, source_key, size, n)."""
    sums = counts.groupBy("source_key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    sources = common.materialise(common.ranked(sums, [F.asc_nulls_last("source")]).withColumn("weight", weight), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    capped = F.col("source_size") * CAP
    level = 0.0
    while True:  # the level only rises, and each round caps at least one more source
        held, free = sources.agg(F.sum(F.when(capped <= F.col("weight") * level, capped)), F.sum(F.when(capped > F.col("weight") * level, F.col("weight")))).first()
        new = (total * BUDGET - (held or 0)) / free if free else level
        if new <= level:
            break
        level = new
    return sources.select("source_key", "source_size", "n", "least", F.least(capped.cast("double"), F.col("weight") * F.lit(float(level))).alias("target"))


def _tilt(multiplier: str = "multiplier") -> Column:
    return F.exp(F.col(multiplier) * F.col("size") / F.col("mean"))


def meet(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """rows with the columns of their source."""
    return rows.join(F.broadcast(sources) if few else sources.hint("merge"), "source_key")


def newton_step(counts: DataFrame, state: DataFrame, few: bool) -> DataFrame:
    """state (source_key, target, mean, low, high, multiplier, residual) after one step over all documents."""
    tilt, mass = _tilt(), F.col("n") * F.col("size")
    sums = meet(counts, state, few).groupBy(*state.columns).agg(
        F.sum(mass * F.least(tilt, F.lit(float(CAP)))).alias("reached"),
        F.sum(F.when(tilt < CAP, mass * tilt * F.col("size") / F.col("mean")).otherwise(0.0)).alias("hessian"),
    )
    residual = F.abs(F.col("reached") / F.col("target") - 1)
    low = F.when(F.col("reached") < F.col("target"), F.col("multiplier")).otherwise(F.col("low"))
    high = F.when(F.col("reached") > F.col("target"), F.col("multiplier")).otherwise(F.col("high"))
    newton = F.when(F.col("hessian") > 0, F.col("multiplier") - F.log(F.col("reached") / F.col("target")) * F.col("reached") / F.col("hessian"))
    kept = sums.select("source_key", "target", "mean", low.alias("low"), high.alias("high"), "multiplier", residual.alias("now"), "residual", newton.alias("newton"))
    inside = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high")) & ((F.col("now") <= F.col("residual") / 2) | (F.col("now") <= 1e-6))
    moved = F.when(F.col("now") <= TOLERANCE, F.col("multiplier")).when(inside, F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)
    return kept.select("source_key", "target", "mean", "low", "high", moved.alias("multiplier"), F.col("now").alias("residual"))


def multipliers(counts: DataFrame, sources: DataFrame) -> DataFrame:
    """sources with mean and multiplier. A source at its cap, or without words, has none."""
    # All rates are at most CAP ** (size / least), and at least (target / source_size) where sizes are at the least.
    base = sources.filter((F.col("source_size") > 0) & (F.col("target") > 0) & (F.col("target") < CAP * F.col("source_size"))).withColumn("mean", F.col("source_size") / F.col("n"))
    unit = F.col("mean") / F.col("least")
    low, high = F.least(F.lit(-1e-3), 1.001 * F.log(F.col("target") / F.col("source_size")) * unit), F.lit(1.001 * math.log(CAP)) * unit
    few = sources.count() <= FEW_SOURCES
    state = base.select("source_key", "target", "mean", low.alias("low"), high.alias("high"), F.lit(0.0).alias("multiplier"), F.lit(1e300).alias("residual"))
    for _ in range(MAX_JOBS):
        for _ in range(STEPS):
            state = newton_step(counts, state, few)
        state = common.materialise(state, "dual")
        # The last residual is the one before the last step, which is quadratic by then.
        worst = state.agg(F.max("residual")).first()[0]
        if worst is None or worst <= 1e-7:
            return sources.join(state.select("source_key", "mean", F.round("multiplier", 9).alias("multiplier")), "source_key", "left")
    raise RuntimeError("the dual did not settle")


def solve(rows: DataFrame) -> DataFrame:
    """The sources of rows (source, source_key, size) with their multipliers."""
    counts = common.materialise(rows.groupBy("source", "source_key", "size").agg(F.count(F.lit(1)).alias("n")), "counts")
    sources = common.materialise(targets(counts), "targets")
    return common.materialise(multipliers(counts.filter("size > 0").select("source_key", "size", "n"), sources), "solved")


def rate() -> Column:
    """A document's rate from its size and its source's columns, a multiple of 1 / UNIT."""
    tilted = F.least(F.coalesce(_tilt(), F.lit(float(CAP))), F.lit(float(CAP)))
    return F.when(F.col("size") > 0, F.floor(tilted * UNIT + 0.5)).otherwise(0).cast("long")


def dealt(rows: DataFrame) -> DataFrame:
    """key (the columns of a row that tell it apart), size, source_size, target, rate, copies for every row."""
    solved = solve(rows).withColumnRenamed("n", "documents")
    items = rows.groupBy("source_key", "size", "key").agg(F.count(F.lit(1)).alias("rows"))
    # A row that repeats is cut into items of CELL_ROWS rows, which fall into cells of their own.
    items = items.withColumn("part", F.explode(F.expr(f"sequence(0, cast((rows - 1) div {CELL_ROWS} as int))"))).withColumn("rows", F.least(F.lit(CELL_ROWS), F.col("rows") - F.col("part") * CELL_ROWS))
    name = F.concat_ws(":", F.coalesce(F.col("key.doc_id").cast("string"), F.lit("null")), "size", "part")
    mixed = F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")
    placed = meet(items.withColumn("mixed", mixed), solved, solved.count() <= FEW_SOURCES).withColumn("units", rate())
    cell = F.pmod("mixed", F.ceil(F.col("documents") / CELL_ROWS))
    item = F.struct((-F.col("size")).alias("order"), "mixed", "key", "part", "size", "rows", "units")
    cells = placed.groupBy("source_key", cell.alias("cell")).agg(F.array_sort(F.collect_list(item)).alias("items"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    # What is owed is counted in words times UNIT.
    owed = "(s.owed + x.units * x.size * x.rows)"
    copies = f"if(x.size = 0, 0L, least({CAP}L * x.rows, greatest(0L, ({owed} + x.size * {UNIT // 2}L) div (x.size * {UNIT}L))))"
    fold = f"aggregate(items, named_struct('owed', 0L, 'copies', cast(array() as array<bigint>)), (s, x) -> named_struct('owed', {owed} - {copies} * x.size * {UNIT}L, 'copies', concat(s.copies, array({copies})))).copies"
    each = cells.withColumn("copies", F.expr(fold)).select(F.explode(F.arrays_zip("items", "copies")).alias("z"), "source_size", "target")
    share = F.expr("transform(sequence(1L, z.items.rows), i -> z.copies div z.items.rows + if(i <= z.copies % z.items.rows, 1, 0))")
    return each.select("z.items.key", "z.items.size", "source_size", "target", (F.col("z.items.units") / UNIT).alias("rate"), F.explode(share).alias("copies"))


def size_rows(docs: DataFrame, key: Column) -> DataFrame:
    """key, source, source_key, size of every row, written once. key is a struct with doc_id."""
    text, source = docs["text"].cast("string"), docs["source"].cast("string")
    named = F.coalesce(F.concat(F.lit("s"), source), F.lit("none"))
    return common.materialise(docs.select(key.alias("key"), source.alias("source"), named.alias("source_key"), F.coalesce(words(text), F.lit(0)).cast("long").alias("size")), "sizes")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, rate for every row of docs."""
    rows = size_rows(docs, F.struct(docs["doc_id"].cast("long").alias("doc_id")))
    return dealt(rows).select("key.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The contract's row for each row of docs, and copies."""
    return mix(docs).drop("rate")


def take_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them; its own columns only."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows, row = common.numbered(docs)
    sizes = size_rows(rows, F.struct(rows["doc_id"].cast("long").alias("doc_id"), rows[row].alias("row")))
    # Only what isn't taken once has to meet its text.
    times, copy = common.unused(rows, "maskwell_times"), common.unused(rows, "maskwell_copy")
    other = common.materialise(dealt(sizes).filter("copies <> 1").select(F.col("key.row").alias(row), F.col("copies").alias(times)), "copies")
    taken = common.meets(rows, row, other, "left").withColumn(times, F.coalesce(F.col(times), F.lit(1).cast("long"))).filter(F.col(times) > 0)
    return taken.select(*own, F.explode(F.expr(f"sequence(1L, {times})")).alias(copy)).select(*own)
