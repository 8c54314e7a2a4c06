"""Scoring detected spans against gold ones, and choosing thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import vocab
from ..functions.columns import blanked, let, parse_date
from ..functions.udfs import token_set_ratio

#: The thresholds that a sweep tries.
GRID = tuple(round(0.05 * k, 2) for k in range(1, 19))
TOP_MISSED = 40
#: How far around a percentile a sketch brackets it, as a share of all ranks.
WIDTH = 1e-3


def coarse(label: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in vocab.COARSE.items() for x in kv])[label], label)


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


_SPANS = "array<struct<start:int,end:int,label:string>>"


def _touch(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _matching(gold: Column | str, pred: Column | str, then) -> Column:
    """then(gold, pred, taken): taken has for each gold span the number of the prediction that it takes, or
    -1, and pred its numbers as k.

    Spark computes an expression as often as it is written, and in a lambda for every element: so each
    of the three is bound once.
    """
    numbered = F.transform(pred, lambda p, k: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["label"].alias("label"), k.alias("k")))

    def taken(gold: Column, pred: Column) -> Column:
        fits = lambda t, g: F.filter(pred, lambda p: _touch(g, p) & (p["label"] == g["label"]) & ~F.array_contains(t, p["k"]))
        return F.aggregate(gold, F.array().cast("array<int>"), lambda t, g: F.concat(t, F.array(F.coalesce(F.get(fits(t, g), F.lit(0))["k"], F.lit(-1)))))

    return let(gold, lambda g: let(numbered, lambda p: let(taken(g, p), lambda t: then(g, p, t))))


def _exact(gold: Column, pred: Column, taken: Column) -> Column:
    own = lambda k: F.get(pred, F.get(taken, k))
    return F.size(F.filter(gold, lambda g, k: (own(k)["start"] == g["start"]) & (own(k)["end"] == g["end"])))


def _bare(gold: Column, pred: Column) -> Column:
    return F.filter(gold, lambda g: ~F.exists(pred, lambda p: _touch(g, p)))


def matched(gold: Column | str, pred: Column | str) -> Column:
    """struct<hits, exact, missed, bare, extra> of two arrays of struct<start, end, label>.

    Each gold span in order takes the first unused prediction of its label that overlaps it. hits are
    the gold spans that got one, missed those that didn't, bare those that no prediction of any label
    overlaps, extra the predictions that nobody took; exact counts hits with equal ends.
    """
    plain = lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["label"].alias("label"))

    def parts(gold: Column, pred: Column, taken: Column) -> Column:
        hits, missed = F.filter(gold, lambda g, k: F.get(taken, k) >= 0), F.filter(gold, lambda g, k: F.get(taken, k) < 0)
        extra = F.filter(pred, lambda p: ~F.array_contains(taken, p["k"]))
        spans = {"hits": hits, "missed": missed, "bare": _bare(gold, pred), "extra": extra}
        plains = {name: F.transform(x, plain).alias(name) for name, x in spans.items()}
        none = F.array().cast(_SPANS)
        return F.when(gold.isNotNull(), F.struct(plains["hits"], _exact(gold, pred, taken).alias("exact"), plains["missed"], plains["bare"], F.coalesce(plains["extra"], none).alias("extra")))

    return _matching(gold, pred, parts)


COUNTS = ("tp", "fp", "fn", "exact", "uncovered")


def one_to_one(gold: Column | str, pred: Column | str, counts: tuple[str, ...] = COUNTS) -> Column:
    """struct<tp, fp, fn, exact, uncovered> of two arrays of struct<start, end, label>; those in counts only."""

    def count(gold: Column, pred: Column, taken: Column) -> Column:
        tp = F.size(F.filter(taken, lambda k: k >= 0))
        each = {"tp": tp, "fp": F.greatest(F.size(pred), F.lit(0)) - tp, "fn": F.size(gold) - tp, "exact": _exact(gold, pred, taken), "uncovered": F.size(_bare(gold, pred))}
        return F.struct(*[each[name].alias(name) for name in counts])

    return _matching(gold, pred, count)


def report(scores: DataFrame, source: str = "source") -> DataFrame:
    """Micro scores by source and overall (source null) from rows with tp, fp, fn, exact, uncovered."""
    sums = scores.groupingSets([[source], []], source).agg(
        F.count(F.lit(1)).alias("notes"), *[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "exact", "uncovered")],
        F.sum((F.col("fn") > 0).cast("long")).alias("leaky"), F.sum((F.col("uncovered") > 0).cast("long")).alias("exposed"),
    )
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select(
        source, "notes", "tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        ratio(F.col("leaky"), F.col("notes")).alias("leak_rate"), ratio(F.col("exposed"), F.col("notes")).alias("uncovered_rate"), ratio(F.col("exact"), F.col("tp")).alias("exact_rate"),
    )


def by_category(rows: DataFrame) -> DataFrame:
    """category, tp, fp, fn, recall from rows (category, outcome) with outcome tp, fp or fn."""
    n = lambda o: F.sum((F.col("outcome") == o).cast("long")).alias(o)
    return rows.groupBy("category").agg(n("tp"), n("fp"), n("fn")).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))


def positional_percentiles(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """p50 and p95 as the values at positions n div 2 and floor(0.95 n) of the sorted values.

    A sketch with map-side combine first brackets each position to within WIDTH of all ranks; exact
    counts then place it, so only the rows of the brackets are sorted, and no task gets a whole group.
    """
    known = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    shares = {"p50": 0.5, "p95": 0.95}
    ends = [x for p in shares.values() for x in (p - WIDTH, p + WIDTH)]
    sketch = known.groupBy(*by).agg(F.percentile_approx("_v", ends, int(2 / WIDTH)).alias("_ends"), F.count(F.lit(1)).alias("_n"))
    place = {"p50": F.floor(F.col("_n") / 2), "p95": F.floor(F.col("_n") * F.lit(95) / 100)}
    joined = known.alias("a").join(sketch.alias("b"), _same(by)).select(*[F.col(f"a.{c}").alias(c) for c in by], "_v", "_ends", "_n")
    out = None
    for k, name in enumerate(shares):
        low, high = F.col("_ends")[2 * k], F.col("_ends")[2 * k + 1]
        # How often each value of the bracket occurs, and in one row how many values are below it.
        counted = joined.filter(F.col("_v") <= high).groupBy(*by, F.when(F.col("_v") >= low, F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"), F.first(place[name]).alias("_at"))
        upto = F.sum("_c").over(Window.partitionBy(*by).orderBy(F.asc_nulls_first("_v")))
        one = counted.withColumn("_upto", upto).filter(F.col("_v").isNotNull() & (F.col("_upto") > F.col("_at"))).groupBy(*by).agg(F.min("_v").alias(name))
        out = one if out is None else out.alias("a").join(one.alias("b"), _same(by)).select("a.*", f"b.{name}")
    return out


def _same(by: list[str]) -> list[Column]:
    """Equal groups of tables a and b; null is a group."""
    return [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]


def top_missed(missed: DataFrame, by: str, surface: str, order: str, keep: int = TOP_MISSED) -> DataFrame:
    """The most frequent surfaces of each group; of equals the first seen."""
    counted = missed.groupBy(by, surface).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    rn = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "_first", surface))
    return counted.withColumn("rn", rn).filter(F.col("rn") <= keep).select(by, surface, "n", "rn")


def sweep(scored: DataFrame, grid=GRID) -> DataFrame:
    """category, t, tp, fp, fn, precision, recall from rows (category, score, is_gold, found).

    A row is a gold span (found: the best score of an overlapping prediction, null for none) or a
    prediction without gold. The grid has a fixed number of rows, so each row meets it in place.
    """
    each = scored.withColumn("t", F.explode(F.lit(list(grid))))
    above = F.coalesce(F.col("score") >= F.col("t"), F.lit(False))
    sums = each.groupBy("category", "t").agg(F.sum((F.col("is_gold") & above).cast("long")).alias("tp"), F.sum((~F.col("is_gold") & above).cast("long")).alias("fp"), F.sum((F.col("is_gold") & ~above).cast("long")).alias("fn"))
    return sums.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))


def choose(swept: DataFrame, floor: float) -> DataFrame:
    """The strictest threshold of each category with enough recall, else the lowest; saturated if tp never moves."""
    has_gold = swept.filter(F.col("tp") + F.col("fn") > 0)
    return has_gold.groupBy("category").agg(F.coalesce(F.max(F.when(F.col("recall") >= floor, F.col("t"))), F.min("t")).alias("threshold"), (F.count_distinct("tp") == 1).alias("saturated"))


def entity_sets(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """tp, fp, fn of two sets of equal columns, in one pass over both."""
    sides = gold.withColumn("_g", F.lit(1)).withColumn("_p", F.lit(0)).unionByName(pred.withColumn("_g", F.lit(0)).withColumn("_p", F.lit(1)))
    each = sides.groupBy(*gold.columns).agg(F.max("_g").alias("_g"), F.max("_p").alias("_p"))
    count = lambda when, name: F.count(F.when(when, 1)).alias(name)
    return each.agg(count((F.col("_g") == 1) & (F.col("_p") == 1), "tp"), count(F.col("_g") == 0, "fp"), count(F.col("_p") == 0, "fn"))


def weakest(categories: DataFrame, keep: int = 3) -> DataFrame:
    """The categories with gold and least recall."""
    return categories.filter(F.col("tp") + F.col("fn") > 0).orderBy("recall", "category").limit(keep)


def ablation(results: DataFrame) -> DataFrame:
    """Runs by recall, with rank; failed ones (null recall) have none."""
    ok = F.col("recall").isNotNull()
    return results.withColumn("rank", F.when(ok, F.row_number().over(Window.partitionBy(ok).orderBy(F.desc("recall"), "run"))))


def hipaa_rollup(spans: DataFrame, categories: DataFrame) -> DataFrame:
    """Spans by HIPAA number and category, with subtotals and the total."""
    joined = spans.join(F.broadcast(categories.select("category", "hipaa")), "category", "left")  # 24 rows
    return joined.rollup("hipaa", "category").agg(F.count(F.lit(1)).alias("n"))


def check_intervals(rows: DataFrame, id_: str, mapping: str = "mapping") -> DataFrame:
    """id_, placeholder, annotated, actual: each interval annotation against the dates it was made from.

    Both dates are entries of the row's own mapping, so nothing is joined. actual is null where one
    of them isn't a whole date.
    """
    name, noted = r"\[(DATE_[0-9]+)", r"\[(DATE_[0-9]+) = (DATE_[0-9]+) ([+-]) ([0-9]+)d\]"
    marks = rows.select(id_, mapping, F.explode(F.filter(mapping, lambda e: e["placeholder"].rlike(noted))).alias("e"))
    base = F.get(F.filter(mapping, lambda x: F.regexp_extract(x["placeholder"], name, 1) == F.regexp_extract("e.placeholder", noted, 2)), F.lit(0))["canonical"]
    pairs = marks.select(id_, F.col("e.placeholder").alias("placeholder"), F.col("e.canonical").alias("own"), base.alias("base"))
    parsed = pairs.select(id_, "placeholder", parse_date(F.col("own")).alias("own"), parse_date(F.col("base")).alias("base"))
    day = lambda p: F.when(F.col(p)["day"].isNotNull() & F.col(p)["year"].isNotNull(), F.make_date(F.col(p)["year"], F.col(p)["month"], F.col(p)["day"]))
    sign = F.when(F.regexp_extract("placeholder", noted, 3) == "-", -1).otherwise(1)
    return parsed.select(id_, "placeholder", (sign * F.regexp_extract("placeholder", noted, 4).cast("int")).alias("annotated"), F.datediff(day("own"), day("base")).alias("actual"))


def residual_dates(masked: Column) -> Column:
    """Numeric dates that are still in a masked text."""
    return F.regexp_extract_all(blanked(masked), F.lit(r"\b[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}\b"), F.lit(0))


def interval_summary(rows: DataFrame, id_: str, text: str = "masked_text", mapping: str = "mapping") -> DataFrame:
    """One row: checked, correct and unresolvable interval annotations, and the residual dates of masked notes."""
    verdicts = check_intervals(rows, id_, mapping).agg(
        F.count("actual").alias("checked"), F.count(F.when(F.col("annotated") == F.col("actual"), 1)).alias("correct"), F.count(F.when(F.col("actual").isNull(), 1)).alias("unresolvable"),
        F.lit(0).cast("long").alias("residual"),
    )
    zero = [F.lit(0).cast("long").alias(c) for c in ("checked", "correct", "unresolvable")]
    left = rows.agg(*zero, F.coalesce(F.sum(F.size(residual_dates(F.col(text)))), F.lit(0)).cast("long").alias("residual"))
    return verdicts.unionByName(left).agg(*[F.sum(c).alias(c) for c in verdicts.columns])


#: Answers that say nothing, and how alike two answers must be to agree.
VACUOUS = r"(?i)^\W*(?:n/?a|none|unknown|not (?:stated|documented|mentioned|specified|available)|i (?:do not|don't) know)?\W*$"
AGREES = 80.0


def qa_agreement(answers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, pairs, mean_similarity, agreement from rows (original, masked): answers to one question from a
    note as it was and from its masked form, rehydrated. Pairs that are both vacuous don't count."""
    said = answers.filter(~(F.coalesce("original", F.lit("")).rlike(VACUOUS) & F.coalesce("masked", F.lit("")).rlike(VACUOUS)))
    scored = said.withColumn("_s", token_set_ratio(F.coalesce("original", F.lit("")), F.coalesce("masked", F.lit(""))))
    return scored.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("pairs"), (F.avg("_s") / 100).alias("mean_similarity"), F.avg((F.col("_s") >= AGREES).cast("double")).alias("agreement"))
