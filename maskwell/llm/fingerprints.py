"""Document fingerprints: one-permutation MinHash with optimal densification, Spark expressions only.

Words are runs of characters other than ASCII white space, taken as they are; a shingle is five
words (a shorter text is one shingle, also an empty one). Each shingle is hashed once (XXH64); the
hash's upper seven bits name one of 128 bins, and a bin keeps its smallest hash. An empty bin copies
a full one, found by its own sequence of hashed probes, so that any two documents with the same full
bins copy alike; should many probes fail, a cycle through all bins ends the search. A bin's value is
remixed with the bin's number, so that copies of one value don't agree by one chance only, and eight
low-order bits of it are stored, 8 bins to a long. Two unrelated bins agree by chance in 1 of 256
cases, which the likeness estimate corrects: J = (f - 1/256) / (1 - 1/256), held to 0..1. Its
standard error is about sqrt(J (1 - J) / 128).

`next_documents` puts each document beside the one that follows in descending doc_id without one
global sort and with one shuffle of the texts: rows are cut into buckets at sampled boundaries (they
only balance the work), each bucket also gets the first row of the bucket below, and the last bucket
the very first row. Boundaries are places in the order of id, text hash and row, so null ids, equal
ids and rows that repeat split like any others. A bucket has about a quarter of the square root of
all rows (BUCKET_ROWS at least), and the driver holds 24 bytes a bucket: at 10^10 documents these
are 25,000 rows and 10 MB.

Defined results for odd input: null text counts as empty; null ids come after all others; rows with
equal ids order by text hash (largest first); a single document follows itself; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

WORDS, BINS, BITS = 5, 128, 8
#: Rows that a bucket has at least, on average; and the sampled rows that it is measured by.
BUCKET_ROWS, SAMPLES_PER_BUCKET = 512, 16
_NO_ID = -(1 << 63)

_SPACE = " \t\n\x0b\f\r"


def _first(low: int, high: int, probe: str) -> str:
    """SQL for the first full bin among probes low..high of empty bin i, else null."""
    return f"get(filter(transform(sequence({low}, {high}), t -> cast({probe} as int)), j -> (shiftright(get(full, shiftright(j, 6)), j & 63) & 1) = 1), 0)"


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with column out, array<bigint> of 16 longs; text must not be null. Adds no other column."""
    keep = [F.col(f"`{c}`") for c in df.columns]
    words = df.select(*keep, F.split(F.btrim(F.col(text), F.lit(_SPACE)), "[ \t-\r]+").alias("_w"))
    hashed = words.select(*keep, F.expr(f"sort_array(transform(sequence(0, greatest(size(_w) - {WORDS}, 0)), i -> xxhash64({', '.join(f'get(_w, i + {k})' for k in range(WORDS))})))").alias("_h"))
    # Signed order keeps a bin's hashes together; the first of each run is the bin's smallest.
    least = hashed.select(*keep, F.expr("filter(_h, (x, i) -> i = 0 or shiftright(x, 57) <> shiftright(get(_h, i - 1), 57))").alias("_m"))
    # Two bitmaps of the full bins, then for each the number of full bins before it. Columns that a
    # lambda reads are read at least twice, else Spark would inline and recompute them at each step.
    half = lambda q: f"aggregate(_m, 0L, (s, x) -> if(shiftright(x, 63) + 1 = {q}, s | shiftleft(1L, cast(shiftright(x, 57) + 64 as int) & 63), s))"
    maps = least.select(*keep, "_m", F.expr(f"array({', '.join(map(half, range(2)))})").alias("_f"))
    full = maps.select(*keep, "_m", F.expr("concat(_f, array(0L, cast(bit_count(_f[0]) as long)))").alias("full"))
    probe, cycle = "pmod(xxhash64(i, t), 128)", "pmod(pmod(xxhash64(i, -1), 64) * 2 * t + t + pmod(xxhash64(i, -2), 128), 128)"
    source = f"if((shiftright(get(full, shiftright(i, 6)), i & 63) & 1) = 1, i, coalesce({_first(1, 8, probe)}, {_first(9, 64, probe)}, {_first(0, 127, cycle)}))"
    slot = "cast(get(full, 2 + shiftright(j, 6)) as int) + bit_count(get(full, shiftright(j, 6)) & ~shiftleft(-1L, j & 63))"
    bits = full.select(*keep, F.expr(f"transform(transform(sequence(0, 127), i -> {source}), (j, i) -> xxhash64(get(_m, {slot}), i) & 255L)").alias("_b"))
    packed = ", ".join(f"aggregate(slice(_b, {g * 8 + 1}, 8), 0L, (s, x) -> shiftleft(s, 8) | x)" for g in range(16))
    return bits.select(*keep, F.expr(f"array({packed})").alias(out))


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: str, b: str) -> Column:
    """Bias-corrected share of agreeing bins of two fingerprint columns."""
    # The lowest bit of a byte of the folded difference is set where the byte differs.
    fold = "(x ^ y) | shiftrightunsigned(x ^ y, 4)"
    fold = f"({fold}) | shiftrightunsigned({fold}, 2)"
    differ = f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count((({fold}) | shiftrightunsigned({fold}, 1)) & {0x0101010101010101}L)), 0, (s, n) -> s + n)"
    chance = 1 / (1 << BITS)
    return F.expr(f"greatest(0D, (1D - {differ} / {BINS}D - {chance}D) / (1D - {chance}D))")


def _numbers(values: list[int]) -> Column:
    """A literal array of longs; one string, so its size costs no calls."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def boundaries(keys: DataFrame) -> list[tuple[int, int, int]]:
    """Places in keys (id, tie, uid), all longs, which cut it into buckets of about equal numbers of rows."""
    rows = keys.count()
    buckets = rows // max(BUCKET_ROWS, math.isqrt(rows) // 4)
    if buckets < 2:
        return []
    share = min(1.0, SAMPLES_PER_BUCKET * buckets / rows)
    sample = keys.filter(F.pmod(F.xxhash64("id", "tie", "uid"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    placed = common.ranked(sample, [F.col("id"), F.col("tie"), F.col("uid")])
    return sorted(tuple(r) for r in placed.filter((F.col("rank") > 0) & (F.col("rank") % SAMPLES_PER_BUCKET == 0)).select("id", "tie", "uid").collect())


def next_documents(docs: DataFrame, value: list[str], row: str) -> DataFrame:
    """docs with next_<v> for each v of value: the columns of the row after it by descending doc_id.

    Rows with equal ids order by the hash of the first value, then by the column row (a long).
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(value[0]).alias("tie"), F.col(row).alias("uid")]
    keys = common.materialise(docs.select(*key), "keys")
    bounds = boundaries(keys)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))] or [1]
    edges = [_numbers([b[k] for b in bounds] or [0]) for k in range(3)]

    def reached(at: Column) -> Column:
        id_, tie, number = (F.get(e, at) for e in edges)
        return (id_ < F.col("id")) | (id_ == F.col("id")) & ((tie < F.col("tie")) | (tie == F.col("tie")) & (number <= F.col("uid")))

    bucket_of = F.aggregate(F.lit(steps), F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & reached(at + s - 1), at + s).otherwise(at))
    tops = {r["bucket"]: tuple(r["top"]) for r in keys.groupBy(bucket_of.alias("bucket")).agg(F.max(F.struct("id", "tie", "uid")).alias("top")).collect()}
    filled = sorted(tops)
    above = dict(zip(filled, filled[1:]))
    first, last = (tops[filled[-1]], filled[0]) if filled else ((0, 0, 0), 0)
    top_of, above_of = [_numbers([tops.get(b, (0, 0, 0))[k] for b in range(len(bounds) + 1)]) for k in range(3)], _numbers([above.get(b, -1) for b in range(len(bounds) + 1)])
    names = ("id", "tie", "uid")
    at_top = F.lit(True)
    is_first = F.lit(True)
    for k, name in enumerate(names):
        at_top &= F.col(f"k.{name}") == F.get(top_of[k], F.col("bucket"))
        is_first &= F.col(f"k.{name}") == F.lit(first[k]).cast("long")
    placed = docs.select(*own, *key).withColumn("bucket", bucket_of).select(*own, F.struct(*names).alias("k"), "bucket")
    goes_up = F.get(above_of, F.col("bucket")).cast("int")
    homes = F.filter(
        F.array(
            F.struct(F.col("bucket").alias("b"), F.lit(0).alias("g")),
            F.when(at_top & (goes_up >= 0), F.struct(goes_up.alias("b"), F.lit(1).alias("g"))),
            F.when(is_first, F.struct(F.lit(last).alias("b"), F.lit(2).alias("g"))),
        ),
        lambda x: x.isNotNull(),
    )
    spread = placed.select(*own, "k", F.explode(homes).alias("home"))
    order = Window.partitionBy("home.b").orderBy(F.when(F.col("home.g") == 2, 1).otherwise(0), F.desc("k"))
    nexts = spread.select(*own, F.col("home.g").alias("g"), *[F.lead(v).over(order).alias(f"next_{v}") for v in value])
    return nexts.filter("g = 0").drop("g")


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """The contract's row for each document: fingerprints of its text and of its edited text."""
    rows, row = common.numbered(docs.select("doc_id", "text"))
    texts = rows.select("doc_id", common.text_of(rows).alias("text"), F.xxhash64(row).alias("row"))
    paired = next_documents(with_fingerprint(texts, "text", "fp"), ["text", "fp"], "row")
    sized = paired.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("cut", (F.col("n_chars") - F.pmod("n_chars", F.lit(3))) / 3)
    edited = sized.select("doc_id", "n_chars", "fp", "next_fp", F.expr("concat(substring(text, 1, cast(n_chars - cut as int)), substring(next_text, 1, cast(cut as int)))").alias("edited"))
    done = with_fingerprint(edited, "edited", "edited_fp")
    return done.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
    )
