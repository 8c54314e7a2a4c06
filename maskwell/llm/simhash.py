"""SimHash near-dedup with multi-index hashing.

A fingerprint bit is set where over half of the 3-word shingle hashes (XXH64 of the UTF-8 text, seed
42, repeats included) have it. Distinct fingerprints link at 2 or fewer differing bits.

The index holds both 32-bit halves of each fingerprint. Of two fingerprints that differ in at most
two bits, either the upper halves differ in at most one bit or the lower halves are equal; so a
probe enumerates the ball of radius 1 of its upper half and radius 0 of its lower half, and complete
distances verify what the tables return. Of the two ends of a pair that differs in one upper bit
only the one with a 0 there probes the other, which halves the ball.

A bucket with over HOT_BUCKET fingerprints (a large group of near copies) is itself split the same
way: its fingerprints agree in the bits of its key, so the other 32 bits are cut into halves, and the
distance that a probe has left decides how far it looks into each; buckets that stay large are cut
once more, to 8 free bits, of which there are at most 256. So the tables of any input hold short
buckets, and every link is found by fetching and verifying. A group of n fingerprints costs n times
the fingerprints in its short buckets, not n squared.

Components are found by rounds of large-star and small-star contraction over links, each round
written to the shared folder. Nothing of this reaches the driver but counts.

Defined results for odd input: null text counts as empty, and texts without words have fingerprint
zero and link to each other; a null doc_id ranks above all others and is the component of a group
that has no other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import common

SHINGLE, SEED, RADIUS = 3, 42, 2
#: A bucket with more fingerprints is split, down to this many free bits.
HOT_BUCKET, LEAST_WIDTH = 128, 8
MAX_ROUNDS = 60
#: Hashes whose bits are counted at once.
_BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text as an unsigned 64-bit number."""
    words = (text or "").encode().lower().split()  # on bytes: lower-cases A-Z, splits at ASCII white space
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    hashes = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _BLOCK):
        block = hashes[k : k + _BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(x.as_py()) for x in batch.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), batch.column("place"), pa.array(fps)], ["doc_id", "tie", "place", "fp"])


def fingerprint_rows(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(doc_id, tie, place, fp) of every row, written once; tie orders texts, place is the column row, if named."""
    text = common.text_of(docs)
    place = docs[row] if row else F.lit(None).cast("struct<file: bigint, at: bigint>")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), place.alias("place"), text.alias("text"))
    return common.materialise(rows.mapInArrow(lambda batches: common.handing_back(_fingerprints(batches)), "doc_id long, tie long, place struct<file: bigint, at: bigint>, fp long"), "simhash")


def _bits(at: str, width: str) -> str:
    """SQL for a mask of the bits from at on."""
    return f"shiftleft(shiftleft(1L, {width}) - 1, {at})"


def split(entries: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables of half as many free bits, and the probes into them.

    A bucket's fingerprints (entries fp, at, width, key) agree in all but width bits from at on, and
    key holds what they agree in. A probe has bits left that may differ among the free ones. With h
    and l bits that differ in their upper and lower half: if h is 0, the upper halves are equal; if h
    is 1 of at most 2, the upper half is one bit away; else l is 0.
    """
    half, middle = "cast(width div 2 as int)", "cast(at + width div 2 as int)"
    upper, lower = _bits(middle, half), _bits("at", half)
    bucket = lambda at, key, left="": f"named_struct('at', {at}, 'width', {half}, 'key', {key}{left})"
    tables = bucket("at", f"key | (fp & {upper})"), bucket(middle, f"key | (fp & {lower})")
    equal = bucket("at", f"key | (probe & {upper})", ", 'left', left"), bucket(middle, f"key | (probe & {lower})", ", 'left', left")
    near = bucket("at", f"key | (probe & {upper}) | shiftleft(1L, k)", ", 'left', left - 1")
    # Of two ends that differ in one upper bit, the one with a 0 there looks for the other.
    ball = f"transform(filter(sequence({middle}, cast(at + width - 1 as int)), k -> left = {RADIUS} and (probe & shiftleft(1L, k)) = 0), k -> {near})"
    cut = entries.select("fp", F.expr(f"explode(array({', '.join(tables)})) as e")).select("fp", "e.*")
    looks = probes.select("probe", F.expr(f"explode(concat(array({', '.join(equal)}), {ball})) as e")).select("probe", "e.*")
    return cut, looks


def similar_pairs(fps: DataFrame) -> DataFrame:
    """(a, b): all links between distinct fingerprints (column fp)."""
    bucket = ["at", "width", "key"]
    whole = [F.lit(0).alias("at"), F.lit(64).alias("width"), F.lit(0).cast("long").alias("key")]
    entries, probes, found = fps.select("fp", *whole), fps.select(F.col("fp").alias("probe"), *whole, F.lit(RADIUS).alias("left")), None
    for width in (32, 16, 8):
        entries, probes = split(entries, probes)
        short, hot = entries, None
        if width > LEAST_WIDTH:
            hot = common.materialise(entries.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_BUCKET).select(*bucket), "hot")
            short = entries.join(hot, bucket, "left_anti")
        # With no bit spent both ends look for each other.
        fetched = probes.join(short, bucket).filter((F.col("probe") < F.col("fp")) | (F.col("left") < RADIUS) & (F.col("probe") != F.col("fp")))
        near = fetched.filter(F.bit_count(F.col("probe").bitwiseXOR(F.col("fp"))) <= RADIUS).select(F.least("probe", "fp").alias("a"), F.greatest("probe", "fp").alias("b"))
        found = near if found is None else found.unionAll(near)
        if hot is None or hot.isEmpty():
            break
        entries, probes = (common.materialise(x.join(hot, bucket, "left_semi").select(*x.columns), "hot_rows") for x in (entries, probes))
    return found.distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, for nodes with links (a, b)."""
    edges = common.materialise(links.select("a", "b"), "links")
    count = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: neighbours above a node move to its smallest neighbour (or itself).
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        # Small star: neighbours below a node, and itself, move to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("low").alias("y")), F.struct(F.col("b").alias("x"), F.col("low").alias("y")))).alias("e")).select("e.*").filter("x <> y").distinct()
        mark = common.written()
        edges = common.materialise(small.select(F.col("x").alias("b"), F.col("y").alias("a")).select("a", "b"), "links")
        common.release(edges.sparkSession, mark - 1, edges)  # the round before
        # Settled once each node hangs on one root and no root hangs on another; links only shrink.
        state = edges.agg(F.count(F.lit(1)), F.countDistinct("b"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not state[0] or tuple(state) == count:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        count = tuple(state)
    raise RuntimeError("components did not settle")


def near_groups(rows: DataFrame) -> DataFrame:
    """rows (doc_id, tie, place, fp) with component_id and first, the place of the component's first row.

    Rows of a component order by doc_id (nulls last), then text hash, then place.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("tie").alias("tie"), F.col("place").alias("place"))
    fps = common.materialise(rows.groupBy("fp").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n")), "fps")
    roots = components(similar_pairs(fps.select("fp")))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = rooted.groupBy("root").agg(F.min("best").alias("best"))
    by_fp = common.materialise(rooted.select("fp", "n", "root").join(best, "root").select("fp", "n", F.col("best.doc_id").alias("component_id"), F.col("best.place").alias("first")), "groups")
    return common.join_groups(rows, by_fp, "fp", "n").drop("n")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs."""
    return near_groups(fingerprint_rows(docs)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group (the smallest doc_id); its own columns only."""
    rows, row = common.numbered(docs)
    groups = near_groups(fingerprint_rows(rows, row))
    return common.without(rows, row, common.materialise(groups.filter(F.col("place") != F.col("first")).select(F.col("place").alias(row)), "near_copies"))
