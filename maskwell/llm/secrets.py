"""Secret scans with multipart credential linking, Spark expressions only.

Base spans (assign, access, hex) are strong by their own shape and always reported. Weak parts are
not: identifiers (client ids, user names, logins), secrets (mixed tokens of 20 or more characters,
short pass or key fields) and endpoints (URLs, host:port). A weak part is reported when
complementary parts stand within SCOPE code points of it: one that is strong, or one of both other
kinds. Parts that overlap a base span are part of it and not reported again.

Linking is an interval join in cells of SCOPE code points. Each cell of a document keeps, for each
kind of part, only its first start and last end, which decide every distance from outside the cell;
a weak part looks into its own cell and both neighbours. So a join row exists for each part, cell and
kind, never for pairs of parts. Overlaps with base spans come from running ends over parts by start.

Defined results for odd input: null text counts as empty; rows that repeat are scanned each by
itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window, functions as F

from . import common
from .spans import with_spans

SCOPE = 300
#: The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # the same matches as AKIA[A-Z0-9]+ with 16 or more characters
HEX = r"[0-9a-f]{32,}"  # the same matches as [0-9a-f]+ with 32 or more characters
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")

WEAK_ID = r"""(?i)(?<![a-z0-9])(client_?id|access_?key_?id|user_?name|user_?id|login|account_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
WEAK_FIELD = r"""(?i)(?<![a-z0-9])(pwd|pass|auth|credential|private_?key|access_?key)["']?\x20*[:=]\x20*["']?([^\s"'<>]{6,})"""
ENDPOINT = r"""(?i)(?<![a-z0-9.-])(?:https?://[^\s"'<>]+|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[a-z0-9.-]+|[a-z0-9.-]++:[0-9]{2,5}(?![0-9]))"""
_IDENTIFIER, _SECRET, _ENDPOINT = 0, 1, 2
#: Of which one is in every text, in small letters, in which a pattern matches.
_CUES = {"a": ("pass", "secret", "token", "api"), "c": ("akia",), "i": ("client", "access", "user", "login", "account"), "f": ("pwd", "pass", "auth", "credential", "key"), "u": (":", "=")}
_MIXED = "x.v rlike '[0-9]' and x.v rlike '[A-Za-z]'"


def _part(column: str, k: int, part: int, strong: bool, only: str = "true") -> str:
    return f"transform(filter({column}, x -> {only}), x -> named_struct('s', x.s, 'k', {k}, 'e', x.e, 'part', {part}, 'strong', {str(strong).lower()}))"


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, row, base, weak) of every row, written once. base and weak are arrays of parts by start."""
    found = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), common.text_of(docs).alias("text"))
    found = found.select("*", F.lower("text").alias("low"))
    for name, pattern, group in (("a", ASSIGN, 2), ("c", ACCESS, 0), ("h", HEX, 0), ("i", WEAK_ID, 0), ("t", WEAK_SECRET, 0), ("f", WEAK_FIELD, 0), ("u", ENDPOINT, 0)):
        cues = _CUES.get(name)
        found = with_spans(found, "text", pattern, name, group, reduce(or_, [F.contains("low", F.lit(c)) for c in cues]) if cues else None)
    base = ", ".join([_part("a", 0, _SECRET, True, f"x.n >= {ASSIGN_LEAST}"), _part("c", 1, _IDENTIFIER, True), _part("h", 2, _SECRET, True)])
    weak = ", ".join([_part("i", 3, _IDENTIFIER, False), _part("t", 4, _SECRET, False, _MIXED), _part("f", 4, _SECRET, False), _part("u", 5, _ENDPOINT, False)])
    return common.materialise(found.select("doc_id", "row", F.expr(f"array_sort(concat({base}))").alias("base"), F.expr(f"array_sort(concat({weak}))").alias("weak")), "parts")


def link(found: DataFrame) -> DataFrame:
    """(row, linked array of parts): the weak parts of parts() that have complementary parts near."""
    # Two kinds of part at least, else nothing can be complementary.
    several = found.filter(F.expr("size(weak) > 0 and (exists(weak, x -> x.part <> weak[0].part) or exists(base, x -> x.part <> weak[0].part))"))
    each = several.select("row", F.explode(F.concat("base", "weak")).alias("p")).select("row", "p.*").withColumn("is_base", F.col("k") <= 2)
    order = Window.partitionBy("row").orderBy("s", "k", "e")
    ahead = Window.partitionBy("row").orderBy(F.desc("s"), F.desc("k"), F.desc("e"))
    base_before = F.max(F.when(F.col("is_base"), F.col("e"))).over(order)
    base_after = F.min(F.when(F.col("is_base"), F.col("s"))).over(ahead)
    seen = each.withColumn("before", base_before).withColumn("after", base_after)
    alone = ~F.coalesce(F.col("before") > F.col("s"), F.lit(False)) & ~F.coalesce(F.col("after") < F.col("e"), F.lit(False))
    kept = seen.filter(F.col("is_base") | alone).select("row", "s", "k", "e", "part", "strong", "is_base")
    first, last = F.floor(F.col("s") / SCOPE), F.floor((F.col("e") - 1) / SCOPE)
    covered = kept.withColumn("cell", F.explode(F.sequence(first, last)))
    extents = covered.groupBy("row", "cell", "part", "strong").agg(F.min("s").alias("low"), F.max("e").alias("high"))
    looks = kept.filter(~F.col("is_base")).select("row", "s", "k", "e", F.col("part").alias("own"), F.explode(F.sequence(first - 1, last + 1)).alias("cell"))
    near = (F.col("low") - F.col("e") <= SCOPE) & (F.col("s") - F.col("high") <= SCOPE) & (F.col("part") != F.col("own"))
    joined = looks.join(extents, ["row", "cell"]).filter(near)
    judged = joined.groupBy("row", "s", "k", "e", "own").agg(F.max("strong").alias("strong"), F.countDistinct("part").alias("kinds"))
    linked = judged.filter(F.col("strong") | (F.col("kinds") == 2))
    return linked.groupBy("row").agg(F.collect_list(F.struct("s", "k", "e")).alias("linked"))


def _as_text(column: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({column}, x -> concat(get(array({names}), x.k), ':', x.s, ':', x.e)), ',')"


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked for every row of docs."""
    found = parts(docs)
    both = found.select("doc_id", "row", "base").join(common.materialise(link(found), "linked"), "row", "left")
    both = both.withColumn("every", F.expr("array_sort(concat(transform(base, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e)), coalesce(linked, cast(array() as array<struct<s int, k int, e int>>))))"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return both.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(F.expr(_as_text("base")), 256).alias("base_sha256"), F.expr(_as_text("every")).alias("spans"), F.greatest(F.size("linked"), F.lit(0)).cast("long").alias("n_linked"))
