"""Regular expression matches with code point offsets, from Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .chat_format import prefix_sums


def with_spans(df: DataFrame, text: str, pattern: str, out: str, group: int = 0, only: Column | None = None) -> DataFrame:
    """df with out, array<struct<s int, e int, n int, v string>>: matches left to right, non-overlapping.

    s and e are code point offsets, end exclusive; n is the length of the group, v its text. What lies
    between matches comes from a split at the same pattern, so offsets are sums of lengths. The
    pattern must not match the empty string. text must not be null. only: a cheap condition that holds
    for every text with a match; others aren't searched.
    """
    keep = [F.col(f"`{c}`") for c in df.columns]
    every = lambda g: F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(g))
    none = F.array().cast("array<string>")
    found = df.select(*keep, (every(0) if only is None else F.when(only, every(0)).otherwise(none)).alias("_m"))
    hit = F.size("_m") > 0
    cut = found.select(*keep, "_m", (F.when(hit, every(group)) if group else F.lit(None).cast("array<string>")).alias("_g"), F.when(hit, F.split(F.col(text), pattern, -1)).alias("_p"))
    runs = cut.select(*keep, "_m", "_g", F.expr("if(size(_m) = 0, cast(array() as array<int>), flatten(zip_with(slice(_p, 1, size(_m)), _m, (p, x) -> array(char_length(p), char_length(x)))))").alias("_r"))
    starts = runs.select(*keep, "_m", "_g", F.expr(prefix_sums("_r")).alias("_s"))
    value = "coalesce(get(_g, i), x)" if group else "x"
    return starts.select(*keep, F.expr(f"transform(_m, (x, i) -> named_struct('s', get(_s, 2 * i + 1), 'e', get(_s, 2 * i + 1) + char_length(x), 'n', char_length({value}), 'v', {value}))").alias(out))
