"""What Spark has no expression for, as Arrow-batched functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession, functions as F, types as T

from .. import vocab
from ..operators import dates, validate
from ..operators.note import deidentify
from ..operators.resolve import indel_ratio as _indel_ratio, name_key, same_person as _same_person, token_set_ratio as _token_set_ratio
from ..policy import Policy


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _indel_ratio(x, y) for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _token_set_ratio(x, y) for x, y in zip(a, b)])


@F.pandas_udf(T.BooleanType())
def same_person(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two surfaces of names can be one person."""
    return pd.Series([_same_person(name_key(x or ""), name_key(y or "")) for x, y in zip(a, b)])


@F.pandas_udf(T.IntegerType())
def shift_days(key: pd.Series, window: pd.Series) -> pd.Series:
    return pd.Series([dates.shift_days(k or "", int(w)) for k, w in zip(key, window)])


@F.pandas_udf(T.BooleanType())
def ip_ok(value: pd.Series) -> pd.Series:
    """IPv4 and IPv6."""
    return value.map(lambda v: bool(v) and validate.ip(v))


@F.pandas_udf(T.StringType())
def mask_text(text: pd.Series) -> pd.Series:
    policy = Policy()
    return text.map(lambda t: None if t is None else deidentify(t, policy).masked)


def _spans_function():
    class Spans:
        def eval(self, text: str):
            for s in deidentify(text, Policy()).spans:
                yield s.start, s.end, s.category, s.text, s.score, s.source, s.detector

    return F.udtf(Spans, returnType="start: int, `end`: int, category: string, text: string, score: double, source: string, detector: string")


_DIGITS = "regexp_replace(value, '[^0-9]', '')"
_VIN = "upper(trim(value))"
#: SQL bodies of the validators of functions.columns.
SQL_CHECKS = {
    "valid_npi": f"length({_DIGITS}) = 10 AND luhn_check(concat('80840', {_DIGITS}))",
    "valid_dea": "CASE WHEN trim(value) RLIKE '^[A-Za-z]{2}[0-9]{7}$' THEN (" + " + ".join(f"{1 + k % 2} * int(substring(trim(value), {k + 3}, 1))" for k in range(6)) + ") % 10 = int(substring(trim(value), 9, 1)) ELSE false END",
    "valid_vin": f"CASE WHEN {_VIN} RLIKE '^[A-HJ-NPR-Z0-9]{{17}}$' THEN substring({_VIN}, 9, 1) = substring('0123456789X', aggregate(zip_with(split(translate({_VIN}, '{''.join(vocab.VIN_VALUES)}', '{''.join(map(str, vocab.VIN_VALUES.values()))}'), ''), array({', '.join(map(str, vocab.VIN_WEIGHTS))}), (c, w) -> int(c) * w), 0, (s, x) -> s + x) % 11 + 1, 1) ELSE false END",
    "valid_ssn": f"length({_DIGITS}) = 9 AND substring({_DIGITS}, 1, 3) NOT IN ('000', '666') AND substring({_DIGITS}, 1, 1) <> '9' AND substring({_DIGITS}, 4, 2) <> '00' AND substring({_DIGITS}, 6, 4) <> '0000'",
}


def register(spark: SparkSession) -> None:
    """SQL functions deid_mask, deid_spans (in LATERAL), indel_ratio, shift_days, valid_ip, valid_npi, valid_dea, valid_vin, valid_ssn."""
    for name, function in (("deid_mask", mask_text), ("indel_ratio", indel_ratio), ("shift_days", shift_days), ("valid_ip", ip_ok)):
        spark.udf.register(name, function)
    spark.udtf.register("deid_spans", _spans_function())
    for name, body in SQL_CHECKS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(value STRING) RETURNS BOOLEAN RETURN {body}")
