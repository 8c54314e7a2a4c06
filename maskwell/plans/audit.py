"""The audit by itself, over masked texts and their mappings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import schema
from ..operators import guards
from ..operators.audit import scan
from ..operators.rewrite import Entry
from ..policy import Policy


def leak_scan(masked: DataFrame, text: str = "masked_text", mapping: str | None = "mapping", policy: Policy | None = None) -> DataFrame:
    """masked with findings and blocked. mapping: an array of schema.ENTRY, or None for none."""
    held = policy or Policy()
    entries = F.col(mapping) if mapping else F.lit(None).cast(f"array<{schema.ENTRY}>")
    rows = masked.select(*[F.col(f"`{c}`") for c in masked.columns], F.col(text).alias("_text"), entries.alias("_entries"))
    added = StructType.fromDDL(f"findings array<{schema.FINDING}>, blocked boolean")
    arrow = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, mapped in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                found = scan(t or "", [Entry(e["placeholder"], e["category"], e["canonical"] or "", e["surfaces"] or [], []) for e in mapped or []], held)
                out.append({"findings": [f._asdict() for f in found], "blocked": bool(found) and held.on_leak == "block"})
            done = pa.RecordBatch.from_pylist(out, schema=arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *done.columns], [*batch.schema.names[:-2], *arrow.names])

    return rows.mapInArrow(run, StructType(rows.schema.fields[:-2] + added.fields))


def guard_flags(spans: DataFrame) -> DataFrame:
    """spans (text, surface, category) with flags, map<string, boolean>: which guard would drop the first occurrence."""
    at = {c: spans.columns.index(c) for c in ("text", "surface", "category")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, surface, category in zip(*(batch.column(at[c]).to_pylist() for c in ("text", "surface", "category"))):
                start = text.find(surface)
                end = start + len(surface)
                out.append([
                    ("eponym_use", guards.eponym_use(text, start, end)), ("clinical_label", guards.clinical_label(surface)), ("code_fragment", guards.code_fragment(text, start, end)),
                    ("facility_kind", guards.facility_kind(text, start, end)), ("credential_only", guards.credential_only(surface)), ("implausible", guards.implausible(category, surface)),
                ])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.map_(pa.string(), pa.bool_()))], [*batch.schema.names, "flags"])

    return spans.mapInArrow(run, StructType(spans.schema.fields + StructType.fromDDL("flags map<string,boolean>").fields))
