"""De-identification of a table: one pass over its rows, no shuffle.

All state is local to a document, so the whole of detection, arbitration, resolution, rewriting and
audit runs where the row is, in Arrow batches; order-dependent folds over spans, look-around and
scoped flags are beyond Spark's expressions. The pass makes the results that are asked for and skips
the stages that nothing asked for needs; every table that follows from it (spans, mapping, review
queue, findings, counts) is DataFrame work. The same plan runs on a stream.

Each table of a Deidentified is a pass of its own. Where several are wanted, write the wide rows once:

>>> done = Deidentifier().transform(notes).written(path)  # doctest: +SKIP
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import schema, vocab
from ..operators import note
from ..operators.rewrite import rehydrate as rehydrate_text
from ..operators.spans import Span
from ..policy import Policy

#: A source of further spans: texts of a batch in, for each the spans (a model, a dictionary, ...).
SpanSource = Callable[[list[str]], list[Iterable[Span]]]


def nested(rows: list[list[tuple]], kind: pa.DataType) -> pa.Array:
    """A list of tuples for each row as array<struct>, built by column. Fields that are lists of pairs nest once more."""
    flat = list(chain.from_iterable(rows))
    columns = list(zip(*flat)) if flat else [()] * kind.value_type.num_fields
    fields = [kind.value_type.field(k) for k in range(kind.value_type.num_fields)]
    arrays = [nested(list(v), f.type) if pa.types.is_list(f.type) and pa.types.is_struct(f.type.value_type) else pa.array(v, f.type) for f, v in zip(fields, columns)]
    offsets = pa.array(list(accumulate(map(len, rows), initial=0)), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(arrays, fields=fields), type=kind)


#: What each result column takes from a note's result.
_OF = {
    "masked_text": lambda r: r.masked, "spans": lambda r: [(*s, k) for k, s in enumerate(r.spans)], "segments": lambda r: r.segments, "mapping": lambda r: r.entries,
    "review": lambda r: [(s.start, s.end, s.category, s.text, s.score, p, why) for s, p, why in r.review], "findings": lambda r: r.findings, "blocked": lambda r: r.blocked,
    "patient_key": lambda r: r.patient_key, "date_shift_days": lambda r: r.shift, "n_candidates": lambda r: r.candidates,
}


class Deidentifier:
    """Masks a text column under a policy.

    >>> Deidentifier().transform(docs, "text", key="patient_key").masked  # doctest: +SKIP
    """

    def __init__(self, policy: Policy | None = None, sources: Iterable[SpanSource] = ()):
        self.policy, self.sources = policy or Policy(), tuple(sources)

    def transform(self, docs: DataFrame, text: str = "text", key: str | None = None) -> Deidentified:
        """docs with the columns of schema.RESULT. key: a column that names the patient, for date shifts."""
        policy, sources = self.policy, self.sources
        clash = {c.lower() for c in docs.columns if c != text} & set(_OF)
        if clash:
            raise ValueError(f"columns of the result are there already: {', '.join(sorted(clash))}")
        ids = [c for c in docs.columns if c != text]
        rows = docs.select(*[F.col(f"`{c}`") for c in ids], docs[text].cast("string").alias("_text"), (docs[key].cast("string") if key else F.lit(None).cast("string")).alias("_key"))

        def wanted(names: Iterable[str]) -> DataFrame:
            every = StructType.fromDDL(schema.RESULT)
            added = StructType([every[n] for n in names])
            arrow, audit = to_arrow_schema(added), bool({"findings", "blocked"} & set(names))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    texts, keys = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
                    extra: list[list[Span]] = [[] for _ in texts]
                    for source in sources:
                        for mine, more in zip(extra, source([t or "" for t in texts])):
                            mine += more
                    done = [note.deidentify(t, policy, k, e, audit) for t, k, e in zip(texts, keys, extra)]
                    values = [[_OF[f.name](r) for r in done] for f in arrow]
                    made = [nested(v, f.type) if pa.types.is_list(f.type) else pa.array(v, f.type) for f, v in zip(arrow, values)]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *made], [*batch.schema.names[:-2], *arrow.names])

            return rows.mapInArrow(run, StructType(rows.schema.fields[:-2] + added.fields))

        return Deidentified(wanted, ids)


class Deidentified:
    """The wide result and the tables that follow from it. ids: the documents' own columns."""

    def __init__(self, wanted: Callable[[Iterable[str]], DataFrame], ids: list[str]):
        self._wanted, self.ids = wanted, ids

    def results(self, *names: str) -> DataFrame:
        """The documents' own columns and some of schema.RESULT, from one pass that makes no others."""
        return self._wanted(names)

    @property
    def rows(self) -> DataFrame:
        """All results of each document."""
        return self.results(*_OF)

    def written(self, path: str) -> Deidentified:
        """The same results, written to a folder that all executors share and read from there."""
        self.rows.write.mode("errorifexists").parquet(path)
        spark = self.rows.sparkSession
        return Deidentified(lambda names: spark.read.schema(self.rows.schema).parquet(path).select(*[F.col(f"`{c}`") for c in (*self.ids, *names)]), self.ids)

    def _each(self, array: str) -> DataFrame:
        own = [F.col(f"`{c}`") for c in self.ids]
        return self.results(array).select(*own, F.explode(array).alias("x")).select(*own, "x.*")

    @property
    def masked(self) -> DataFrame:
        return self.results("masked_text", "blocked")

    @property
    def released(self) -> DataFrame:
        """Only what the audit lets through."""
        return self.masked.filter(~F.col("blocked")).drop("blocked")

    @property
    def spans(self) -> DataFrame:
        return self._each("spans")

    @property
    def segments(self) -> DataFrame:
        return self._each("segments")

    @property
    def mapping(self) -> DataFrame:
        """Plain text identifiers: keep it out of logs, or encrypt it (see vault)."""
        return self._each("mapping")

    @property
    def review(self) -> DataFrame:
        return self._each("review")

    @property
    def findings(self) -> DataFrame:
        return self._each("findings")

    @property
    def counts(self) -> DataFrame:
        """Spans by category of each document, retained ones too."""
        by = F.transform(F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["category"]))), lambda c: F.struct(c.alias("category"), F.size(F.filter("spans", lambda s: s["category"] == c)).cast("long").alias("n")))
        return self.results("spans").select(*[F.col(f"`{c}`") for c in self.ids], F.map_from_entries(by).alias("counts"))

    def as_json(self) -> Column:
        """One JSON object a row: masked text, mapping, counts by category, review queue."""
        return F.to_json(F.struct(F.col("masked_text").alias("masked"), "mapping", "review", "blocked"))


def detect_spans(docs: DataFrame, text: str = "text", categories: Iterable[str] | None = None) -> DataFrame:
    """Candidates as the rules and form fields emit them, before any arbitration: docs' columns, spans.

    categories: only these; rules that can't emit them don't run, and seq counts only what is emitted.
    """
    wanted = frozenset(categories) if categories is not None else None
    policy = Policy()
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != text], docs[text].cast("string").alias("_text"))
    added = StructType.fromDDL(f"spans array<{schema.SPAN}>")
    arrow = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                spans, _ = note.candidates_of(t or "", policy, wanted)
                found.append({"spans": [s._asdict() | {"seq": k} for k, s in enumerate(spans)]})
            done = pa.RecordBatch.from_pylist(found, schema=arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *done.columns], [*batch.schema.names[:-1], "spans"])

    return rows.mapInArrow(run, StructType(rows.schema.fields[:-1] + added.fields))


def rehydrate(responses: DataFrame, mapping: DataFrame, on: list[str], response: str = "response") -> DataFrame:
    """responses with rehydrated and n_unknown. mapping: rows with placeholder and canonical, by on.

    The mapping of a session is collected into its row (a note's worth of entries); sessions without
    one have all their placeholders replaced by the marker.
    """
    held = mapping.groupBy(*on).agg(F.collect_list(F.struct("placeholder", "canonical")).alias("_entries"))
    joined = responses.join(held, on, "left")
    added = StructType.fromDDL("rehydrated string, n_unknown int")
    at, entries_at = joined.columns.index(response), joined.columns.index("_entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [rehydrate_text(r or "", [(e["placeholder"], e["canonical"]) for e in entries or []]) for r, entries in zip(batch.column(at).to_pylist(), batch.column(entries_at).to_pylist())]
            kept = [(n, c) for k, (n, c) in enumerate(zip(batch.schema.names, batch.columns)) if k != entries_at]
            yield pa.RecordBatch.from_arrays([*[c for _, c in kept], pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int32())], [*[n for n, _ in kept], "rehydrated", "n_unknown"])

    return joined.mapInArrow(run, StructType([f for f in joined.schema.fields if f.name != "_entries"] + added.fields))


def category_table(spark, policy: Policy | None = None) -> DataFrame:
    """category, hipaa, action, threshold: 24 rows, the dimension that lookups broadcast."""
    p = policy or Policy()
    return spark.createDataFrame([(c, n, "mask" if p.masks(c) else "retain", p.threshold(c)) for c, n in vocab.HIPAA.items()], "category string, hipaa int, action string, threshold double")
