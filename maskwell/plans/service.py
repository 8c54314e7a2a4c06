"""Request tables: notes in, masked text out; answers of a language model in, real values out.

The mapping never leaves in a response: it goes to the vault, sealed under its session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..policy import Policy
from ..sources import files
from . import vault
from .deidentify import Deidentifier, rehydrate


#: Statuses of requests, with the number that a web service would answer.
STATUS = {"ok": 200, "unknown": 404, "blocked": 409, "expired": 410, "unreadable": 415, "unavailable": 503}


class Submitted(NamedTuple):
    responses: DataFrame  # session_id, status, masked_text, blocked, counts, findings
    records: DataFrame  # session_id, ciphertext, expires_at
    review: DataFrame  # session_id and the spans of the review band


def counts_of(spans: str) -> Column:
    """map<category, n> of an array of spans."""
    names = F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["category"])))
    return F.map_from_entries(F.transform(names, lambda c: F.struct(c.alias("k"), F.size(F.filter(spans, lambda s: s["category"] == c)).alias("n"))))


def submit(requests: DataFrame, key: bytes, policy: Policy | None = None, shared: str | None = None) -> Submitted:
    """requests: session_id, text, and optionally patient_key and read_error (what kept a text from being read).

    shared: a folder that all executors share; the notes are then masked once for all three tables,
    else once for each.
    """
    p = policy or Policy()
    if "read_error" not in requests.columns:
        requests = requests.withColumn("read_error", F.lit(None).cast("string"))
    done = Deidentifier(p).transform(requests.select("session_id", "text", "read_error", *(["patient_key"] if "patient_key" in requests.columns else [])).withColumnsRenamed({"patient_key": "_patient"}), "text", "_patient" if "patient_key" in requests.columns else None)
    if shared:
        done = done.written(shared)
    found = F.transform("findings", lambda f: F.struct(f["category"].alias("category"), f["start"].alias("start"), f["end"].alias("end"), f["detector"].alias("detector")))
    status = F.when(F.col("read_error").isNotNull(), "unreadable").when(F.col("blocked"), "blocked").otherwise("ok")
    answers = done.results("masked_text", "blocked", "spans", "findings").select("session_id", status.alias("status"), "masked_text", "blocked", counts_of("spans").alias("counts"), found.alias("findings"))
    sealed = vault.seal(done.results("mapping").filter("read_error is null").select("session_id", "mapping"), key, p.vault_ttl_seconds)
    return Submitted(answers, sealed, done.review.drop("read_error", "_patient"))


def upload(files_: DataFrame, key: bytes, policy: Policy | None = None, shared: str | None = None) -> Submitted:
    """files_: session_id, path (its suffix says how to read it), content (bytes). Nothing is written to a file."""
    read = files.decoded(files_, ["session_id"])
    return submit(read.select("session_id", "text", "read_error"), key, policy, shared)


def logged(responses: DataFrame, keep: int = 5) -> DataFrame:
    """What a log may hold of blocked notes: the first findings, without any text."""
    return responses.filter(F.size("findings") > 0).select("session_id", F.size("findings").alias("n"), F.slice("findings", 1, keep).alias("findings"))


def restore(answers: DataFrame, records: DataFrame, key: bytes) -> DataFrame:
    """answers (session_id, response) with rehydrated, n_unknown, expired (no live mapping) and status (ok, expired or unknown)."""
    opened = vault.unseal(records, key).select("session_id", F.explode_outer(vault.entries_of(F.col("mapping_json"))).alias("e")).select("session_id", "e.placeholder", "e.canonical")
    known = records.groupBy("session_id").agg(F.max((F.col("expires_at") > F.current_timestamp()).cast("int")).alias("_live"))
    back = rehydrate(answers, opened.filter("placeholder is not null"), ["session_id"]).join(known, "session_id", "left")
    status = F.when(F.col("_live").isNull(), "unknown").when(F.col("_live") == 0, "expired").otherwise("ok")
    return back.withColumn("expired", F.coalesce(F.col("_live") == 0, F.lit(True))).withColumn("status", status).drop("_live")


def forget(records: DataFrame, sessions: DataFrame) -> DataFrame:
    """records without those of sessions (session_id)."""
    return records.join(sessions.select("session_id").distinct(), "session_id", "left_anti")


def health(records: DataFrame) -> DataFrame:
    """One row: sessions that are live and expired."""
    live = F.col("expires_at") > F.current_timestamp()
    return records.agg(F.lit("ok").alias("status"), F.count(F.when(live, 1)).alias("live"), F.count(F.when(~live, 1)).alias("expired"))


def round_trip(requests: DataFrame, key: bytes, providers: Iterable[Provider], policy: Policy | None = None, shared: str | None = None) -> DataFrame:
    """session_id, status, answer: masked, asked, and put back. Blocked notes are never sent.

    The providers' calls run on executors, a note at a time; status is unavailable where none answers.
    """
    sent, asked = submit(requests, key, policy, shared), tuple(providers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for status, prompt in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                answer = None
                if status == "ok":
                    try:
                        answer = complete(prompt, asked)[0]
                    except ModelUnavailable:
                        status = "unavailable"
                out.append((status, answer))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in out], pa.string()), pa.array([a for _, a in out], pa.string())], ["session_id", "status", "response"])

    answered = sent.responses.select(F.col("session_id").cast("string").alias("session_id"), "status", "masked_text").mapInArrow(run, "session_id string, status string, response string")
    back = restore(answered.select("session_id", F.col("status").alias("_sent"), "response"), sent.records.withColumn("session_id", F.col("session_id").cast("string")), key)
    ok = F.col("_sent") == "ok"
    return back.select("session_id", F.when(ok, F.col("status")).otherwise(F.col("_sent")).alias("status"), F.when(ok, F.col("rehydrated")).alias("answer"))


class ModelUnavailable(RuntimeError):
    """No provider answered."""


class Provider(NamedTuple):
    """A language model behind two calls; the network is the caller's."""

    name: str
    list_models: Callable[[], list[str]]
    complete: Callable[[str, str], str]  # model, prompt
    prefer: tuple[str, ...] = ()


def choose_model(served: list[str], prefer: Iterable[str]) -> str | None:
    """The first preference that is served, exactly or as a part; else a chat model; else the first preference."""
    for want in prefer:
        hit = want if want in served else next((m for m in served if want in m), None)
        if hit:
            return hit
    return next((m for m in served if "instruct" in m or "chat" in m), None) or next(iter(prefer), None) or next(iter(served), None)


def complete(prompt: str, providers: Iterable[Provider]) -> tuple[str, str, str]:
    """(text, provider, model) of the first provider that answers."""
    reasons = []
    for p in providers:
        try:
            model = choose_model(p.list_models(), p.prefer)
            if model is None:
                raise ModelUnavailable("serves no model")
            return p.complete(model, prompt), p.name, model
        except Exception as e:  # the next provider may do
            reasons.append(f"{p.name}: {e}")
    raise ModelUnavailable("; ".join(reasons) or "no providers")
