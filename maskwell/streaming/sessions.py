"""Streams of notes, and a keyed store of sealed mappings that forgets by itself.

De-identification keeps no state between rows, so Deidentifier.transform runs on a stream as it is
(append mode, no watermark). The vault is a stateful operator: one value a session with a
time-to-live, so nothing needs to purge it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.deidentify import Deidentifier
from ..policy import Policy

OUTPUT = "session_id string, op string, status string, ciphertext binary"


def deidentify_stream(notes: DataFrame, text: str = "text", key: str | None = None, policy: Policy | None = None) -> DataFrame:
    return Deidentifier(policy).transform(notes, text, key).rows


class _Vault(StatefulProcessor):
    def __init__(self, ttl_seconds: int):
        self.ttl_ms = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("sealed", "ciphertext binary", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for pdf in rows:
            for op, sealed in zip(pdf["op"], pdf["ciphertext"]):
                if op == "put":
                    self.held.update((sealed,))
                    out.append((key[0], op, "ok", None))
                elif op == "delete":
                    self.held.clear()
                    out.append((key[0], op, "ok", None))
                else:
                    there = self.held.exists()
                    out.append((key[0], op, "ok" if there else "expired", bytes(self.held.get()[0]) if there else None))
        yield pd.DataFrame(out, columns=["session_id", "op", "status", "ciphertext"])

    def close(self) -> None:
        pass


def vault_stream(requests: DataFrame, ttl_seconds: int) -> DataFrame:
    """Answers to requests (session_id, op: put, get or delete, ciphertext), in order within a batch.

    Only ciphertext is in the state. Needs the RocksDB state store and processing time.
    """
    return requests.groupBy("session_id").transformWithStateInPandas(_Vault(ttl_seconds), OUTPUT, "Append", "ProcessingTime")
