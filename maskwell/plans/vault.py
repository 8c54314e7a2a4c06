"""Mappings at rest: AES-GCM by Spark's own functions, bound to their session, with an expiry."""

from __future__ import annotations

import base64
import hashlib
import os

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema


def load_key(env: str = "MASKWELL_VAULT_KEY") -> bytes:
    """32 bytes: the variable's base64, else its own bytes, other lengths hashed; random if unset."""
    value = os.environ.get(env)
    if not value:
        return os.urandom(32)
    try:
        raw = base64.b64decode(value, validate=True)
    except ValueError:
        raw = value.encode()
    return raw if len(raw) == 32 else hashlib.sha256(raw).digest()


def seal(sessions: DataFrame, key: bytes, ttl_seconds: int, session: str = "session_id", mapping: str = "mapping", now: Column | None = None) -> DataFrame:
    """session, ciphertext, expires_at. The session id is authenticated, so a record opens only under it."""
    text = F.to_json(F.col(mapping)) if dict(sessions.dtypes)[mapping] != "string" else F.col(mapping)
    # The nonce is 12 random bytes that Spark draws for each row.
    sealed = F.aes_encrypt(text, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), F.col(session).cast("string"))
    return sessions.select(session, sealed.alias("ciphertext"), ((now if now is not None else F.current_timestamp()) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_seconds))).alias("expires_at"))


def unseal(records: DataFrame, key: bytes, session: str = "session_id", now: Column | None = None) -> DataFrame:
    """session, mapping_json; expired records, and those of another session or key, are absent."""
    text = F.try_aes_decrypt("ciphertext", F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.col(session).cast("string")).cast("string")
    return live(records, now).select(session, text.alias("mapping_json")).filter(F.col("mapping_json").isNotNull())


def live(records: DataFrame, now: Column | None = None) -> DataFrame:
    return records.filter(F.col("expires_at") > (now if now is not None else F.current_timestamp()))


def entries_of(mapping_json: Column) -> Column:
    return F.from_json(mapping_json, f"array<{schema.ENTRY}>")
