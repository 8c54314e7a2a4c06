"""Exact dedup against a minimal perfect hash over historical distinct digests.

The history is reduced to one row for each distinct SHA-256 digest and cut into shards by digest.
Each shard gets a minimal perfect hash: a cascade of bit arrays in which a key owns the first
position that no other remaining key hits, and the rank of that bit is its slot. Slots hold the
full 32-byte digest and the locator of the winning row, so a lookup compares all bytes and a digest
that the history lacks can't pass as a member. An incoming batch is first reduced to one row per
digest as well (a text that makes up a third of all rows is then one lookup), members are resolved
against their slot, and nonmembers group among themselves.

Defined results for odd input: null text counts as empty; a null doc_id ranks below every other;
rows that repeat in doc_id and text count as copies and just one of them stays; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import common

#: Bits of a level for each key that is left; 2 settles about 60 % of the keys a level.
GAMMA = 2.0
MAX_LEVELS = 256
#: Keys that a shard has at most on average, which bounds a task's memory (about 100 bytes a key).
SHARD_KEYS = 40_000
MIN_SHARDS = 64

_GROUP = "shard int, digest binary, has_id boolean, win_id long, win_row long, n long"
_INDEX = "shard int, n int, level_bits binary, bits binary, digests binary, has_ids binary, win_ids binary, win_rows binary, counts binary"
_RESOLVED = "digest binary, has_id boolean, win_id long, win_row long, n long, member boolean"


def _mix(words: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of the digest's first 16 bytes for one level (splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = words[:, 0] ^ (words[:, 1] * np.uint64(2 * level + 1)) ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _words(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests[:, :16]).view(np.uint64)


class MinimalPerfectHash:
    """Maps each of n distinct 32-byte digests to its own slot in 0..n-1."""

    def __init__(self, level_bits: np.ndarray, bits: np.ndarray):
        self.level_bits, self.bits = level_bits, bits
        self.starts = np.concatenate([[0], np.cumsum(level_bits)])
        self.ranks = np.concatenate([[0], np.cumsum(bits)])

    @classmethod
    def build(cls, digests: np.ndarray) -> MinimalPerfectHash:
        words, left, sizes, arrays = _words(digests), np.arange(len(digests)), [], []
        while len(left):
            if len(sizes) == MAX_LEVELS:
                raise ValueError("digests are not distinct")
            size = max(64, int(len(left) * GAMMA))
            at = _mix(words[left], len(sizes)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size)[at.astype(np.int64)] == 1
            level = np.zeros(size, bool)
            level[at[alone].astype(np.int64)] = True
            sizes.append(size)
            arrays.append(level)
            left = left[~alone]
        return cls(np.array(sizes, np.int64), np.concatenate(arrays) if arrays else np.zeros(0, bool))

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """A slot for each digest, -1 where no level has its bit. Members get their own slot."""
        words, out, left = _words(digests), np.full(len(digests), -1, np.int64), np.arange(len(digests))
        for level, size in enumerate(self.level_bits):
            at = self.starts[level] + (_mix(words[left], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            out[left[hit]] = self.ranks[at[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(pdf["digest"])
    mph = MinimalPerfectHash.build(digests)
    order = np.argsort(mph.slots(digests))
    held = pdf.iloc[order]
    return pd.DataFrame([{
        "shard": pdf["shard"].iloc[0], "n": len(pdf), "level_bits": mph.level_bits.tobytes(), "bits": np.packbits(mph.bits).tobytes(),
        "digests": digests[order].tobytes(), "has_ids": held["has_id"].to_numpy(np.uint8).tobytes(), "win_ids": held["win_id"].to_numpy(np.int64).tobytes(),
        "win_rows": held["win_row"].to_numpy(np.int64).tobytes(), "counts": held["n"].to_numpy(np.int64).tobytes(),
    }])


def _resolve_shard(incoming: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(incoming["digest"])
    slots, held = np.full(len(incoming), -1, np.int64), {"digest": np.zeros((0, 32), np.uint8), "has_id": np.zeros(0, bool), "win_id": np.zeros(0, np.int64), "win_row": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)}
    if len(index):
        row = index.iloc[0]
        sizes = np.frombuffer(row["level_bits"], np.int64)
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(sizes.sum())).astype(bool)
        held = {"digest": np.frombuffer(row["digests"], np.uint8).reshape(-1, 32), "has_id": np.frombuffer(row["has_ids"], np.uint8).astype(bool)} | {
            k: np.frombuffer(row[v], np.int64) for k, v in (("win_id", "win_ids"), ("win_row", "win_rows"), ("n", "counts"))
        }
        slots = MinimalPerfectHash(sizes, bits).slots(digests)
        found = slots >= 0
        found[found] = (held["digest"][slots[found]] == digests[found]).all(axis=1)  # every byte, not just the hash
        slots[~found] = -1
    hit = slots >= 0
    new = {"has_id": incoming["has_id"].to_numpy(bool), "win_id": incoming["win_id"].to_numpy(np.int64), "win_row": incoming["win_row"].to_numpy(np.int64), "n": incoming["n"].to_numpy(np.int64)}
    merged = {k: v.copy() for k, v in held.items()}
    s = slots[hit]
    if len(s):
        a, b = [held[k][s] for k in ("has_id", "win_id", "win_row")], [new[k][hit] for k in ("has_id", "win_id", "win_row")]
        later = (b[0] & ~a[0]) | ((b[0] == a[0]) & ((b[1] > a[1]) | ((b[1] == a[1]) & (b[2] > a[2]))))
        for k in ("has_id", "win_id", "win_row"):
            merged[k][s] = np.where(later, new[k][hit], held[k][s])
        merged["n"][s] += new["n"][hit]
    every = np.concatenate([merged["digest"], digests[~hit]])
    out = {k: np.concatenate([merged[k], new[k][~hit]]) for k in ("has_id", "win_id", "win_row", "n")}
    return pd.DataFrame({"digest": [x.tobytes() for x in every]} | out | {"member": np.arange(len(every)) < len(merged["n"])})


def _groups(rows: DataFrame, shards: int) -> DataFrame:
    """One row for each digest: its winner (largest doc_id, then row) and how many rows it has."""
    best = F.max(F.struct("doc_id", "row")).alias("best")
    return rows.groupBy("digest").agg(best, F.count(F.lit(1)).alias("n")).select(
        F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard"), "digest", F.col("best.doc_id").isNotNull().alias("has_id"),
        F.coalesce("best.doc_id", F.lit(0)).cast("long").alias("win_id"), F.col("best.row").alias("win_row"), "n",
    )


def shards_for(rows: int) -> int:
    return max(MIN_SHARDS, -(-rows // SHARD_KEYS))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The index of history (columns digest, doc_id, row): one row for each shard, in the shared folder."""
    return common.materialise(_groups(history, shards).groupBy("shard").applyInPandas(_build_shard, _INDEX), "mph")


def resolve(incoming: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """One row for each digest of the history or of incoming: the winner among both, and the size."""
    def lookup(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _resolve_shard(left, right)

    return _groups(incoming, shards).groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(lookup, _RESOLVED)


def digest_rows(docs: DataFrame, normalise: Callable[[Column], Column] = lambda text: text, place: str | None = None) -> DataFrame:
    """(doc_id, row, place, digest) of every row, written once; row tells rows with equal ids apart, place is a column of docs."""
    text = normalise(common.text_of(docs))
    own = docs[place] if place else F.lit(None).cast("struct<file: bigint, at: bigint>")
    return common.materialise(docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), own.alias("place"), F.unhex(F.sha2(text, 256)).alias("digest")), "digests")


def judged(rows: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """rows (from digest_rows) with what exact_dedup says of them."""
    low, high, total = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    shards, batch = shards_for(total), rows
    if history is None:
        middle = low + (high - low) // 2 if low is not None else 0
        older = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
        history, batch = rows.filter(older), rows.filter(~older)
    groups = common.materialise(resolve(batch, build_index(history, shards), shards), "winners")
    keep = F.when(F.col("has_id"), F.col("win_id"))
    return common.join_groups(rows, groups, "digest", "n").select(
        "doc_id", "place", keep.alias("keep_id"), F.col("n").alias("group_size"), ((F.col("row") == F.col("win_row")) & F.col("doc_id").eqNullSafe(keep)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), F.col("member").alias("in_history"),
    )


def exact_dedup(docs: DataFrame, normalise: Callable[[Column], Column] = lambda text: text, history: DataFrame | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, in_history for every row of docs.

    history: (digest, doc_id, row) of earlier batches, from digest_rows. By default the older half
    of the ids of docs (up to the middle between the smallest and the largest) is the history and
    the other rows are the batch that is looked up; the result is the same for any such cut.
    """
    return judged(digest_rows(docs, normalise), history).drop("place")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup drops; its own columns only."""
    rows, row = common.numbered(docs)
    dropped = judged(digest_rows(rows, place=row)).filter(~F.col("kept")).select(F.col("place").alias(row))
    return common.without(rows, row, common.materialise(dropped, "repeats"))
