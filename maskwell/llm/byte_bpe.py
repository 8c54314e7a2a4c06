"""Byte-level BPE encoding and decoding over a public rank file.

A text is cut by the tokenizer's pattern and each piece is merged by itself. A segment tree over the
piece's byte positions holds at each leaf the rank of the pair that begins there (if its bytes are a
token), together with the position, so the root is the leftmost pair of minimum rank. A merge sets
the pair's own leaf and those of its live neighbours and updates their paths to the root, a
logarithmic number of nodes. Pieces of up to 64 bytes are merged many at a time: one tree a piece, as
rows of one array. Longer pieces (no white space for megabytes, say) get a tree of their own and
cost n log n. Pieces that were merged before come from a table of bounded size.

Ids are decoded by the same rank file; the bytes come back exactly, as each byte is a token.

Defined results for odd input: null text counts as empty and has no ids; rows that repeat are encoded
each by itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces that the table of merged pieces holds, and characters of text whose new pieces are merged at once.
TABLE_PIECES, BLOCK_CHARS = 200_000, 1_000_000
_NONE = np.int64(1 << 62)
_WIDTHS = (2, 4, 8, 16, 32, 64)
#: Pieces merged at once at most, and bytes of them.
_ROWS, _CELLS = 8192, 1 << 17


class BytePairCodec:
    """Encoder and decoder for one rank file (its bytes) and pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.pattern = regex.compile(pattern)
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines())}
        self.ranks, self.numbers = ranks, list(range(max(ranks.values()) + 1))
        self.tokens = [b""] * len(self.numbers)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.decimals = list(map(str, self.numbers))
        self.bytes_to_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = sorted((ranks[t[:k]] << 32 | ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
        self.pair_keys, self.pair_ranks = np.array([k for k, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64)
        self.pair_rank = dict(pairs)
        self.table: dict[str, tuple[int, ...]] = {}

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; _NONE where it is no token, or an id is negative."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (right >= 0), self.pair_ranks[at], _NONE)

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        """Merges pieces of at most width bytes, each in its own tree."""
        n, shift = len(pieces), width.bit_length() - 1
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        inside = np.arange(width) < lengths[:, None]
        # One column more on either side than positions: no neighbour there, id -1.
        ids = np.full((n, width + 2), -1, np.int64)
        ids[:, 1:-1] = np.where(inside, self.bytes_to_id[raw], -1)
        after = np.tile(np.arange(1, width + 3), (n, 1))
        before = np.tile(np.arange(-1, width + 1), (n, 1))
        tree = np.full((n, 2 * width), _NONE, np.int64)

        def leaves(rank: np.ndarray, position: np.ndarray) -> np.ndarray:
            return np.where(rank == _NONE, _NONE, rank << shift | position)

        first, second = ids[:, 1:-1], ids[:, 2:]
        tree[:, width:] = leaves(np.where(first >= 0, self._lookup(np.maximum(first, 0), second), _NONE), np.arange(width))
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        rows = np.nonzero(tree[:, 1] < _NONE)[0]
        while len(rows):
            root = tree[rows, 1]
            rank, at = root >> shift, (root & (width - 1)) + 1
            gone = after[rows, at]
            follows, leads = after[rows, gone], before[rows, at]
            ids[rows, at], ids[rows, gone] = rank, -1
            after[rows, at] = follows
            before[rows, follows] = at
            has_lead = leads > 0
            lead = np.where(has_lead, leads, at)  # without a neighbour the own leaf is set once more, last
            own = leaves(self._lookup(rank, ids[rows, follows]), at - 1)
            left = np.where(has_lead, leaves(self._lookup(np.maximum(ids[rows, lead], 0), rank), lead - 1), own)
            tree[rows, width + gone - 1] = _NONE
            tree[rows, width + at - 1] = own
            tree[rows, width + lead - 1] = left
            for position in (gone, at, lead):
                node = (width + position - 1) >> 1
                for _ in range(shift):
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node = node >> 1
            rows = rows[tree[rows, 1] < _NONE]
        kept = ids[:, 1:-1]
        live = kept >= 0
        flat, ends = kept[live].tolist(), np.cumsum(live.sum(axis=1)).tolist()
        number, start, out = self.numbers, 0, []
        for end in ends:
            out.append(tuple([number[x] for x in flat[start:end]]))
            start = end
        return out

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """Merges one piece of any length."""
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        none, pair_rank = 1 << 62, self.pair_rank
        shift = width.bit_length() - 1
        ids, after, before = self.bytes_to_id[list(piece)].tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        leaf = [none if (r := pair_rank.get(ids[i] << 32 | ids[i + 1])) is None else r << shift | i for i in range(n - 1)]
        tree = [none] * width + leaf + [none] * (width - n + 1)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(position: int, left: int, right: int) -> None:
            rank = pair_rank.get(left << 32 | right) if left >= 0 and right >= 0 else None
            node = width + position
            tree[node] = none if rank is None else rank << shift | position
            node >>= 1
            while node:
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    break
                tree[node] = low
                node >>= 1

        while tree[1] < none:
            rank, at = tree[1] >> shift, tree[1] & (width - 1)
            gone = after[at]
            follows, lead = after[gone], before[at]
            ids[at], ids[gone], after[at] = rank, -1, follows
            if follows < n:
                before[follows] = at
            put(gone, -1, -1)
            put(at, rank, ids[follows] if follows < n else -1)
            if lead >= 0:
                put(lead, ids[lead], rank)
        return tuple(x for x in ids if x >= 0)

    def merge(self, pieces: list[str]) -> None:
        """Puts pieces into the table."""
        if len(self.table) + len(pieces) > TABLE_PIECES:
            self.table.clear()
        by_width: dict[int, list[tuple[str, bytes]]] = {w: [] for w in _WIDTHS}
        for piece in pieces:
            raw = piece.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                self.table[piece] = (rank,)
            elif len(raw) > _WIDTHS[-1]:
                self.table[piece] = self._merge_long(raw)
            else:
                by_width[1 << (len(raw) - 1).bit_length()].append((piece, raw))
        for width, own in by_width.items():
            step = min(_ROWS, _CELLS // width)
            for k in range(0, len(own), step):
                rows = own[k : k + step]
                self.table.update(zip((p for p, _ in rows), self._merge_rows([r for _, r in rows], width)))

    def encode_many(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """The ids of each text, without special tokens. Blocks of texts bound what is held."""
        block, size = [], 0
        for text in texts:
            block.append(self.pattern.findall(text))
            size += len(text)
            if size >= BLOCK_CHARS:
                yield from self._encode_block(block)
                block, size = [], 0
        yield from self._encode_block(block)

    def _encode_block(self, block: list[list[str]]) -> Iterator[list[int]]:
        new = set(chain.from_iterable(block)).difference(self.table)
        if len(self.table) + len(new) > TABLE_PIECES:  # then all pieces of the block are needed again
            self.table.clear()
            new = set(chain.from_iterable(block))
        self.merge(list(new))
        get = self.table.__getitem__
        for pieces in block:
            yield list(chain.from_iterable(map(get, pieces)))
        if len(self.table) > TABLE_PIECES:
            self.table.clear()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decimal(self, ids: list[int]) -> str:
        return " ".join(map(self.decimals.__getitem__, ids))


_codecs: dict[str, BytePairCodec] = {}


def codec(rank_file: bytes, pattern: str) -> BytePairCodec:
    """One codec for each rank file and pattern in a worker process."""
    key = hashlib.sha256(rank_file + pattern.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = BytePairCodec(rank_file, pattern)
    return _codecs[key]


def _with_codec(df: DataFrame, work, schema: str, vocabulary: str | None, pattern: str | None) -> DataFrame:
    """df.mapInArrow(work) with a codec; the driver reads the rank file (under 1 MB) and sends it along."""
    with open(vocabulary or public_tokenizers.path(VOCABULARY), "rb") as file:
        sent = df.sparkSession.sparkContext.broadcast((file.read(), pattern or public_tokenizers.PATTERN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*sent.value)
        for batch in batches:
            yield from work(own, batch)

    return df.mapInArrow(lambda batches: common.handing_back(run(batches)), schema)


def encode_documents(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>) for every row of docs."""
    def work(own: BytePairCodec, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = list(own.encode_many(x.as_py() for x in batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(len, ids)), pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_of(docs).alias("text"))
    return _with_codec(rows, work, "doc_id long, n_tokens long, ids array<int>", vocabulary, pattern)


def decode_documents(encoded: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, content (binary) for every row of encoded (doc_id, ids); null ids count as none."""
    def work(own: BytePairCodec, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        content = [own.decode(ids or []) for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(content, pa.binary())], ["doc_id", "content"])

    return _with_codec(encoded.select("doc_id", "ids"), work, "doc_id long, content binary", vocabulary, pattern)


def round_trip_digests(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """The contract's row for each document: digests of its ids and of the bytes decoded from them."""
    def work(own: BytePairCodec, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts, id_digests, text_digests = [], [], []
        for ids in own.encode_many(x.as_py() for x in batch.column("text")):
            counts.append(len(ids))
            id_digests.append(hashlib.sha256(own.decimal(ids).encode()).hexdigest())
            text_digests.append(hashlib.sha256(own.decode(ids)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_of(docs).alias("text"))
    return _with_codec(rows, work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", vocabulary, pattern)
