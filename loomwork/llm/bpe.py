"""Byte-level BPE encoding and decoding in padded numpy matrices.

Distinct pre-tokens are bucketed by byte length and laid out as rows of a
padded matrix.  In each round every row merges its leftmost pair of minimum
rank; pair ranks come from an open-addressing hash table held in two numpy
arrays, finished rows are compacted away, and the matrix loses one column.
A pre-token of over ``LONG`` bytes is a matrix of its own, whose rows are its
segments, and its leftmost minimum-rank pair is found by the segments' minima.
The encoded form of a pre-token is kept in a bounded cache of the worker.

Defined results: a null or empty text has no ids and decodes to no bytes; rows
with a null ``doc_id`` and repeated rows are encoded like any other; of equal
ranks (ties) the leftmost merges; very long texts are encoded whole; an empty
table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm._shared import documents, id_text, map_batches, vocabulary_path

NONE = np.int32(2**31 - 1)
_EMPTY = np.int64(-1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank of each line of a tiktoken rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """All pairs of tokens whose joined bytes are a token, hashed by (left, right).

    Its size is fixed by the vocabulary, so it can be broadcast.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.first = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 31 | right)
                    values.append(rank)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 1.6))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, _EMPTY, dtype=np.int64)
        self.values = np.full(1 << bits, NONE, dtype=np.int32)
        keys, values = np.array(keys, dtype=np.int64), np.array(values, dtype=np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == _EMPTY
            _, one = np.unique(slot, return_index=True)  # one claimant for each slot
            placed = np.zeros(len(keys), dtype=bool)
            placed[one] = True
            placed &= free
            self.keys[slot[placed]], self.values[slot[placed]] = keys[placed], values[placed]
            slot, keys, values = (slot[~placed] + 1) & self.mask, keys[~placed], values[~placed]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it does not merge or is padding."""
        key = left.astype(np.int64) << 31 | right.astype(np.int64)
        out = np.full(key.shape, NONE, dtype=np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        key = key.ravel()[at]
        slot = self._slot(key)
        flat = out.ravel()
        while len(at):
            found = self.keys[slot]
            hit = found == key
            flat[at[hit]] = self.values[slot[hit]]
            go = ~hit & (found != _EMPTY)
            at, key, slot = at[go], key[go], (slot[go] + 1) & self.mask
        return flat.reshape(out.shape)


def _merge_matrix(table: PairTable, pieces: list[bytes]) -> list[bytes]:
    """The ids, as little-endian bytes, of pieces of about one length."""
    width = max(map(len, pieces))
    raw = np.zeros((len(pieces), width), dtype=np.uint8)
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    inside = np.arange(width) < lengths[:, None]
    raw[inside] = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    ids = np.where(inside, table.first[raw], np.int32(-1))
    row, out = np.arange(len(pieces)), [b""] * len(pieces)
    rank = table.rank(ids[:, :-1], ids[:, 1:])

    def finish(which: np.ndarray) -> None:
        lines = ids[which]
        full = lines >= 0
        data, ends = lines[full].astype("<u4").tobytes(), (4 * full.sum(axis=1).cumsum()).tolist()
        for r, start, end in zip(row[which].tolist(), [0, *ends], ends, strict=False):
            out[r] = data[start:end]

    while rank.shape[1] and len(row):
        at = rank.argmin(axis=1)  # the first of equal minima
        least = rank[np.arange(len(row)), at]
        done = least == NONE
        if done.any():
            finish(done)
            row, ids, rank, at, least = (x[~done] for x in (row, ids, rank, at, least))
            if not len(row):
                return out
        n, lines = len(row), np.arange(len(row))
        ids[lines, at] = least
        keep = np.ones(ids.shape, dtype=bool)
        keep[lines, at + 1] = False
        ids = ids[keep].reshape(n, -1)
        keep = np.ones(rank.shape, dtype=bool)
        keep[lines, at] = False
        rank = rank[keep].reshape(n, -1)
        if rank.shape[1]:
            for side, ok in ((at, at < rank.shape[1]), (at - 1, at > 0)):
                r, c = lines[ok], side[ok]
                rank[r, c] = table.rank(ids[r, c], ids[r, c + 1])
            used = int((ids >= 0).sum(axis=1).max())
            if used < ids.shape[1]:
                ids, rank = ids[:, :used], rank[:, : max(0, used - 1)]
    finish(np.ones(len(row), dtype=bool))
    return out


def _merge_folded(table: PairTable, piece: bytes) -> bytes:
    """The ids of one long piece, folded into a matrix of segments.

    Each round merges the leftmost pair of minimum rank, as in
    ``_merge_matrix``; the least rank of every segment is kept, so that a round
    looks at one segment and not at the whole piece.  Merged ids leave gaps
    that links step over.
    """
    ids = table.first[np.frombuffer(piece, dtype=np.uint8)].astype(np.int64)
    n = len(ids)
    width = max(64, int(n**0.5))
    rank = np.full(-(-n // width) * width, NONE, dtype=np.int32)
    rank[: n - 1] = table.rank(ids[:-1], ids[1:])
    folded = rank.reshape(-1, width)
    least = folded.min(axis=1)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    of = lambda a, b: table.ranks.get(table.bytes_of[int(ids[a])] + table.bytes_of[int(ids[b])], NONE)
    while True:
        segment = int(least.argmin())
        if least[segment] == NONE:
            return ids[ids >= 0].astype("<u4").tobytes()
        i = segment * width + int(folded[segment].argmin())  # the first of equal minima
        gone, left = int(after[i]), int(before[i])
        ids[i], ids[gone] = rank[i], -1
        right = int(after[gone])
        after[i] = right
        rank[gone], rank[i] = NONE, NONE
        if right < n:
            before[right] = i
            rank[i] = of(i, right)
        if left >= 0:
            rank[left] = of(left, i)
        for k in {segment, gone // width, max(left, 0) // width}:
            least[k] = folded[k].min()


class Encoder:
    """Encodes texts with a pair table and a bounded cache of pre-tokens."""

    #: Cached pre-tokens and their longest length; cells of one matrix; bytes from which a piece is folded into a matrix of its own.
    CACHED, CACHED_LENGTH, CELLS, LONG = 500_000, 64, 1 << 20, 2048

    def __init__(self, table: PairTable, cached: int = CACHED):
        import regex

        self.table, self.cache, self.cached = table, {}, cached
        pattern = regex.compile(table.pattern)
        self.find, self.findall = pattern.finditer, pattern.findall

    def encode_pieces(self, pieces: Iterable[bytes]) -> dict[bytes, bytes]:
        """The ids of each distinct piece."""
        ranks, out, buckets = self.table.ranks, {}, {}
        for p in pieces:
            if (r := ranks.get(p)) is not None:
                out[p] = r.to_bytes(4, "little")
            elif len(p) > self.LONG:
                out[p] = _merge_folded(self.table, p)
            else:
                buckets.setdefault((len(p) - 1).bit_length(), []).append(p)
        for bits, group in buckets.items():
            rows = max(1, self.CELLS >> bits)
            for k in range(0, len(group), rows):
                part = group[k : k + rows]
                out.update(zip(part, _merge_matrix(self.table, part), strict=True))
        return out

    def known(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """A mapping that has all the given pre-tokens."""
        new = set(pieces).difference(self.cache)
        if not new:
            return self.cache
        byte = {p: p.encode() for p in new}
        done = self.encode_pieces(byte.values())
        fresh = {p: done[b] for p, b in byte.items()}
        old, short = self.cache, {p: x for p, x in fresh.items() if len(p) <= self.CACHED_LENGTH}
        if len(old) + len(short) > self.cached:
            self.cache = {}
        if len(short) <= self.cached:
            self.cache.update(short)
        return self.cache if self.cache is old and len(short) == len(fresh) else _Both(fresh, old)

    def pieces(self, text: str, at_once: int = 1 << 16) -> Iterator[list[str]]:
        """The pre-tokens in order, in lists of a bounded number."""
        if len(text) <= at_once:
            yield self.findall(text)
            return
        found = (m.group() for m in self.find(text))
        while part := list(islice(found, at_once)):
            yield part

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        lists = [list(self.pieces(t)) for t in texts]
        find = self.known(set().union(*[part for parts in lists for part in parts])).__getitem__
        for parts in lists:
            yield b"".join([x for part in parts for x in map(find, part)])


class _Both(dict):
    """Fresh pieces, then those that the cache held before."""

    def __init__(self, fresh: dict, rest: dict):
        super().__init__(fresh)
        self.rest = rest

    def __missing__(self, piece: str) -> bytes:
        return self.rest[piece]


class Decoder:
    """Bytes of ids: one gather over the concatenated token bytes."""

    def __init__(self, table: PairTable):
        top = max(table.bytes_of, default=-1) + 1
        tokens = [table.bytes_of.get(i, b"") for i in range(top)]
        self.length = np.fromiter(map(len, tokens), dtype=np.int64, count=top)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]]) if top else np.zeros(0, dtype=np.int64)
        self.data = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def decode(self, ids: bytes) -> bytes:
        i = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        if not len(i):
            return b""
        n = self.length[i]
        ends = np.cumsum(n)
        return self.data[np.arange(ends[-1]) + np.repeat(self.start[i] - ends + n, n)].tobytes()


@lru_cache(maxsize=4)
def load_table(path: str) -> PairTable:
    import public_tokenizers

    return PairTable(read_ranks(path), public_tokenizers.PATTERN)


def small_batches(texts: list[str], limit: int = 1 << 21) -> Iterator[slice]:
    """Runs of rows with a bounded number of characters, one row at least."""
    start = total = 0
    for k, t in enumerate(texts):
        if k > start and total + len(t) > limit:
            yield slice(start, k)
            start, total = k, 0
        total += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), decoded (bytes)."""
    table = df.sparkSession.sparkContext.broadcast(load_table(path))

    def run(batches):
        encoder, decoder = Encoder(table.value), Decoder(table.value)
        for b in batches:
            ids, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            for part in small_batches(texts):
                encoded = list(encoder.encode(texts[part]))
                yield pa.RecordBatch.from_arrays([ids[part.start : part.stop], pa.array(encoded, pa.binary()), pa.array([decoder.decode(e) for e in encoded], pa.binary())], ["doc_id", "ids", "decoded"])

    return map_batches(id_text(df, id_col, text_col), run, "doc_id long, ids binary, decoded binary")


VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(documents(spark, sf_dir), vocabulary_path(VOCABULARY))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
