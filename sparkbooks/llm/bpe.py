"""Byte-level BPE encoding and decoding by rank files.

Two tiers resolve a pre-token. A minimal perfect hash over the vocabulary answers pre-tokens that are
tokens themselves with one probe: a displacement table sends each key to a slot of its own, and the slot's
key is compared. Other pre-tokens go to a linked list of bytes whose neighbouring pairs wait in a heap by rank.
Both need only the rank file, which the driver reads once and broadcasts: its size does not depend on
the data. Workers keep what recent pre-tokens came to in a bounded memory, from task to task.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbooks.llm.shared import Remembered, id_type, small_batches

#: Pre-tokens whose ids, and strings of bytes whose ranks, a worker remembers, and the longest pre-token, in characters, that it remembers.
REMEMBERED, RANKS = 1 << 19, 1 << 18
LONGEST = 64
#: A rank file above this is not broadcast.
MOST_BYTES = 64 << 20
#: Characters of text in an output batch, about.
BATCH = 2_000_000


class PerfectHash:
    """A minimal perfect hash from the keys 0 to n - 1 of a list of distinct byte strings to their places.

    Hash and displace: keys fall into n / 4 buckets; the largest buckets first seek a seed that sends all
    their keys to free slots, and buckets of one key take the slots that are left.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        held: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, key in enumerate(keys):
            held[xxhash.xxh3_64_intdigest(key) % self.buckets].append(i)
        self.seeds, self.slots, free = [0] * self.buckets, [-1] * n, [True] * n
        order = sorted(range(self.buckets), key=lambda b: -len(held[b]))
        for b in order:
            if len(held[b]) < 2:
                break
            seed = 1
            while True:
                at = [xxhash.xxh3_64_intdigest(keys[i], seed) % n for i in held[b]]
                if len(set(at)) == len(at) and all(free[s] for s in at):
                    break
                seed += 1
            self.seeds[b] = seed
            for i, s in zip(held[b], at, strict=True):
                self.slots[s], free[s] = i, False
        left = iter([s for s in range(n) if free[s]])
        for b in order:
            if len(held[b]) == 1:
                s = next(left)
                self.seeds[b], self.slots[s] = -1 - s, held[b][0]

    def place(self, key: bytes) -> int:
        """The place of key if it is one of the keys; else any place."""
        seed = self.seeds[xxhash.xxh3_64_intdigest(key) % self.buckets]
        return self.slots[-1 - seed if seed < 0 else xxhash.xxh3_64_intdigest(key, seed) % self.n]


class Vocabulary:
    """Tokens by id, and ranks by token through the perfect hash."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = list(ranks)
        self.ids = list(ranks.values())
        self.hash = PerfectHash(self.tokens)
        self.by_id = dict(zip(self.ids, self.tokens, strict=True))
        self.kept: _Memory | None = None

    def memory(self) -> _Memory:
        """A worker's memory: it stays with the broadcast vocabulary while Spark uses the worker for further tasks."""
        if self.kept is None:
            self.kept = _Memory(self)
        return self.kept

    def rank(self, token: bytes) -> int | None:
        at = self.hash.place(token)
        return self.ids[at] if self.tokens[at] == token else None

    def merged(self, piece: bytes, rank: Callable[[bytes], int | None] | None = None) -> list[int]:
        """Merges neighbours of the lowest rank first, of equal ranks the leftmost, until no pair is a token.

        rank is self.rank, or something that remembers what it says.
        """
        n, rank = len(piece), rank or self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if end[i] else n
            # stale: the left part is gone, or either part has grown since
            if not end[i] or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(piece[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if (h := before[i]) >= 0 and (r := rank(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            r = rank(piece[i : end[i]])
            if r is None:
                raise ValueError(f"the vocabulary has no token for byte {piece[i : end[i]]!r}")
            out.append(r)
            i = after[i]
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} has over {MOST_BYTES} bytes")
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


@lru_cache(maxsize=2)
def _vocabulary(path: str, changed: float) -> Vocabulary:
    return Vocabulary(read_ranks(path))


class _Ranks(Remembered):
    """The ranks of byte strings met so far, None for what is no token."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(RANKS)
        self.vocabulary = vocabulary

    def __missing__(self, piece: bytes) -> int | None:
        if piece in self.old:
            return super().__missing__(piece)
        rank = self.vocabulary.rank(piece)
        if len(piece) <= LONGEST:
            self[piece] = rank
        return rank


class _Memory(Remembered):
    """What pre-tokens come to, as little-endian 32-bit ids."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(REMEMBERED)
        self.vocabulary, self.ranks = vocabulary, _Ranks(vocabulary)

    def __missing__(self, piece: str) -> bytes:
        if piece in self.old:
            return super().__missing__(piece)
        raw = piece.encode()
        rank = self.vocabulary.rank(raw)
        ids = [rank] if rank is not None else self.vocabulary.merged(raw, self.ranks.__getitem__)
        out = b"".join(i.to_bytes(4, "little") for i in ids)
        if len(piece) <= LONGEST:
            self[piece] = out
        return out

    def turn(self) -> None:
        super().turn()
        self.ranks.turn()


def decoded_by(tokens: dict[int, bytes]) -> Callable[[bytes | None], bytes]:
    """A function from ids, as encode() gives them, to the bytes that they stand for; null ids give none, unknown ids are an error."""
    return lambda ids: b"".join(map(tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False
) -> DataFrame:
    """(id, ids): one row for each row of docs; ids are the text's token ids as little-endian 32-bit integers. With `decoded` a column of that name
    has the bytes that the ids are decoded to, in the same pass and by the same task, as decode() would give them.

    Each match of the pattern is encoded by itself; there are no special tokens. A null text counts as empty, and
    an empty one has no ids. Rows that repeat are encoded each; no rows give no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(_vocabulary(path, os.stat(path).st_mtime))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, pieces, back = shared.value.memory(), regex.compile(pattern).findall, decoded_by(shared.value.by_id)

        def part(ids: pa.Array, out: list[bytes]) -> pa.RecordBatch:
            columns = {"id": ids, "ids": pa.array(out, pa.binary())}
            if decoded:
                columns["decoded"] = pa.array(map(back, out), pa.binary())
            return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        for batch in batches:
            begin, out, held = 0, [], 0
            for at in range(batch.num_rows):
                out.append(b"".join(map(memory.__getitem__, pieces(batch.column(1)[at].as_py() or ""))))
                held += len(out[-1])
                memory.turn()
                if held >= BATCH:
                    yield part(batch.column(0)[begin : at + 1], out)
                    begin, out, held = at + 1, [], 0
            if out:
                yield part(batch.column(0)[begin:], out)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    encoded = rows.mapInArrow(run, f"id {id_type(rows, 'id')}, ids binary" + ", decoded binary" * decoded)
    return encoded.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with the bytes that its ids stand for; null ids give no bytes. Unknown ids are an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = decoded_by({i: t for t, i in shared.value.items()})
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            out = map(back, batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, out_col])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields]
    return encoded.mapInArrow(run, ", ".join([*kinds, f"`{out_col}` binary"]))


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of encoded and decoded rows, one for each. Empty ids are hashed as no bytes; null ids or bytes give nulls;
    no rows give no rows; other columns are not looked at."""
    return encoded.select(
        id_col,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
