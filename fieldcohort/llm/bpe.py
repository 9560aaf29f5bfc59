"""Byte-level BPE, encoding and decoding, from a rank file.

Every match of the split pattern (a pre-token) is encoded by itself.  Lookup has two tiers: a minimal perfect hash over
the vocabulary answers for pre-tokens that are tokens as a whole, many at once; the rest go through a heap of ranked
neighbour pairs over a linked list of their bytes.  Pre-tokens of a slice are made distinct first, and results of the
heap tier are kept in a memo of bounded size.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import DataFrame

from fieldcohort.llm.common import release, slices
from fieldcohort.llm.hashing import mix
from fieldcohort.llm.splitting import splitter

#: Entries of each of the memo's two generations of encoded pre-tokens; when the young one is full, it replaces the old.
MEMO = 200_000
#: Longer pre-tokens are not kept in the memo.
MEMO_LENGTH = 64
#: Bytes from which on a pre-token's lists are arrays.
LONG = 1 << 16
#: Text bytes encoded at once; every pre-token of them is an object.
PIECE_BYTES = 1 << 18
#: Bytes of a packed id.
ID_BYTES = array("I").itemsize


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class PerfectHash:
    """A minimal perfect hash: n keys fill n slots without gaps.

    Keys fall into buckets by one hash; from the largest bucket on, each gets the first displacement that sends all its
    keys to free slots, and buckets of one key take the slots left over, noted as they are.  Slots keep the key's text and
    value; a lookup compares the text, so foreign keys are told apart.
    """

    KEYS = ("fieldcohort-mph0", "fieldcohort-mph1")

    def __init__(self, keys: list[str], values: list[int]):
        self.n = n = len(keys)
        self.buckets = max(1, n // 4)
        names = np.array(keys, dtype=object)
        bucket, a = self._hashes(names)
        order = np.argsort(bucket, kind="stable")
        groups = sorted(np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1), key=len, reverse=True) if n else []
        taken, slot_of = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
        # a displacement, or -1 - slot for a bucket of one key
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        single = [int(g[0]) for g in groups if len(g) == 1]
        for size in sorted({len(g) for g in groups} - {1}, reverse=True):
            # all buckets of one size try the same displacement at once; of those that want a slot, the first takes it
            left, d = np.array([g for g in groups if len(g) == size]), 0
            while len(left):
                slots = self._slots(a[left], np.full(left.shape, d))
                fits = ~taken[slots].any(axis=1) & (np.diff(np.sort(slots, axis=1), axis=1) > 0).all(axis=1)
                tried = np.flatnonzero(fits)
                _, first = np.unique(slots[tried], return_index=True)
                wins = np.zeros(slots[tried].size, dtype=bool)
                wins[first] = True
                tried = tried[wins.reshape(-1, size).all(axis=1)]
                taken[slots[tried]], slot_of[left[tried]] = True, slots[tried]
                self.shift[bucket[left[tried, 0]]] = d
                left, d = np.delete(left, tried, axis=0), d + 1
        free = np.flatnonzero(~taken)
        slot_of[single], self.shift[bucket[single]] = free, -1 - free
        self.names, self.values = np.empty(n, dtype=object), np.zeros(n, dtype=np.int64)
        self.names[slot_of], self.values[slot_of] = names, values

    def _hashes(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, g = (hash_array(names, hash_key=k, categorize=False) for k in self.KEYS)
        return (h % np.uint64(self.buckets)).astype(np.int64), g

    def _slots(self, a: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """The slot of a second hash under a displacement."""
        moved = mix(a + shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)
        return np.where(shift < 0, -1 - shift, moved.astype(np.int64))

    def find(self, names: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where it is none."""
        if not self.n or not len(names):
            return np.full(len(names), -1)
        bucket, a = self._hashes(names)
        slot = self._slots(a, self.shift[bucket])
        return np.where(self.names[slot] == names, self.values[slot], -1)


class Codec:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.split = splitter(pattern)
        self.table = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.table[rank] = token
        self.single = [self.ranks.get(bytes([b])) for b in range(256)]
        # (left, right) -> joined, for every way to cut a token into two tokens
        self.joins = {(left << 32) | right: rank for token, rank in self.ranks.items() for k in range(1, len(token)) if (left := self.ranks.get(token[:k])) is not None and (right := self.ranks.get(token[k:])) is not None}
        self.pairs = [self.ranks.get(bytes((k >> 8, k & 255)), -1) for k in range(1 << 16)]
        whole = [(token.decode(), rank) for token, rank in self.ranks.items() if _is_text(token)]
        self.hash = PerfectHash([t for t, _ in whole], [r for _, r in whole])
        # pre-token -> its ids, packed, which takes a quarter of a tuple of numbers
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, raw: bytes) -> list[int]:
        """The ids of one pre-token: the lowest-ranked neighbour pair, leftmost first, is joined until none is left."""
        n, pairs, join = len(raw), self.pairs, self.joins.get
        if n > LONG:
            return self._merge_long(raw)
        # rank of the pair that begins at each place; -1: none, -2: joined to the one before
        rank_at = [pairs[(a << 8) | b] for a, b in zip(raw, raw[1:])]  # noqa: B905
        heap = [(r << 32) | k for k, r in enumerate(rank_at) if r >= 0]
        ids = [self.single[b] for b in raw]
        if not heap:
            return ids
        heapq.heapify(heap)
        rank_at.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        self._join(heap, ids, rank_at, after, before, join)
        return [x for x, r in zip(ids, rank_at, strict=True) if r != -2]

    def _merge_long(self, raw: bytes) -> list[int]:
        """``merge`` for a very long pre-token: 4 bytes a place in each list, and the pairs of its bytes, sorted, beside a
        heap of the pairs that joining makes."""
        n, byte = len(raw), np.frombuffer(raw, dtype=np.uint8).astype(np.int32)
        ranks = np.array(self.pairs, dtype=np.int32)[(byte[:-1] << 8) | byte[1:]]
        places = np.flatnonzero(ranks >= 0)
        first = (ranks[places].astype(np.int64) << 32) | places
        first.sort()
        of = np.array([-1 if x is None else x for x in self.single], dtype=np.int32)
        ids, rank_at = array("i", of[byte].tobytes()), array("i", np.append(ranks, -1).astype(np.int32).tobytes())
        after, before = (array("i", np.arange(k, n + k, dtype=np.int32).tobytes()) for k in (1, -1))
        heap: list[int] = []
        for start in range(0, len(first), LONG):
            part = first[start : start + LONG].tolist()
            # pairs made so far come first where they rank lower; what is left goes on with the next part
            for pair in part:
                if heap and heap[0] < pair:
                    self._join(heap, ids, rank_at, after, before, self.joins.get, pair)
                if rank_at[pair & 0xFFFFFFFF] == pair >> 32:
                    heapq.heappush(heap, pair)
        self._join(heap, ids, rank_at, after, before, self.joins.get)
        kept = np.frombuffer(rank_at, dtype=np.int32) != -2
        return np.frombuffer(ids, dtype=np.int32)[kept].tolist()

    @staticmethod
    def _join(heap: list[int], ids, rank_at, after, before, join, until: int = 1 << 62) -> None:
        """Join the pairs of the heap that rank before ``until``, and those that this makes."""
        n, pop, push = len(ids), heapq.heappop, heapq.heappush
        while heap and heap[0] < until:
            top = pop(heap)
            k, rank = top & 0xFFFFFFFF, top >> 32
            if rank_at[k] != rank:
                continue
            gone = after[k]
            after[k] = far = after[gone]
            ids[k], rank_at[gone], r = rank, -2, -1
            if far < n:
                before[far] = k
                if (r := join((rank << 32) | ids[far], -1)) >= 0:
                    push(heap, (r << 32) | k)
            rank_at[k] = r
            if (p := before[k]) >= 0:
                rank_at[p] = r = join((ids[p] << 32) | rank, -1)
                if r >= 0:
                    push(heap, (r << 32) | p)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's ids end."""
        found = [self.split(t) for t in texts]
        ends = np.cumsum([len(f) for f in found], dtype=np.int64)
        flat = np.empty(int(ends[-1]) if len(ends) else 0, dtype=object)
        flat[:] = list(chain.from_iterable(found))
        if not len(flat):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64)
        codes, distinct = pd.factorize(flat)
        whole = self.hash.find(distinct)
        sizes, parts = np.ones(len(distinct), dtype=np.int64), []
        missed = np.flatnonzero(whole < 0)
        for token in distinct[missed].tolist():
            got = self.memo.get(token)
            if got is None:
                got = self.old.get(token) or array("I", self.merge(token.encode("utf-8"))).tobytes()
                if len(token) <= MEMO_LENGTH:
                    if len(self.memo) >= MEMO:
                        self.old, self.memo = self.memo, {}
                    self.memo[token] = got
            parts.append(got)
        sizes[missed] = lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // ID_BYTES
        first = np.cumsum(sizes) - sizes
        # ids of the distinct pre-tokens, one after the other
        pool = np.empty(int(sizes.sum()), dtype=np.uint32)
        pool[first] = np.maximum(whole, 0)
        merged = np.frombuffer(b"".join(parts), dtype=np.uintc)
        pool[np.arange(len(merged)) + np.repeat(first[missed] - (np.cumsum(lengths) - lengths), lengths)] = merged
        each = sizes[codes]
        to = np.cumsum(each)
        ids = pool[np.arange(int(to[-1])) + np.repeat(first[codes] - (to - each), each)]
        return ids, np.concatenate(([0], to))[ends]

    def decode(self, ids) -> bytes:
        """The bytes of a sequence of ids."""
        return b"".join(map(self.table.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each process and rank file."""
    return Codec(path, pattern)


def encode_documents(df: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Encode every whole ``text`` of ``df`` and decode the ids again.

    Returns doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256 and, with
    ``keep_ids``, ids (array of long).  A null text counts as empty: no ids, digests of nothing.  Null or repeated doc_ids
    pass through row by row; an empty table gives no rows; other columns are not read.  Rows are independent, so a lost
    executor costs its own tasks only.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in slices(batches, "text", PIECE_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids, ends = tool.encode(texts)
            cuts = np.split(ids, ends[:-1])
            out = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([len(x) for x in cuts], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in cuts], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(tool.decode(x)).hexdigest() for x in cuts], pa.string()),
            }
            if keep_ids:
                out["ids"] = pa.array([x.astype(np.int64) for x in cuts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(out)
        # the worker lives on after the task; what it has memorised need not
        tool.memo, tool.old = {}, {}
        release()

    return df.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)
