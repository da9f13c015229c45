"""Cost-balanced packing of tokenized documents into sequences of a fixed length.

A piece of ``n`` tokens costs ``linear * n + quadratic * n * n``: attention looks inside one
document only. Documents are cut into whole sequences as long as they fill one; what is left
goes, in descending length, to the sequence of least cost that still has room for it. A document
that fits nowhere is cut at the largest room, so sequences end up full.

Every task packs the documents it reads, in pools of a bounded number of tokens: no shuffle, and no
group of documents has to meet anywhere. What a pool leaves over goes into the task's next pool;
the last rest (below one sequence) is laid into sequences of powers of two, which need no padding.
``sequence_id`` is made from the number of the task and counts on inside it. Files are split
the same way when a task is repeated, so it packs the same sequences again.

Defined cases: a missing text is an empty one; an empty text is the end token alone; repeated rows and
repeated keys are packed once per row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from umbral.llm.text import no_nulls

#: Shift of the task's number in ``sequence_id``.
TASK_BITS = 36


@dataclass(frozen=True)
class Packing:
    """``tokenizer`` and ``ranks`` are files of one vocabulary; ``pool_tokens`` bounds what a task holds."""

    tokenizer: str
    ranks: str
    pattern: str
    capacity: int = 2048
    end_id: int = 1
    linear: float = 1.0
    quadratic: float = 1 / 2048
    pool_tokens: int = 1 << 20

    def __post_init__(self):
        if self.capacity < 1 or self.capacity & (self.capacity - 1):
            raise ValueError("capacity must be a power of two")


def public_packing(name: str = "byte_bpe_50k", **options) -> Packing:
    """The settings for one of the installed public vocabularies."""
    import public_tokenizers

    return Packing(
        public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN, **options
    )


@lru_cache(maxsize=4)
def _encoders(tokenizer: str, ranks: str, pattern: str):
    """The tokenizer itself, a faster reader of the same vocabulary, and the strings only the first treats as tokens."""
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer)
    added = [t.content for t in slow.get_added_tokens_decoder().values()]
    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return slow, tiktoken.Encoding("pack", pat_str=pattern, mergeable_ranks=merges, special_tokens={}), added


def encode(text: str, how: Packing) -> np.ndarray:
    """Ids of a text as ``tokenizers`` gives them without special tokens added, and the end id."""
    slow, fast, added = _encoders(how.tokenizer, how.ranks, how.pattern)
    ids = slow.encode(text, add_special_tokens=False).ids if any(a in text for a in added) else fast.encode_ordinary(text)
    ids.append(how.end_id)
    return np.array(ids, dtype="<u4")


def assign(lengths: list[int], rooms: list[int], linear: float, quadratic: float) -> tuple[list[list], list[tuple[int, int, int]]]:
    """Place documents into sequences with ``rooms`` tokens each.

    Returns ``[(document, start, length), …]`` per sequence and what did not fit at all.
    """
    placed: list[list] = [[] for _ in rooms]
    room = list(rooms)
    by_cost = [(0.0, s) for s in range(len(room))]
    by_room = [(-r, s) for s, r in enumerate(room)]
    waiting = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(by_room)
    heapq.heapify(waiting)
    rest = []
    while waiting:
        n, i, start = heapq.heappop(waiting)
        n = -n
        while by_room and -by_room[0][0] != room[by_room[0][1]]:
            heapq.heappop(by_room)
        most = -by_room[0][0] if by_room else 0
        if most == 0:
            rest.append((i, start, n))
            continue
        part = min(n, most)
        passed = []
        while room[by_cost[0][1]] < part:
            entry = heapq.heappop(by_cost)
            if room[entry[1]]:
                passed.append(entry)
        cost, s = heapq.heappop(by_cost)
        for entry in passed:
            heapq.heappush(by_cost, entry)
        placed[s].append((i, start, part))
        room[s] -= part
        if room[s]:
            heapq.heappush(by_cost, (cost + linear * part + quadratic * part * part, s))
            heapq.heappush(by_room, (-room[s], s))
        if part < n:
            heapq.heappush(waiting, (part - n, i, start + part))
    return placed, rest


def powers_of_two(n: int) -> list[int]:
    """The parts of ``n``, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class _Pool:
    """Pieces that wait for a sequence, and the pieces that have one."""

    def __init__(self, how: Packing, first_sequence: int):
        self.how, self.next = how, first_sequence
        self.waiting: list[tuple[object, int, int, np.ndarray]] = []
        self.tokens = 0
        self.out: list[tuple] = []

    def _emit(self, key, total: int, start: int, ids: np.ndarray, sequence: int, offset: int) -> None:
        self.out.append((key, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset, ids))

    def add(self, key, ids: np.ndarray) -> None:
        size, total = self.how.capacity, len(ids)
        whole = total - total % size
        for start in range(0, whole, size):
            self._emit(key, total, start, ids[start : start + size], self.next, 0)
            self.next += 1
        if whole < total:
            self.waiting.append((key, total, whole, ids[whole:]))
            self.tokens += total - whole

    def pack(self, last: bool) -> None:
        how = self.how
        rooms = [how.capacity] * (self.tokens // how.capacity) + (powers_of_two(self.tokens % how.capacity) if last else [])
        placed, rest = assign([len(w[3]) for w in self.waiting], rooms, how.linear, how.quadratic)
        for pieces in placed:
            offset = 0
            for i, start, n in pieces:
                key, total, base, ids = self.waiting[i]
                self._emit(key, total, base + start, ids[start : start + n], self.next, offset)
                offset += n
            self.next += 1
        self.waiting = [(w[0], w[1], w[2] + start, w[3][start : start + n]) for w, start, n in ((self.waiting[i], s, n) for i, s, n in rest)]
        self.tokens = sum(len(w[3]) for w in self.waiting)

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack_documents(df: DataFrame, how: Packing, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: where it comes from (``key``, ``start``, ``length``) and where it lies (``sequence_id``, ``offset``).

    ``ids_crc32`` is the CRC-32 of its ids as unsigned little-endian 32-bit numbers, ``doc_tokens``
    the tokens of its document; ``with_ids`` adds the ids themselves.
    """
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    fields = [StructField(key, df.schema[key].dataType), *[StructField(n, LongType()) for n in names]]
    if with_ids:
        fields.append(StructField("ids", ArrayType(IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = _Pool(how, TaskContext.get().partitionId() << TASK_BITS)

        def rows(kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*pool.take(), strict=True))
            arrays = [pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:7]]]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in columns[7]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for k, t in zip(batch.column(0).to_pylist(), no_nulls(batch.column(1)), strict=True):
                pool.add(k, encode(t, how))
                if pool.tokens >= how.pool_tokens:
                    pool.pack(last=False)
            if pool.out:
                yield rows(kind)
        if kind is not None:
            pool.pack(last=True)
            if pool.out:
                yield rows(kind)

    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, StructType(fields))
