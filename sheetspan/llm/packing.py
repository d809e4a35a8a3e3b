"""Packing of documents into fixed windows of tokens by minimum bin slack."""

from __future__ import annotations

import zlib
from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .batches import small_batches

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many items of each length together come closest to ``room`` without exceeding it.

    Bit t of ``reach`` says that some items have total t.  A length with c items is added in
    blocks of 1, 2, 4 ... items, so that every count up to c can be made; the bitset before each
    block is kept, and walking back through them tells which blocks the best total uses.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        left, block = min(counts[length], room // length), 1
        while left > 0:
            n = min(block, left)
            steps.append((reach, length, n))
            reach |= (reach << (length * n)) & mask
            left, block = left - n, block * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, defaultdict(int)
    for before, length, n in reversed(steps):
        if not before >> total & 1:
            total -= length * n
            used[length] += n
    return dict(used)


class Packer:
    """Fills windows of ``size`` tokens from a pool of document rests and emits pieces."""

    def __init__(self, size: int, first_sequence: int):
        self.size, self.sequence = size, first_sequence
        self.pool: dict[int, deque] = defaultdict(deque)
        self.held = 0
        self.out: list[tuple] = []

    def _emit(self, piece: tuple, offset: int) -> None:
        doc, start, ids, whole = piece
        self.out.append((doc, start, len(ids) // 4, zlib.crc32(ids), whole, self.sequence, offset, ids))

    def add(self, doc: int | None, ids: bytes) -> None:
        """Whole windows of a document leave at once, its rest waits."""
        whole, step = len(ids) // 4, 4 * self.size
        for at in range(0, len(ids) - len(ids) % step, step):
            self._emit((doc, at // 4, ids[at : at + step], whole), 0)
            self.sequence += 1
        if rest := len(ids) % step:
            self._put((doc, whole - rest // 4, ids[-rest:], whole))

    def _put(self, piece: tuple) -> None:
        self.pool[len(piece[2]) // 4].append(piece)
        self.held += len(piece[2]) // 4

    def _take(self, length: int) -> tuple:
        own = self.pool[length]
        piece = own.popleft()
        if not own:
            del self.pool[length]
        self.held -= length
        return piece

    def _cut(self, piece: tuple, length: int) -> tuple:
        """The first ``length`` tokens of a piece; the others go back to the pool."""
        doc, start, ids, whole = piece
        if len(ids) > 4 * length:
            self._put((doc, start + length, ids[4 * length :], whole))
        return doc, start, ids[: 4 * length], whole

    def _fill(self, room: int) -> None:
        """One sequence of ``room`` tokens: the longest rest that fits, the best multiset for what
        remains, and, if that leaves slack, the beginning of one more rest."""
        offset = 0
        longest = max((x for x in self.pool if x <= room), default=0)
        picked = [self._take(longest)] if longest else []
        if room > longest and self.pool:
            fill = best_fill({x: len(q) for x, q in self.pool.items() if x <= room - longest}, room - longest)
            for length, n in fill.items():
                picked += [self._take(length) for _ in range(n)]
        slack = room - sum(len(p[2]) // 4 for p in picked)
        if slack:
            picked.append(self._cut(self._take(max(self.pool)), slack))
        for piece in picked:
            self._emit(piece, offset)
            offset += len(piece[2]) // 4
        self.sequence += 1

    def flush(self, low: int) -> list[tuple]:
        """Fill windows while more than ``low`` tokens wait; at 0 what is left over goes into
        sequences of powers of two, which need no padding."""
        while self.held > max(low, self.size - 1):
            self._fill(self.size)
        while low == 0 and self.held:
            self._fill(1 << (self.held.bit_length() - 1))
        done, self.out = self.out, []
        return done


def pack(
    docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text", waiting: int = 2_000_000
) -> DataFrame:
    """Pieces of the token sequences that hold all documents: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    Each task packs the documents of its own partition, so nothing is shuffled, and holds about
    ``waiting`` tokens at most: beyond that it fills windows until a quarter is left.  Documents
    are cut freely: whole windows first, then rests by minimum bin slack; a window that no
    multiset fills takes the beginning of another rest, and a task's last tokens go into
    sequences of powers of two.  There is no padding.  A null text is a document of the end id
    alone; repeated rows are packed each by itself; null keys stay null.  Sequence ids are unique,
    not dense: the partition's number times 2**33, plus a count.
    """

    def run(batches):
        coder = tokens.encoder(vocabulary)
        packer, end = Packer(size, TaskContext.get().partitionId() << 33), np.uint32(end_id).tobytes()
        for batch in batches:
            texts, keys = batch["text"].tolist(), [None if v is None else int(v) for v in batch["id"]]
            for part in tokens.text_batches(texts):
                for k, raw in zip(keys[part], coder.encode(texts[part]), strict=True):
                    packer.add(k, raw + end)
                yield from frames(packer.flush(waiting // 4) if packer.held > waiting else packer.flush(1 << 62))
        yield from frames(packer.flush(0))

    def frames(rows):
        for at in range(0, len(rows), 1000):
            x = list(zip(*rows[at : at + 1000], strict=True))
            yield pd.DataFrame({"doc_id": pd.array(x[0], dtype="Int64")} | dict(zip(_NAMES[1:], x[1:], strict=True)))

    small_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").cast("string").alias("id"), F.col(text).alias("text")).mapInPandas(run, SCHEMA)


_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
