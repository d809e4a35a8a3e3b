"""Removal of lines that many documents share, by arrays behind a sharded minimal perfect hash.

A line is known by 128 bits: ``h`` deals it to a shard and to a slot there, ``f`` is its fingerprint.  Counting gives the
lines that enough documents hold; each shard of them gets a minimal perfect hash (levels of bits, a line's slot is
the rank of its bit) over compact arrays of fingerprints, counts and last documents.  Documents then probe
the arrays: no line is joined or shuffled a second time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..workspace import stage
from .batches import small_batches
from .hashing import mix

#: Bits of a level for each line that is still without a slot.
SPACE = 2
_NO_KEY = -(1 << 63)


def split(raw: bytes | None, least: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text, and the key of each (None below ``least`` code points)."""
    raw = raw or b""
    lines, keys = raw.split(b"\n"), []
    for key in raw.lower().split(b"\n"):  # bytes: only A-Z, and only the six blanks below
        key = key.strip(b" \t\n\v\f\r")
        long = len(key) >= least and (len(key) >= 4 * least or key.isascii() or sum(c & 0xC0 != 0x80 for c in key) >= least)
        keys.append(key if long else None)
    return lines, keys


def hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _place(h: np.ndarray, f: np.ndarray, level: int, size) -> np.ndarray:
    """Where lines fall among ``size`` bits of a level; other levels deal them independently."""
    step = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return (mix(h.view(np.uint64) ^ mix(f.view(np.uint64) + step)) % np.asarray(size, np.uint64)).astype(np.int64)


def build(h: np.ndarray, f: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """A minimal perfect hash of distinct lines: bits of each level, all bits as words, and the slot of each line.

    On each level, lines that have a place to themselves set its bit; the others go on to the next one."""
    sizes, words, slots, todo, given = [], [], np.zeros(len(h), np.int64), np.arange(len(h)), 0
    while len(todo):
        size = -(-SPACE * len(todo) // 64) * 64
        at = _place(h[todo], f[todo], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        own = alone[at]
        slots[todo[own]] = given + np.cumsum(alone)[at[own]] - 1
        given += int(own.sum())
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        sizes.append(size)
        todo = todo[~own]
    return sizes, np.concatenate([*words, np.empty(0, np.uint64)]), slots


@dataclass
class Arrays:
    """A block of shards, from ``first`` on, of ``shards`` in all."""

    first: int
    shards: int
    sizes: np.ndarray  # shards of the block x levels: bits
    words: np.ndarray  # bits of all shards, one after the other
    fingerprints: np.ndarray
    counts: np.ndarray
    last: np.ndarray

    def __post_init__(self):
        flat = self.sizes.ravel()
        self.begin = (np.cumsum(flat) - flat).reshape(self.sizes.shape)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def slots(self, h: np.ndarray, f: np.ndarray) -> np.ndarray:
        """The slot of each line, -1 for those that are not held."""
        shard = np.mod(h, self.shards) - self.first
        found = np.full(len(h), -1, np.int64)
        todo = np.flatnonzero((shard >= 0) & (shard < len(self.sizes)))
        for level in range(self.sizes.shape[1]):
            todo = todo[self.sizes[shard[todo], level] > 0]
            if not len(todo):
                break
            own = shard[todo]
            at = self.begin[own, level] + _place(h[todo], f[todo], level, self.sizes[own, level])
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            found[todo[hit]] = (self.before[at >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))))[hit]
            todo = todo[~hit]
        held = np.flatnonzero(found >= 0)
        found[held[self.fingerprints[found[held]] != f[held]]] = -1
        return found


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 20, copies: int = 3) -> DataFrame:
    """h, f, count, last of the lines that ``copies`` documents hold: how many do, and the largest key of them.  A row is a document;
    a line counts once in it.  Null keys are smallest."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, rows = [], []
            for i, raw in enumerate(batch.column(1).to_pylist()):
                own = {k for k in split(raw, least)[1] if k is not None}
                keys += own
                rows += [i] * len(own)
            h, f = hashes(keys)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[np.array(rows, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(f), pa.array(ids, pa.int64())], names=["h", "f", "id"])

    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NO_KEY)).alias("id"), F.col(text).cast("binary").alias("text"))
    lines = rows.mapInArrow(run, "h long, f long, id long")
    return lines.groupBy("h", "f").agg(F.count(F.lit(1)).alias("count"), F.max("id").alias("last")).where(F.col("count") >= copies)


def index(lines: DataFrame, shard_lines: int = 50_000) -> tuple[DataFrame, int, int]:
    """(shard, lines, sizes, words, fingerprints, counts, last by shard; number of shards; lines in all): the written index over
    the distinct lines of ``counted``.  Shards hold about ``shard_lines`` lines each, since hashes are even."""
    lines = stage(lines, "lines")
    n = lines.count()
    shards = max(1, -(-n // shard_lines))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        sizes, words, slots = build(own["h"].to_numpy(), own["f"].to_numpy())
        order = np.argsort(slots)
        raw = lambda c, kind: own[c].to_numpy()[order].astype(kind).tobytes()
        most = np.minimum(own["count"].to_numpy(), (1 << 32) - 1)
        return pd.DataFrame({
            "shard": own["shard"].iloc[:1].to_numpy(), "lines": [len(own)], "sizes": [sizes], "words": [words.tobytes()], "fingerprints": [raw("f", "<i8")],
            "counts": [most[order].astype("<u4").tobytes()], "last": [raw("last", "<i8")],
        })

    dealt = lines.withColumn("shard", F.pmod("h", F.lit(shards)))
    built = dealt.groupBy("shard").applyInPandas(run, "shard long, lines long, sizes array<long>, words binary, fingerprints binary, counts binary, last binary")
    return stage(built, "line-index"), shards, n


def arrays(part: DataFrame, first: int, until: int, shards: int) -> Arrays:
    """The shards ``first`` to ``until`` (exclusive) of a written index, one block of bounded size."""
    rows = {r["shard"]: r for r in part.where(F.col("shard").between(first, until - 1)).collect()}
    levels = max((len(r["sizes"]) for r in rows.values()), default=0)
    sizes = np.zeros((until - first, levels), np.int64)
    for k, r in rows.items():
        sizes[k - first, : len(r["sizes"])] = r["sizes"]
    joined = lambda c, kind: np.frombuffer(b"".join(bytes(rows[k][c]) for k in sorted(rows)), kind)
    return Arrays(first, shards, sizes, joined("words", "<u8"), joined("fingerprints", "<i8"), joined("counts", "<u4"), joined("last", "<i8"))


def _probed(docs: DataFrame, key: str, text: str, block: Arrays, least: int, copies: int) -> DataFrame:
    """The documents without the lines that the block tells to drop; ``n_dropped`` grows by them."""
    names, sent = docs.columns, docs.sparkSession.sparkContext.broadcast(block)
    at, dropped_at = names.index(text), names.index("n_dropped")
    ids = F.coalesce(F.col(f"`{key.replace('`', '``')}`").cast("long"), F.lit(_NO_KEY))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            *columns, raws, keys = batch.columns
            texts, rows, asked, places = [], keys.to_pylist(), [], []
            for i, raw in enumerate(raws.to_pylist()):
                lines, found = split(raw, least)
                texts.append(lines)
                for j, k in enumerate(found):
                    if k is not None:
                        asked.append(k)
                        places.append((i, j))
            h, f = hashes(asked)
            slot = own.slots(h, f)
            dropped = np.zeros(len(rows), np.int64)
            for x in np.flatnonzero(slot >= 0).tolist():
                i, j = places[x]
                if own.counts[slot[x]] >= copies and own.last[slot[x]] != rows[i]:
                    texts[i][j] = None
                    dropped[i] += 1
            kept = [b"\n".join([x for x in lines if x is not None]) for lines in texts]
            columns[at] = pa.array(kept, pa.binary()).view(pa.string())
            columns[dropped_at] = pa.array(columns[dropped_at].to_numpy() + dropped)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    shown = [F.lit(None).cast("string").alias(c) if c == text else F.col(f"`{c.replace('`', '``')}`") for c in names]
    passed = docs.select(*shown, F.col(f"`{text.replace('`', '``')}`").cast("binary"), ids)
    return passed.toDF(*(f"c{i}" for i in range(len(names) + 2))).mapInArrow(run, schema)


def drop_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 20, copies: int = 3, shard_lines: int = 50_000, block_lines: int = 2_000_000) -> DataFrame:
    """The input with the text without shared lines, and n_lines (before), n_dropped; all other columns as they are.

    Texts are split at line ends; null and empty ones are one empty line and come back empty.  A line's key is the line without
    ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased.  Keys of ``least`` code points or more that ``copies`` documents
    hold lose all their lines, except in the document of the largest key that holds it.  Each row is a document: rows that
    repeat a key count each, and all rows of the largest key keep the line; null keys are smallest.  Keys are integers.
    Columns named n_lines or n_dropped are replaced.  An empty table gives an empty one.

    Lines are counted with a partial aggregate, so a line that very many documents hold costs a row a task.  Only
    lines that may be dropped are indexed; the 64 bits of the fingerprint tell the others apart (one in 2**64 of
    those would pass).  The index is probed in blocks of about ``block_lines`` lines (21 bytes each), one broadcast at a time and so
    of bounded size; between blocks the documents are written, as the next block needs the counts so far.
    """
    small_batches(docs.sparkSession)
    built, shards, n = index(counted(docs, key, text, least, copies), shard_lines)
    step = max(1, block_lines // shard_lines)
    name = F.col(f"`{text.replace('`', '``')}`")
    own = F.coalesce(name, F.lit(""))
    rows = docs.withColumns({"n_lines": F.char_length(own) - F.char_length(F.replace(own, F.lit("\n"))) + F.lit(1).cast("long"), "n_dropped": F.lit(0).cast("long")})
    rows = rows.to(StructType([StructField(f.name, LongType() if f.name in ("n_lines", "n_dropped") else f.dataType) for f in rows.schema]))
    for first in range(0, shards, step):
        rows = _probed(rows, key, text, arrays(built, first, min(first + step, shards), shards), least, copies)
        if first + step < shards:
            rows = stage(rows, "probed")
    return rows
