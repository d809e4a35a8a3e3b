"""Token ids as length-delimited binary records, with an offset index for reads in any order.

A shard is a run of records.  A record is

    length   unsigned 64-bit, little-endian: bytes of the payload
    check    unsigned 32-bit: masked CRC-32 of the eight length bytes
    payload  signed 64-bit document id, then its token ids as unsigned 16-bit (or 32-bit) integers
    check    unsigned 32-bit: masked CRC-32 of the payload

A mask rotates a checksum by 15 bits and adds a constant, so that a checksum of data that holds
checksums stays meaningful.  The index of a shard, ``<shard>.idx``, holds each record's offset as an
unsigned 64-bit integer, and the end of the shard last.  ``manifest`` is a Parquet table with a row
per shard: shard, path, records, tokens, width, in ascending order of document id.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens

_HEAD = struct.Struct("<QI")
_CHECK = struct.Struct("<I")
_NO_ID = -(1 << 63)


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, _CHECK.pack(masked(length)), payload, _CHECK.pack(masked(payload))))


def unframe(source) -> bytes:
    """The payload of the record at the reader's place; ValueError if a checksum is wrong."""
    head = source.read(12)
    length, check = _HEAD.unpack(head)
    if masked(head[:8]) != check:
        raise ValueError("a record's length is damaged")
    payload = source.read(length)
    if len(payload) != length or _CHECK.unpack(source.read(4))[0] != masked(payload):
        raise ValueError("a record's payload is damaged")
    return payload


def _file(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_records(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, key: str = "doc_id", text: str = "text", partitions: int | None = None
) -> DataFrame:
    """Encode whole texts and write them in ascending order of ``key``; returns the manifest.

    Null texts are empty documents (the end id alone).  Null keys come first and are stored as the
    smallest 64-bit integer; rows that repeat a key are records of their own.  Each task streams
    one range of keys into a shard of its own attempt, and the manifest, which Spark commits,
    names the attempts that count; so a lost or repeated task leaves no wrong record.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).repartitionByRange(n, "id").sortWithinPartitions("id").select(F.col("id").cast("string").alias("id"), "text")

    def write(batches):
        coder, at, place, total = tokens.encoder(vocabulary), 0, 0, 0
        wide = coder.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16 or end_id >= 1 << 16
        kind, shard = ("<u4" if wide else "<u2"), TaskContext.get().partitionId()
        path, out, offsets = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.rec", None, []
        for batch in batches:
            texts, keys = batch["text"].tolist(), [_NO_ID if v is None else int(v) for v in batch["id"]]
            for part in tokens.text_batches(texts):
                for k, raw in zip(keys[part], coder.encode(texts[part]), strict=True):
                    if out is None:
                        system, name = _file(path)
                        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
                        out = system.open_output_stream(name)
                    own = np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id))
                    record = frame(struct.pack("<q", k) + own.astype(kind).tobytes())
                    out.write(record)
                    offsets.append(place)
                    place, total, at = place + len(record), total + len(own), at + 1
        if out is not None:
            out.close()
            system, name = _file(path + ".idx")
            with system.open_output_stream(name) as index:
                index.write(np.array([*offsets, place], "<u8").tobytes())
            yield pd.DataFrame({"shard": [shard], "path": [path], "records": [at], "tokens": [total], "width": [int(kind[-1])]})

    manifest = ordered.mapInPandas(write, "shard long, path string, records long, tokens long, width int")
    manifest.write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest with each shard's first record and first token in the whole corpus.  It has a
    row per shard, so the running sums over all of it are small."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return spark.read.parquet(f"{folder}/manifest").withColumn("first_record", total("records")).withColumn("first_token", total("tokens"))


def read_records(spark: SparkSession, folder: str, split: int = 20_000) -> DataFrame:
    """All records, in parts of at most ``split`` records: doc_id, start (tokens before it), ids
    (little-endian unsigned 32-bit).  A part reads the one entry of the index
    that it starts at: the offset also tells how many tokens the shard has before it."""
    parts = read_manifest(spark, folder).select(
        "path", "first_token", "width", F.explode(F.sequence(F.lit(0), F.col("records") - 1, F.lit(split))).alias("begin"),
        F.col("records").alias("records"),
    )
    spread = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "begin")

    def read(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                system, name = _file(row.path + ".idx")
                begin, end = row.begin, min(row.begin + split, row.records)
                with system.open_input_file(name) as index:
                    index.seek(8 * begin)
                    place = int(np.frombuffer(index.read(8), "<u8")[0])
                # Each record before this one is 24 bytes and its ids.
                start = row.first_token + (place - 24 * begin) // row.width
                system, name = _file(row.path)
                with system.open_input_file(name) as source:
                    source.seek(place)
                    held: list[tuple] = []
                    size = 0
                    for _ in range(begin, end):
                        payload = unframe(source)
                        ids = np.frombuffer(payload, f"<u{row.width}", offset=8).astype("<u4")
                        key = struct.unpack_from("<q", payload)[0]
                        held.append((None if key == _NO_ID else key, start, ids.tobytes()))
                        start, size = start + len(ids), size + 4 * len(ids)
                        if size > 8 << 20:
                            yield _frame(held)
                            held, size = [], 0
                    if held:
                        yield _frame(held)

    def _frame(rows):
        return pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], dtype="Int64"), "start": [r[1] for r in rows], "ids": [r[2] for r in rows]})

    return spread.mapInPandas(read, "doc_id long, start long, ids binary")
