"""Exact deduplication of texts, safe against very large groups of copies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import stage

BLANKS = "[\\x20\\x09-\\x0D]+"


def sha256(normalised: Column) -> Column:
    return F.unhex(F.sha2(normalised, 256))


def exact_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = 16, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without the characters of ``[\\x20\\x09-\\x0D]``; null
    counts as the empty text.  Of equal texts the row with the most code points in its original
    text stays, then the smallest key; null keys come last.  Rows that repeat a key each count in
    ``group_size`` and share one answer, so all rows of the winning key are marked as kept.

    Copies are combined three times, each time over (digest, full content): within a map task (the
    partial aggregate), within one of ``salts`` salts of a digest, then over the winners of the
    salts.  A group of any size thus sends a row per task and salt at most.  Membership then
    needs only digests: the last combine also counts the different contents of each digest, and
    where a digest stands for several, its members are matched by content as well.
    """
    norm = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANKS, "")
    base = docs.select(F.col(key).alias("id"), norm.alias("content"), F.coalesce(F.char_length(text), F.lit(0)).alias("n")).withColumn(
        "digest", digest(F.col("content"))
    )
    rank = F.struct((-F.col("n")).alias("shorter"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"))
    salted = (
        base.groupBy("digest", "content", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
        .agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("size"))
    )
    whole = salted.groupBy("digest", "content").agg(F.min("best").alias("best"), F.sum("size").alias("size"))
    groups = stage(
        whole.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("contents"), F.min("best").alias("best"), F.sum("size").alias("size"))
        .where("contents > 1 OR size > 1")
        .select("digest", "contents", F.col("best.id").alias("keep"), "size"),
        "copies",
    )
    members = base.select("id", "digest", F.sha2("content", 256).alias("text_sha256"))
    pure = groups.where("contents = 1").select("digest", "keep", "size", F.lit(True).alias("copied"))
    if groups.where("contents > 1").isEmpty():
        found = members.join(pure, "digest", "left")
    else:
        mixed = groups.where("contents > 1").select("digest")
        apart = whole.join(mixed, "digest", "left_semi").select(
            "digest", "content", F.col("best.id").alias("keep"), "size", F.lit(True).alias("copied")
        )
        same = base.join(mixed, "digest", "left_semi").select("id", "digest", "content", F.sha2("content", 256).alias("text_sha256"))
        found = members.join(mixed, "digest", "left_anti").join(pure, "digest", "left").unionByName(
            same.join(apart, ["digest", "content"]).drop("content")
        )
    keep = F.when(F.col("copied"), F.col("keep")).otherwise(F.col("id"))
    return found.select(
        F.col("id").alias(key),
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The input without the rows that ``exact_groups`` drops, all columns as they were.  Rows that
    repeat both key and text stay or go together; a key with several texts is judged by text."""
    gone = exact_groups(docs, key, text).where("NOT kept").select(F.col(key).alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    sha = F.sha2(F.regexp_replace(F.coalesce(docs[text], F.lit("")), BLANKS, ""), 256)
    return docs.join(gone, docs[key].eqNullSafe(gone["_id"]) & (sha == gone["_sha"]), "left_anti")
