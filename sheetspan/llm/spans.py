"""Spans of pattern matches as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,rank:int,end:int,kind:string,match:string>>"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matches(text: Column, pattern: str, kind: str, rank: int, needs: str | None = None, block: int = 128) -> Column:
    """All leftmost non-overlapping matches of a pattern that never matches the empty string:
    array of (start, rank, end, kind, match), places in code points, end exclusive.

    The text between the matches and the matches themselves come from two passes; adding up their
    lengths gives the places, within blocks and then over blocks, so that long texts of very many
    matches cost little more than their length.  ``needs`` is a cheap pattern without which there
    is no match.
    """

    def spans(items: Column, at: Column) -> Column:
        return F.aggregate(
            items,
            F.struct(at.alias("at"), F.expr(f"cast(array() as {SPAN})").alias("spans")),
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + x["n"]).alias("at"),
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["at"] + x["gap"]).alias("start"), F.lit(rank).alias("rank"), (acc["at"] + x["gap"] + x["n"]).alias("end"),
                            F.lit(kind).alias("kind"), x["match"].alias("match"),
                        )
                    ),
                ).alias("spans"),
            ),
            lambda acc: acc["spans"],
        )

    def over_blocks(items: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / block).cast("int")), lambda i: F.slice(items, i * block + 1, F.lit(block)))
        begins = lambda blocks: F.aggregate(
            blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + x["n"])))
        )
        return let(cut, lambda blocks: F.flatten(F.zip_with(blocks, F.slice(begins(blocks), F.lit(1), F.size(blocks)), spans)))

    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    item = lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("n"), m.alias("match"))
    items = let(found, lambda m: F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), m, item))
    none = F.expr(f"cast(array() as {SPAN})")
    whole = let(items, lambda x: F.when(F.size(x) > block, over_blocks(x)).when(F.size(x) > 0, spans(x, F.lit(0))).otherwise(none))
    return F.when(text.rlike(needs or pattern), whole).otherwise(none)


def blocks(spans: Column, size: int = 128) -> Column:
    """Sorted spans in blocks, each with its least start and greatest end, so that a search looks into few of them."""
    block = lambda s: F.struct(F.get(s, F.lit(0))["start"].alias("start"), F.array_max(F.transform(s, lambda x: x["end"])).alias("end"), s.alias("spans"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / size).cast("int")), lambda i: block(F.slice(spans, i * size + 1, F.lit(size))))
    return F.when(F.size(spans) > 0, cut).otherwise(F.slice(F.array(block(spans)), 1, 0))


def overlaps(span: Column, own: Column) -> Column:
    """Whether a span overlaps one of those in blocks."""
    meets = lambda x: (x["start"] < span["end"]) & (span["start"] < x["end"])
    return F.exists(own, lambda b: meets(b) & F.exists(b["spans"], meets))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def written(spans: Column) -> Column:
    """kind:start:end of each span, by start and then rank, comma-joined."""
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
