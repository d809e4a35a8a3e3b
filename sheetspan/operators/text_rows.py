"""Rows of text from the pieces of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col


def text_rows(items: DataFrame) -> DataFrame:
    """Pieces of text (page_id, ord, text, x, y, w, h) as rows, from the top, each read from left to right, with their common box.

    A piece stays in the row while its middle is within 0.6 of the height (its own or that of the row's first piece, 8 at least) of
    the first piece's middle.  Blank and null texts are left out; equal places keep the order of ord.  One ordered fold over a page.
    """
    piece = F.struct("y", "x", "ord", "h", "w", "text")
    pages = items.where(F.trim("text") != "").groupBy("page_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    start = F.struct(F.lit(0).alias("row"), F.lit(None).cast("double").alias("mid"), F.lit(0.0).alias("tall"), F.array().cast("array<int>").alias("rows"))

    def step(acc, p):
        mid = p["y"] + p["h"] / 2
        same = F.coalesce(F.abs(mid - acc["mid"]) <= F.greatest(p["h"], acc["tall"], F.lit(8.0)) * 0.6, F.lit(False))
        row = F.when(same, acc["row"]).otherwise(acc["row"] + 1)
        head = lambda own, first: F.when(same, first).otherwise(own)
        return F.struct(row.alias("row"), head(mid, acc["mid"]).alias("mid"), head(p["h"], acc["tall"]).alias("tall"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    placed = pages.select("page_id", F.inline(F.arrays_zip("pieces", F.aggregate("pieces", start, step)["rows"].alias("row")))).select("page_id", "row", "pieces.*")
    text = F.transform(F.array_sort(F.collect_list(F.struct("x", "y", "ord", "text"))), lambda p: p["text"])
    rows = placed.groupBy("page_id", "row").agg(
        F.trim(F.regexp_replace(F.array_join(text, " "), r"\s+", " ")).alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(C("x") + C("w")).alias("right"), F.max(C("y") + C("h")).alias("bottom")
    )
    return rows.select("page_id", "row", "text", "x", "y", (C("right") - C("x")).alias("w"), (C("bottom") - C("y")).alias("h"))
