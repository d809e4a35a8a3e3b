"""Apartment types that the title block of a page states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..workspace import stage
from .entrances import UNIT_WORD
from .spatial import box_pairs

C = F.col
#: A line that is a unit number alone, a line that is the word type alone, one with the type after it, and a unit with its type.
UNIT_ALONE = r"(?i)^#?\s*([A-Z]?\d{1,4}[A-Z]?)$"
TYPE_ALONE = r"(?i)^types?[:.]?$"
TYPE_NAMED = r"(?i)^types?[:.\s]+(.+)$"
UNIT_AND_TYPE = r"(?i)^(?:unit|apt|apartment|dwelling|flat|suite)\.?\s*#?\s*([A-Z]?\d{1,4}[A-Z]?)\s*(?:[-–,/]|type\s*[:.]?\s*|\s+)(studio|\d+\s*b)$"
#: How many line heights a type may stand below its label, and a label below its unit.
BELOW = 8


def _group(pattern: str, k: int) -> Column:
    found = F.regexp_extract(C("text"), pattern, k)
    return F.when(found != "", found)


def _type(beds: Column) -> Column:
    return F.when(beds == 0, "Studio").when(beds.isNotNull(), F.concat(beds.cast("string"), F.lit("B")))


def _read(lines: DataFrame) -> DataFrame:
    """Lines in what they say: unit, beds_unit and beds (a unit with its type), named (beds after the word type), label (the word alone), token (beds
    alone).  A unit word alone takes the number of the next line, which goes."""
    own = lines.select("page_id", "ord", F.trim("text").alias("text"), "bbox").where("text <> ''")
    unit = F.when(~C("text").contains(":"), F.get(t.parse_unit_ids(C("text"), 1), F.lit(0)))
    own = own.withColumn("unit", unit)
    w = Window.partitionBy("page_id").orderBy("ord")
    word = C("text").rlike(UNIT_WORD) & (F.lower("text") != "u") & (F.lower("text") != "u.")
    number = F.coalesce("unit", F.upper(_group(UNIT_ALONE, 1)))
    taken = F.coalesce(F.lag(word).over(w), F.lit(False)) & number.isNotNull()
    ahead = F.lead(F.struct(number.alias("unit"), C("text").alias("text"))).over(w)
    joined = own.select("*", taken.alias("taken"), F.when(word & ahead["unit"].isNotNull(), ahead).alias("ahead")).where("NOT taken")
    joined = joined.select("page_id", "ord", "bbox", F.when(C("ahead").isNotNull(), F.concat_ws(" ", "text", "ahead.text")).otherwise(C("text")).alias("text"), F.coalesce("ahead.unit", "unit").alias("unit"), C("ahead").isNotNull().alias("made"))
    # What a joined line says beside its unit is what its first line says: nothing.
    said = lambda c: F.when(~C("made"), c)
    both = F.upper(_group(UNIT_AND_TYPE, 1))
    return joined.select(
        "page_id", "ord", "bbox", "unit", both.alias("beds_unit"), F.when(both.isNotNull(), t.bedroom_type(_group(UNIT_AND_TYPE, 2))).alias("beds"),
        said(t.bedroom_type(_group(TYPE_NAMED, 1))).alias("named"), F.coalesce(said(C("text").rlike(TYPE_ALONE)), F.lit(False)).alias("label"), said(t.bedroom_type(C("text"))).alias("token"),
    )


def _under(upper: str, lower: str) -> Column:
    """Whether a box stands below another one in its column."""
    a, b = C(upper), C(lower)
    middle = lambda x: x["x"] + x["width"] / 2
    lower_middle = (b["y"] + b["height"] / 2) > (a["y"] + a["height"] / 2)
    near = (b["y"] - g.bottom(a)) <= F.greatest(a["height"], F.lit(12.0)) * BELOW
    shared = F.least(g.right(a), g.right(b)) > F.greatest(a["x"], b["x"])
    return lower_middle & near & (shared | (F.abs(middle(a) - middle(b)) <= F.greatest(a["width"], b["width"], F.lit(24.0))))


def type_hits(lines: DataFrame) -> DataFrame:
    """Apartment types of a page, each once: page_id, unit (null: none known), apartment_type, bedrooms.

    lines: page_id, ord, text, bbox (null: none).  Lines are read in rows, from left to right: a row begins where a line's middle is over 55 % of the higher line (12 px at
    least) below the last one's.  A unit stays known until the next one; the word type alone waits for the next line that says a type.
    So hits are: a unit and type in one line; a type after the word; and the type that was waited for.  Besides, each word type alone takes
    the topmost type below it in its column, with the last unit above it in its column, or else the page's last unit.
    """
    read = _read(lines)
    b = C("bbox")
    cy, h = F.coalesce(b["y"] + b["height"] / 2, F.lit(0.0)), F.greatest(F.coalesce(b["height"], F.lit(12.0)), F.lit(12.0))
    placed = read.select("*", cy.alias("cy"), h.alias("h"), F.coalesce(b["x"] + b["width"] / 2, F.lit(0.0)).alias("cx"))
    down = Window.partitionBy("page_id").orderBy("cy", "ord")
    new = (C("cy") - F.lag("cy").over(down)) > 0.55 * F.greatest(C("h"), F.lag("h").over(down))
    rows = placed.withColumn("new", F.coalesce(new.cast("int"), F.lit(0))).withColumn("row", F.sum("new").over(down))
    order = Window.partitionBy("page_id").orderBy("row", "cx", "ord")
    event = F.when(C("beds").isNotNull() | C("named").isNotNull(), False).when(C("label"), True).when(C("token").isNotNull(), False)
    scan = rows.select(
        "page_id", "ord", "bbox", "label", "token", "beds", "beds_unit", "named", "unit", F.row_number().over(order).alias("at"), F.last("unit", ignorenulls=True).over(order).alias("known"),
        F.last(event, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("waits"), F.last("unit", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("final"),
    )
    # Lines that say nothing give no hit; the others are read four times.
    scan = stage(scan.where("label OR token IS NOT NULL OR unit IS NOT NULL OR beds IS NOT NULL OR named IS NOT NULL"), "type_lines")
    waited = F.when(C("waits") & ~C("label"), C("token"))
    count = F.when(C("beds").isNotNull(), C("beds")).when(C("named").isNotNull(), C("named")).otherwise(waited)
    read_hits = scan.select("page_id", F.when(C("beds").isNotNull(), C("beds_unit")).otherwise(C("known")).alias("unit"), count.alias("bedrooms")).where("bedrooms IS NOT NULL")

    boxed = scan.where("bbox IS NOT NULL")
    reach = lambda box: g.expand(box, F.greatest(box["width"], box["height"] * BELOW, F.lit(12.0 * BELOW)))
    label = boxed.where("label").select("page_id", C("ord").alias("label_ord"), C("bbox").alias("lbox"), reach(C("bbox")).alias("lwide"), "final")
    token = boxed.where("token IS NOT NULL").select("page_id", C("at"), "token", C("bbox").alias("tbox"), reach(C("bbox")).alias("twide"))
    units = boxed.where("unit IS NOT NULL").select("page_id", C("at"), "unit", C("bbox").alias("ubox"), reach(C("bbox")).alias("uwide"))
    low = box_pairs(label, token, "lwide", "twide").where(_under("lbox", "tbox")).groupBy("page_id", "label_ord", "final").agg(F.min_by("token", F.struct("tbox.y", "at")).alias("bedrooms"))
    above = box_pairs(units, label.drop("final"), "uwide", "lwide").where(_under("ubox", "lbox")).groupBy("page_id", "label_ord").agg(F.max_by("unit", "at").alias("unit"))
    block = low.join(above, ["page_id", "label_ord"], "left").select("page_id", F.coalesce("unit", "final").alias("unit"), "bedrooms")
    return read_hits.unionByName(block).distinct().select("page_id", "unit", _type(C("bedrooms")).alias("apartment_type"), C("bedrooms").cast("int").alias("bedrooms"))
