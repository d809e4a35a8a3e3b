"""Entrance doors of a page, seed points of the corridor before them, and unit numbers that stand apart from their word."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from .rollup import wide_doors
from .spatial import box_pairs

C = F.col
#: A line that is a unit word alone, and one that is a bare number.
UNIT_WORD = r"(?i)^(?:unit|apt|apartment|dwelling|tenancy|flat|suite|u)\.?$"
UNIT_NUMBER = r"^#?\s*(\d{1,4}[A-Za-z]?)$"


def entrances(doors: DataFrame, shared: DataFrame, pad: float, mode: str = "auto", least: float = 29.0) -> DataFrame:
    """Entrance doors of each page and the rule that found them; the first rule with any door wins.

    doors: page_id, entity_id, ord, label, points, span; shared: page_id, points of shared areas.  Wide doors are those of N9.  Rules: with mode
    "threshold", the wide doors; wide doors within 2.5 pads of a shared area; two or more wide doors; on pages with a shared area, doors labelled main door
    or within one pad, then two, of it; the wide door where nothing is shared, else doors within 2.5 pads.
    """
    d = wide_doors(doors, mode, least).withColumn("m", g.vertex_mean(C("points"))).withColumn("reach", g.expand(g.box(C("m.x"), C("m.y"), F.lit(0.0), F.lit(0.0)), 2.5 * pad))
    areas = shared.select("page_id", C("points").alias("ring"), g.bbox_of(C("points")).alias("rbox"))
    near = box_pairs(d.select("page_id", "entity_id", "m", "reach"), areas, "reach", "rbox").groupBy("page_id", "entity_id").agg(F.min(g.dist_to_ring(C("m.x"), C("m.y"), C("ring"))).alias("away"))
    within = lambda k: F.coalesce(C("away") <= k * pad, F.lit(False))
    main, some = t.is_main_door(C("label")), C("_any").isNotNull()
    flags = d.join(near, ["page_id", "entity_id"], "left").join(shared.select("page_id", F.lit(True).alias("_any")).distinct(), "page_id", "left").select(
        "page_id", "entity_id", "wide", (C("wide") & within(2.5)).alias("spine"), (some & (main | within(1))).alias("one"), (some & (main | within(2))).alias("two"), within(2.5).alias("far"), some.alias("any_area"),
    )
    page = Window.partitionBy("page_id")
    n = {k: F.count_if(C(k)).over(page) for k in ("spine", "wide", "one", "two")}
    rule = (
        F.when((n["wide"] > 0) & F.lit(mode == "threshold"), "wide").when(n["spine"] > 0, "wide_near").when(n["wide"] > 1, "wide")
        .when(n["one"] > 0, "near").when(n["two"] > 0, "near_2").when(~C("any_area"), "wide").otherwise("near_2.5")
    )
    flag = {"wide_near": "spine", "wide": "wide", "near": "one", "near_2": "two", "near_2.5": "far"}
    kept = F.lit(False)
    for name, column in flag.items():
        kept = F.when(C("rule") == name, C(column)).otherwise(kept)
    return flags.withColumn("rule", rule).where(kept).select("page_id", "entity_id", "rule")


def corridor_seeds(doors: DataFrame, pad: float) -> DataFrame:
    """Points beside the longest row or column of entrance doors (page_id, ord, x, y, wide): wide ones if there are any, else all.

    Doors align in bins of 2 pads; the bin of the widest extent counts, rows before columns, then the earlier door.  Its first, mean and
    last place get a point 2.5 pads to either side; a single door gets one, 2 pads above it; unaligned doors give none.
    """
    some = F.count_if(F.coalesce("wide", F.lit(False))).over(Window.partitionBy("page_id")) > 0
    own = doors.withColumn("_some", some).where(~C("_some") | C("wide"))
    bin_of = lambda c: F.floor(C(c) / (2 * pad) + 0.5)
    axes = F.array(F.struct(F.lit("h").alias("axis"), bin_of("y").alias("bin")), F.struct(F.lit("v").alias("axis"), bin_of("x").alias("bin")))
    rows = own.select("*", F.inline(axes)).groupBy("page_id", "axis", "bin").agg(
        F.count("*").alias("n"), F.min("ord").alias("first"), *(f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max), ("mid", F.avg)))
    )
    span = F.when(C("axis") == "h", C("high_x") - C("low_x")).otherwise(C("high_y") - C("low_y"))
    best = rows.withColumn("span", span).where("n > 1 AND span > 0").groupBy("page_id").agg(F.min_by(F.struct(*rows.columns[1:]), F.struct(-C("span"), "axis", "first")).alias("b"))
    step = 2.5 * pad
    seed = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    beside = F.array(*(seed(C(f"b.{k}_x"), C("b.mid_y") + s) for k in ("low", "mid", "high") for s in (-step, step)))
    across = F.array(*(seed(C("b.mid_x") + s, C(f"b.{k}_y")) for k in ("low", "mid", "high") for s in (-step, step)))
    aligned = best.select("page_id", F.posexplode(F.when(C("b.axis") == "h", beside).otherwise(across)).alias("k", "p"))
    single = own.groupBy("page_id").agg(F.count("*").alias("n"), F.min("x").alias("x"), F.min("y").alias("y")).where("n = 1").select("page_id", F.lit(0).alias("k"), seed(C("x"), C("y") - 2 * pad).alias("p"))
    return aligned.unionByName(single).select("page_id", "k", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def prefix_numbers(lines: DataFrame) -> DataFrame:
    """Unit words that stand alone (page_id, ord, text, bbox), each with the nearest bare number to its right or below that no
    earlier word took; ties go to the earlier number.

    Only neighbours are paired, over grid cells; what follows is one ordered fold over a page's neighbouring pairs.
    """
    text = F.trim("text")
    words = lines.where(text.rlike(UNIT_WORD)).select("page_id", C("ord").alias("word_ord"), C("bbox").alias("a"))
    numbers = lines.where(text.rlike(UNIT_NUMBER)).select("page_id", C("ord").alias("number_ord"), C("bbox").alias("b"), F.upper(F.regexp_extract(text, UNIT_NUMBER, 1)).alias("unit"))
    size = F.greatest(C("a.width"), C("a.height"), F.lit(8.0))
    near = box_pairs(words.withColumn("reach", g.expand(C("a"), size * 3.5)), numbers, "reach", "b")
    side = lambda at, end: F.least(end(C("a")), end(C("b"))) - F.greatest(C("a")[at], C("b")[at])
    gap = lambda at, end: (C("b")[at] - end(C("a"))).between(size * -0.4, size * 3.5)
    right = (side("y", g.bottom) > size * 0.25) & gap("x", g.right)
    below = (side("x", g.right) > size * 0.25) & gap("y", g.bottom)
    square = lambda at, long: F.pow(C("b")[at] + C("b")[long] / 2 - C("a")[at] - C("a")[long] / 2, 2)
    pair = F.struct("word_ord", (square("x", "width") + square("y", "height")).alias("d"), "number_ord", "unit")
    pages = near.where(right | below).groupBy("page_id").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    start = F.slice(C("pairs"), 1, 0)
    taken = lambda acc, p: F.exists(acc, lambda k: (k["word_ord"] == p["word_ord"]) | (k["number_ord"] == p["number_ord"]))
    kept = F.aggregate("pairs", start, lambda acc, p: F.when(taken(acc, p), acc).otherwise(F.concat(acc, F.array(p))))
    return pages.select("page_id", F.inline(kept)).select("page_id", "word_ord", "number_ord", "unit")
