"""Room names found in a page's text, put onto rooms.

Seeds are names in the text: page_id, seed_id, label, unit_id (null: none), x, y.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..workspace import stage
from .graph import components
from .spatial import box_pairs

C = F.col
#: Categories whose name must stand inside its room, what a place outside costs, and the most that a match may cost.
INSIDE = ("bedroom", "bathroom", "robe")
OUTSIDE, MOST = 4000.0, 6000.0


def _at(x: str, y: str) -> Column:
    return g.box(C(x), C(y), F.lit(0.0), F.lit(0.0))


def cluster_open_plan(seeds: DataFrame, units: DataFrame, cell: float = 160.0) -> DataFrame:
    """Seeds with those of open-plan names merged where they stand near one another: page_id, seed_id (the smallest), label, unit_id, x, y (means), merged.

    Two such names of one unit, or of none, are near within 16 % of the longer side of the unit's box (units: page_id, unit_id, points), 80 px at
    least and 160 at most, or 96 px without a unit; what is near to a near one belongs together, in whatever order.  A merged name lists the kinds of all.
    """
    own = seeds.withColumn("kinds", t.open_plan_kinds(C("label")))
    box = g.bbox_of(C("points"))
    radius = units.select("page_id", "unit_id", F.greatest(F.lit(80.0), F.least(F.lit(160.0), 0.16 * F.greatest(box["width"], box["height"]))).alias("radius"))
    open_ = stage(own.where(F.size("kinds") > 0).join(radius, ["page_id", "unit_id"], "left").withColumn("radius", F.coalesce("radius", F.lit(96.0))), "open-plan")
    side = lambda p: open_.select("page_id", C("seed_id").alias(p), C("unit_id").alias(f"unit_{p}"), C("x").alias(f"x_{p}"), C("y").alias(f"y_{p}"), "radius", g.expand(_at("x", "y"), C("radius") / 2).alias(f"box_{p}"))
    pairs = box_pairs(side("a"), side("b").drop("radius"), "box_a", "box_b", cell).where("a < b AND unit_a <=> unit_b")
    near = pairs.where(F.hypot(C("x_a") - C("x_b"), C("y_a") - C("y_b")) <= C("radius"))
    linked = components(near.select("a", "b"), node="seed_id", component="first")
    grouped = open_.join(linked, "seed_id", "left").groupBy("page_id", F.coalesce("first", "seed_id").alias("first")).agg(
        F.min_by("label", "seed_id").alias("label"), F.min_by("unit_id", "seed_id").alias("unit_id"), F.array_distinct(F.flatten(F.collect_set("kinds"))).alias("kinds"),
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("merged"),
    )
    name = F.when(C("merged") > 1, t.open_plan_label(C("kinds"))).otherwise(C("label"))
    merged = grouped.select("page_id", C("first").alias("seed_id"), name.alias("label"), "unit_id", "x", "y", "merged")
    return own.where(F.size("kinds") == 0).select("page_id", "seed_id", "label", "unit_id", "x", "y", F.lit(1).cast("long").alias("merged")).unionByName(merged)


def label_rooms_from_text(rooms: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds matched to rooms (page_id, room_id, ord, label, unit_id, points), one to one: page_id, seed_id, room_id, label (the room's new one), unit_id.

    Seeds take their turn by page, those with a number in their label first, then by label, then by id.  Each looks for the free room of least cost: the
    distance to the room's centroid, and 4000 more from outside (ties: the smaller ord).  Seeds of a unit look at its rooms only; bedrooms, bathrooms and robes only at the
    room that they stand in; a cost over 6000 is none.  The room takes the name if its own one is generic or of the same
    category or both are open-plan, and then lists both; else the seed is left without.  One ordered fold goes over the seeds of a page.
    """
    generic = lambda c: F.lower(F.trim(c)).isin("room", "space", "area") | F.lower(F.trim(c)).startswith("room ")
    turn = F.struct(F.when(C("label").rlike(r"\b\d+\b"), 0).otherwise(1).alias("plain"), C("label").alias("name"), "seed_id", C("said.kinds").alias("kinds"))
    s = seeds.withColumn("said", t.room_said(C("label"))).select("page_id", turn.alias("turn"), C("unit_id").alias("seed_unit"), "x", "y", "said.category")
    r = rooms.withColumn("said", t.room_said(C("label"))).select(
        "page_id", "room_id", C("ord").alias("room_ord"), C("unit_id").alias("room_unit"), "points", g.centroid(C("points")).alias("c"), g.expand(g.bbox_of(C("points")), 1.0).alias("rbox"),
        C("said.category").alias("old_category"), C("said.kinds").alias("old_kinds"), generic(C("label")).alias("generic"),
    )
    # Seeds and rooms meet by page, as the fold needs them; what is cheap to test comes first.
    own_unit = C("seed_unit").isNull() | F.coalesce(C("seed_unit") == C("room_unit"), F.lit(False))
    around = g.in_box(C("x"), C("y"), C("rbox"))
    pairs = s.join(r, "page_id").where(own_unit & (around | ~C("category").isin(*INSIDE)))
    away = F.hypot(C("x") - C("c.x"), C("y") - C("c.y"))
    cost = F.round(F.when(around & g.point_in_poly(C("x"), C("y"), C("points")), away).when(~C("category").isin(*INSIDE), away + OUTSIDE), 6)
    together = (F.size("turn.kinds") > 0) & (F.size("old_kinds") > 0)
    fits = C("generic") | (C("category") == C("old_category")) | together
    option = F.struct("cost", "room_ord", "room_id", fits.alias("fits"), F.when(together, C("old_kinds")).alias("kinds"), F.coalesce("room_unit", "seed_unit").alias("unit_id"))
    found = pairs.withColumn("cost", cost).where(C("cost") <= MOST)
    options = found.groupBy("page_id", "turn").agg(F.sort_array(F.collect_list(option)).alias("options"))
    pages = options.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("turn", "options"))).alias("seeds"))

    def take(kept: Column, seed: Column) -> Column:
        free = F.get(F.filter(seed["options"], lambda o: ~F.exists(kept, lambda k: k["o"]["room_id"] == o["room_id"])), F.lit(0))
        return F.when(free["fits"], F.concat(kept, F.array(F.struct(seed["turn"].alias("turn"), free.alias("o"))))).otherwise(kept)

    none = F.transform(F.slice("seeds", 1, 0), lambda x: F.struct(x["turn"].alias("turn"), x["options"][0].alias("o")))
    out = pages.select("page_id", F.inline(F.aggregate("seeds", none, take)))
    label = F.when(C("o.kinds").isNotNull(), F.coalesce(t.open_plan_label(F.array_union("turn.kinds", "o.kinds")), C("turn.name"))).otherwise(C("turn.name"))
    return out.select("page_id", "turn.seed_id", "o.room_id", label.alias("label"), "o.unit_id")


def text_anchor_rooms(seeds: DataFrame, matched: DataFrame, rooms: DataFrame, radius: float = 36.0) -> DataFrame:
    """Squares for the seeds of a unit that no room took: page_id, seed_id, label, unit_id, points, area.

    An open-plan seed that stands in an open-plan room of its unit, names that J12 gave counting, needs none."""
    left = seeds.where(C("unit_id").isNotNull()).join(matched.select("seed_id"), "seed_id", "left_anti")
    now = rooms.join(matched.select("room_id", C("label").alias("new"), C("unit_id").alias("new_unit")), "room_id", "left")
    plan = now.where(F.size(t.open_plan_kinds(F.coalesce("new", "label"))) > 0).select("page_id", F.coalesce("new_unit", "unit_id").alias("room_unit"), "points", g.bbox_of(C("points")).alias("rbox"))
    open_ = left.where(F.size(t.open_plan_kinds(C("label"))) > 0).select("page_id", "seed_id", "unit_id", "x", "y", _at("x", "y").alias("sbox"))
    covered = box_pairs(open_, plan, "sbox", "rbox").where((C("unit_id") == C("room_unit")) & g.point_in_poly(C("x"), C("y"), C("points"))).select("seed_id").distinct()
    square = g.rect_points(C("x") - radius, C("y") - radius, F.lit(2 * radius), F.lit(2 * radius))
    return left.join(covered, "seed_id", "left_anti").select("page_id", "seed_id", "label", "unit_id", square.alias("points"), F.lit(4 * radius * radius).alias("area"))
