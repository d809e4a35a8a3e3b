"""Buildings, floors, units, rooms and objects of annotated pages as one table, and the scale that a page's text states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..workspace import stage
from .spatial import box_pairs, of_type

C = F.col
NODE = ("page_id", "kind", "node_id", "parent_id", "unit_id", "label", "area_m2", "rooms", "bedrooms", "bathrooms", "confidence")


def _named(label: Column, default) -> Column:
    return F.coalesce(F.when(label != "", label), F.lit(default) if isinstance(default, str) else default)


def _nodes(df: DataFrame, kind: str, **values: Column) -> DataFrame:
    kinds = {"rooms": "long", "bedrooms": "long", "bathrooms": "long", "area_m2": "double", "confidence": "double"}
    values = {"kind": F.lit(kind), "page_id": C("page_id"), **values}
    return df.select(*(values.get(c, F.lit(None)).cast("long" if c == "page_id" else kinds.get(c, "string")).alias(c) for c in NODE))


def units_of_rooms(rooms: DataFrame, units: DataFrame) -> DataFrame:
    """The unit of each private room: that of its attribute ``unit_ref``, else the first whose number is that of ``unit_text``, else
    the first whose outline holds its centre, else the one that covers most of its box, half at least.  Rooms without any are left out."""
    private = rooms.where(~C("common"))
    found = lambda df, place, share: df.select("page_id", "room_id", "unit_id", F.struct(place.alias("place"), share.alias("share"), C("unit_ord")).alias("by"))
    key = t.unit_key(C("unit_text"))
    by_id = found(private.where("unit_ref IS NOT NULL").join(units, (private["unit_ref"] == C("unit_id")) & (private["page_id"] == units["page_id"])).drop(units["page_id"]), F.lit(1), F.lit(0.0))
    by_text = found(private.where(key != "").withColumn("key", key).join(units, ["page_id", "key"]), F.lit(2), F.lit(0.0))
    centre = private.where(F.size("room_points") > 0).withColumn("c", g.centroid(C("room_points")))
    centre = centre.withColumn("reach", g.bbox_of(F.concat("room_points", F.array("c"))))
    # An outline is walked only where its box holds the centre.
    held = g.in_box(C("c.x"), C("c.y"), g.expand(C("unit_box"), 1.0)) & g.point_in_poly(C("c.x"), C("c.y"), C("unit_points"))
    share = g.overlap_frac(C("room_box"), C("unit_box"))
    near = box_pairs(units, centre.drop("unit_text"), "unit_box", "reach").withColumn("held", held).withColumn("part", share).where("held OR part >= 0.5")
    by_place = found(near, F.when(C("held"), 3).otherwise(4), F.when(C("held"), 0.0).otherwise(-C("part")))
    return by_id.unionByName(by_text).unionByName(by_place).groupBy("page_id", "room_id").agg(F.min_by("unit_id", "by").alias("unit_id"))


def rooms_of_objects(objects: DataFrame, rooms: DataFrame) -> DataFrame:
    """The smallest room, then the first, whose outline (its box, under three points) holds the centre of an object; objects in none are left out."""
    at = objects.where(F.size("points") > 0).withColumn("c", g.centroid(C("points"))).select("page_id", C("entity_id").alias("object_id"), "c", g.box(C("c.x"), C("c.y"), F.lit(0.0), F.lit(0.0)).alias("at"))
    pairs = box_pairs(at, rooms.select("page_id", "room_id", "room_ord", "room_points", "room_box"), "at", "room_box")
    inside = F.when(F.size("room_points") >= 3, g.point_in_poly(C("c.x"), C("c.y"), C("room_points"))).otherwise(True)
    return pairs.where(inside).groupBy("page_id", "object_id").agg(F.min_by("room_id", F.struct(g.box_area(C("room_box")), "room_ord")).alias("room_id"))


def hierarchy(entities: DataFrame, pages: DataFrame) -> DataFrame:
    """One row for each floor, unit, room and object of the pages that are floor plans; rejected regions do not count.

    pages: page_id, building_id, is_floor_plan (null: yes), ppm.  entities also have unit_ref and unit_text, a room's unit as its attributes name
    it, and printed_m2, its printed size; any of them may be null.  Shared rooms have no unit.  A page without units gets one fallback unit
    that holds its private rooms, with their areas' sum where there is a scale; objects take the unit of their room from detected units only.
    """
    plans = pages.where(F.coalesce("is_floor_plan", F.lit(True)))
    own = entities.where(~C("status").eqNullSafe("rejected")).join(plans.select("page_id", "ppm"), "page_id")
    # Units, rooms and objects are read several times, so each is written once.
    units = stage(of_type(own, "unit_boundary").select(
        "page_id", C("entity_id").alias("unit_id"), C("ord").alias("unit_ord"), _named(C("label"), "Unit").alias("unit_label"), C("points").alias("unit_points"), g.bbox_of(C("points")).alias("unit_box"),
        C("confidence").alias("unit_confidence"), "ppm",
    ).withColumn("key", t.unit_key(C("unit_label"))), "units")
    rooms = stage(of_type(own, "room").select(
        "page_id", C("entity_id").alias("room_id"), C("ord").alias("room_ord"), _named(C("label"), "Room").alias("room_label"), C("points").alias("room_points"), g.bbox_of(C("points")).alias("room_box"),
        t.is_common(C("label")).alias("common"), "unit_ref", "unit_text", C("confidence").alias("room_confidence"),
        F.coalesce("printed_m2", g.area_m2(g.poly_area(C("points")), C("ppm"))).alias("room_m2"),
    ), "rooms")
    placed = stage(units_of_rooms(rooms, units.drop("ppm", "unit_confidence")), "placed")
    with_units = units.select("page_id").distinct().withColumn("detected", F.lit(True))
    fallback = F.concat(F.lit("unit-fallback-"), C("page_id"))
    unit = F.when(C("common"), None).when(C("detected"), C("unit_id").cast("string")).otherwise(fallback)
    homes = rooms.join(placed, ["page_id", "room_id"], "left").join(with_units, "page_id", "left").withColumn("unit", unit)

    low = F.lower("room_label")
    bath = low.contains("bath") | low.contains("ensuite") | low.contains("toilet")
    counts = homes.where("unit IS NOT NULL").groupBy("page_id", "unit").agg(
        F.count("*").alias("n"), F.count_if(low.contains("bed")).alias("beds"), F.count_if(bath).alias("baths"), F.sum("room_m2").alias("m2")
    )
    stats = {"rooms": F.coalesce("n", F.lit(0)), "bedrooms": F.coalesce("beds", F.lit(0)), "bathrooms": F.coalesce("baths", F.lit(0))}
    floor_id = F.concat(F.lit("floor-"), C("page_id"))
    sized = units.withColumn("unit", C("unit_id").cast("string")).join(counts, ["page_id", "unit"], "left")
    area = F.round(g.area_m2(g.poly_area(C("unit_points")), C("ppm")), 6)
    detected = _nodes(sized, "unit", node_id=C("unit"), parent_id=floor_id, unit_id=C("unit"), label=C("unit_label"), area_m2=area, confidence=C("unit_confidence"), **stats)
    bare = plans.join(with_units, "page_id", "left_anti").join(counts, "page_id", "left")
    total = F.round(F.when((C("ppm") > 0) & (C("m2") != 0), C("m2")), 6)
    assumed = _nodes(bare, "unit", node_id=fallback, parent_id=floor_id, unit_id=fallback, label=F.lit("Unit 1"), area_m2=total, confidence=F.lit(0.5), **stats)
    held = rooms.groupBy("page_id").agg(F.count("*").alias("n"))
    floors = _nodes(plans.join(held, "page_id", "left"), "floor", node_id=floor_id, parent_id=C("building_id"), rooms=stats["rooms"])
    room_rows = _nodes(homes, "room", node_id=C("room_id"), parent_id=F.coalesce("unit", floor_id), unit_id=C("unit"), label=C("room_label"), area_m2=F.round("room_m2", 6), confidence=C("room_confidence"))
    objects = stage(of_type(own, "door", "window", "fixture", "stair").select("page_id", "entity_id", "type", "label", "confidence", "points"), "objects")
    where = rooms_of_objects(objects, rooms).join(placed, ["page_id", "room_id"], "left").withColumnRenamed("object_id", "entity_id")
    things = objects.select("page_id", "entity_id", "type", "label", "confidence").join(where, ["page_id", "entity_id"], "left")
    object_rows = _nodes(things, "object", node_id=C("entity_id"), parent_id=F.coalesce(C("room_id").cast("string"), floor_id), unit_id=C("unit_id"), label=_named(C("label"), C("type")), confidence=C("confidence"))
    return floors.unionByName(detected).unionByName(assumed).unionByName(room_rows).unionByName(object_rows)


def _side(df: DataFrame, p: str) -> DataFrame:
    return df.select("page_id", *(C(c).alias(f"{p}_{c}") for c in df.columns if c != "page_id"))


def nearby(a: DataFrame, b: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Pairs of tokens (page_id, at, bbox or null, more) of a page: gaps of at most 12 heights across and 5 down, or two places apart in
    the list where a box is missing.  Columns come with the prefix of their side."""
    one, two = _side(a, left), _side(b, right)
    x, y = C(f"{left}_bbox"), C(f"{right}_bbox")

    def wide(box: Column) -> Column:
        h = F.greatest(box["height"], F.lit(10.0))
        return g.box(box["x"] - h * 12, box["y"] - h * 5, box["width"] + h * 24, box["height"] + h * 10)

    h = F.greatest(x["height"], y["height"], F.lit(10.0))
    across = F.greatest(F.lit(0.0), x["x"] - g.right(y), y["x"] - g.right(x)) <= h * 12
    down = F.greatest(F.lit(0.0), x["y"] - g.bottom(y), y["y"] - g.bottom(x)) <= h * 5
    boxed = box_pairs(one.where(x.isNotNull()).withColumn("lbox", wide(x)), two.where(y.isNotNull()).withColumn("rbox", wide(y)), "lbox", "rbox").where(across & down).drop("lbox", "rbox")
    steps = F.explode(F.array(*(C(f"{left}_at") + k for k in range(-2, 3))))
    listed = one.withColumn("_at", steps).join(two.withColumn("_at", C(f"{right}_at")), ["page_id", "_at"]).where(x.isNull() | y.isNull()).drop("_at")
    return boxed.unionByName(listed)


def scale_of_page(lines: DataFrame) -> DataFrame:
    """The scale that a page's lines (page_id, ord, text, confidence, bbox or null) state, with where it was read: the first line with ratio and
    paper ("line"), else the best pair of a ratio and a paper near each other ("pair": 20 with "scale" in or near one of them, else 8,
    plus both confidences, less a 40th of the distance or the places between them), else the best ratio ("ratio"), those in or near "scale"
    first.  Ties go to the earlier line; pages without a ratio are left out; null texts say nothing."""
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("ord"))
    text = F.coalesce("text", F.lit(""))
    said = lines.select(
        "page_id", place.alias("at"), "bbox", F.coalesce("confidence", F.lit(0.0)).alias("conf"), F.lower(text).contains("scale").alias("named"), t.read_scale(text).alias("s")
    )
    read = said.select("page_id", "at", "bbox", "conf", "named", "s.ratio", "s.paper", "s.both").where("named OR ratio IS NOT NULL OR paper IS NOT NULL")
    read = stage(read, "scales")
    words = read.where("named").select("page_id", "at", "bbox")
    tokens = read.where("ratio IS NOT NULL OR paper IS NOT NULL")
    labelled = nearby(tokens.select("page_id", "at", "bbox"), words).select("page_id", C("a_at").alias("at")).distinct().withColumn("labelled", F.lit(True))
    tokens = stage(tokens.join(labelled, ["page_id", "at"], "left").withColumn("labelled", C("named") | C("labelled").isNotNull()), "tokens")
    ratios, papers = tokens.where("ratio IS NOT NULL"), tokens.where("paper IS NOT NULL")
    middle = lambda p, a, s: C(f"{p}_bbox")[a] + C(f"{p}_bbox")[s] / 2
    apart = F.sqrt(F.pow(middle("a", "x", "width") - middle("b", "x", "width"), 2) + F.pow(middle("a", "y", "height") - middle("b", "y", "height"), 2)) / 40
    score = F.when(C("a_labelled") | C("b_labelled"), 20.0).otherwise(8.0) + C("a_conf") + C("b_conf") - F.coalesce(apart, F.abs(C("a_at") - C("b_at")).cast("double"))
    found = lambda df, n, rank, ratio, paper, source: df.select("page_id", F.struct(F.lit(n).alias("n"), *(r.cast("double").alias(f"k{i}") for i, r in enumerate(rank)), ratio.alias("ratio"), paper.alias("paper"), F.lit(source).alias("source")).alias("b"))
    zero = F.lit(0.0)
    line = found(tokens.where("both AND ratio IS NOT NULL AND paper IS NOT NULL"), 1, [C("at"), zero, zero, zero], C("ratio"), C("paper"), "line")
    pair = found(nearby(ratios, papers), 2, [-F.round(score, 9), C("a_at"), C("b_at"), zero], C("a_ratio"), C("b_paper"), "pair")
    alone = found(ratios, 3, [(~C("labelled")).cast("int"), (~C("named")).cast("int"), -C("conf"), C("at")], C("ratio"), F.lit(None).cast("string"), "ratio")
    best = line.unionByName(pair).unionByName(alone).groupBy("page_id").agg(F.min("b").alias("b"))
    return best.select("page_id", "b.ratio", "b.paper", F.concat(F.lit("1:"), C("b.ratio"), F.coalesce(F.concat(F.lit(" @ "), C("b.paper")), F.lit(""))).alias("declared"), "b.source")
