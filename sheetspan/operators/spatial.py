"""Spatial joins between the regions of a page.

Regions have page_id, entity_id, ord, type, label, status, confidence, points and bbox.  Joins are
equi-joins on the page and a grid cell, so a page of very many regions spreads over its cells;
ties go to the smaller area or distance and then to the smaller ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t

C = F.col
CELL = 512.0


def _cells(df: DataFrame, box: str, cell: float) -> DataFrame:
    b = C(box)
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))
    return df.withColumn("gx", span(b["x"], g.right(b))).withColumn("gy", span(b["y"], g.bottom(b)))


def box_pairs(left: DataFrame, right: DataFrame, lbox: str, rbox: str, cell: float = CELL) -> DataFrame:
    """Rows of both tables, on one page, whose boxes touch (borders count).

    Every box is put into the cells that it covers; a pair is taken in the cell of the top left
    corner of its intersection only, so it comes out once.
    """
    corner = lambda k: F.floor(F.greatest(C(f"{lbox}.{k}"), C(f"{rbox}.{k}")) / cell)
    both = _cells(left, lbox, cell).join(_cells(right, rbox, cell), ["page_id", "gx", "gy"])
    return both.where(g.boxes_touch(C(lbox), C(rbox)) & (C("gx") == corner("x")) & (C("gy") == corner("y"))).drop("gx", "gy")


def of_type(entities: DataFrame, *types: str) -> DataFrame:
    return entities.where(C("type").isin(*types))


def _point_box(p: Column) -> Column:
    return g.box(p["x"], p["y"], F.lit(0.0), F.lit(0.0))


def _rooms(entities: DataFrame, pad: float = 0.0) -> DataFrame:
    """Rooms with their columns named for joins; rbox is padded."""
    return of_type(entities, "room").select(
        "page_id", C("entity_id").alias("room_id"), C("ord").alias("room_ord"), C("label").alias("room_label"), C("points").alias("room_points"),
        C("bbox").alias("room_box"), g.expand(C("bbox"), pad).alias("rbox"),
    )


def _first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def opening_room(entities: DataFrame, pad: float = 24.0) -> DataFrame:
    """Each door or window with the smallest room whose padded box holds its centroid."""
    openings = of_type(entities, "door", "window").withColumn("obox", _point_box(g.centroid(C("points")))).select("page_id", C("entity_id").alias("to_id"), "type", "obox")
    pairs = box_pairs(openings, _rooms(entities, pad), "obox", "rbox")
    area = F.greatest(g.box_area(C("room_box")), F.lit(1.0))
    best = _first(pairs, ["page_id", "to_id"], area, "room_ord")
    kind = F.when(C("type") == "door", "room_door_access").otherwise("room_window_access")
    return best.select("page_id", kind.alias("kind"), C("room_id").alias("from_id"), "to_id")


def fixture_room(entities: DataFrame) -> DataFrame:
    """Each fixture or stair with the smallest room whose polygon holds its centroid."""
    own = of_type(entities, "fixture", "stair").withColumn("c", g.centroid(C("points"))).withColumn("obox", _point_box(C("c"))).select("page_id", C("entity_id").alias("to_id"), "c", "obox")
    rooms = _rooms(entities).withColumn("rbox", g.bbox_of(C("room_points")))
    pairs = box_pairs(own, rooms, "obox", "rbox").where(g.point_in_poly(C("c.x"), C("c.y"), C("room_points")))
    best = _first(pairs, ["page_id", "to_id"], F.greatest(g.box_area(C("room_box")), F.lit(1.0)), "room_ord")
    return best.select("page_id", F.lit("room_contains_fixture").alias("kind"), C("room_id").alias("from_id"), "to_id")


def room_adjacency(entities: DataFrame, pad: float = 24.0) -> DataFrame:
    """Unordered pairs of rooms whose boxes, both padded, touch."""
    a = _rooms(entities, pad).select("page_id", C("room_id").alias("from_id"), C("room_ord").alias("ord_a"), C("rbox").alias("abox"))
    b = _rooms(entities, pad).select("page_id", C("room_id").alias("to_id"), C("room_ord").alias("ord_b"), C("rbox").alias("bbox"))
    return box_pairs(a, b, "abox", "bbox").where("ord_a < ord_b").select("page_id", F.lit("room_adjacency").alias("kind"), "from_id", "to_id")


def unit_rooms(entities: DataFrame, frac: float = 0.5) -> DataFrame:
    """Units and the rooms they contain, with the method: centroid in the unit's polygon, in its
    box, or an overlap of at least ``frac`` of the room.  Shared areas belong to no unit."""
    units = of_type(entities, "unit_boundary").select(
        "page_id", C("entity_id").alias("unit_id"), C("ord").alias("unit_ord"), C("label").alias("unit_label"), C("points").alias("unit_points"), C("bbox").alias("unit_box")
    )
    reach = units.withColumn("p", g.bbox_of(C("unit_points"))).withColumn(
        "ubox",
        g.box(
            F.least("p.x", "unit_box.x"), F.least("p.y", "unit_box.y"),
            F.greatest(g.right(C("p")), g.right(C("unit_box"))) - F.least("p.x", "unit_box.x"), F.greatest(g.bottom(C("p")), g.bottom(C("unit_box"))) - F.least("p.y", "unit_box.y"),
        ),
    )
    rooms = _rooms(entities).where(~t.is_common(C("room_label"))).withColumn("c", g.centroid(C("room_points")))
    rooms = rooms.withColumn("rbox", g.bbox_of(F.concat(C("room_points"), F.array(C("c")))))
    pairs = box_pairs(reach, rooms, "ubox", "rbox")
    method = (
        F.when(g.in_box(C("c.x"), C("c.y"), g.expand(C("p"), 1.0)) & g.point_in_poly(C("c.x"), C("c.y"), C("unit_points")), "polygon")
        .when(g.in_box(C("c.x"), C("c.y"), C("unit_box")), "box")
        .when(g.overlap_frac(C("room_box"), C("unit_box")) >= frac, "overlap")
    )
    # As rows of its own, the method is worked out once a pair.
    found = F.explode(F.array_compact(F.array(method))).alias("method")
    return pairs.select("page_id", "unit_id", "unit_ord", "unit_label", "room_id", "room_ord", "room_label", found)


def unit_label_assignment(entities: DataFrame, contained: DataFrame) -> DataFrame:
    """A row for each labelled unit itself and one for each of its rooms, with the unit's label."""
    own = of_type(entities, "unit_boundary").where("label IS NOT NULL AND label <> ''")
    self_rows = own.select("page_id", C("entity_id").alias("from_id"), C("entity_id").alias("to_id"), "label", F.lit("unit").alias("source"))
    rooms = contained.select("page_id", C("room_id").alias("from_id"), C("unit_id").alias("to_id"), F.coalesce("unit_label", F.lit("")).alias("label"), F.lit("unit_contains_room").alias("source"))
    return self_rows.unionByName(rooms)


def fused_relations(entities: DataFrame) -> DataFrame:
    """Room to its first containing unit, opening to every containing room, fixture to its
    first; containment is of the vertex mean in the polygon."""
    def held(inner: DataFrame, outer: DataFrame) -> DataFrame:
        i = inner.withColumn("m", g.vertex_mean(C("points"))).withColumn("ibox", _point_box(C("m"))).select("page_id", C("entity_id").alias("to_id"), "type", "m", "ibox")
        o = outer.select("page_id", C("entity_id").alias("from_id"), "ord", C("points").alias("around"), g.bbox_of(C("points")).alias("obox"))
        return box_pairs(i, o, "ibox", "obox").where(g.point_in_poly(C("m.x"), C("m.y"), C("around")))

    rooms, units = of_type(entities, "room"), of_type(entities, "unit_boundary")
    openings = held(of_type(entities, "door", "window"), rooms)
    kind = F.when(C("type") == "door", "room_door_access").otherwise("room_window_exterior")
    parts = [
        _first(held(rooms, units), ["page_id", "to_id"], "ord").withColumn("kind", F.lit("unit_contains_room")),
        openings.withColumn("kind", kind),
        _first(held(of_type(entities, "fixture"), rooms), ["page_id", "to_id"], "ord").withColumn("kind", F.lit("room_contains_fixture")),
    ]
    out = [p.select("page_id", "kind", "from_id", "to_id") for p in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def same_group(a: str, b: str) -> Column:
    """Whether two rooms are both shared, or of one unit id, or of one unit label."""
    x, y = C(a), C(b)
    same = lambda k: F.coalesce((x[k] != "") & (x[k] == y[k]), F.lit(False))
    return (x["is_common"] & y["is_common"]) | same("unit_id") | same("unit_label")


def room_nodes(entities: DataFrame, contained: DataFrame) -> DataFrame:
    """Rooms of the room graph: room_id, ord, label, is_common, unit_id and unit_label of the first unit that
    contains them, points, box."""
    unit = _first(contained, ["page_id", "room_id"], "unit_ord").select("page_id", "room_id", C("unit_id").cast("string").alias("unit_id"), "unit_label")
    rooms = of_type(entities, "room").select("page_id", C("entity_id").alias("room_id"), "ord", "label", t.is_common(C("label")).alias("is_common"), "points", "bbox")
    return rooms.join(unit, ["page_id", "room_id"], "left")


def shared_wall_edges(rooms: DataFrame, pad: float = 24.0) -> DataFrame:
    """Pairs of rooms of one group whose padded boxes overlap and whose rings are within pad."""
    group = F.struct("is_common", "unit_id", "unit_label")
    side = lambda p: rooms.select("page_id", C("room_id").alias(f"{p}_id"), C("ord").alias(f"{p}_ord"), group.alias(f"{p}_group"), C("points").alias(f"{p}_points"), g.expand(C("bbox"), pad / 2).alias(f"{p}box"))
    pairs = box_pairs(side("a"), side("b"), "abox", "bbox").where("a_ord < b_ord")
    near = pairs.where(same_group("a_group", "b_group") & g.boxes_overlap(C("abox"), C("bbox")))
    return near.where(g.min_ring_distance(C("a_points"), C("b_points")) <= pad).select("page_id", F.lit("shared_wall").alias("kind"), C("a_id").alias("from_id"), C("b_id").alias("to_id"))


def opening_edges(rooms: DataFrame, openings: DataFrame, pad: float = 24.0) -> DataFrame:
    """Windows with their nearest room within pad; doors join their two nearest rooms if those
    are of one group, else the nearest room and the door."""
    o = openings.withColumn("m", g.vertex_mean(C("points"))).select("page_id", C("entity_id").alias("via_id"), "type", "m", g.expand(_point_box(C("m")), pad).alias("obox"))
    r = rooms.select("page_id", "room_id", C("ord").alias("room_ord"), F.struct("is_common", "unit_id", "unit_label").alias("grp"), C("points").alias("ring"), g.bbox_of(C("points")).alias("rbox"))
    pairs = box_pairs(o, r, "obox", "rbox").withColumn("d", g.dist_to_ring(C("m.x"), C("m.y"), C("ring"))).where(C("d") <= pad)
    w = Window.partitionBy("page_id", "via_id").orderBy("d", "room_ord")
    ranked = pairs.withColumn("n", F.row_number().over(w)).where("n <= 2")
    two = ranked.groupBy("page_id", "via_id", "type").agg(
        F.max(F.when(C("n") == 1, F.struct("room_id", "grp"))).alias("one"), F.max(F.when(C("n") == 2, F.struct("room_id", "grp"))).alias("other")
    ).withColumn("g1", C("one.grp")).withColumn("g2", C("other.grp"))
    joined = (C("type") == "door") & C("other").isNotNull() & F.coalesce(same_group("g1", "g2"), F.lit(False))
    return two.select(
        "page_id",
        F.when(C("type") == "window", "exterior_window").when(joined, "door").otherwise("room_door").alias("kind"),
        C("one.room_id").alias("from_id"),
        F.when(joined, C("other.room_id")).otherwise(C("via_id")).alias("to_id"),
        "via_id",
    )


def nearest_seed(items: DataFrame, seeds: DataFrame, max_d2: float | None = None) -> DataFrame:
    """Each item (page_id, item_id, x, y) with its nearest seed (page_id, seed_id, seed_ord, sx, sy)."""
    d2 = (C("x") - C("sx")) * (C("x") - C("sx")) + (C("y") - C("sy")) * (C("y") - C("sy"))
    pairs = items.join(seeds, "page_id").withColumn("d2", d2)
    pairs = pairs if max_d2 is None else pairs.where(C("d2") <= max_d2)
    best = pairs.groupBy("page_id", "item_id").agg(F.min(F.struct("d2", "seed_ord", "seed_id")).alias("b"))
    return best.select("page_id", "item_id", "b.seed_id", "b.d2")


def seed_unit(seeds: DataFrame, units: DataFrame, reach: float = 1500.0) -> DataFrame:
    """Each seed (page_id, seed_id, sx, sy) with the smallest unit that contains it, else the
    unit of the nearest centroid within reach, else null."""
    u = units.select("page_id", C("entity_id").alias("unit_id"), "ord", "points", g.centroid(C("points")).alias("c"))
    inside = g.point_in_poly(C("sx"), C("sy"), C("points"))
    d = F.hypot(C("sx") - C("c.x"), C("sy") - C("c.y"))
    key = F.when(inside, F.struct(F.lit(0).alias("far"), g.poly_area(C("points")).alias("v"), C("ord"), C("unit_id"))).when(d <= reach, F.struct(F.lit(1).alias("far"), F.round(d, 6).alias("v"), C("ord"), C("unit_id")))
    best = seeds.join(u, "page_id", "left").groupBy("page_id", "seed_id").agg(F.min(key).alias("b"))
    return best.select("page_id", "seed_id", "b.unit_id", (C("b.far") == 0).alias("inside"))


def unit_rings(units: DataFrame) -> DataFrame:
    """Units with what ``unit_around`` asks of them: page_id, unit_id, ord, ring, ubox, area."""
    return units.select("page_id", C("entity_id").alias("unit_id"), "ord", C("points").alias("ring"), g.expand(g.bbox_of(C("points")), 1.0).alias("ubox"), g.poly_area(C("points")).alias("area"))


def unit_around(points: DataFrame, rings: DataFrame) -> DataFrame:
    """Points (page_id, id, x, y, more) with unit_id, the smallest unit that contains them, or null.

    All steps are dealt by page, so each table is shuffled once; outlines are walked only where their box holds the point."""
    around = (C("page_id") == C("ring_page")) & g.in_box(C("x"), C("y"), C("ubox")) & g.point_in_poly(C("x"), C("y"), C("ring"))
    held = points.join(rings.select(C("page_id").alias("ring_page"), "unit_id", C("ord").alias("unit_ord"), "ring", "ubox", "area"), around, "left")
    own = F.min(F.when(C("ring_page").isNotNull(), F.struct("area", "unit_ord", "unit_id")))["unit_id"].alias("unit_id")
    return held.groupBy("page_id", "id").agg(*(F.first(c).alias(c) for c in points.columns if c not in ("page_id", "id")), own)


def doors_on_shared_area(doors: DataFrame, regions: DataFrame, pad: float = 24.0) -> DataFrame:
    """Doors that are labelled main door or lie within pad of a shared area, on pages that have one."""
    d = doors.withColumn("m", g.vertex_mean(C("points"))).withColumn("obox", g.expand(_point_box(C("m")), pad))
    main = t.is_main_door(C("label"))
    r = regions.select("page_id", C("points").alias("ring"), g.bbox_of(C("points")).alias("rbox"))
    near = box_pairs(d.where(~main).select("page_id", "entity_id", "m", "obox"), r, "obox", "rbox").where(g.dist_to_ring(C("m.x"), C("m.y"), C("ring")) <= pad)
    named = d.where(main).join(regions.select("page_id").distinct(), "page_id", "left_semi")
    return named.select("page_id", "entity_id", F.lit("label").alias("reason")).unionByName(near.select("page_id", "entity_id", F.lit("near").alias("reason")).distinct())


def touches_external(rooms: DataFrame, walls: DataFrame, pad: float = 24.0) -> DataFrame:
    """Rooms whose centroid is within pad of an external wall's ring."""
    r = rooms.withColumn("c", g.centroid(C("points"))).select("page_id", "entity_id", "c", g.expand(_point_box(C("c")), pad).alias("obox"))
    w = walls.where(F.lower("label").contains("external")).select("page_id", C("points").alias("ring"), g.bbox_of(C("points")).alias("rbox"))
    return box_pairs(r, w, "obox", "rbox").where(g.dist_to_ring(C("c.x"), C("c.y"), C("ring")) <= pad).select("page_id", "entity_id").distinct()


def missing_windows(rooms: DataFrame, edges: DataFrame) -> DataFrame:
    """Habitable private rooms without an exterior window."""
    lit = edges.where("kind = 'exterior_window'").select("page_id", C("from_id").alias("room_id")).distinct()
    return rooms.where(t.is_habitable(C("label")) & ~C("is_common")).join(lit, ["page_id", "room_id"], "left_anti").select("page_id", "room_id", "label")


def on_tile_edge(box: Column, tile: Column, margin: float = 8.0) -> Column:
    """Whether a side of the box lies within margin of the same side of its tile; false without a tile."""
    near = (F.abs(box["x"] - tile["x"]) <= margin) | (F.abs(g.right(box) - g.right(tile)) <= margin) | (F.abs(box["y"] - tile["y"]) <= margin) | (F.abs(g.bottom(box) - g.bottom(tile)) <= margin)
    return F.coalesce((tile["width"] > 1) & (tile["height"] > 1) & near, F.lit(False))


def tile_matches(regions: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Pairs of one page, type and label that show one thing: IoU of at least ``threshold`` or
    intersection over the smaller of at least that, clamped to 0.3 to 0.5; or, at a seam, an overlap
    if one of them is on its tile's edge (so also IoS >= 0.08), or a touch if both are.  Regions carry
    the box of their tile as ``tile``; without that column, or where it is null, there is no seam."""
    edge = on_tile_edge(C("bbox"), C("tile")) if "tile" in regions.columns else F.lit(False)
    side = lambda p: regions.select("page_id", C("region_id").alias(p), C("type").alias(f"type_{p}"), C("label").alias(f"label_{p}"), C("bbox").alias(f"{p}box"), edge.alias(f"edge_{p}"))
    pairs = box_pairs(side("a"), side("b"), "abox", "bbox").where("a < b AND type_a = type_b AND label_a <=> label_b")
    a, b = C("abox"), C("bbox")
    smaller = min(0.5, max(0.3, threshold))
    seam = (C("edge_a") & C("edge_b")) | ((C("edge_a") | C("edge_b")) & (g.intersect_area(a, b) > 0))
    return pairs.where((F.round(g.iou(a, b), 9) >= threshold) | (F.round(g.ios(a, b), 9) >= smaller) | seam).select("page_id", "a", "b")
