"""Units that no detector drew: labels matched to shapes one to one, and outlines around rooms that doors join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..workspace import stage
from .graph import room_clusters
from .rollup import number_units
from .spatial import box_pairs, of_type, unit_rooms

C = F.col


def assign_greedy(items: DataFrame, seeds: DataFrame, reach: float = 128.0, growth: float = 4.0) -> DataFrame:
    """Items (page_id, item_id, x, y) and seeds (page_id, seed_id, sx, sy) of each page matched one to one: page_id, item_id, seed_id, d2.

    The result is that of taking all pairs of a page by squared distance (ties: the smaller item, then the smaller seed) while both are free,
    but only neighbours are ever paired.  Within a reach, pairs over grid cells are matched in rounds: those go that are best for their
    item and for their seed alike.  When none is left, what is free tries a reach ``growth`` times as wide; any pair
    of the wider one comes later in the order.  Ids are unique; rows without a place or page take no part.
    """
    free_items = stage(items.select("page_id", "item_id", "x", "y").dropna(), "items")
    free_seeds = stage(seeds.select("page_id", "seed_id", "sx", "sy").dropna(), "seeds")
    matched = []
    while True:
        # Only pages where both sides have something left.
        free_items = stage(free_items.join(free_seeds.select("page_id").distinct(), "page_id", "left_semi"), "items")
        if free_items.isEmpty():
            break
        free_seeds = stage(free_seeds.join(free_items.select("page_id").distinct(), "page_id", "left_semi"), "seeds")
        at = lambda x, y, r: g.expand(g.box(C(x), C(y), F.lit(0.0), F.lit(0.0)), r)
        near = box_pairs(free_items.withColumn("ibox", at("x", "y", reach)), free_seeds.withColumn("sbox", at("sx", "sy", 0.0)), "ibox", "sbox", cell=4 * reach)
        d2 = (C("x") - C("sx")) * (C("x") - C("sx")) + (C("y") - C("sy")) * (C("y") - C("sy"))
        pairs = stage(near.select("page_id", "item_id", "seed_id", d2.alias("d2")).where(C("d2") <= reach * reach), "pairs")
        while not pairs.isEmpty():
            key = F.struct("d2", "item_id", "seed_id")
            best_item, best_seed = (pairs.groupBy(side).agg(F.min(key).alias("best")) for side in ("item_id", "seed_id"))
            both = best_item.select("best").intersect(best_seed.select("best")).select("best.*")
            found = stage(both.join(pairs.select("page_id", "item_id", "seed_id"), ["item_id", "seed_id"]), "matched")
            matched.append(found)
            for side in ("item_id", "seed_id"):
                pairs = pairs.join(found.select(side), side, "left_anti")
            pairs = stage(pairs, "pairs")
            free_items = free_items.join(found.select("item_id"), "item_id", "left_anti")
            free_seeds = free_seeds.join(found.select("seed_id"), "seed_id", "left_anti")
        free_seeds = stage(free_seeds, "seeds")
        reach *= growth
    out = items.select("page_id", "item_id").join(seeds.select("seed_id"), F.lit(False)).withColumn("d2", F.lit(0.0))
    for found in matched:
        out = found if found is matched[0] else out.unionByName(found)
    return out.select("page_id", "item_id", "seed_id", "d2")


def _half(points: Column) -> Column:
    """The chain below sorted points: of each new point's predecessors stay those from which it is a left turn.  Lines through later points of a
    convex chain are higher at the new point, so what stays is a beginning of the chain, and counting finds its end."""

    def left(a: Column, b: Column, p: Column) -> Column:
        return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]) > 0

    def add(chain: Column, p: Column) -> Column:
        kept = F.size(F.filter(chain, lambda b, i: (i > 0) & left(F.get(chain, i - 1), b, p)))
        return F.concat(F.slice(chain, F.lit(1), kept + 1), F.array(p))

    return F.aggregate(points, F.slice(points, 1, 0), add)


def hull(points: Column) -> Column:
    """The convex hull of points, from the leftmost (then topmost) one on, corners only; one or two points as they are."""
    own = F.array_sort(F.array_distinct(points))

    def of(p: Column) -> Column:
        there, back = _half(p), _half(F.reverse(p))
        open_ = lambda chain: F.slice(chain, F.lit(1), F.greatest(F.size(chain) - 1, F.lit(0)))
        return F.when(F.size(p) < 3, p).otherwise(F.concat(open_(there), open_(back)))

    return F.element_at(F.transform(F.array(own), of), 1)


def hulls(shapes: DataFrame, keys: list[str], salts: int = 16) -> DataFrame:
    """keys, hull: around the points of all shapes (keys, points) of a group.  Hulls of shapes are merged by hashes of shapes first, so a group of any size
    brings few points to one task."""
    one = shapes.select(*keys, hull(C("points")).alias("points"))
    of_all = F.when(F.size("all") == 1, F.get("all", F.lit(0))).otherwise(hull(F.flatten("all")))
    salted = one.groupBy(*keys, F.pmod(F.xxhash64("points"), F.lit(salts)).alias("_salt")).agg(F.collect_set("points").alias("all"))
    merged = salted.select(*keys, of_all.alias("points")).groupBy(*keys).agg(F.collect_list("points").alias("all"))
    return merged.select(*keys, of_all.alias("hull"))


def infer_units(entities: DataFrame, pad: float = 24.0) -> DataFrame:
    """H3: units around the private rooms that no detected unit holds: page_id, label, unit_id (the smallest room of its cluster), points, bbox,
    confidence, room_ids, entrance_ids, method.

    Private rooms are clustered over all doors but main doors (H2): a door joins the rooms whose boxes, padded, hold its centroid.  A cluster's free rooms
    become a unit with their convex hull as its outline, or the box around them if they lie on a line.  Its entrances are main doors and doors beside a shared
    area that stand at a room of the cluster.  Units are labelled from left to right by the mean of their rooms' centroids.  Pages
    without doors get none.
    """
    rooms = of_type(entities, "room")
    doors = of_type(entities, "door").withColumn("c", g.centroid(C("points"))).select("page_id", C("entity_id").alias("via_id"), t.is_main_door(C("label")).alias("main"), g.box(C("c.x"), C("c.y"), F.lit(0.0), F.lit(0.0)).alias("dbox"))
    beside = rooms.select("page_id", C("entity_id").alias("room_id"), t.is_common(C("label")).alias("shared"), g.expand(C("bbox"), pad).alias("rbox"))
    near = stage(box_pairs(doors, beside, "dbox", "rbox").select("page_id", "via_id", "main", "room_id", "shared"), "near")
    private = beside.where("NOT shared").select("page_id", "room_id")
    clusters = room_clusters(private, near.where("NOT shared AND NOT main").select("via_id", "room_id"))
    clusters = stage(clusters.join(doors.select("page_id").distinct(), "page_id", "left_semi"), "clusters")

    opens = near.where("main OR shared").select("via_id").distinct()
    entrances = near.where("NOT shared").join(opens, "via_id", "left_semi").join(clusters.select("room_id", "cluster"), "room_id").groupBy("cluster").agg(F.array_sort(F.collect_set("via_id")).alias("entrance_ids"))

    free = clusters.join(unit_rooms(entities).select("room_id").distinct(), "room_id", "left_anti")
    shapes = free.join(rooms.select(C("entity_id").alias("room_id"), "points", g.centroid(C("points")).alias("c"), "bbox"), "room_id")
    corners = g.rect_points(C("bbox.x"), C("bbox.y"), C("bbox.width"), C("bbox.height"))
    outline = F.when(F.size("points") > 0, C("points")).otherwise(corners)
    around = hulls(shapes.select("page_id", "cluster", outline.alias("points")), ["page_id", "cluster"])
    sums = shapes.groupBy("page_id", "cluster").agg(F.array_sort(F.collect_list("room_id")).alias("room_ids"), F.round(F.avg("c.x"), 6).alias("x"))
    box = g.bbox_of(C("hull"))
    flat = F.when(F.size("hull") < 3, g.rect_points(box["x"], box["y"], box["width"], box["height"])).otherwise(C("hull"))
    units = around.join(sums, ["page_id", "cluster"]).join(entrances, "cluster", "left").withColumn("ord", C("cluster"))
    return number_units(units).select(
        "page_id", "label", C("cluster").alias("unit_id"), flat.alias("points"), box.alias("bbox"), F.lit(0.55).alias("confidence"), "room_ids",
        F.coalesce("entrance_ids", F.slice("room_ids", 1, 0)).alias("entrance_ids"), F.lit("room_door_cluster").alias("method"),
    )
